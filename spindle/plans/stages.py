"""Stages from a raw link to a resource row, as DataFrame -> DataFrame steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions import fixed, urls

Hook = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class CrawlConfig:
    """[C5-C7] Options with their defaults; hooks run in order, and a hook drops a row by filtering it."""

    local_root: str = "out"
    local_source_root: str | None = None
    max_depth: int = 1
    concurrency: int = 12
    min_concurrency: int = 4
    keep_search: bool = False
    strip_search_for_dedupe: bool = True
    skip_bad_links: bool = True
    redirects: int = 15
    retry_limit: int = 25
    max_retry_after_ms: int = 60_000
    period_seconds: int = 60
    incomplete_marker: str = "</html>"
    rules: list | None = None
    link_redirect: tuple[Hook, ...] = ()
    detect_type: tuple[Hook, ...] = ()
    save_path: tuple[Hook, ...] = ()
    before_download: tuple[Hook, ...] = ()
    after_download: tuple[Hook, ...] = ()
    init: tuple[Callable, ...] = ()
    dispose: tuple[Callable, ...] = ()
    meta: dict = field(default_factory=dict)

    def checked(self) -> CrawlConfig:
        if not self.local_root:
            raise ValueError("local_root is needed")
        return replace(self, concurrency=self.concurrency if self.concurrency >= 1 else 12, local_root=self.local_root.replace("\\", "/"))

    def merged(self, **overrides) -> CrawlConfig:
        return replace(self, **{**overrides, "meta": {**self.meta, **overrides.get("meta", {})}}).checked()


def weak_assign(target: dict, source: dict) -> dict:
    """[C2] Fills only keys that are absent."""
    return {**source, **target}


def apply_hooks(df: DataFrame, hooks) -> DataFrame:
    return reduce(DataFrame.transform, hooks, df)


# [F2-F6] adapters: column builders become hooks
def skip_when(condition) -> Hook:
    return lambda df: df.filter(~F.coalesce(condition, F.lit(False)))


def discard_when(condition) -> Hook:
    return lambda df: df.withColumn("discard", F.col("discard") | F.coalesce(condition, F.lit(False)))


def redirect_request(link) -> Hook:
    return lambda df: df.withColumn("download_link", F.when(F.col("download_link") == "", F.lit("")).otherwise(link)).filter(F.coalesce(F.col("download_link"), F.lit("")) != "")


def redirect_filter(link) -> Hook:
    return lambda df: df.withColumn("redirected_url", F.nullif(link, F.lit("")))


def create_resources(found: DataFrame, cfg: CrawlConfig) -> DataFrame:
    """[P1, P2, P5-P7, P11] Rows (raw_url, type, ref_url, ref_save_path, ...) become resources.

    Adds url, download_link, save_path, replace_path, host, discard, error. Links that can't be resolved keep
    their text as replacement and are discarded, or fail the page if ``skip_bad_links`` is off.
    """
    df = apply_hooks(found.withColumn("discard", F.lit(False)), cfg.link_redirect)
    df = df.filter((F.coalesce(F.col("raw_url"), F.lit("")) != "") & urls.is_followed(F.col("raw_url")))
    df = apply_hooks(df.withColumn("type", urls.detect_type(F.col("raw_url"), F.col("type"))), cfg.detect_type)
    full = urls.resolve(F.col("raw_url"), F.col("ref_url"))
    if cfg.local_source_root:
        full = F.when(F.col("ref_url").startswith("file:"), urls.resolve_file(F.col("raw_url"), F.col("ref_url"), cfg.local_source_root)).otherwise(full)
    df = df.withColumn("_full", full).withColumn("_bad", (F.col("_full") == "") | urls.bad_protocol(F.col("_full"), F.col("ref_url")))
    df = df.withColumn("save_path", F.when(F.col("_bad"), F.col("raw_url")).otherwise(urls.save_path(F.col("_full"), F.col("type"), cfg.keep_search, cfg.local_source_root)))
    df = apply_hooks(df, cfg.save_path).filter(F.col("save_path").isNotNull())
    relative = urls.tidy_replacement(urls.relative_path(F.col("save_path"), F.col("ref_save_path"), F.col("_full")))
    if not cfg.skip_bad_links:
        df = df.withColumn("_bad", F.when(F.col("_bad"), F.raise_error(F.concat(F.lit("unsupported link "), F.col("raw_url"))).cast("boolean")).otherwise(F.lit(False)))
    df = df.select(
        *[c for c in df.columns if c not in ("_full", "_bad", "discard")],
        F.when(F.col("_bad"), F.col("raw_url")).otherwise(urls.stored_url(F.col("_full"), cfg.keep_search)).alias("url"),
        F.when(F.col("_bad"), F.col("raw_url")).otherwise(urls.download_link(F.col("_full"))).alias("download_link"),
        F.when(F.col("_bad"), F.col("raw_url")).otherwise(relative).alias("replace_path"),
        urls.hostname(F.col("_full")).alias("host"),
        (F.col("discard") | F.col("_bad")).alias("discard"),
        F.when(F.col("_bad"), F.lit("unsupported link")).alias("error"),
    )
    return apply_hooks(df, cfg.before_download)


def fetched(frontier: DataFrame, pages: DataFrame, cfg: CrawlConfig) -> DataFrame:
    """[S3, P8, R1] Bodies from a corpus by dedupe key; discarded and streamed rows aren't asked for.

    Which page answers a key is chosen without bodies, among keys of the frontier only; then just those bodies are read.
    """
    key = lambda c: urls.dedupe_key(F.col(c), cfg.strip_search_for_dedupe)
    asked = frontier.filter(~F.col("discard") & (F.col("type") != fixed.STREAMING)).withColumn("_k", key("url"))
    chosen = pages.select(key("url").alias("_k"), "page_id").join(asked.select("_k"), "_k", "left_semi").groupBy("_k").agg(F.min("page_id").alias("page_id"))
    bodies = pages.select(F.col("page_id").alias("_p"), F.col("html").alias("body")).join(chosen, F.col("_p") == F.col("page_id")).select("_k", "page_id", "body").groupBy("_k").agg(F.first("page_id").alias("page_id"), F.first("body").alias("body"))
    return asked.join(bodies, "_k", "left").select(*frontier.columns, "page_id", "body")


def first_bodies(df: DataFrame, *bodies: str) -> DataFrame:
    """[P8] The first handler that yields a body wins; rows without one are discarded."""
    return df.withColumn("body", F.coalesce(*map(F.col, bodies))).filter("body is not null")


def incomplete_html(pages: DataFrame, marker: str = "</html>") -> DataFrame:
    """[S3b]"""
    return pages.withColumn("incomplete", ~F.contains(F.coalesce(F.col("html"), F.lit("")), F.lit(marker)))
