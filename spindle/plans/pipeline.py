"""The stages as one object, which hooks may call, and the default chain."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions import css, fixed, urls
from spindle.operators import markup
from spindle.plans.stages import CrawlConfig, create_resources, fetched


#: Characters after which a piece of transformed pages is handed back.
PIECE = 1 << 20


def wrap_save_path(make) -> object:
    """[P4] A column builder (row's columns -> path) as a save-path hook; a null path drops the row."""
    return lambda df: df.withColumn("save_path", make(df))


def html_transform(make) -> object:
    """[X12] A function from page text to page text as a hook on bodies of HTML rows.

    Of a batch (10,000 pages or 64 MB in Spark) only one page and the results of ``PIECE`` characters are Python's own.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made, size = [], 0
            for page in batch:
                made.append(make(page.as_py()) if page.is_valid else None)
                size += len(made[-1] or "")
                if size >= PIECE:
                    yield pa.array(made, pa.string())
                    made, size = [], 0
            if made:
                yield pa.array(made, pa.string())

    return lambda df: df.withColumn("body", F.when(F.col("type") == fixed.HTML, run(F.col("body").cast("string"))).otherwise(F.col("body").cast("string")))


def after_chain(df: DataFrame, handlers) -> tuple[DataFrame, DataFrame | None]:
    """[P9] Handlers in order; each returns rows, or rows and links found in them, which are gathered."""
    children = None
    for handler in handlers:
        out = handler(df)
        df, more = out if isinstance(out, tuple) else (out, None)
        if more is not None:
            children = more if children is None else children.unionByName(more)
    return df, children


#: [P13] Columns that a row keeps when it is handed on.
CLONED = ("url", "raw_url", "ref_url", "save_path", "replace_path", "download_link", "type", "depth", "host", "body", "headers", "redirected_url", "redirected_save_path", "error")


def clone(df: DataFrame) -> DataFrame:
    """[P13]"""
    return df.select(*[c for c in CLONED if c in df.columns])


def normalise(df: DataFrame) -> DataFrame:
    """[P14] Rebuilds what derives from a row's URL and times: host, wait_ms (asked to begun) and download_ms (begun to done)."""
    ms = lambda a, b: F.unix_millis(F.col(b)) - F.unix_millis(F.col(a))
    return df.withColumn("host", urls.hostname(F.col("url"))).withColumn("wait_ms", ms("created", "begun")).withColumn("download_ms", ms("begun", "done"))


def children(level: DataFrame, rules=None) -> DataFrame:
    """[X1, X6-X10] Links (key, raw_url, type, ordinal) of the bodies of a level: pages, style sheets, SVG and sitemaps."""
    have = level.filter(F.col("body").isNotNull())
    of = lambda *kinds: have.filter(F.col("type").isin(*kinds)).select("key", "url", F.col("body").cast("string").alias("body"))
    pages = markup.extract_links(of(fixed.HTML), "key", "url", "body", rules=rules).select("key", "raw_url", "type", "ordinal")
    images = markup.extract_links(of(fixed.SVG), "key", "url", "body", svg=True).select("key", "raw_url", "type", "ordinal")
    listed = lambda rows, found, kind: rows.select("key", F.posexplode(found).alias("ordinal", "raw_url")).select("key", "raw_url", F.lit(kind).cast("int").alias("type"), "ordinal")
    sheets = listed(of(fixed.CSS), css.css_urls_distinct(F.col("body")), fixed.BINARY)
    maps = listed(of(fixed.SITEMAP), markup.sitemap_urls(F.col("body")), fixed.HTML)
    return pages.unionByName(images).unionByName(sheets).unionByName(maps)


@dataclass(frozen=True)
class Pipeline:
    """[P15, P16] The default stages bound to a configuration; a hook that holds it can run any of them itself."""

    cfg: CrawlConfig

    def create(self, found: DataFrame) -> DataFrame:
        return create_resources(found, self.cfg)

    def fetch(self, frontier: DataFrame, corpus: DataFrame) -> DataFrame:
        return fetched(frontier, corpus, self.cfg)

    def after(self, level: DataFrame) -> tuple[DataFrame, DataFrame]:
        level, more = after_chain(level, self.cfg.after_download)
        found = children(level, self.cfg.rules)
        return level, found if more is None else found.unionByName(more)

    def key(self, link: Column) -> Column:
        return urls.dedupe_key(link, self.cfg.strip_search_for_dedupe)
