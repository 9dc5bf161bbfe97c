"""What a request's outcome means for its row: responses, retries, redirects, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions import fixed, urls
from spindle.plans.stages import CrawlConfig, apply_hooks, create_resources


def request_link(link: Column, ref_url: Column) -> Column:
    """[S3a, U16] (link, referer) of a request: the link normalised, the referer only where another page refers to it."""
    return F.struct(urls.normal_uri(link).alias("link"), F.when(ref_url != link, ref_url).alias("referer"))


def respond(answered: DataFrame, cfg: CrawlConfig) -> DataFrame:
    """[S3a] Rows with status_code, response_url and body: 304 discards the row; another URL than asked for is a redirect.

    Adds redirected_url and redirected_save_path, null where nothing was redirected. Empty bodies stay as no body.
    """
    moved = F.coalesce(F.col("response_url") != F.col("url"), F.lit(False)) & (F.col("response_url") != "")
    df = answered.filter(F.coalesce(F.col("status_code") != 304, F.lit(True)))
    df = df.withColumn("redirected_url", F.when(moved, F.col("response_url")))
    return df.withColumn("redirected_save_path", F.when(moved, urls.save_path(F.col("response_url"), F.col("type"), cfg.keep_search))).withColumn("body", F.when(F.length("body") > 0, F.col("body")))


def follow_redirects(df: DataFrame, cfg: CrawlConfig, id_col: str = "key") -> DataFrame:
    """[X11] Redirected URLs go through the stages themselves: those that hooks drop or that can't be followed are forgotten."""
    again = df.filter("redirected_url IS NOT NULL").select(F.col(id_col).alias("_id"), F.col("redirected_url").alias("raw_url"), "type", F.col("url").alias("ref_url"), F.col("save_path").alias("ref_save_path"))
    done = create_resources(again, cfg).filter(~F.col("discard")).select("_id", F.col("url").alias("_url"), F.col("save_path").alias("_path"))
    return df.drop("redirected_save_path").join(done, F.col(id_col) == F.col("_id"), "left").withColumn("redirected_url", F.col("_url")).withColumn("redirected_save_path", F.col("_path")).drop("_id", "_url", "_path")


def seen_keys(level: DataFrame, cfg: CrawlConfig) -> DataFrame:
    """[G2] Keys of a level that count as seen: its own, and those of the places it was redirected to."""
    moved = level.filter("redirected_url IS NOT NULL").select(urls.dedupe_key(F.col("redirected_url"), cfg.strip_search_for_dedupe).alias("key"))
    return level.select("key").unionByName(moved).distinct()


def not_html(content_types: Column) -> Column:
    """[S3c] Whether a page's content types (an array) speak of anything but HTML; without any there is nothing to say."""
    page = F.exists(content_types, lambda x: F.contains(x, F.lit("/html")) | F.contains(x, F.lit("/xml")) | F.contains(x, F.lit("application/xhtml+xml")))
    return F.coalesce((F.size(content_types) > 0) & ~page, F.lit(False))


def request_failed(name: Column) -> Column:
    """[S5c] Errors of the request itself, after which waiting helps."""
    return F.coalesce(name.isin("RequestError", "TimeoutError"), F.lit(False))


def manual_wait(attempt: Column, body_length: Column, name: Column, message: Column, code: Column, limit: int = 25) -> Column:
    """[S4] Milliseconds before the outer loop tries again, null if it doesn't: no body or a closed connection waits 200 ms
    for each try so far, a request error without a code or by timeout 300 ms."""
    closed = F.coalesce(F.lower(message).contains("premature close"), F.lit(False)) | (name.isNull() & (F.coalesce(body_length, F.lit(0)) == 0))
    timed = F.coalesce(name.isin("RequestError", "TimeoutError"), F.lit(False)) & (code.isNull() | (code == "ETIMEDOUT"))
    return F.when(attempt > limit, F.lit(None)).when(closed, attempt * 200).when(timed, attempt * 300).cast("bigint")


def resume(have: Column, accept_ranges: Column, status: Column, content_range: Column) -> Column:
    """[S5] How a download to a file of ``have`` bytes goes on: append what came, or start anew.

    A server that takes ranges and answers 206 from the byte asked for is appended; 416 and any other answer start anew.
    """
    fits = (have > 0) & F.coalesce(urls.accepts_bytes(accept_ranges), F.lit(False)) & (status == 206) & urls.same_range_start(have, content_range)
    return F.when(fits, "append").when(status == 416, "restart").otherwise("replace")


def streams(df: DataFrame, sink, before=(), after=()) -> DataFrame:
    """[S5d, S5e] Rows of streamed resources go to ``sink`` and end there: hooks before may filter rows or give bodies.

    Only http and https are asked for; rows whose hook gave a body aren't. Returns what is left for the other stages.
    """
    mine = apply_hooks(df.filter(F.col("type") == fixed.STREAMING), before)
    apply_hooks(sink(mine.filter(F.col("url").rlike("^https?://") & F.col("body").isNull())), after)
    return df.filter(F.col("type") != fixed.STREAMING)
