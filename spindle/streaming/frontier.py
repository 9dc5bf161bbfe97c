"""The frontier as a stream: exact de-duplication by key, and download rates by period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.functions import urls
from spindle.plans.stages import CrawlConfig, create_resources


def stream_resources(links: DataFrame, cfg: CrawlConfig) -> DataFrame:
    """Resources of a stream of links, each key once for ever: the state never forgets, as a crawl never refetches."""
    rows = create_resources(links, cfg)
    return rows.withColumn("key", urls.dedupe_key(F.col("url"), cfg.strip_search_for_dedupe)).dropDuplicates(["key"])


def rates(events: DataFrame, time: str = "ts", seconds: int = 60, late: str = "5 minutes") -> DataFrame:
    """[J4] Downloads per period, final once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, f"{seconds} seconds")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("period"), "n")
