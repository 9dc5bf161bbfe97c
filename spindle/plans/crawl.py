"""Bounded recursive crawl over a corpus: breadth first, with history-aware de-duplication."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.functions import fixed, urls
from spindle.plans.pipeline import Pipeline
from spindle.plans.requests import seen_keys
from spindle.plans.stages import CrawlConfig, create_resources, fetched


def first_by_key(df: DataFrame, key: str, *order) -> DataFrame:
    """[G1] One row per key, the first in ``order``; partial minima, so a popular key costs no long list."""
    columns = df.columns
    best = F.min(F.struct(*order, *[F.col(c) for c in columns if c not in order])).alias("_b")
    return df.groupBy(F.col(key).alias("_key")).agg(best).select(*[F.col(f"_b.{c}").alias(c) for c in columns])


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, save) -> DataFrame:
    """[G1-G3, F7] (key, depth) of all keys within ``max_depth`` steps: least depth. ``save`` writes a table and rereads it."""
    seen = save(seeds.select("key").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier, edges["src"] == frontier["key"]).select(F.col("dst").alias("key")).distinct()
        frontier = save(step.join(seen.select("key"), "key", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def saver(spark: SparkSession, folder: str):
    def save(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share; a temporary one only with a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spindle-")
    return found.rstrip("/")


def crawl(spark: SparkSession, seeds: list[str] | DataFrame, pages: DataFrame, cfg: CrawlConfig, folder: str) -> DataFrame:
    """[S1, S2, G1-G3] All resources reached from ``seeds`` within ``cfg.max_depth`` levels, with bodies where the corpus has them.

    Each level is written to ``folder`` (shared storage), which cuts lineage; children of a level are resolved,
    filtered, then de-duplicated within the level (least parent and ordinal win) and against all before.
    """
    cfg = cfg.checked()
    save = saver(spark, folder)
    more = [u for hook in cfg.init for u in hook() or []]
    first = seeds.select(F.col("url").alias("raw_url")) if isinstance(seeds, DataFrame) else spark.createDataFrame([(u,) for u in seeds], "raw_url string")
    first = first.unionByName(spark.createDataFrame([(u,) for u in more], "raw_url string")).distinct()
    found = first.selectExpr("raw_url", "raw_url AS ref_url", "'' AS ref_save_path", "0 AS depth", "0 AS ordinal", f"{fixed.HTML} AS type")
    found = found.withColumn("ref_save_path", urls.save_path(F.col("ref_url"), F.col("type"), cfg.keep_search))
    seen, done = None, None
    for depth in range(cfg.max_depth + 1):
        level = create_resources(found, cfg).withColumn("key", urls.dedupe_key(F.col("url") if cfg.strip_search_for_dedupe else F.col("download_link"), cfg.strip_search_for_dedupe))
        level = first_by_key(level.filter(~F.col("discard")), "key", "ref_url", "ordinal")
        if seen is not None:
            level = level.join(seen.select("key"), "key", "left_anti")
        level, found = Pipeline(cfg).after(save(fetched(level, pages, cfg)))
        keys = seen_keys(level, cfg) if "redirected_url" in level.columns else level.select("key")
        seen = keys if seen is None else seen.union(keys)
        done = level if done is None else done.unionByName(level)
        if depth == cfg.max_depth or level.isEmpty():
            break
        parents = level.select(F.col("key").alias("_k"), F.col("url").alias("ref_url"), F.col("save_path").alias("ref_save_path"), "depth")
        found = found.join(parents, found["key"] == F.col("_k")).select("raw_url", "ref_url", "ref_save_path", (F.col("depth") + 1).alias("depth"), "ordinal", "type")
    for hook in cfg.dispose:
        hook()
    return done
