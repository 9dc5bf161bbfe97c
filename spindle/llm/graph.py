"""Connected components by min-label hooking and pointer jumping, on shuffles only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.scratch import Scratch, parts

#: Rows that a partition of edges or labels should have at least: small graphs take few tasks.
ROWS = 20_000


def components(edges: DataFrame, scratch: Scratch, rounds: int = 200) -> DataFrame:
    """(id, component) for all ids in ``edges`` (a, b): component is the smallest id reachable.

    Each round a vertex takes the least label around it, then the label of that label. Labels only fall
    and stay within the component, so the end is exact; chains shrink at least by half with the jumps. Every
    round is written out, so no lineage grows; a hub's edges meet only partial minima.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    few = min(parts(both.sparkSession), 4 + both.count() // ROWS)
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")).coalesce(few), "labels")
    for _ in range(rounds):
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(around, "id").select("id", "component", F.least("component", "near").alias("next"))
        up = labels.select(F.col("id").alias("next"), F.col("component").alias("top"))
        jumped = hooked.join(up, "next", "left").select("id", F.least("next", F.coalesce("top", "next")).alias("component"), (F.least("next", F.coalesce("top", "next")) < F.col("component")).cast("int").alias("moved"))
        new = scratch.save(jumped.coalesce(few), "labels")
        moved = new.agg(F.max("moved")).first()[0]
        scratch.drop(labels)
        labels = new
        if not moved:
            return labels.select("id", "component")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
