"""Operator 2, mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.llm.scratch import Scratch, parts

#: Words of a text: runs of anything but space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per source (null is one): source_size, target. One row for each source comes in and goes out.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; a target
    stops at ``most`` times its source's size and the excess goes to the others by weight. Filling in order
    of cap / weight gives the fixed point at once: a source is capped if its cap is at most its share of
    what is left.
    """
    names = Window.orderBy(F.col("source").isNull(), F.col("source"))
    fill = Window.orderBy("per_weight", F.col("source").isNull(), F.col("source"))
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most).withColumn("per_weight", F.col("cap") / F.col("weight"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy())).withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(after))
    capped = F.col("cap") * F.col("weights") <= F.col("left") * F.col("weight")
    level = F.min(F.when(~capped, F.struct("per_weight", (F.col("left") / F.col("weights")).alias("level")))).over(Window.partitionBy())["level"]
    s = s.withColumn("capped", capped).withColumn("level", level)
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def mix_sources(docs: DataFrame, seed: str = "mix", scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and copies: how often the mix takes each row.

    Within a source all documents have the same expected copies, target / source_size, so the prefix sum is
    that rate times the document's rank; with one random offset for the source, a document is taken once for
    each integer that its stretch crosses. Ranks follow size (then doc_id), so the words taken stay within
    about one document of the target. No rank comes from one task: rows are dealt by range of (source, size,
    doc_id), ranked within their partition, and shifted by the counts of the partitions before.

    Null texts have size 0; null sources form one source; rows with equal keys are interchangeable; repeated
    ids are separate documents; an empty table gives an empty one; columns named like the results give way to
    them. Reruns on the same rows agree.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mix")
    return _mixed(spark, docs.drop("source_size", "target", "copies").withColumn("size", size_of()), seed, scratch)


def _mixed(spark: SparkSession, sized: DataFrame, seed: str, scratch: Scratch) -> DataFrame:
    order = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("doc_id").asc()]
    dealt = sized.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # partition in the upper bits, place in it in the lower 33
    dealt = scratch.save(dealt.withColumn("_place", place), "dealt")
    dealt = dealt.withColumn("_part", F.shiftright("_place", 33)).withColumn("_place", F.col("_place").bitwiseAND((1 << 33) - 1))
    counts = dealt.groupBy("_part", "source").agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("first"))
    # a partition holds a few sources and a source a few partitions: partitions plus sources rows in all
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(dealt.groupBy("source").agg(F.sum("size").alias("source_size")))
    shift = counts.withColumn("_shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1)
    shift = shift.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select(F.col("_part").alias("_p"), F.col("c.source").alias("_s"), "_shift", "source_size", "target")
    out = dealt.join(shift, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("source"), F.lit("")))), 1, 13), 16, 10)
    offset = digits.cast("double") / F.lit(float(16**13))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda rank: F.floor(rate * rank + offset)
    rank = F.col("_place") + F.col("_shift")
    return out.withColumn("copies", (upto(rank) - upto(rank - 1)).cast("long")).drop("_part", "_p", "_s", "_place", "_shift")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    scratch = Scratch(spark, "mix")
    mixed = _mixed(spark, docs.select("doc_id", "source", size_of().alias("size")), "mix", scratch)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, sum(source_size) OVER ()::BIGINT AS total FROM s),
f AS (SELECT *, 3 * source_size AS cap, total - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
        sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS weights
      FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
g AS (SELECT *, cap * weights <= rest * weight AS capped FROM f),
l AS (SELECT arg_min(rest / weights, cap / weight) AS level FROM g WHERE NOT capped),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight * level END AS target,
        ('0x' || substr(md5('mix' || coalesce(source, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM g LEFT JOIN l ON true),
r AS (SELECT d.doc_id, d.size, t.*, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS rank FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate * rank + u) - floor(rate * (rank - 1) + u))::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
