"""Operator 3, quality rules: hashed n-gram likelihood ratio of trusted against raw text. Native expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.scratch import Scratch

#: n-grams fall into 2**16 buckets, so a model has a fixed size and can be broadcast.
BUCKET_BITS = 16
#: At most so many trusted rows (least hash first) fit the target; all held-out ones calibrate the threshold.
SAMPLE = 40_000
#: Share of the held-out trusted rows that may fall below the threshold.
MISS = 0.002
#: Added to each bucket's target count (twice that to the raw count).
PRIOR = 0.5


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _signals(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Base signals of each row, its words, and a row number to group by."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(F.col(id_col), *more, F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"), (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"), lines.alias("_lines"), word_array(F.col(text_col)).alias("_w"))
    n = F.size("_w")
    triples = F.when(n < 3, F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.cast("int").alias("p")))
    )
    d = d.select("*", n.cast("long").alias("n_words"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.sort_array(triples).alias("_t")).drop("_lines")
    same = lambda x, i: F.get("_t", i)["h"].eqNullSafe(x["h"])
    d = d.withColumn("_t", F.sort_array(F.filter(F.transform("_t", lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["p"])), lambda p: p.isNotNull())))
    steps = F.transform("_t", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_t", i + 1) - p, F.lit(3))))
    return d.withColumn("n_repeat_words", F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_t")


def _buckets(words: Column) -> Column:
    """Buckets of all 1- and 2-grams of a word array."""
    top = lambda h: F.shiftrightunsigned(h, 64 - BUCKET_BITS).cast("int")
    ones = F.transform(words, lambda x: top(F.xxhash64(x)))
    twos = F.transform(words, lambda x, i: F.when(F.get(words, i + 1).isNotNull(), top(F.xxhash64(x, F.get(words, i + 1)))))
    return F.concat(ones, twos)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, scratch: Scratch | None = None) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    ``score`` is the sum over the text's 1- and 2-grams of log p_trusted(bucket) - log p_raw(bucket), divided
    by their number. Raw counts cover every document. Trusted documents are labelled quality 1 and not toxic;
    a hash of the id deals them into two halves. A bounded ``sample`` of one fits p_trusted; all of the other
    sets the threshold, at the score that a share ``MISS`` of them misses (a histogram of 0.001 steps, so reruns
    agree). A row is kept if it doesn't
    fail the base rules and its score reaches the threshold; without trusted rows the base rules decide.

    Null and empty texts have no words and fail the base rules. Rows with equal ids are judged one by one; a
    label that repeats or contradicts itself counts as trusted only if all its rows are; null ids carry no
    label. Word triples are compared by 64-bit hashes within one document. The only shuffles are of bucket
    counts, of one row per document and of the ids and scores that set the threshold.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "rules")
    trusted = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("ok")).filter("ok")
    trusted = scratch.save(trusted.select("_id", F.xxhash64("_id").alias("_h"), F.pmod(F.xxhash64("_id"), F.lit(2)).cast("int").alias("_fold")), "trusted")
    fit = scratch.save(trusted.filter("_fold = 0").orderBy("_h").limit(sample).select("_id", "_fold"), "fit")

    counts = docs.select(id_col, text_col).join(F.broadcast(fit), F.col(id_col) == F.col("_id"), "left")  # ``sample`` rows at most
    counts = counts.select("_fold", word_array(F.col(text_col)).alias("_w")).select("_fold", F.explode(_buckets(F.col("_w"))).alias("_b"))
    counts = counts.filter("_b is not null").groupBy("_b").agg(F.count(F.lit(1)).alias("raw"), F.count(F.when(F.col("_fold") == 0, 1)).alias("target"))
    counts = scratch.save(counts, "counts")
    raw, target = counts.agg(F.sum("raw"), F.sum("target")).first()
    raw, target, size = raw or 0, target or 0, 1 << BUCKET_BITS
    bias = math.log(raw + 2 * PRIOR * size) - math.log(target + PRIOR * size)
    weights = counts.select("_b", (F.log(F.col("target") + PRIOR) - F.log(F.col("raw") + 2 * PRIOR) + F.lit(bias)).alias("_x"))

    rows = _signals(docs.select(id_col, text_col), id_col, text_col).withColumn("_row", F.monotonically_increasing_id())
    base = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = rows.select(*base, "_row", F.explode_outer(_buckets(F.col("_w"))).alias("_g"))
    rows = rows.join(F.broadcast(weights), F.col("_g") == F.col("_b"), "left")  # 2**BUCKET_BITS rows at most
    rows = rows.groupBy("_row").agg(*[F.first(c).alias(c) for c in base], F.sum("_x").alias("_sum"), F.count("_x").alias("_n"))
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumn("score", F.coalesce(F.col("_sum") / F.col("_n"), F.lit(0.0)))
    rows = scratch.save(rows.drop("_row", "_sum", "_n"), "scores")

    held = rows.filter(~F.col("base_failed")).join(trusted.filter("_fold = 1"), F.col(id_col) == F.col("_id"), "left_semi")
    held = held.groupBy(F.floor(F.col("score") * 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # some thousand bins, whatever the rows
    total, seen, threshold = sum(r["n"] for r in held), 0, -math.inf
    for r in held:
        if seen + r["n"] > MISS * total:
            threshold = r["bin"] / 1000
            break
        seen += r["n"]
    if not target:
        threshold = -math.inf
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
