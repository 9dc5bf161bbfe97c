"""From documents to packed sequences: classify, de-duplicate, remove repeats, mix, pack."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.bits import outside
from spindle.llm.jaccard_join import near_duplicates
from spindle.llm.mixing import mix_sources
from spindle.llm.packing import pack
from spindle.llm.perplexity import classify
from spindle.llm.scratch import Scratch
from spindle.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with numbers, written once: decisions are on rows, as ids may repeat, and numbers given twice may differ."""
    return scratch.save(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows", small=True)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity under the model of trusted text exceeds their language's threshold."""
    scratch = Scratch(spark, "stage-classify")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = _numbered(docs, scratch)
    judged = classify(rows, labels, carry=("_row",), scratch=scratch)
    gone = scratch.save(judged.filter("not kept").select("_row"), "gone")
    return scratch.finish(outside(rows, gone, "_row").select(*COLUMNS))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group of documents joined by links of shingle similarity 0.75 or more."""
    scratch = Scratch(spark, "stage-near")
    rows = _numbered(docs, scratch)
    groups = near_duplicates(rows, id_col="_row", scratch=scratch)
    gone = scratch.save(groups.filter("_row <> component_id").select("_row"), "gone")
    return scratch.finish(outside(rows, gone, "_row").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes each byte in a 200-byte string that starts anywhere else; characters cut in two go as well."""
    scratch = Scratch(spark, "stage-suffix")
    out = remove_repeats(docs, carry=("lang", "source"), characters=True, scratch=scratch)
    return scratch.finish(out.select("doc_id", F.col("kept").alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that each source's words come near its target."""
    mixed = mix_sources(docs.select(*COLUMNS), scratch=Scratch(spark, "stage-mix"))
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), scratch=Scratch(spark, "stage-pack"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicate_groups),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mixture),
    ("packing", packed),
]

#: A language model and a similarity join over whole texts are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out, scratch = stage(spark, docs, sf_dir), Scratch(spark, f"pipeline-{k}")
        docs = scratch.save(out, "stage", small=True) if k < len(STAGES) - 1 else out
    return docs
