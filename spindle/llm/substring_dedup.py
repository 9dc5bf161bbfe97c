"""Operator 8, substring dedup against a log-structured fingerprint index."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.scratch import Scratch, parts
from spindle.llm.spans import Plan, marked, merged, repeated_spans, roots

#: Fingerprints of 12-word grams chosen in each 50-word window, then 6 offsets at once, then single windows.
PLAN = Plan(length=50, gram=12, unit="word", fans=(7, 6))
#: Runs that may stand side by side before they are compacted into one.
RUNS = 3
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class FingerprintIndex:
    """Immutable runs of window fingerprints, each dealt and sorted by fingerprint when written.

    A run has one row (core, low, high) a fingerprint: the least and the greatest id that it occurs in, summed up
    before the rows move, so a fingerprint that a third of all texts has is one row a task. A batch is merge-joined
    with every run; as all are bucketed alike, no row moves for that. Once there are more than RUNS runs they are
    compacted into one.
    """

    def __init__(self, scratch: Scratch, buckets: int):
        self.scratch, self.buckets, self.runs = scratch, buckets, []

    def _write(self, rows: DataFrame) -> DataFrame:
        run = rows.groupBy("core").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        return self.scratch.bucketed(run, "core", self.buckets, "run", ordered=True, dealt=True)

    def add(self, nodes: DataFrame) -> DataFrame:
        """Adds a batch of nodes; (core, core_low) of its fingerprints that two ids have, of this batch or of any before."""
        batch = self._write(nodes.select("core", F.col("id").alias("low"), F.col("id").alias("high")))
        found, lows = batch, [F.col("low")]
        for k, run in enumerate(self.runs):
            found = found.join(run.select("core", F.col("low").alias(f"low{k}")), "core", "left")
            lows.append(F.col(f"low{k}"))
        found = found.select("core", F.least(*lows).alias("core_low") if len(lows) > 1 else lows[0].alias("core_low"), "high")
        found = self.scratch.save(found.filter("core_low < high").select("core", "core_low"), "found")
        self.runs.append(batch)
        if len(self.runs) > RUNS:
            old, rows = self.runs, self.runs[0]
            for r in old[1:]:
                rows = rows.unionByName(r)
            self.runs = [self._write(rows)]
            self.scratch.drop(*old)
        return found


def _edges(texts: DataFrame, batches: int) -> list:
    """Last ids of all batches but the last, about even; from a sample, as they only deal the work."""
    ids = texts.filter("id is not null").select("id")
    n = ids.count()
    some = sorted(r["id"] for r in ids.sample(min(1.0, 100 * batches / max(n, 1)), seed=1).collect()) if batches > 1 else []  # some hundreds
    return sorted({some[len(some) * k // batches] for k in range(1, batches)}) if some else []


def remove_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = PLAN, batches: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """Per row: id, n_words, n_removed, kept (words joined by one space).

    A word goes if a window of ``plan.length`` words covers it whose word sequence also starts in a document
    with a smaller id. Documents come in ``batches`` by ascending id range, as they would arrive; each batch is
    matched with the index of all before it and with itself, and then added. Matches are verified by the words
    around them (``spans.repeated_spans``), those of all batches together, as each step of that is a job of its own.

    Null and empty texts have no words. Rows with equal ids don't count as smaller than each other; null ids
    are neither smaller nor larger than any. Windows are compared as sequences of 64-bit word hashes.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "substring")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = scratch.bucketed(texts, "row", parts(spark), "texts")
    edges = _edges(texts, batches)
    nodes = scratch.save(roots(texts.filter("id is not null"), plan), "roots")
    index, found = FingerprintIndex(scratch, parts(spark)), []
    for k in range(len(edges) + 1):
        part = nodes
        if k:
            part = part.filter(F.col("id") > edges[k - 1])
        if k < len(edges):
            part = part.filter(F.col("id") <= edges[k])
        found.append(index.add(part))
    again = found[0]
    for f in found[1:]:
        again = again.union(f)
    cores = scratch.save(again.groupBy("core").agg(F.min("core_low").alias("core_low")), "cores")
    scratch.drop(*index.runs, *found)
    found = repeated_spans(nodes, texts, plan, scratch, earlier=True, cores=cores)
    scratch.drop(nodes)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], []]
            for text, found in zip(batch.column(1), batch.column(2)):
                words = _WORD.findall(text.as_py().encode())
                n, gone = len(words), 0
                if found.is_valid:
                    s, e = (found.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
                    kept, at = [], 0
                    for s, e in zip(*(c.tolist() for c in merged(s, e, n))):
                        kept += words[at:s]
                        gone, at = gone + e - s, e
                    words = kept + words[at:]
                for column, value in zip(out, (n, gone, b" ".join(words).decode())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, [pa.int64(), pa.int64(), pa.string()])], names=[id_col, "n_words", "n_removed", "kept"])

    return marked(texts, found).select("id", "text", "spans").mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_known(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
