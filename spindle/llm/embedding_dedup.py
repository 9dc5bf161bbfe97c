"""Operator 9, embedding near-duplicates by spherical-cap filters."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.graph import components
from spindle.llm.scratch import Scratch

#: Random directions of each block of the product code: DIRECTIONS ** blocks filters.
DIRECTIONS = 256
#: Filters that a vector passes at the cap, on average over random vectors.
PASSED = 16
#: Only vectors with fewer filters than this lower their own cap, step by step.
LEAST = 12


def blocks_for(rows: int) -> int:
    """Blocks of the code: so many that a pair of unrelated vectors shares a filter less than once for each row."""
    return max(3, math.ceil(math.log(max(rows, 1) * LEAST**2) / math.log(DIRECTIONS)))


def cap_for(blocks: int) -> float:
    """The product, in standard deviations of a random vector's, that PASSED of all filters exceed."""
    return NormalDist().inv_cdf(1 - PASSED / DIRECTIONS**blocks)


@functools.lru_cache(maxsize=16)
def _code(dim: int, blocks: int, seed: int = 7) -> list[tuple[slice, np.ndarray]]:
    """The dimensions of each block and its unit directions; blocks beyond ``dim`` are empty."""
    rng = np.random.Generator(np.random.PCG64([seed, dim, blocks]))
    out, at = [], 0
    for part in np.array_split(np.arange(dim), blocks):
        c = rng.standard_normal((DIRECTIONS, max(len(part), 1)))
        out.append((slice(at, at + len(part)), c / np.linalg.norm(c, axis=1, keepdims=True)))
        at += len(part)
    return [(at, c) for at, c in out if at.stop > at.start]


def list_decode(x: np.ndarray, blocks: int, cap: float | None = None, least: int = LEAST) -> list[np.ndarray]:
    """For each unit vector the ids of all filters (c_1, ..., c_n) whose summed product is at least the cap.

    The code is a product, so the list grows block by block: a beginning stays only if the best directions of the
    blocks to come can still lift it to the cap. Only what passes is ever listed.
    """
    dim = x.shape[1]
    unit = np.sqrt(blocks / dim)
    code = _code(dim, blocks)
    cap = cap_for(blocks) if cap is None else cap
    scores = [x[:, at] @ c.T / unit for at, c in code]
    order = [np.argsort(-s, axis=1) for s in scores]
    falling = [np.take_along_axis(s, o, axis=1) for s, o in zip(scores, order)]
    rest = np.cumsum(np.stack([f[:, 0] for f in falling] + [np.zeros(len(x))])[::-1], axis=0)[::-1]  # rest[k]: best sum of blocks k and on
    least = min(least, DIRECTIONS ** len(code))
    out = []
    for i in range(len(x)):
        level = min(cap, rest[0, i])
        while True:
            have, ids = np.zeros(1), np.zeros(1, np.int64)
            for k in range(len(code)):
                f, need = falling[k][i], level - rest[k + 1, i] - have
                reach = np.searchsorted(-f, -need, side="right")
                which = np.repeat(np.arange(len(have)), reach)
                j = np.arange(len(which)) - np.repeat(np.cumsum(reach) - reach, reach)
                have, ids = have[which] + f[j], ids[which] * DIRECTIONS + order[k][i][j]
            if len(ids) >= least:
                break
            level -= 0.15
        out.append(ids)
    return out


def _mixed(ids: np.ndarray, dim: int) -> np.ndarray:
    """Filter ids that differ by dimension as well; a clash only makes a candidate that the check throws out."""
    return ids + np.array([dim], np.int64) * np.int64(0x5851F42D4C957F2D)


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, blocks: int | None = None, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, representatives, links): rows with their representative, one row per distinct vector, verified pairs.

    Vectors of one label (not null) that are equal bit for bit collapse to one representative first. A filter's
    bucket within a label is joined with itself; each candidate pair is compared once, in double precision, and
    kept at ``cosine`` or more. No bucket is cut.
    """
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "embed")
    plain = vectors.schema[vector_col].dataType.simpleString() == "array<float>"  # travels as it is; sums are in double precision
    v = F.col(vector_col) if plain else F.col(vector_col).cast("array<double>")
    sound = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"), F.coalesce(sound, F.lit(False)).alias("sound"))
    # the hash finds equal vectors; a vector is grouped with its label and size, and with a second hash besides
    key = [F.xxhash64("label", "v").alias("k1"), F.xxhash64(F.reverse("v"), "label").alias("k2")]
    rows = scratch.save(rows.select("*", *[F.when(F.col("sound"), k).alias(n) for k, n in zip(key, ("k1", "k2"))]), "rows")
    reps = rows.filter("sound").groupBy("k1", "k2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    reps = scratch.save(reps, "reps")
    heads = scratch.save(rows.join(reps, rows["row"] == reps["rep"]).select("rep", "label", "v", "copies", "least"), "heads")
    blocks = blocks_for(heads.count()) if blocks is None else blocks

    def filters(batches):
        import pyarrow as pa

        for batch in batches:
            by_size: dict[int, list[int]] = {}
            for i, n in enumerate(batch.column(2).value_lengths().to_pylist()):
                by_size.setdefault(n, []).append(i)
            for dim, at in by_size.items():
                part = batch.take(pa.array(at))
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                big = np.abs(x).max(axis=1, keepdims=True)
                x = x / big
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                found = list_decode(x, blocks)
                n = np.array([len(f) for f in found])
                take = np.repeat(np.arange(len(n)), n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(take)), part.column(1).take(pa.array(take)), pa.array(_mixed(np.concatenate(found), dim) if len(found) else [], pa.int64())], names=["rep", "label", "filter"])

    passed = scratch.save(heads.select("rep", "label", "v").mapInArrow(filters, f"rep long, label {heads.schema['label'].dataType.simpleString()}, filter long"), "passed")
    crowded = passed.groupBy("label", "filter").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("label", "filter")
    shared = scratch.save(passed.join(crowded, ["label", "filter"], "left_semi"), "shared")
    scratch.drop(passed)
    x, y = shared.alias("x"), shared.alias("y")
    pairs = x.join(y, (F.col("x.label") == F.col("y.label")) & (F.col("x.filter") == F.col("y.filter")) & (F.col("x.rep") < F.col("y.rep"))).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    side = lambda n: heads.select(F.col("rep").alias(n), F.col("v").alias(f"v{n}"))

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = [batch.column(c).value_lengths().to_numpy(zero_copy_only=False) for c in (2, 3)]
            for dim in np.unique(sizes[0]):  # of one filter, so of one dimension, but for a clash of filter ids
                at = pa.array(np.flatnonzero((sizes[0] == dim) & (sizes[1] == dim)))
                part = batch.take(at)
                x, y = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64) for c in (2, 3))
                # each side is divided by its largest component, so that no square leaves the range
                x, y = (v / np.abs(v).max(axis=1, keepdims=True, initial=0.0) for v in (x, y))
                dot = lambda p, q: np.einsum("ij,ij->i", p, q)
                found = dot(x, y) / np.sqrt(dot(x, x)) / np.sqrt(dot(y, y))
                keep = pa.array(np.flatnonzero(found >= cosine))
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep), pa.array(found).take(keep)], names=["a", "b", "cosine"])

    links = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "va", "vb").mapInArrow(compare, "a long, b long, cosine double")
    links = scratch.save(links, "links")
    scratch.drop(shared, heads)
    return rows.select("row", "id", "k1", "k2"), reps, links


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98, blocks: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (least id reachable), kept.

    Rows link when labels are equal and not null and their cosine is at least ``cosine``. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing and are their own component. Exact
    copies link with each other. Rows with equal ids are separate vectors; a null id gives a null component.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "embed")
    rows, reps, links = embedding_links(vectors, id_col, vector_col, label_col, cosine, blocks, scratch)
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = reps.select(F.col("rep").alias("b"), "copies")
    near = both.join(copies, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("near"))
    comps = components(links, scratch).withColumnRenamed("id", "rep")
    r = reps.join(near, "rep", "left").join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = r.groupBy("component").agg(F.min("least").alias("component_id"))
    r = scratch.save(r.join(least, "component").select("k1", "k2", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), "component_id"), "classes")
    out = rows.join(r, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
