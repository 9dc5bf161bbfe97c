"""Semi- and anti-joins that shuffle only what a fixed-size bit table can't settle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2 MB, whatever the input. A fuller table settles less and more rows go to the join; results don't change.
BITS = 1 << 24
SLICES = 16
#: Most wrong keys that each executor holds; of more, the rows are joined with them by a shuffle.
WRONG = 1 << 20


def bit_table(ids: DataFrame, at) -> np.ndarray:
    """The bits ``at`` (a column of numbers below BITS) of all rows, as bytes."""
    width = BITS // 8 // SLICES
    marks = ids.select(at.alias("at")).groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(at % 8 AS int)))").alias("bits"))

    def gather(name, table):
        import pyarrow as pa

        x = np.zeros(width, np.uint8)
        x[table.column("byte").to_numpy() % width] = table.column("bits").to_numpy()
        return pa.table({"slice": pa.array([name[0].as_py()], pa.int64()), "bits": pa.array([x.tobytes()], pa.binary())})

    table = np.zeros((SLICES, width), np.uint8)
    for r in marks.withColumn("slice", F.floor(F.col("byte") / width)).groupBy("slice").applyInArrow(gather, "slice long, bits binary").collect():
        table[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return table.reshape(-1)


def has_bit(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _at(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def _flagged(rows: DataFrame, shared, key: str) -> DataFrame:
    """``rows`` with ``_may``: whether the bit table has the row's key."""
    out = rows.withColumn("_may", _at(key))

    def run(batches):
        import pyarrow as pa

        held = shared.value
        for batch in batches:
            x = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            may = has_bit(held, x).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(may)], names=batch.schema.names)

    return out.mapInArrow(run, out.schema)


def among(rows: DataFrame, ids: DataFrame, key: str, scratch) -> DataFrame:
    """Rows whose key is in ``ids`` (one column named ``key``).

    Only keys move: the few that the bit table lets through and that aren't in ``ids`` are found first, and taken away
    where the rows are.
    """
    shared = scratch.share(bit_table(ids, _at(key)))
    rows = rows.filter(F.col(key).isNotNull())
    may = _flagged(rows, shared, key).filter("_may = 1").drop("_may")
    wrong = scratch.save(_flagged(rows.select(key), shared, key).filter("_may = 1").select(key).distinct().join(ids, key, "left_anti"), "wrong")
    return may.join(F.broadcast(wrong) if wrong.count() <= WRONG else wrong, key, "left_anti")


def outside(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ``ids``: most pass where they are, the rest through an anti-join."""
    flagged = _flagged(rows, rows.sparkSession.sparkContext.broadcast(bit_table(ids, _at(key))), key)
    return flagged.filter("_may = 0").drop("_may").unionByName(flagged.filter("_may = 1").drop("_may").join(ids, key, "left_anti"))
