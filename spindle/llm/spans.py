"""Exact search for long repeated runs of symbols, the search behind substring dedup.

Every window of ``length`` symbols contains an anchor: the q-gram with the least hash in it. The choice
depends on the window alone, so equal windows have their anchors at the same offset. Anchors whose q-gram
occurs once end here. For the others, all windows around the anchor at once are a node: the offsets [x, y] that
the anchor may have in a window. The node's core is what all its windows share, its hull all that they cover.
If the core is new, none of the windows repeats; if the hull repeats, all of them do; else the node is
split, and single windows decide in the end. So the sorting keys of a level refine the buckets of the level
before, and only undecided nodes are looked at again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindle.llm.scratch import Scratch


@dataclass(frozen=True)
class Plan:
    """``fans``: into how many nodes an undecided node splits, level by level; the last level are single windows."""

    length: int
    gram: int
    unit: str
    fans: tuple[int, ...]

    @property
    def reach(self) -> int:
        return self.length - self.gram


def symbols(column, unit: str):
    """Yields (first row, symbols, starts, ends) by chunks of a string column."""
    from spindle.llm.kernel import BYTE, chunks, words

    for row, data, starts, ends in chunks(column):
        if unit == "byte":
            yield row, BYTE[data], starts, ends
        else:
            h, _, _, before = words(data, starts, ends)
            yield row, h, before[:-1], before[1:]


def _node_hashes(runs, a, x, y, start, end, plan: Plan):
    """Hashes of core and hull of nodes; the hull's also tells where its text begins or ends early."""
    from spindle.llm.kernel import mix

    u = np.uint64
    core = runs.of(a - x, a - y + plan.length) + mix(x.astype(u) + u(1))
    left, right = np.maximum(a - y, start), np.minimum(a - x + plan.length, end)
    hull = runs.of(left, right) + mix((a - left).astype(u) * u(1 << 20) + (right - a).astype(u) + u(1 << 50)) + mix(x.astype(u) + u(7))
    return core, hull


NODES = "core long, hull long, row long, a int, x int, y int, fresh boolean"


def _batch(pa, core, hull, row, a, x, y, fresh, ids):
    return pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(hull.view(np.int64)), pa.array(row), *(pa.array(c.astype(np.int32)) for c in (a, x, y)), pa.array(fresh), ids], names=["core", "hull", "row", "a", "x", "y", "fresh", "id"])


def roots(texts: DataFrame, plan: Plan) -> DataFrame:
    """A node (core, hull, row, a, x, y, fresh, id) for each anchor of ``texts`` (row, id, text)."""
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        from spindle.llm.kernel import Runs, anchors, whole

        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            for first, s, starts, ends in symbols(batch.column(2), plan.unit):
                runs = Runs(s)
                a = anchors(runs.each(plan.gram), plan.reach + 1, whole(len(s), starts, ends, plan.length))
                if len(a) == 0:
                    continue
                doc = np.searchsorted(starts, a, side="right") - 1
                x, y = np.zeros(len(a), np.int64), np.full(len(a), plan.reach)
                core, hull = _node_hashes(runs, a, x, y, starts[doc], ends[doc], plan)
                yield _batch(pa, core, hull, rows[first + doc], a - starts[doc], x, y, np.ones(len(a), bool), batch.column(1).take(pa.array(first + doc)))

    return texts.select("row", "id", "text").mapInArrow(run, f"{NODES}, id {kind}")


def _split(texts: DataFrame, nodes: DataFrame, plan: Plan, fan: int) -> DataFrame:
    """The child nodes of ``nodes`` (row, a, x, y, fresh); texts are joined by row and stay where they are dealt."""
    kind = texts.schema["id"].dataType.simpleString()
    asked = nodes.groupBy("row").agg(F.collect_list(F.struct("a", "x", "y", "fresh")).alias("nodes"))  # as many as a text has anchors

    def run(batches):
        import pyarrow as pa

        from spindle.llm.kernel import Runs

        for batch in batches:
            for i in range(batch.num_rows):
                _, s, starts, ends = next(iter(symbols(batch.column(2).slice(i, 1), plan.unit)))
                runs, n = Runs(s), int(ends[0])
                flat = batch.column(3)[i].values
                a, x, y, fresh = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                a, x, y = a.astype(np.int64), x.astype(np.int64), y.astype(np.int64)
                width = -(-(y - x + 1) // fan)
                kids = [(a, x + width * k, np.minimum(y, x + width * (k + 1) - 1), fresh) for k in range(fan)]
                a, x, y, fresh = (np.concatenate(c) for c in zip(*kids))
                # some window of the node lies in the text
                keep = (x <= y) & (np.maximum(x, a + plan.length - n) <= np.minimum(y, a))
                a, x, y, fresh = a[keep], x[keep], y[keep], fresh[keep]
                if len(a) == 0:
                    continue
                core, hull = _node_hashes(runs, a, x, y, np.zeros(len(a), np.int64), np.full(len(a), n), plan)
                at = np.zeros(len(a), np.int64)
                yield _batch(pa, core, hull, np.full(len(a), batch.column(0)[i].as_py()), a, x, y, fresh, batch.column(1).slice(i, 1).take(pa.array(at)))

    joined = texts.select("row", "id", "text").join(asked.hint("shuffle_hash"), "row").select("row", "id", "text", "nodes")
    return joined.mapInArrow(run, f"{NODES}, id {kind}")


def repeated_spans(nodes: DataFrame, texts: DataFrame, plan: Plan, scratch: Scratch, earlier: bool, cores: DataFrame | None = None) -> DataFrame:
    """(row, start, end) of windows, of fresh nodes, that occur elsewhere (``earlier``: in a row with a smaller id).

    ``nodes``: root nodes, written out. ``cores``: (core, core_low) of those root cores that occur again, if known. Keys are counted with partial sums and joined back as a table of their
    own, so a key that a third of all texts has costs its rows, spread by AQE, and no list of them is made.
    """
    spans = []
    for level in range(len(plan.fans) + 1):
        single = level == len(plan.fans)
        stats = [F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high")]
        again = (F.col("low") < F.col("high")) if earlier else (F.col("n") > 1)
        if level or cores is None:
            cores = scratch.save(nodes.groupBy("core").agg(*stats).filter(again).select("core", F.col("low").alias("core_low")), "cores")
        held = scratch.save(nodes.join(cores, "core"), "held")
        if single:
            done = held.filter("fresh").filter(F.col("core_low") < F.col("id")) if earlier else held.filter("fresh")
            spans.append(scratch.save(done.select("row", (F.col("a") - F.col("x")).alias("start"), (F.col("a") - F.col("x") + plan.length).alias("end")), "spans"))
            scratch.drop(cores, held)
            break
        hulls = scratch.save(held.groupBy("hull").agg(*stats).filter(again).select("hull", F.col("low").alias("hull_low")), "hulls")
        whole = F.col("hull_low").isNotNull() if not earlier else F.coalesce(F.col("hull_low") < F.col("id"), F.lit(False))
        judged = held.join(hulls, "hull", "left").withColumn("whole", whole)
        judged = judged.withColumn("open", F.col("fresh") & ~F.col("whole") & (F.col("core_low") < F.col("id") if earlier else F.lit(True)))
        judged = scratch.save(judged, "judged")
        spans.append(scratch.save(judged.filter("fresh and whole").select("row", F.greatest(F.col("a") - F.col("y"), F.lit(0)).alias("start"), (F.col("a") - F.col("x") + plan.length).alias("end")), "spans"))
        asked = scratch.save(judged.filter("open").groupBy("core").agg(F.lit(1).alias("one")).select("core"), "asked")
        rivals = judged.join(asked, "core", "left_semi")
        # rows with equal core and hull are alike: the first stands for them all, besides those still open
        first = rivals.groupBy("core", "hull").agg(F.min(F.struct("id", "row", "a", "x", "y")).alias("f")).select("f.row", "f.a", "f.x", "f.y", F.lit(False).alias("fresh"))
        ask = judged.filter("open").select("row", "a", "x", "y", F.lit(True).alias("fresh")).union(first).groupBy("row", "a", "x", "y").agg(F.max("fresh").alias("fresh"))
        kids = scratch.save(_split(texts, ask, plan, plan.fans[level]), "nodes")
        scratch.drop(cores, held, hulls, judged, asked, *([nodes] if level else []))
        nodes = kids
    out = spans[0]
    for s in spans[1:]:
        out = out.union(s)
    return out


def marked(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """``texts`` with each row's spans as sorted arrays, null where it has none."""
    by_row = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))  # as many as a text has anchors
    return texts.join(by_row.hint("shuffle_hash"), "row", "left")


def merged(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of spans (sorted by start) within ``size`` symbols."""
    ends = np.minimum(ends, size)
    far = np.maximum.accumulate(ends)
    new = np.append(True, starts[1:] > far[:-1])
    return starts[new], far[np.append(np.flatnonzero(new)[1:] - 1, len(far) - 1)]
