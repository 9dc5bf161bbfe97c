"""Operator 10, n-gram Jaccard join by rare-first prefix filtering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.bits import BITS, bit_table, has_bit
from spindle.llm.graph import components
from spindle.llm.kernel import tidy
from spindle.llm.scratch import Scratch, parts

#: Shingle frequencies are counted in 2**18 hashed buckets: a fixed 1 MB, whatever the input. They only order shingles.
FREQ_BITS = 18
SLICES = 16
#: Groups in which the tasks' counts of a slice are summed first.
FAN = 256
#: Cells of the suffix filter's histogram of a set.
CELLS = 64
#: Prefix entries of a shard, bytes of text of a block, and pairs that a task compares at once.
SHARD, BLOCK, PAIRS = 1 << 20, 1 << 20, 1 << 10
SHINGLE = 5
#: Pivot rounds at most before the join of what is left, pivots of a group in a round after the first, and pairs
#: for each member of an unsettled group up to which that join comes at once. They change the cost, not the result.
ROUNDS = 6
PIVOTS = 6
FEW = 8


def shingle_sets(column, width: int = SHINGLE):
    """Yields (row, sorted distinct 64-bit shingle hashes) of a string column: A-Z lower-cased, words, ``width`` words each.

    A text with fewer words has its whole sequence as one shingle; one without words the empty set.
    """
    from spindle.llm.kernel import LOWER, Runs, chunks, words

    for row, data, starts, ends in chunks(column):
        h, _, _, before = words(LOWER[data], starts, ends)
        runs = Runs(h)
        each = runs.each(width)
        for i in range(len(starts)):
            a, b = before[i], before[i + 1]
            if b - a >= width:
                yield row + i, np.unique(each[a : b - width + 1])
            elif b > a:
                yield row + i, runs.of(np.array([a]), np.array([b])) ^ np.uint64(b - a)
            else:
                yield row + i, each[:0]


def set_key(s: np.ndarray) -> int:
    """64-bit hash of a set: equal sets, and in effect only those, have equal keys."""
    from spindle.llm.kernel import mix

    with np.errstate(over="ignore"):
        x = mix(s.copy())
        y = x.sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_xor.reduce(x) + np.uint64(len(s))
        return int(mix(np.array([y], np.uint64)).view(np.int64)[0])


def _survey(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """A row (id, n, k) for each document, and from each task its counts of shingles by bucket, in slices."""
    docs_id = docs.schema[id_col].dataType
    kind = docs_id.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        counts = np.zeros(1 << FREQ_BITS, np.int64)
        for batch in batches:
            n, k = [], []
            for _, s in shingle_sets(batch.column(1), width):
                n.append(len(s))
                k.append(set_key(s) if len(s) else None)
                np.add.at(counts, (s >> np.uint64(64 - FREQ_BITS)).astype(np.int64), 1)
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=["id", "n", "k", "slice", "counts"])
        step = len(counts) // SLICES
        some = [i for i in range(SLICES) if counts[i * step : (i + 1) * step].any()]
        none = pa.nulls(len(some))
        yield pa.RecordBatch.from_arrays([none.cast(to_arrow_type(docs_id)), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(some, pa.int32()), pa.array([counts[i * step : (i + 1) * step].tobytes() for i in some], pa.binary())], names=["id", "n", "k", "slice", "counts"])
        tidy()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, f"id {kind}, n long, k long, slice int, counts binary")


def _frequencies(survey: DataFrame) -> np.ndarray:
    """The summed bucket counts: SLICES rows come to the driver, 2 MB in all."""

    def total(key, table):
        import pyarrow as pa

        s = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([s.tobytes()], pa.binary())})

    step = (1 << FREQ_BITS) // SLICES
    out = np.zeros(1 << FREQ_BITS, np.int64)
    # in two steps, so that no group holds a piece of every task
    parts_ = survey.filter("slice is not null").select("slice", "counts", F.pmod(F.xxhash64("counts"), F.lit(FAN)).alias("fan")).groupBy("slice", "fan").applyInArrow(total, "slice int, counts binary")
    for r in parts_.groupBy("slice").applyInArrow(total, "slice int, counts binary").collect():
        out[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["counts"], np.int64)
    return out


def _prefix(s: np.ndarray, f: np.ndarray, percent: int) -> np.ndarray:
    """The shingles that any set of enough similarity shares one of, rarest first: by bucket frequency, then by hash."""
    most = len(s) - -(-percent * len(s) // 100) + 1
    return s[np.lexsort((s, f[(s >> np.uint64(64 - FREQ_BITS)).astype(np.int64)]))[:most]]


def _slices(batches, text: int):
    """Slices of batches with about BLOCK bytes of text each."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + BLOCK, side="right")))
            yield batch.slice(low, high - low)
            low = high


def _shared_prefixes(docs: DataFrame, freq: np.ndarray, shards: int, percent: int, text_col: str, width: int, scratch: Scratch) -> DataFrame:
    """(token, k, n, pos): prefix shingles that at least two different sets have, rarest first in each set.

    First each block of texts sends its distinct prefix shingles as packed names and gets back one bit for each:
    whether another text has it too. Only those that do are shuffled as rows, with their sets.
    """
    from spindle.llm.names import PIECES, batch_of, pieces, repeated, told

    spark = docs.sparkSession
    by_freq = spark.sparkContext.broadcast(freq)
    numbered = scratch.bucketed(docs.select(F.monotonically_increasing_id().alias("block"), F.col(text_col).alias("text")).mapInArrow(_gathered, "block long, text array<string>"), "block", shards, "blocks")

    def prefixes(texts):
        f = by_freq.value
        sets = [s for _, s in shingle_sets(texts, width)]
        return sets, [_prefix(s, f, percent) if len(s) else s for s in sets]

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, found = prefixes(batch.column(1)[i].values)
                yield batch_of(batch.column(0)[i].as_py(), pieces(np.concatenate([np.zeros(0, np.uint64), *found]), None, shards, True)[0])
        tidy()

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                sets, found = prefixes(batch.column(1)[i].values)
                token = np.concatenate([np.zeros(0, np.uint64), *found])
                if not len(token):
                    continue
                again = told(batch.column(2)[i])[1][pieces(token, None, shards, True)[1]]
                sizes = np.array([len(x) for x in found])
                key = np.repeat(np.array([set_key(s) if len(s) else 0 for s in sets], np.int64), sizes)
                n = np.repeat(np.array([len(s) for s in sets]), sizes)
                pos = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                # equal sets of a block are one
                first = np.sort(np.unique(key, return_index=True)[1])
                keep = again & np.isin(np.arange(len(token)) - pos, first)
                yield pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(key[keep]), pa.array(n[keep].astype(np.int64)), pa.array(pos[keep].astype(np.int64))], names=["token", "k", "n", "pos"])
        tidy()

    answers = numbered.mapInArrow(ask, PIECES).groupBy("shard").applyInArrow(repeated, "block long, shard long, flags binary, n long")
    answers = scratch.save(answers.groupBy("block").agg(F.collect_list(F.struct("shard", "flags", "n")).alias("answers")), "answers")  # a bit for each name of a block
    scratch.release()
    some = numbered.join(answers.hint("shuffle_hash"), "block").select("block", "text", "answers").mapInArrow(rows, "token long, k long, n long, pos long")
    some = scratch.save(some.groupBy("token", "k").agg(F.max("n").alias("n"), F.min("pos").alias("pos")), "some")
    scratch.release()
    several = some.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("token")
    out = scratch.save(some.join(several, "token", "left_semi"), "shared")
    by_freq.destroy()
    scratch.drop(numbered, answers, some)
    return out


def _gathered(batches):
    """Texts as lists of about BLOCK bytes; null texts are left out."""
    import pyarrow as pa

    for part in _slices(batches, 1):
        texts = part.column(1).drop_null()
        yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)], names=["block", "text"])
    tidy()


def _sets_of(docs: DataFrame, wanted: DataFrame, shards: int, scratch: Scratch, id_col: str, text_col: str, width: int) -> DataFrame:
    """(k, cells, text) of the wanted (k, least id), dealt by k: later joins move pairs only.

    A fixed-size bit table of the wanted pairs (2 MB, from any input) drops nearly all others before the
    shuffle; a join then drops the rest, so the table only saves work.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    whole = kind in ("bigint", "int")
    mark = F.pmod(F.col("k").bitwiseXOR(F.coalesce(F.col("id").cast("bigint"), F.lit(0))) if whole else F.col("k"), F.lit(BITS))
    shared = scratch.share(bit_table(wanted, mark))

    def keys(batches):
        import pyarrow as pa

        bits = shared.value
        for batch in _slices(batches, 1):
            found = [(i, s, set_key(s)) for i, s in shingle_sets(batch.column(1), width) if len(s)]
            at = np.array([k for _, _, k in found], np.int64)
            if whole and len(found):
                at = at ^ batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[[i for i, _, _ in found]]
            may = has_bit(bits, np.mod(at, BITS))
            found = {i: (s, k) for (i, s, k), m in zip(found, may) if m}
            keep = list(found)
            at = pa.array(keep, pa.int64())
            cells = [np.bincount((found[i][0] & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32).tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([found[i][1] for i in keep], pa.int64()), pa.array(cells, pa.binary()), batch.column(1).take(at)], names=["id", "k", "cells", "text"])
        tidy()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(keys, f"id {kind}, k long, cells binary, text string")
    rows = rows.join(wanted, (rows["k"] == wanted["k"]) & rows["id"].eqNullSafe(wanted["id"]), "left_semi").select("k", "cells", "text").dropDuplicates(["k"])
    out = scratch.bucketed(rows, "k", shards, "sets")
    scratch.unshare()
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """Which of the pairs (a, b) reach the threshold: suffix filter on the cells, then the sets of both texts, once a pair."""

    def cells(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, y = (np.stack([np.frombuffer(v.as_buffer(), np.uint32) for v in batch.column(c)]).astype(np.int64) for c in (2, 3))
            most = np.minimum(x, y).sum(axis=1)
            keep = (100 + percent) * most >= percent * (x.sum(axis=1) + y.sum(axis=1))
            yield batch.select([0, 1]).filter(pa.array(keep))

    def exact(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in (b.slice(low, PAIRS) for b in batches for low in range(0, b.num_rows, PAIRS)):
            sides = []
            for c in (2, 3):
                coded = pc.dictionary_encode(batch.column(c))
                sets = [s for _, s in shingle_sets(coded.dictionary, width)]
                sides.append([sets[i] for i in coded.indices.to_pylist()])
            keep = []
            for x, y in zip(*sides):
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append((100 + percent) * both >= percent * (len(x) + len(y)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        tidy()

    side = lambda n, c: sets.select(F.col("k").alias(n), F.col(c).alias(f"{n}_{c}"))
    near = pairs.select("a", "b").join(side("a", "cells"), "a").join(side("b", "cells"), "b").select("a", "b", "a_cells", "b_cells").mapInArrow(cells, "a long, b long")
    near = scratch.save(near, "near")
    both = near.join(side("b", "text"), "b").join(side("a", "text"), "a").select("a", "b", "a_text", "b_text")
    out = scratch.save(both.mapInArrow(exact, "a long, b long"), "found")
    scratch.drop(near)
    scratch.release()
    return out


def _merged(labels: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (k, c) after the links found (a, b): only one edge for each two components enters the graph."""
    if found.isEmpty():
        return labels
    end = lambda n: labels.select(F.col("k").alias(n), F.col("c").alias(f"{n}c"))
    edges = found.join(end("a"), "a").join(end("b"), "b").select(F.least("ac", "bc").alias("a"), F.greatest("ac", "bc").alias("b")).distinct()
    roots = components(scratch.save(edges, "between"), scratch)
    return scratch.save(labels.join(roots.withColumnRenamed("id", "c"), "c", "left").select("k", F.coalesce("component", "c").alias("c")), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = SHINGLE, scratch: Scratch | None = None) -> DataFrame:
    """Per row: id, n_shingles, component_id (least id reachable by links of Jaccard similarity >= percent / 100).

    Equal sets are one vertex. Each set's shingles are ordered rarest first by corpus frequency, and the prefix
    that any similar set must meet is indexed; sets that share a prefix shingle and pass the length, positional
    and suffix filters are compared once. What is wanted is connectivity, so groups of sets with the same shingle
    first compare their members with a few pivots, round by round, while that still settles many; then every
    member outside its group's largest component is joined with all others of the group that are not yet in its
    component. A group of near copies costs its size, not its square, and no link between components is lost.

    Null and empty texts have no shingles and are their own component; rows with equal ids are separate rows; a
    null id gives a null component unless a copy has an id; extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "jaccard")
    survey = scratch.save(_survey(docs, id_col, text_col, width), "survey")
    freq = _frequencies(survey)
    rows = survey.filter("slice is null").select("id", "n", "k")
    entries = rows.agg(F.sum(F.ceil(F.col("n") * (100 - percent) / 100) + 1)).first()[0] or 0
    shards = max(parts(spark), -(-int(entries) // SHARD))
    shared = _shared_prefixes(docs, freq, shards, percent, text_col, width, scratch)
    keys = scratch.save(rows.filter("k is not null").groupBy("k").agg(F.min("id").alias("id")), "keys")
    wanted = scratch.save(shared.select("k").distinct().join(keys, "k"), "wanted")
    sets = _sets_of(docs, wanted, shards, scratch, id_col, text_col, width)

    labels, seen, cost = scratch.save(wanted.select("k", F.col("k").alias("c")), "labels"), None, None
    for turn in range(ROUNDS + 1):
        members, used = shared.join(labels, "k"), []
        last = False
        if turn:
            # in each group the largest component is settled; only the others' members need partners
            members = scratch.save(members, "members")
            sizes = members.groupBy("token", "c").agg(F.count(F.lit(1)).alias("m"))
            groups = sizes.groupBy("token").agg(F.sum("m").alias("m"), F.max(F.struct("m", "c")).alias("top"))
            tops = scratch.save(groups.filter("top.m < m").select("token", F.col("top.c").alias("top"), "m", (F.col("m") - F.col("top.m")).alias("others")), "tops")
            left, rows_left = tops.agg(F.sum(F.col("m").cast("double") * F.col("others")), F.sum("m")).first()
            if left is None:  # every group is within one component
                break
            last = turn == ROUNDS or left <= FEW * rows_left or (cost is not None and left > 0.8 * cost)
            cost = left
            used += [members, tops]
            members = scratch.save(members.join(tops.select("token", "top"), "token"), "mixed")
            used.append(members)
        x = members if turn == 0 else members.filter("c <> top")
        x = x.select("token", *[F.col(c).alias(f"x_{c}") for c in ("k", "n", "pos", "c")])
        if last:
            y = members
        else:
            # the member with the fewest rarer shingles is the closest to what the group shares
            by = [F.col("pos")] if turn == 0 else []
            by += [F.xxhash64("k", F.lit(f"{turn} {i}")) for i in range(1 if turn == 0 else PIVOTS)]
            mins = members.groupBy("token").agg(*[F.min(F.struct(h.alias("h"), "k", "n", "pos", "c")).alias(f"p{i}") for i, h in enumerate(by)])
            bare = [F.struct(*[F.col(f"p{i}")[c].alias(c) for c in ("k", "n", "pos", "c")]) for i in range(len(by))]
            used.append(scratch.save(mins.select("token", F.explode(F.array_distinct(F.array(*bare))).alias("y")), "pivots"))
            y = used[-1].select("token", "y.*")
            if turn:
                x = members.select("token", *[F.col(c).alias(f"x_{c}") for c in ("k", "n", "pos", "c")])
        y = y.select("token", *[F.col(c).alias(f"y_{c}") for c in ("k", "n", "pos", "c")])
        low, high = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
        most = F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos"))
        pairs = x.join(y, "token").filter((F.col("x_c") != F.col("y_c")) & (100 * low >= percent * high) & ((100 + percent) * most >= percent * (low + high)))
        pairs = pairs.select(F.least("x_k", "y_k").alias("a"), F.greatest("x_k", "y_k").alias("b")).distinct()
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, "pairs")
        found = _verified(pairs, sets, percent, width, scratch)
        seen = pairs if seen is None else seen.union(pairs)
        old, labels = labels, _merged(labels, found, scratch)
        scratch.drop(found, *used, *([old] if old is not labels else []))
        if last:
            break
    scratch.drop(shared, sets, wanted)
    labels = labels.select(F.col("k").alias("id"), F.col("c").alias("component"))
    least = keys.join(labels.withColumnRenamed("id", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    least = scratch.save(least, "least")
    tops = scratch.save(least.groupBy("component").agg(F.min("id").alias("component_id")), "tops")
    classes = scratch.save(least.join(tops, "component").select("k", "component_id"), "classes")
    out = rows.join(classes, "k", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
