"""Operator 4, suffix-array dedup by bucket-pointer refinement over packed blocks of texts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.kernel import tidy
from spindle.llm.names import PIECES, batch_of, pieces, repeated, told
from spindle.llm.scratch import Scratch, parts

#: Length of the strings, and of the grams of the initial buckets (each round doubles them: 50, 100, 200).
LENGTH, GRAM = 200, 50
#: Length of the grams of the sieve, which are sampled by content.
SIEVE = 64
#: Bytes of text of a block, the unit that a task sorts at once; a longer text is a block of its own.
BLOCK = 1 << 20
#: Bytes of text for each shard of bucket names, and for each bucket of the table of blocks.
SHARD, DEAL = 4 << 20, 12 << 20


class Block:
    """The texts of a block in one buffer: where windows fit, names of grams, and the suffixes still unsettled."""

    def __init__(self, data, sizes):
        from spindle.llm.kernel import whole

        self.data = np.frombuffer(data, np.uint8)
        sizes = np.frombuffer(sizes, np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.fits = whole(len(self.data), self.starts, self.ends, LENGTH)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the sampled grams, the least of each window of LENGTH bytes, and their names."""
        from spindle.llm.kernel import BYTE, Runs, anchors

        if not self.fits.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.grams = Runs(BYTE[self.data]).each(SIEVE)
        at = anchors(self.grams, LENGTH - SIEVE + 1, self.fits)
        return at, self.grams[at]

    def windows(self, at: np.ndarray, again: np.ndarray) -> np.ndarray:
        """Windows whose least gram occurs again, as places; all others occur once."""
        from spindle.llm.kernel import ahead

        n = len(self.fits)
        if not n:
            return np.zeros(0, np.int64)
        low, reach = at[again], LENGTH - SIEVE
        step = np.zeros(n + 1, np.int32)
        np.add.at(step, np.maximum(low - reach, 0), 1)
        np.add.at(step, np.minimum(low + 1, n), -1)
        near = np.flatnonzero((np.cumsum(step[:n]) > 0) & self.fits)
        least = ahead(self.grams, reach + 1, np.minimum)[near]
        alive = np.unique(self.grams[low])
        return near[alive[np.minimum(np.searchsorted(alive, least), len(alive) - 1)] == least] if len(alive) else near[:0]

    def names(self, places: np.ndarray, width: int = GRAM, symbols: np.ndarray | None = None) -> np.ndarray:
        """Hashes of ``width`` bytes at ``places`` (sorted); reads only the stretches around them."""
        from spindle.llm.kernel import BYTE, Runs

        symbols = BYTE if symbols is None else symbols
        if not len(places):
            return np.zeros(0, np.uint64)
        edge = np.flatnonzero(np.append(True, np.diff(places) > width))
        out = np.empty(len(places), np.uint64)
        for a, b in zip(edge, [*edge[1:], len(places)]):
            low, high = places[a], places[b - 1] + width
            out[a:b] = Runs(symbols[self.data[low:high]]).each(width)[places[a:b] - low]
        return out

    def wanted(self, windows: np.ndarray, turn: int) -> np.ndarray:
        """Suffixes whose bucket of this turn decides about ``windows``: those at the offsets of the parts of a window."""
        width = GRAM << turn
        flag = np.zeros(len(self.data) + LENGTH, bool)
        for off in range(0, LENGTH, width):
            flag[windows + off] = True
        return np.flatnonzero(flag)

    def buckets(self, windows: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes, bucket names) of a turn: a name is made of the suffix's own and of that of the suffix one width on."""
        from spindle.llm.kernel import mix

        ask = self.wanted(windows, turn)
        if turn == 0:
            return ask, self.names(ask)
        below, name = self.buckets(windows, turn - 1)
        table = np.empty(len(self.data) + LENGTH, np.uint64)
        table[below] = name
        return ask, mix(table[ask] * np.uint64(0x9E3779B97F4A7C15) + table[ask + (GRAM << (turn - 1))])


def _mask(windows: np.ndarray) -> bytes:
    """Places as (start, length) of runs."""
    edge = np.flatnonzero(np.append(True, np.diff(windows) > 1)) if len(windows) else np.zeros(0, np.int64)
    return np.concatenate([windows[edge], np.diff(np.append(edge, len(windows)))]).astype(np.int32).tobytes()


def _unmask(data) -> np.ndarray:
    start, size = np.frombuffer(data, np.int32).astype(np.int64).reshape(2, -1)
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _blocks(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """One row for each block: its number, the texts, their sizes, and the ids and carried columns as lists."""
    names = [id_col, *carry]
    lists = ", ".join(f"c{i} array<{docs.schema[c].dataType.simpleString()}>" for i, c in enumerate(names))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, low + int(np.searchsorted(np.cumsum(sizes[low:]), BLOCK, side="right")))
                part = batch.slice(low, high - low)
                data = b"".join(t.as_buffer() for t in part.column(1).cast(pa.binary()))
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c) for c in part.columns[3:]]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), pa.array([data], pa.binary()), pa.array([sizes[low:high].astype(np.int64).tobytes()], pa.binary()), *lists], names=["block", "data", "sizes", *(f"c{i}" for i in range(len(names)))])
                low = high

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_n"), text.alias("_t"), F.octet_length(text).alias("_s"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)])
    return rows.mapInArrow(run, f"block long, data binary, sizes binary, {lists}")


#: Turns of refinement.
TURNS = (LENGTH // GRAM).bit_length()


def _names_of(block: Block, windows: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Bucket names of a turn, and in the last one the check besides, a hash of other symbols over the whole string."""
    keys = block.buckets(windows, turn)[1]
    if turn < TURNS - 1:
        return keys, None
    from spindle.llm.kernel import BYTE

    return keys, (block.names(windows, LENGTH, BYTE[::-1] ^ np.uint64(0x1B873593CC9E2D50)) >> np.uint64(48)).astype(np.uint16)


def unsettled(block: Block, answers, turn: int, shards: int) -> np.ndarray:
    """The windows of a block still unsettled once the answers of a turn (-1: the sieve) are in."""
    own, flags = told(answers)
    if not len(flags):
        return np.zeros(0, np.int64)
    if turn < 0:
        at, keys = block.anchors()
        return block.windows(at, flags[pieces(keys, None, shards, True)[1]])
    windows = _unmask(own)
    keys, checks = _names_of(block, windows, turn)
    alive = np.zeros(len(block.data) + LENGTH, bool)
    alive[block.wanted(windows, turn)] = flags[pieces(keys, checks, shards, turn < TURNS - 1)[1]]
    return windows[np.logical_and.reduce([alive[windows + off] for off in range(0, LENGTH, GRAM << turn)])]


def refined(blocks: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """(block, answers) of the last turn, from which ``unsettled`` tells the LENGTH-byte strings that occur again.

    A sieve first: of each window the least SIEVE-gram, a sample of the suffixes chosen by content; a window whose
    sampled gram is alone is settled. Then the initial buckets are those of GRAM bytes, and each turn refines the
    buckets by sorting the suffixes on their own bucket's name and on that of the suffix one width on, which
    doubles the width up to LENGTH. A window is settled as soon as a bucket of any of its parts holds one suffix,
    and its suffixes are left out of all later turns. Names are fixed functions of the names below, so that no rank
    travels; a block sends each distinct name once, and gets back one bit for it. The last turn tells strings
    apart by 64 bits of name and 16 bits of an independent hash of all LENGTH bytes.
    """

    def step(turn):
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    number, block = batch.column(0)[i].as_py(), Block(batch.column(1)[i].as_buffer(), batch.column(2)[i].as_buffer())
                    own = []
                    if turn < 0:
                        keys, checks = block.anchors()[1], None
                    else:
                        windows = unsettled(block, batch.column(3)[i], turn - 1, shards)
                        if not len(windows):
                            continue
                        own = [(-1 - number % shards, _mask(windows), b"", b"", -1)]
                        keys, checks = _names_of(block, windows, turn)
                    out = pieces(keys, checks, shards, turn < TURNS - 1)[0] + own
                    yield batch_of(number, out)
            tidy()

        return run

    answers, texts = None, blocks.select("block", "data", "sizes")
    for turn in range(-1, TURNS):
        ask = texts if answers is None else texts.join(answers.hint("shuffle_hash"), "block").select("block", "data", "sizes", "answers")
        found = ask.mapInArrow(step(turn), PIECES).groupBy("shard").applyInArrow(repeated, "block long, shard long, flags binary, n long")
        new = scratch.save(found.groupBy("block").agg(F.collect_list(F.struct("shard", "flags", "n")).alias("answers")), "answers")  # a bit for each name of a block
        scratch.drop(*([answers] if answers is not None else []))
        del ask, found
        scratch.release()
        answers = new
    return answers


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), characters: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept (binary), spans (start, end), and the columns ``carry``.

    Every byte covered by a LENGTH-byte string that also starts anywhere else, same text included, is removed;
    strings are judged on the input. Texts are dealt once, in blocks, as a bucketed table; each turn of the
    refinement (``refined``) reads them where they lie and shuffles bucket names only. A name that a
    third of all texts has is sent once by each block.

    Null and empty texts have 0 bytes; texts shorter than the string have no repeats; rows with equal ids are
    documents of their own; other columns are ignored. Cuts may fall within a character, which is why ``kept`` is
    binary; with ``characters`` it is a string that leaves out the characters cut in two.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "suffix")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(parts(spark), -(-int(size) // SHARD))
    blocks = scratch.bucketed(_blocks(docs, id_col, text_col, carry), "block", max(parts(spark), -(-int(size) // DEAL)), "blocks")
    answers = refined(blocks, shards, scratch)
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, *carry)]
    names = [id_col, *carry]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.column(1)[i].as_buffer(), batch.column(2)[i].as_buffer())
                windows = unsettled(block, batch.column(3)[i], TURNS - 1, shards)
                edge = np.flatnonzero(np.append(True, np.diff(windows) > LENGTH)) if len(windows) else np.zeros(0, np.int64)
                low, high = windows[edge], (windows[np.append(edge[1:], len(windows)) - 1] + LENGTH if len(windows) else windows)
                # runs that touch at the end of one text and the start of the next are two
                doc = np.searchsorted(block.starts, low, side="right") - 1
                last = np.searchsorted(block.starts, np.maximum(high - 1, 0), side="right") - 1
                spans: list[list[tuple[int, int]]] = [[] for _ in block.starts]
                for a, b, d, e in zip(low.tolist(), high.tolist(), doc.tolist(), last.tolist()):
                    for k in range(d, e + 1):
                        s, t = max(a, int(block.starts[k])), min(b, int(block.ends[k]))
                        if s < t:
                            spans[k].append((s - int(block.starts[k]), t - int(block.starts[k])))
                data = block.data.tobytes()
                out: list[list] = [[], [], [], [], []]
                for s, e, runs in zip(block.starts.tolist(), block.ends.tolist(), spans):
                    kept, at = [], s
                    for a, b in runs:
                        kept.append(data[at : s + a])
                        at = s + b
                    kept.append(data[at:e])
                    kept = b"".join(kept)
                    for column, value in zip(out, (e - s, sum(b - a for a, b in runs), len(runs), kept.decode("utf-8", "ignore") if characters else kept, [{"start": a, "end": b} for a, b in runs])):
                        column.append(value)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string() if characters else pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                lists = [batch.column(4 + k).slice(i, 1).flatten() for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([lists[0], *map(pa.array, out, types), *lists[1:]], names=["_id", "n_bytes", "n_removed", "n_spans", "kept", "spans", *(f"_c{k}" for k in range(len(carry)))])

    more = "".join(f", _c{k} {kind}" for k, kind in enumerate(kinds[1:]))
    done = blocks.join(answers.hint("shuffle_hash"), "block", "left").select("block", "data", "sizes", "answers", *(f"c{k}" for k in range(len(names))))
    done = done.mapInArrow(run, f"_id {kinds[0]}, n_bytes long, n_removed long, n_spans long, kept {'string' if characters else 'binary'}, spans array<struct<start:long,end:long>>{more}")
    return done.select(F.col("_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept", "spans", *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
