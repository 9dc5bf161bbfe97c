"""Operator 6, quality classifier: perplexity under a modified Kneser-Ney bigram model of trusted text."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindle.llm.bits import among
from spindle.llm.kernel import tidy
from spindle.llm.scratch import Scratch, parts

#: Hashes that stand for the beginning and the end of a text.
BOS, EOS = 0x243F6A8885A308D3, 0x13198A2E03707344
#: Bits of the table that tells which keys can be in the model at all (32 MB); it only saves look-ups.
SEEN_BITS = 28
#: Most words that have a number, which shortens the keys of their pairs, and texts that these words are sought in; results don't change.
RANK_BITS, SAMPLE = 19, 8192
CODE_BITS = 2 * RANK_BITS
#: Words and entries of the model, the most frequent ones, that each task holds too; they only save look-ups.
COMMON = 1 << 20
#: Bigrams that a task of the training packs at once; bytes of text, over all documents, for each shard.
SHARD, DEAL = 1 << 20, 64 << 20
#: Share of a language's held-out trusted documents above its threshold where no label tells bad documents.
MISS = 0.003
SLICES = 16
#: Documents whose pairs a task holds at once (their numbers take 16 bits), and their bytes unless one alone has more.
#: A block sends at most two pieces to each shard, so larger blocks and shards keep the pieces few.
BLOCK, BLOCK_BYTES = 4096, 4 << 20


def sequences(column):
    """Yields (first row, words before each text, hashes, text of each, places of pairs) of pieces of a column.

    A text with words is a sequence from BOS to EOS; pair i is of the entries i and i + 1.
    """
    from spindle.llm.kernel import chunks, words

    for row, data, starts, ends in chunks(column):
        h, _, _, before = words(data, starts, ends)
        n = np.diff(before)
        size = np.where(n > 0, n + 2, 0)
        end = np.cumsum(size)
        low = end - size
        out = np.full(size.sum(), BOS, np.uint64)
        text = np.repeat(np.arange(len(n)), size)
        out[np.arange(len(h)) - np.repeat(before[:-1], n) + np.repeat(low, n) + 1] = h
        out[end[n > 0] - 1] = EOS
        pair = np.ones(len(out), bool)
        pair[end[n > 0] - 1] = False
        yield row, before, out, text, np.flatnonzero(pair)


def _blocks(batch, column: int):
    """Slices of a batch of BLOCK rows and, by the texts in a column, BLOCK_BYTES at most; a row at least."""
    import pyarrow.compute as pc

    end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(end, BLOCK_BYTES + (end[low - 1] if low else 0), side="right"))
        high = min(max(high, low + 1), low + BLOCK)
        yield batch.slice(low, high - low)
        low = high


#: Keys are codes below 2**CODE_BITS of two words that have numbers, or else hashes with this bit.
HASHED = np.uint64(1 << 63)
_MASK, _HALF = np.uint64((1 << CODE_BITS) - 1), np.uint64(RANK_BITS)
_ODD = [0x9E3779B97F4A7C15 & int(_MASK) | 1, 0xD6E8FEB86659FD93 & int(_MASK) | 1]


def _code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for two numbers of words, spread over all CODE_BITS; ``_decode`` undoes it."""
    c = (a.astype(np.uint64) << _HALF) | b.astype(np.uint64)
    for odd in _ODD:
        c ^= c >> _HALF
        c = (c * np.uint64(odd)) & _MASK
    return c ^ (c >> _HALF)


def _decode(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = c ^ (c >> _HALF)
    for odd in _ODD[::-1]:
        c = (c * np.uint64(pow(odd, -1, 1 << CODE_BITS))) & _MASK
        c ^= c >> _HALF
    return (c >> _HALF).astype(np.int64), (c & ((np.uint64(1) << _HALF) - np.uint64(1))).astype(np.int64)


def _hashed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    from spindle.llm.kernel import mix

    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second) | HASHED


def _pair_key(first: np.ndarray, second: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of pairs of words: by their numbers ``a`` and ``b`` if both have one, else by their hashes."""
    key = _hashed(first, second)
    both = np.flatnonzero((a >= 0) & (b >= 0))
    key[both] = _code(a[both], b[both])
    return key


def _shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """By ranges of codes and of hashes, so that sorted keys of one kind have sorted shards and small differences."""
    n = np.uint64(shards)
    return np.where(keys < HASHED, (keys * n) >> np.uint64(CODE_BITS), (((keys ^ HASHED) >> np.uint64(32)) * n) >> np.uint64(31))


def _places(keys: np.ndarray) -> np.ndarray:
    """The bit of each key in the table of possible keys: one, as a table that fills up still tells some apart."""
    return ((keys * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - SEEN_BITS)).astype(np.int64)


def _possible(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _places(keys)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def _press(x: np.ndarray) -> bytes:
    """Numbers by byte planes, packed as entropy has it: the shuffle's own compression only finds repeats."""
    import pyarrow as pa

    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T)
    return len(x).to_bytes(4, "little") + (pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True) if len(x) else b"")


def _unpress(data, kind) -> np.ndarray:
    import pyarrow as pa

    data, size = memoryview(data), np.dtype(kind).itemsize
    n = int.from_bytes(data[:4], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[4:], n * size), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _plain(data) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _press(np.diff(keys, prepend=np.uint64(0)))


def _unpack(data) -> np.ndarray:
    return np.cumsum(_unpress(data, np.uint64), dtype=np.uint64)


def _split(keys: np.ndarray, shards: int, *more: np.ndarray):
    """Yields (shard, sorted keys, the others in the same order) of codes and of hashes."""
    order = np.argsort(keys)
    keys, more = keys[order], [m[order] for m in more]
    shard = _shards(keys, shards)
    edge = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | ((keys[1:] ^ keys[:-1]) >= HASHED))) if len(shard) else []
    for a, b in zip(edge, [*edge[1:], len(shard)]):
        yield int(shard[a]), keys[a:b], [m[a:b] for m in more]


def _summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and the sum of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    n = np.diff(np.append(edge, len(keys))) if n is None else np.add.reduceat(n[order], edge)
    return keys[edge], order[edge], n


class _Index:
    """Places of keys in an array, by tables of slots: of random keys that takes a fraction of a binary search.

    A slot has a place + 1, negative if other keys of the slot are in the next table.
    """

    def __init__(self, keys: np.ndarray):
        self.keys, self.levels = keys, None

    def __getstate__(self):
        return _pack(self.keys)

    def __setstate__(self, state):
        self.keys, self.levels = _unpack(state), None

    def _build(self) -> None:
        self.levels, left = [], np.arange(len(self.keys))
        while len(left):
            bits, odd = max(4, len(left).bit_length() + 1), np.uint64(pow(0x9E3779B97F4A7C15, 2 * len(self.levels) + 1, 1 << 64))
            slot = ((self.keys[left] * odd) >> np.uint64(64 - bits)).astype(np.int64)
            slots = np.zeros(1 << bits, np.int32)
            slots[slot] = left + 1
            have = slots[slot] - 1
            lost = np.flatnonzero((have != left) & (self.keys[have] != self.keys[left]))
            slots[np.unique(slot[lost])] *= -1
            self.levels.append((slots, odd, np.uint64(64 - bits)))
            left = left[lost]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each, -1 if there is none."""
        out = np.full(len(h), -1, np.int64)
        if self.levels is None:
            self._build()
        todo = slice(None)
        for slots, odd, shift in self.levels:
            at = slots[((h * odd) >> shift).astype(np.int64)]
            place = np.abs(at) - 1
            hit = self.keys[place] == h
            out[todo] = np.where(hit, place, -1)
            more = np.flatnonzero(~hit & (at < 0))
            if not len(more):
                break
            todo, h = more if isinstance(todo, slice) else todo[more], h[more]
        return out


def _discounts(counts) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many types were seen once, twice, three and four times."""
    n1, n2, n3, n4 = (max(float(c or 0), 0.0) for c in counts)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    rate = lambda k, a, b: min(max(k - (k + 1) * y * b / a, 0.0), k) if a else k / 2
    return np.array([0.0, rate(1, n1, n2), rate(2, n2, n3), rate(3, n3, n4)])


def _sorted(t):
    """An Arrow table by its first column, as unsigned numbers."""
    return t.take(np.argsort(t.column(0).to_numpy().view(np.uint64))).combine_chunks()


class _Bits:
    """A table of bits that is packed while it moves."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __getstate__(self):
        return _press(self.bits)

    def __setstate__(self, state):
        self.bits = _unpress(state, np.uint8)


class Tables:
    """Numbers of words, discounts, the score of an unknown word, and what each task holds of the common words and entries.

    Broadcasts are packed: the driver and each executor keep a copy on disk. Sorted keys pack best.
    """

    def __init__(self, known: np.ndarray):
        self.known = _Index(np.sort(known))

    def __getstate__(self):
        return {k: (v.dtype.str, _press(v)) if isinstance(v, np.ndarray) else v for k, v in vars(self).items() if k != "of_words"}

    def __setstate__(self, state):
        vars(self).update({k: _unpress(v[1], v[0]) if isinstance(v, tuple) else v for k, v in state.items()})
        if "entries" in state:
            self._hold_of_words()

    def discounts(self, counts) -> None:
        self.discount = _discounts(counts)

    def hold_words(self, t, unknown: float) -> None:
        t = _sorted(t)
        keys, *values = (t.column(i).to_numpy() for i in range(4))
        self.words, self.unknown = _Index(keys.view(np.uint64)), unknown
        # float32 holds their logarithms well enough; the last place is that of other words
        self.total, self.back, self.lower = (np.append(v, np.nan).astype(np.float32) for v in values)

    def drop_words(self) -> None:
        self.words = self.total = self.back = self.lower = None

    def hold_entries(self, t) -> None:
        t = _sorted(t)
        self.entries, self.values = _Index(t.column(0).to_numpy().view(np.uint64)), np.append(t.column(1).to_numpy(), np.float32(np.nan))
        self._hold_of_words()

    def _hold_of_words(self) -> None:
        #: by the words' numbers, the last of words that have none
        self.of_words = np.append(self.values[self.entries.find(self.known.keys | HASHED)], np.float32(np.nan))


def _common(rows: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of greatest ``n``, ``most`` at most, by a histogram."""
    step = F.floor(F.log2(n) * 4)
    least, have = None, 0
    for r in sorted(rows.groupBy(step.alias("step")).count().collect(), reverse=True):  # 256 steps at most
        have += r["count"]
        if have > most:
            break
        least = r["step"]
    return rows.filter(F.lit(False) if least is None else step >= least)


def _trained(texts: DataFrame, shards: int, scratch: Scratch) -> tuple[DataFrame, Tables, np.ndarray]:
    """(shard, keys, values) of all entries of the model, the tables each task holds, and that of possible keys.

    A text's log probability is its number of events (its words and its end) times that of an unknown word, plus the
    values of its keys in the model: of a word's hash, its lower-order log probability less an unknown word's and the
    log of its back-off mass; of each pair's key, what its own count adds to both. All grow with the text.
    """

    def tally(batches):
        import pyarrow as pa

        for batch in (x for b in batches for x in _blocks(b, 0)):
            k, _, n = _summed(np.concatenate([np.zeros(0, np.uint64)] + [h for _, _, h, _, _ in sequences(batch.column(0))]))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["w", "n"])
        tidy()

    some = texts.sample(min(1.0, SAMPLE / max(1, texts.count())), 1).select(F.substring("text", 1, 1 << 14).alias("text"))
    some = scratch.save(some.mapInArrow(tally, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "known")
    tables = Tables(_common(some, "n", 1 << RANK_BITS).select("w").toArrow().combine_chunks().column(0).to_numpy().view(np.uint64))
    scratch.drop(some)
    shared = scratch.share(tables)

    def count(batches):
        import pyarrow as pa

        known = shared.value.known
        for batch in (x for b in batches for x in _blocks(b, 0)):
            parts = [[np.zeros(0, np.uint64)] * 3]
            for _, _, h, _, at in sequences(batch.column(0)):
                r = known.find(h)
                parts.append([_pair_key(h[at], h[at + 1], r[at], r[at + 1]), h[at], h[at + 1]])
            keys, a, b = (np.concatenate(x) for x in zip(*parts))
            keys, at, n = _summed(keys)
            # a hash is that of its words, which are sent instead
            found = [(s, *((k[:0], *m) if k[0] >= HASHED else (k, m[0][:0], m[1][:0], m[2]))) for s, k, m in _split(keys, shards, a[at], b[at], n.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), *(pa.array(x, pa.binary()) for x in ([_pack(f[1]) for f in found], [f[2].tobytes() for f in found], [f[3].tobytes() for f in found], [_press(f[4]) for f in found]))], names=["shard", "keys", "a", "b", "n"])
        tidy()

    def total(key, table):
        import pyarrow as pa

        known, out = shared.value.known.keys, []
        keys, a, b = (np.concatenate([f(x.as_buffer()) for x in table.column(c)]) for c, f in (("keys", _unpack), ("a", _plain), ("b", _plain)))
        n = [_unpress(x.as_buffer(), np.uint32).astype(np.int64) for x in table.column("n")]
        hashed = [len(x.as_buffer()) > 0 for x in table.column("a")]
        of = lambda kind: np.concatenate([np.zeros(0, np.int64), *(x for x, h in zip(n, hashed) if h == kind)])
        k, _, m = _summed(keys, of(False))
        first, second = _decode(k)
        out.append([known[first], known[second], m])
        _, at, m = _summed(_hashed(a, b), of(True))
        out.append([a[at], b[at], m])
        a, b, n = (np.concatenate(x) for x in zip(*out))
        tidy()
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64), "n": n})

    pairs = scratch.save(texts.mapInArrow(count, "shard long, keys binary, a binary, b binary, n binary").groupBy("shard").applyInArrow(total, "a long, b long, n long"), "pairs", small=True)
    scratch.drop(texts)
    scratch.unshare()
    tables.discounts(pairs.agg(*[F.count(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first())
    none = F.lit(0).cast("long")
    sides = pairs.select(F.col("a").alias("w"), "n", none.alias("before")).unionByName(pairs.select(F.col("b").alias("w"), none.alias("n"), F.lit(1).cast("long").alias("before")))
    seen_as = lambda when: F.sum(F.when(when, 1).otherwise(0))
    stats = scratch.save(sides.groupBy("w").agg(F.sum("n").alias("total"), F.sum("before").alias("continuation"), seen_as(F.col("n") == 1).alias("ones"), seen_as(F.col("n") == 2).alias("twos"), seen_as(F.col("n") >= 3).alias("more")), "words")
    scratch.release()
    c = F.col("continuation")
    known, all_, *kinds = (x or 0 for x in stats.agg(F.count(F.lit(1)), F.sum(c), *[F.count(F.when(c == k, 1)) for k in (1, 2, 3, 4)], F.count(F.when(c >= 3, 1))).first())
    # both orders are modified Kneser-Ney: discounts of their own for counts of 1, 2 and 3 or more
    d, e, all_ = [float(x) for x in tables.discount], [float(x) for x in _discounts(kinds[:4])], max(all_, 1)
    base = (e[1] * kinds[0] + e[2] * kinds[1] + e[3] * kinds[4] or 1.0) / (known + 1)
    left = F.col("ones") * d[1] + F.col("twos") * d[2] + F.col("more") * d[3]
    own = F.when(c >= 3, c - e[3]).when(c == 2, c - e[2]).when(c == 1, c - e[1]).otherwise(0.0)
    words = stats.select("w", "total", F.when(F.col("total") > 0, F.greatest(left / F.col("total"), F.lit(1e-6))).otherwise(1.0).alias("back"), ((F.greatest(own, F.lit(0.0)) + base) / float(all_)).alias("lower"), (F.col("total") + c).alias("n"))
    tables.hold_words(_common(words, "n", COMMON // 2).select("w", F.col("total").cast("double"), "back", "lower").toArrow().combine_chunks(), base / all_)
    shared = scratch.share(tables)

    def fill(batches):
        import pyarrow as pa

        tab = shared.value
        for batch in batches:
            a, b = (batch.column(i).to_numpy().view(np.uint64) for i in range(2))
            first, second = tab.words.find(a), tab.words.find(b)
            more = [x.astype(np.float64) for x in (tab.total[first], tab.back[first], tab.lower[second])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_pair_key(a, b, tab.known.find(a), tab.known.find(b)).view(np.int64)), *(pa.array(x, mask=np.isnan(x)) for x in more)], names=["a", "b", "n", "key", "total", "back", "lower"])
        tidy()

    # words that each task holds are settled where the pair is, so only rare ones are joined by their hash
    names = ["a", "b", "n", "key", "total", "back", "lower"]
    filled = pairs.mapInArrow(fill, "a long, b long, n long, key long, total double, back double, lower double")
    part = scratch.save(filled.filter("total is null or lower is null"), "rare", small=True)
    own = F.greatest(F.col("n") - F.when(F.col("n") >= 3, d[3]).when(F.col("n") == 2, d[2]).otherwise(d[1]), F.lit(0.0)) / F.col("total")
    of_pairs = lambda rows: rows.select("key", (F.log(own + F.col("back") * F.col("lower")) - F.log("back") - F.log("lower")).cast("float").alias("value"), "n")
    # the settled ones first, so that pairs are gone before the rare ones move
    settled = scratch.save(of_pairs(filled.filter("total is not null and lower is not null")), "settled", small=True)
    del sides, filled
    scratch.drop(pairs)
    rare = part.filter("total is null").select("a", "b", "n", "key", "lower").join(words.select(F.col("w").alias("a"), F.col("total").cast("double").alias("total"), "back"), "a").select(*names)
    both = part.filter("total is not null").unionByName(rare)
    rare = both.filter("lower is null").drop("lower").join(words.select(F.col("w").alias("b"), "lower"), "b").select(*names)
    of_words = words.select(F.col("w").bitwiseOR(F.lit(-(1 << 63))).alias("key"), (F.log("lower") - F.log(F.lit(tables.unknown)) + F.log("back")).cast("float").alias("value"), "n")
    others = scratch.save(of_pairs(both.filter("lower is not null").unionByName(rare)).unionByName(of_words), "others", small=True)
    entries = settled.unionByName(others)
    del words, both, rare, of_words
    scratch.drop(part, stats)
    scratch.unshare()
    tables.drop_words()
    tables.hold_entries(_common(entries, "n", COMMON).select("key", "value").toArrow().combine_chunks())

    def packed(batches):
        import pyarrow as pa

        def out():
            keys, values = (np.concatenate([h[k] for h in have]) for k in range(2))
            found = list(_split(keys.view(np.uint64), shards, values))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _, _ in found], pa.int64()), pa.array([_pack(k) for _, k, _ in found], pa.binary()), pa.array([_press(m[0]) for _, _, m in found], pa.binary())], names=["shard", "keys", "values"])

        have, n = [], 0
        for batch in batches:
            have.append([batch.column(i).to_numpy() for i in range(2)])
            n += batch.num_rows
            if n >= SHARD:
                yield out()
                have, n = [], 0
        if n:
            yield out()

    def marks(batches):
        import pyarrow as pa

        bits = np.zeros((1 << SEEN_BITS) // 8, np.uint8)
        for batch in batches:
            at = _places(batch.column(0).to_numpy().view(np.uint64))
            np.bitwise_or.at(bits, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        bits = bits.reshape(SLICES, -1)
        some = [i for i in range(SLICES) if bits[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([_press(bits[i]) for i in some], pa.binary())], names=["slice", "bits"])

    def join_marks(key, table):
        import pyarrow as pa

        x = np.bitwise_or.reduce([_unpress(k.as_buffer(), np.uint8) for k in table.column("bits")])
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([_press(x)], pa.binary())})

    size = entries.count()
    seen = np.zeros((SLICES, (1 << SEEN_BITS) // 8 // SLICES), np.uint8)
    if size > 1 << (SEEN_BITS + 1):  # so full a table would save next to nothing
        seen |= np.uint8(255)
    else:
        few = entries.select("key").coalesce(1 + size // (4 * SHARD))  # 8 tasks at most, each of which sends the whole table
        for r in few.mapInArrow(marks, "slice long, bits binary").groupBy("slice").applyInArrow(join_marks, "slice long, bits binary").collect():  # SLICES rows, 32 MB in all
            seen[r["slice"]] = _unpress(r["bits"], np.uint8)
    # dealt by shard once, before there are questions: those then meet it without another copy on disk
    model = scratch.bucketed(entries.select("key", "value").mapInArrow(packed, "shard long, keys binary, values binary"), "shard", max(parts(texts.sparkSession), 2 * shards), "model")
    del entries
    scratch.drop(settled, others)
    return model, tables, seen.reshape(-1)


def perplexities(docs: DataFrame, model: DataFrame, tables: Tables, seen: np.ndarray, shards: int, columns: list[str], text_col: str, scratch: Scratch) -> DataFrame:
    """``columns`` of each row with n_words and perplexity (null without words).

    Keys of common entries are settled where the text is. All others that can be in the model go to its shards,
    packed, with the document's number in its block; a shard joins them with its entries and returns sums by
    document, which the block adds up. Documents are read once and carry their columns; texts aren't shuffled.
    """
    shared = scratch.share((tables, math.log(tables.unknown), _Bits(seen)))
    kinds = [docs.schema[c].dataType.simpleString() for c in columns]
    lists = "".join(f", c{i} array<{k}>" for i, k in enumerate(kinds))
    names = [f"c{i}" for i in range(len(columns))]

    def ask(batches):
        import pyarrow as pa

        tab, unknown, bits = shared.value
        bits = bits.bits
        for batch in batches:
            for part in _blocks(batch, 1):
                number = part.column(0)[0].as_py()
                sums, sizes = np.zeros(part.num_rows), np.zeros(part.num_rows, np.int64)
                keys, docs_at = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
                for row, before, h, text, pair in sequences(part.column(1)):
                    n = len(before) - 1
                    sizes[row : row + n] = np.diff(before)
                    rank = tab.known.find(h)
                    value, rare = tab.of_words[rank], np.flatnonzero(rank < 0)
                    value[rare] = tab.values[tab.entries.find(h[rare] | HASHED)]
                    p = _pair_key(h[pair], h[pair + 1], rank[pair], rank[pair + 1])
                    k = np.concatenate([h | HASHED, p])
                    who = np.concatenate([text, text[pair]])
                    value = np.concatenate([value, tab.values[tab.entries.find(p)]])
                    far = np.isnan(value)
                    events = np.diff(before) + (np.diff(before) > 0)
                    sums[row : row + n] = np.bincount(who[~far], value[~far], n) + unknown * events
                    k, who = k[far], who[far]
                    may = _possible(bits, k)
                    keys.append(k[may])
                    docs_at.append((who[may] + row).astype(np.uint16))
                found = list(_split(np.concatenate(keys), shards, np.concatenate(docs_at)))
                n = len(found)
                own = [pa.array([None] * n + [c.to_pylist()], pa.list_(c.type)) for c in part.columns[2:]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _, _ in found] + [-1 - (number * 0x9E3779B97F4A7C15 % (1 << 64) >> 33) % shards], pa.int64()), pa.array([number] * (n + 1), pa.int64()), pa.array([_pack(k) for _, k, _ in found] + [sums.tobytes()], pa.binary()), pa.array([_press(m[0]) for _, _, m in found] + [sizes.tobytes()], pa.binary()), *own],
                    names=["shard", "block", "keys", "docs", *names],
                )
        tidy()

    def answer(key, table, entries):
        import pyarrow as pa

        if key[0].as_py() < 0:
            return table.select(["block", "keys", "docs", *names]).rename_columns(["block", "sums", "local", *names]).add_column(1, "docs", pa.nulls(table.num_rows, pa.binary()))
        held = np.concatenate([np.zeros(0, np.uint64)] + [_unpack(x.as_buffer()) for x in entries.column("keys")])
        value, out = np.concatenate([np.zeros(0)] + [_unpress(x.as_buffer(), np.float32) for x in entries.column("values")]), []
        order = np.argsort(held, kind="stable")
        held, value = np.append(held[order], np.uint64(2**64 - 1)), np.append(value[order], 0.0)  # an end that nothing passes
        for i, b in enumerate(table.column("block").to_pylist()):
            k, d = _unpack(table.column("keys")[i].as_buffer()), _unpress(table.column("docs")[i].as_buffer(), np.uint16)
            at = np.searchsorted(held, k)
            hit = held[at] == k
            sums = np.bincount(d[hit], value[at[hit]])
            who = np.flatnonzero(sums)
            out.append({"block": b, "docs": who.astype(np.uint16).tobytes(), "sums": sums[who].astype(np.float32).tobytes()})
        tidy()
        mine = pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("sums", pa.binary()), ("local", pa.binary())]))
        for c in names:
            mine = mine.append_column(c, pa.nulls(len(out), table.schema.field(c).type))
        return mine

    def gather(key, table):
        import pyarrow as pa

        whole = next(i for i, d in enumerate(table.column("local")) if d.is_valid)
        sums = np.frombuffer(table.column("sums")[whole].as_buffer(), np.float64).copy()
        sizes = np.frombuffer(table.column("local")[whole].as_buffer(), np.int64)
        # in a fixed order, so that reruns round alike
        parts = sorted((table.column("docs")[i].as_py(), table.column("sums")[i].as_py()) for i in range(table.num_rows) if i != whole)
        for d, s in parts:
            np.add.at(sums, np.frombuffer(d, np.uint16), np.frombuffer(s, np.float32))
        return pa.table({**{c: table.column(c)[whole].values for c in names}, "n_words": pa.array(sizes), "logp": pa.array(sums)})

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), text_col, *[F.col(c).alias(n) for c, n in zip(columns, names)])
    asked = numbered.mapInArrow(ask, f"shard long, block long, keys binary, docs binary{lists}")
    answers = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(answer, f"block long, docs binary, sums binary, local binary{lists}")
    scores = answers.groupBy("block").applyInArrow(gather, "".join(f"c{i} {k}, " for i, k in enumerate(kinds)) + "n_words long, logp double")
    return scores.select(*[F.col(n).alias(c) for c, n in zip(columns, names)], "n_words", F.when(F.col("n_words") > 0, F.exp(-F.col("logp") / (F.col("n_words") + 1))).alias("perplexity"))


def _limits(steps: dict, share: float) -> dict:
    """For each language the step that a ``share`` of its trusted documents exceeds; ``steps``: language -> step -> (trusted, bad)."""
    out = {}
    for lang, at in steps.items():
        total, over = sum(n for n, _ in at.values()), 0
        for s in sorted(at, reverse=True):
            over += at[s][0]
            if over > share * total:
                out[lang] = s
                break
    return out


def _share(steps: dict, miss: float) -> float:
    """The share of trusted documents to lose, in steps of 0.1%, that sets rejected shares of low-quality and trusted
    documents furthest apart, over all languages (Youden's index; the least such); ``miss`` without either kind."""
    total = [sum(n[k] for lang, at in steps.items() if lang is not None for n in at.values()) for k in range(2)]
    if not all(total):
        return miss
    best = (-math.inf, miss)
    for k in range(1, 501):
        limit = _limits(steps, k / 1000)
        everywhere = limit.get(None, math.inf)
        gone = [sum(n[i] for lang, at in steps.items() if lang is not None for s, n in at.items() if s > limit.get(lang, everywhere)) for i in range(2)]
        gain = gone[1] / total[1] - gone[0] / total[0]
        if gain > best[0]:
            best = (gain, k / 1000)
    return best[1]


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", miss: float = MISS, carry: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """Per row: id, language, the columns ``carry``, n_words, perplexity, threshold, kept.

    Trusted documents are labelled quality 1 and not toxic in all their label rows. A hash of the id deals them
    into two halves: one trains the model, the other sets each language's threshold, the perplexity that a share
    of its held-out documents exceeds (from a histogram of steps of 1% of a nat). That share is chosen on all
    held-out documents and all of quality 0 (``_share``), and is ``miss`` without labels of quality 0. Toxic
    documents of quality 1 read like trusted ones and set nothing. A language without held-out documents uses
    the threshold of all. Documents at or below the threshold are kept.

    Null and empty texts have no words, a null perplexity and aren't kept; null languages are one language; rows
    with equal ids are scored one by one; null ids carry no label; without trusted documents all with words stay.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "kn")
    trusted = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("ok")).filter("ok")
    trusted = scratch.save(trusted.select("_id", F.pmod(F.xxhash64("_id"), F.lit(2)).cast("int").alias("_fold")), "trusted")
    teach = trusted.filter("_fold = 0").select("_id")
    low = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("quality").alias("_q")).filter("_q = 0")
    texts = among(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter("_id is not null"), teach, "_id", scratch)
    size = scratch.save(texts.select("text"), "texts")
    shards = max(SLICES, -(-int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // DEAL))
    model, tables, seen = _trained(size, shards, scratch)
    scratch.release()
    scored = scratch.save(perplexities(docs, model, tables, seen, shards, [id_col, lang_col, *carry], text_col, scratch), "scores")
    scratch.unshare()
    scratch.drop(model)
    del model, tables, seen
    scratch.release()
    step = F.floor(F.log("perplexity") * 100).alias("step")
    judged = trusted.filter("_fold = 1").select("_id", F.lit(0).alias("_bad")).unionByName(low.select("_id", F.lit(1).alias("_bad")))
    held = scored.filter("perplexity is not null").join(judged, F.col(id_col) == F.col("_id")).groupBy(lang_col, step).agg(F.count(F.when(F.col("_bad") == 0, 1)).alias("good"), F.sum("_bad").alias("bad")).collect()  # languages times a few hundred steps
    by_lang: dict = {}
    for r in held:
        for lang in ((r[lang_col],), None):
            steps = by_lang.setdefault(lang, {})
            good, bad = steps.get(r["step"], (0, 0))
            steps[r["step"]] = good + r["good"], bad + r["bad"]
    limit = {lang: math.exp((s + 1) / 100) for lang, s in _limits(by_lang, _share(by_lang, miss)).items()}
    threshold = F.lit(limit.get(None, math.inf))
    for lang, value in limit.items():
        if lang is not None:
            threshold = F.when(F.col(lang_col).eqNullSafe(F.lit(lang[0])), F.lit(value)).otherwise(threshold)
    return scored.withColumn("threshold", threshold).withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
