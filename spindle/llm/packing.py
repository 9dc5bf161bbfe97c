"""Operator 5, mixture-controlled packing by deficit round-robin over source queues."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindle.llm.kernel import tidy
from spindle.llm.scratch import Scratch

#: Ends each document.
END = 2
#: Tokens of one packing group, which one task holds: a few MB whatever the input.
GROUP = 1 << 20
#: A source waits until it may place a piece of so many tokens, or a document's rest.
PIECE = 64


def windows(queues: dict, deficits: dict, shares: dict, width: int, piece: int = PIECE):
    """Yields (window, offset, source, document, start, length) until all queues are empty.

    ``queues``: source -> [(document, tokens)]. Each window adds share * width to every source's deficit
    and visits the sources in turn, starting one later each time; a source places documents, cut where its
    deficit or the window ends. What is then left of the window goes to the largest deficits. What a source
    got too much or too little stays in its deficit for the next window.
    """
    order = sorted(queues, key=lambda s: (s is None, s or ""))
    at = {s: [0, 0] for s in order}
    live = [s for s in order if queues[s]]
    window = 0
    while live:
        offset = 0
        for s in order:
            deficits[s] = deficits.get(s, 0.0) + shares.get(s, 0.0) * width
        turn = live[window % len(live) :] + live[: window % len(live)]

        def place(s, most):
            nonlocal offset
            doc, start = at[s]
            name, tokens = queues[s][doc]
            n = min(most, tokens - start, width - offset)
            made = (window, offset, s, name, start, n)
            offset += n
            deficits[s] -= n
            at[s] = [doc, start + n] if start + n < tokens else [doc + 1, 0]
            return made

        for s in turn:
            while offset < width and at[s][0] < len(queues[s]):
                may, rest = int(deficits[s]), queues[s][at[s][0]][1] - at[s][1]
                if may < min(piece, rest):
                    break
                yield place(s, may)
        live = [s for s in live if at[s][0] < len(queues[s])]
        while offset < width and live:
            s = max(live, key=lambda x: deficits[x])
            yield place(s, width)
            live = [x for x in live if at[x][0] < len(queues[x])]
        window += 1


def cut_last(pieces: list[tuple], width: int):
    """Splits an unfinished last window at powers of two, so that none of its sequences needs padding."""
    if not pieces:
        return
    last = pieces[-1][0]
    total = sum(p[5] for p in pieces if p[0] == last)
    yield from (p for p in pieces if p[0] != last)
    sizes = [width] if total == width else [1 << b for b in range(width.bit_length() - 1, -1, -1) if total >> b & 1]
    rest, k, filled = [p for p in pieces if p[0] == last], 0, 0
    for _, _, s, name, start, n in rest:
        while n:
            take = min(n, sizes[k] - filled)
            yield last + k, filled, s, name, start, take
            start, n, filled = start + take, n - take, filled + take
            if filled == sizes[k]:
                k, filled = k + 1, 0


def tokenised(docs: DataFrame, tokenizer: str, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(row, id, source, n, ids): each document's ids, closed by END, as 16-bit little-endian integers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        from spindle.llm.bpe import word_encoder

        encode = word_encoder(tokenizer).encode
        for batch in batches:
            ids = [encode(t.as_py() or "") + END.to_bytes(2, "little") for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["row", "id", "source", "n", "ids"])
        tidy()

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col))
    return d.mapInArrow(run, f"row long, id {kind}, source string, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, width: int = 4096, group: int = GROUP, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", targets: dict[str | None, float] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    Every document's ids, closed by END, go into sequences of ``width``; every window is filled to the
    target proportions of the sources that still have tokens: ``targets`` (a source left out has 0 and comes when
    the others are used up), or the sources' own shares of all tokens. Documents are dealt into groups of about ``group`` tokens. A group starts with the
    deficits that the groups before it leave, which are known beforehand: the source's share of all their
    tokens, less its tokens in them (0 with ``targets``, as each group then keeps its own proportions). Only a group's last window can be unfinished; it is cut at powers of two,
    so nothing is padded.

    A null or empty text is the one id END; null sources are one source; rows with equal ids are packed each;
    an empty table gives no pieces. ``width`` must be a power of two.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "pack")
    tokens = scratch.save(tokenised(docs, tokenizer, id_col, source_col, text_col), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    groups = max(1, round(total / group))
    tokens = tokens.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(groups)))
    held = scratch.save(tokens.groupBy("pack", "source").agg(F.sum("n").alias("n")), "held")
    shares = held.groupBy("source").agg((F.sum("n") / F.lit(float(max(total, 1)))).alias("share"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("pack").agg(F.sum("n").alias("t")).withColumn("t", F.coalesce(F.sum("t").over(before(Window.orderBy("pack"))), F.lit(0)))
    got = held.withColumn("got", F.coalesce(F.sum("n").over(before(Window.partitionBy("source").orderBy("pack"))), F.lit(0)))
    if targets is not None:
        weigh = sum(targets.values()) or 1.0
        shares = spark.createDataFrame([(k, v / weigh) for k, v in targets.items()], "source string, share double")
    heads = got.join(sums, "pack").alias("g").join(shares.alias("s"), F.expr("g.source <=> s.source"), "left").select("pack", F.col("g.source").alias("source"), F.coalesce("share", F.lit(0.0)).alias("share"), (F.col("share") * F.col("t") - F.col("got") if targets is None else F.lit(0.0)).alias("deficit"))
    kind = tokens.schema["id"].dataType.simpleString()
    rows = tokens.select("pack", "row", "id", "source", "n", "ids", F.lit(None).cast("double").alias("share"), F.lit(None).cast("double").alias("deficit")).unionByName(heads, allowMissingColumns=True)

    def run(key, table):
        import pyarrow as pa

        pack_id = key[0].as_py()
        table = table.select(["row", "source", "n", "share", "deficit", "id", "ids"]).sort_by([("row", "ascending")])
        row, source, n, share, deficit = (table.column(i).to_pylist() for i in range(5))
        queues: dict = {}
        shares, deficits = {}, {}
        for i, r in enumerate(row):
            if r is None:
                shares[source[i]], deficits[source[i]] = share[i], deficit[i]
            else:
                queues.setdefault(source[i], []).append((i, n[i]))
        made = list(cut_last(list(windows(queues, deficits, shares, width)), width))
        wide = {i: memoryview(np.frombuffer(table.column(6)[i].as_buffer(), "<u2").astype("<u4")).cast("B") for q in queues.values() for i, _ in q}
        at = pa.array([p[3] for p in made], pa.int64())
        columns = [
            table.column(5).take(at),
            pa.array([p[4] for p in made], pa.int64()),
            pa.array([p[5] for p in made], pa.int64()),
            pa.array([zlib.crc32(wide[p[3]][4 * p[4] : 4 * (p[4] + p[5])]) for p in made], pa.int64()),
            table.column(2).take(at),
            pa.array([(pack_id << 32) + p[0] for p in made], pa.int64()),
            pa.array([p[1] for p in made], pa.int64()),
            table.column(1).take(at),
        ]
        tidy()
        return pa.Table.from_arrays(columns, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return rows.groupBy("pack").applyInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
