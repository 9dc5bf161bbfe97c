"""Operator 1, token counts: exact counts at every prefix by dynamic programming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", tables: bool = False) -> DataFrame:
    """Per row: ``id_col``, n_bytes, n_tokens, over_limit, chars_at_limit.

    ``tokenizer``: path of a byte-level BPE JSON file that every executor can open. ``chars_at_limit`` is
    the longest cut (between or within pieces) whose own encoding has at most ``limit`` tokens. With
    ``tables`` the text's prefix table comes too, as ``unit_tokens``: running token counts at the ends of
    the text's units, from which any budget question is answered without encoding again (see
    ``bpe.PrefixCounter``, whose ``prefixes`` gives every single prefix).

    A null text counts as an empty one (0 bytes, 0 tokens). Null or repeated ids stay as they are, one row
    each; other columns are ignored; an empty table gives an empty one. Map-only: no shuffle.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens")), T.StructField("over_limit", T.BooleanType()), T.StructField("chars_at_limit", T.LongType())])
    if tables:
        schema.add("unit_tokens", T.ArrayType(T.LongType()))

    def run(batches):
        import pyarrow as pa

        from spindle.llm.bpe import prefix_counter

        counter = prefix_counter(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                text = text.as_py() or ""
                table = counter.table(text)
                n = table[-1] if table else 0
                for column, value in zip(out, (len(text.encode()), n, n > limit, counter.within(text, table, limit), table)):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k in list(zip(out, kinds))[: 5 if tables else 4]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.fieldNames())

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
