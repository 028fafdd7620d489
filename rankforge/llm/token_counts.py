"""Token counts by a map-side two-tier lookup.

Tier one is a compact table of frequent pre-token lengths (of a sentencepiece model: of frequent words), made from at
most ``sample_docs`` documents that the first partitions give and broadcast (at most ``table_size`` entries). Tier two
is a bounded cache in each Python worker, filled by encoding misses. No pre-token is shuffled; the table changes speed,
never results. Null and empty texts have no tokens; columns beside id and text are not read, whatever their names;
repeated rows are counted each; very long texts are counted whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens


def frequent_table(docs: DataFrame, path: str, text: str, sample_docs: int, table_size: int) -> list[tuple[str, int]]:
    """(pre-token, tokens) of at most table_size pre-tokens of under 60 characters; ``head`` stops after a few partitions."""
    few = docs.select(F.col(text).alias("t")).where(F.length("t") <= 20_000).head(sample_docs)
    return tokens.frequent((r["t"] for r in few), path, table_size)


def token_counts(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", sample_docs: int = 2000, table_size: int = 65_536, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; ``path`` names a .json (tokenizers) or .model (sentencepiece)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_table(docs, path, text, sample_docs, table_size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = tokens.counter(path)
        if not c.pre:
            c.pre.update(shared.value)
        for b in batches:
            n = np.array([c.text(t) for t in b.column("t").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
