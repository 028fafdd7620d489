"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from rankforge.sources.scratch import drop_table, new_path  # noqa: F401

_held: dict = {}


def free_others() -> None:
    """Drops what this Python worker holds for other stages, so that the caches of one job's operators do not add up."""
    task = TaskContext.get()
    stage = task.stageId() if task else None
    old = [k for k, (at, _) in _held.items() if at != stage]
    for key in old:
        del _held[key]
    if old:
        give_back()


def give_back() -> None:
    """Returns freed memory to the system: Arrow's pool and the C library keep it otherwise (60 to 100 MB a worker after a stage)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def held(key, make):
    """What this Python worker holds under ``key``: made at its first use in a stage and kept for the stage's further tasks."""
    free_others()
    if key not in _held:
        task = TaskContext.get()
        _held[key] = (task.stageId() if task else None, make())
    return _held[key][1]


def fresh(columns: list[str], name: str) -> str:
    """The name, or one with further underscores that no column has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder; recovery rereads it.

    The table outlives the returned frame, as with checkpoint(): whoever owns the folder clears it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_files(docs: DataFrame) -> DataFrame:
    """The frame itself if it is a plain scan of files, whose rows have a place; else a table written from it."""
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    return docs if plain and "_metadata" not in docs.columns else materialize(docs, "rows")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n, as a column."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def crc_text(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def smallest_hashes(rows: DataFrame, label: str, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each label value, those first by ``order``: a bounded training sample.

    The first column of ``order`` must be a hash spread evenly over all longs, and rows must be distinct by it. A
    label's rows are counted first (a row a label), and only those under a hash threshold, of which 2 * most + 64 are
    expected, meet in the final ranking; fewer than ``most`` of a larger label pass it with a chance under 1e-9.
    """
    held = rows.withColumn("__h", order[0].cast("double") / 2.0**64 + 0.5)
    counted = held.groupBy(label).agg(F.count("*").alias("__n"))  # a row a label
    held = held.join(F.broadcast(counted), held[label].eqNullSafe(counted[label])).drop(counted[label])
    near = held.where(F.col("__h") <= (2 * most + 64) / F.col("__n"))
    rank = F.row_number().over(W.partitionBy(label).orderBy(*order))
    return near.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank", "__n", "__h")


def id_ranges(rows: DataFrame, range_bytes: int = 64 << 20, most_sampled: int = 1_000_000) -> tuple[int, DataFrame]:
    """Adds ``pid``, the number of a range of (doc_id, tie) of about ``range_bytes`` of text; null ids come first.

    ``rows`` holds doc_id (long), t (text) and tie (a hash of the text, so that a hot id is cut too). Bounds are
    quantiles by bytes of a hash sample of a hundredth of the rows (2,000 to ``most_sampled``), as Spark's own range
    partitioner takes; they decide how even the ranges are, never the result.
    """
    spark = rows.sparkSession
    n = rows.count()
    every = max(1, n // min(most_sampled, max(2_000, n // 100)))
    picked = rows.where(F.pmod(F.xxhash64("doc_id", "tie", F.lit(3)), F.lit(every)) == 0)
    picked = picked.select(F.col("doc_id").isNotNull().alias("some"), F.coalesce("doc_id", F.lit(0)).alias("d"), "tie", F.coalesce(F.octet_length("t"), F.lit(0)).alias("n"))
    sample = sorted((r["some"], r["d"], r["tie"], r["n"]) for r in picked.collect())
    total = sum(r[3] + 8 for r in sample)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * every // range_bytes))
    ends = np.cumsum([r[3] + 8 for r in sample])
    cuts = np.searchsorted(ends, total * np.arange(1, parts) / parts) if sample else []
    bounds = sorted({sample[i][:3] for i in cuts})
    nulls = np.array([b[2] for b in bounds if not b[0]], np.int64)
    ids = np.array([b[1] for b in bounds if b[0]], np.int64)
    ties = np.array([b[2] for b in bounds if b[0]], np.int64)
    shared = spark.sparkContext.broadcast((nulls, ids, ties))  # 16 bytes a range

    def number(some: pd.Series, d: pd.Series, tie: pd.Series) -> pd.Series:
        nulls, ids, ties = shared.value
        some, d, tie = some.to_numpy(bool), d.to_numpy(np.int64), tie.to_numpy(np.int64)
        low, high = np.searchsorted(ids, d, "left"), np.searchsorted(ids, d, "right")
        out = high + len(nulls)
        for a in np.unique(low[(low < high) & some]):  # ids that a bound names: their ties decide
            at = np.flatnonzero(some & (low == a) & (low < high))
            out[at] = len(nulls) + a + np.searchsorted(ties[a : high[at[0]]], tie[at], "right")
        out[~some] = np.searchsorted(nulls, tie[~some], "right")
        return pd.Series(out.astype(np.int32))

    pid = F.pandas_udf(number, "int")(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0).cast("long")), F.col("tie"))
    return len(bounds) + 1, rows.withColumn("pid", pid)
