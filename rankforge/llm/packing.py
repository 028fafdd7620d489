"""Best-fit-decreasing packing of token sequences.

Documents are tokenized once and cut into pieces; only piece lengths matter for packing. Best-fit decreasing treats
pieces of one length alike, so the driver plans with the histogram of lengths (at most ``max_tokens`` rows, whatever
the corpus): a segment tree over remaining capacities finds the tightest open bin in logarithmic time, and a run of
equal bins is filled at once. Pieces then look up their place by (length, rank); ranks are counted within small
(length, bucket) groups and shifted by the counts of earlier buckets, so no length, however frequent, meets in a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import tokens
from .common import materialize


class CapacityTree:
    """Max segment tree over capacities 0..most; a leaf is 1 while some open bin has that capacity."""

    def __init__(self, most: int):
        self.n = 1 << most.bit_length()
        self.t = bytearray(2 * self.n)

    def set(self, capacity: int, there: bool) -> None:
        i = capacity + self.n
        self.t[i] = there
        while i := i >> 1:
            self.t[i] = self.t[2 * i] | self.t[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of an open bin that is need or more."""
        i = need + self.n
        while not self.t[i]:
            while i & 1:  # a right child: up
                i >>= 1
                if i <= 1:
                    return None
            if i == 0:
                return None
            i += 1
        while i < self.n:
            i = 2 * i if self.t[2 * i] else 2 * i + 1
        return i - self.n


def plan(histogram: dict[int, int], most: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths: (length, first rank, end rank, a bin's number of them, first bin, offset)."""
    tree, open_bins, runs, bins = CapacityTree(most), {}, [], 0  # open_bins: capacity -> [(first bin, end)]

    def add(capacity: int, a: int, b: int) -> None:
        if a < b and capacity:
            open_bins.setdefault(capacity, []).append((a, b))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                per = most // length
                a, b, capacity = bins, bins + -(-left // per), most
                bins = b
            else:
                a, b = open_bins[capacity].pop()
                if not open_bins[capacity]:
                    tree.set(capacity, False)
            per = capacity // length
            full = min(b - a, left // per)
            offset = most - capacity
            if full:
                runs.append((length, rank, rank + full * per, per, a, offset))
                add(capacity - per * length, a, a + full)
                rank, left = rank + full * per, left - full * per
            if left and a + full < b:  # the last of this length share one more bin
                runs.append((length, rank, rank + left, left, a + full, offset))
                add(capacity - left * length, a + full, a + full + 1)
                rank, left, full = rank + left, 0, full + 1
            add(capacity, a + full, b)
    return runs


def pieces(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document's ids and the end id, cut only if longer than max_tokens; the first piece takes the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, end, size = tokens.codec(path, "bytes"), end_id.to_bytes(4, "little"), 4 * max_tokens
        for b in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(c.each(b.column("t").cast(pa.binary()).to_pylist(), end)):
                first = len(ids) % size or size
                cuts = [0, *range(first, len(ids) + 1, size)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    of.append(i)
                    piece.append(k)
                    start.append(x // 4)
                    length.append((y - x) // 4)
                    crc.append(zlib.crc32(ids[x:y] if k or y < len(ids) else ids))
            at = pa.array(of, pa.int64())
            made = [pa.array(np.array(x, kind)) for x, kind in ((piece, np.int32), (start, np.int64), (length, np.int64), (crc, np.int64))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), *made], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(cut, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece, the end id. Equal lengths are placed in order of (bucket, doc_id, piece);
    repeated rows are packed each. Very long texts are encoded whole, then cut. An empty table gives an empty result;
    further columns are not read, whatever their names.
    """
    made = pieces(docs, path, doc_id=doc_id, text=text, max_tokens=max_tokens, end_id=end_id)
    made = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", F.spark_partition_id()), F.lit(4096)).cast("int"))
    made = materialize(made, "pieces")
    counts = made.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    by_length = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(by_length), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_tokens rows
    spark = docs.sparkSession
    runs = spark.createDataFrame(plan(histogram, max_tokens), "r_length long, r_from long, r_to long, per long, bin long, at long")
    within = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    ranked = made.withColumn("rn", F.row_number().over(within) - 1).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rn") + F.col("before"))
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("r_from")) & (F.col("rank") < F.col("r_to")))
    k = F.col("rank") - F.col("r_from")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin") + F.floor(k / F.col("per"))).cast("long").alias("sequence_id"), (F.col("at") + F.pmod(k, F.col("per")) * F.col("length")).cast("long").alias("offset"))
