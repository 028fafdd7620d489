"""Token ids in binary shards of patched frame-of-reference blocks.

A shard (little-endian): magic, range number, shard number, documents, ids, then as arrays the documents' ids (int64,
with a byte each that tells nulls), their id counts, and for each block of 512 ids its minimum, bit width, exception
count and start in the payload. A block's payload: the values minus the minimum, packed at the width that holds a
chosen percentile of them, then positions (uint16) and values (uint32) of the exceptions. Any block is found by its
start and decoded alone.

Ids are written in ascending doc_id order (nulls first, repeated ids by the hashes of their texts): rows go to id
ranges of about equal bytes, each range is sorted and streamed into shards of about ``shard_ids`` ids by rename, so a
repeated task writes the same names again. Null and empty texts hold the end id alone; repeated rows are written each;
a very long text makes a shard as long as itself; an empty table gives an empty result; further columns are not read,
whatever their names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from . import tokens
from .common import id_ranges, materialize, new_path

MAGIC, HEAD, BLOCK = b"RFPFOR01", struct.Struct("<8sqqqq"), 512


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """(m, 512) values under 2**width as (m, 8 * width) 64-bit words; a lane of all blocks is one contiguous row."""
    m, lanes, out = len(v), np.ascontiguousarray(v.T, np.uint64), np.zeros((BLOCK * width // 64 + 1, len(v)), np.uint64)
    for i in range(BLOCK if width and m else 0):
        word, shift = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out[: BLOCK * width // 64].T, "<u8")


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    m, lanes, low = len(words), np.ascontiguousarray(words.T), np.uint64((1 << width) - 1)
    out = np.zeros((BLOCK, m), np.uint64)
    for i in range(BLOCK if width and m else 0):
        word, shift = divmod(i * width, 64)
        x = lanes[word] >> np.uint64(shift)
        if shift + width > 64:
            x |= lanes[word + 1] << np.uint64(64 - shift)
        np.bitwise_and(x, low, out=out[i])
    return np.ascontiguousarray(out.T)


def _places(starts: np.ndarray, size: int) -> np.ndarray:
    """The byte positions of runs of one size."""
    return starts[:, None] + np.arange(size)


def encode_shard(pid: int, number: int, doc_ids: list, counts: list[int], ids: np.ndarray, percentile: float = 90) -> bytes:
    n = -(-len(ids) // BLOCK)
    v = np.concatenate([ids, np.repeat(ids[-1:], n * BLOCK - len(ids))]).astype("<u4", copy=False).reshape(n, BLOCK)
    low = v.min(1) if n else np.zeros(0, "<u4")
    v = v - low[:, None]
    at = np.partition(v, k := int(BLOCK * percentile / 100) - 1, axis=1)[:, k] if n else low
    width = np.ceil(np.log2(at.astype(float) + 1)).astype(np.uint8)
    over = v.astype(np.uint64) >> width.astype(np.uint64)[:, None] > 0
    exceptions = over.sum(1)
    sizes = 64 * width.astype(np.int64) + 6 * exceptions
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n else np.zeros(0, np.int64)
    payload = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        low_bits = v[rows] & np.uint32((1 << int(w)) - 1)
        payload[_places(starts[rows], 64 * int(w))] = _pack(low_bits, int(w)).view(np.uint8)
    row, where = np.nonzero(over)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    tail = (starts + 64 * width.astype(np.int64))[row]
    payload[_places(tail + 2 * nth, 2)] = where.astype("<u2").view(np.uint8).reshape(-1, 2)
    payload[_places(tail + 2 * exceptions[row] + 4 * nth, 4)] = v[row, where].astype("<u4").view(np.uint8).reshape(-1, 4)
    null = np.array([d is None for d in doc_ids], np.uint8)
    arrays = (np.array([d or 0 for d in doc_ids], "<i8"), null, np.array(counts, "<u4"), low.astype("<u4"), width, exceptions.astype("<u2"), starts.astype("<u8"))
    return HEAD.pack(MAGIC, pid, number, len(doc_ids), len(ids)) + b"".join(a.tobytes() for a in arrays) + payload.tobytes()


class Shard:
    def __init__(self, data: bytes):
        magic, self.pid, self.number, docs, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        n, at, out = -(-self.n_ids // BLOCK), HEAD.size, []
        for kind, k in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", n), ("u1", n), ("<u2", n), ("<u8", n)):
            out.append(np.frombuffer(data, kind, k, at))
            at += out[-1].nbytes
        ids, null, self.counts, self.low, self.width, self.exceptions, self.starts = out
        self.doc_ids, self.data, self.payload = [None if z else int(i) for i, z in zip(ids, null, strict=True)], data, at

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Ids a to b; only their blocks are decoded."""
        b = self.n_ids if b is None else min(b, self.n_ids)
        if a >= b:
            return np.zeros(0, "<u4")
        first, last = a // BLOCK, -(-b // BLOCK)
        out = np.zeros((last - first, BLOCK), np.uint64)
        width, exceptions = self.width[first:last].astype(np.int64), self.exceptions[first:last].astype(np.int64)
        starts, data = self.payload + self.starts[first:last].astype(np.int64), np.frombuffer(self.data, np.uint8)
        for w in np.unique(width[width > 0]):
            rows = np.flatnonzero(width == w)
            out[rows] = _unpack(data[_places(starts[rows], 64 * int(w))].view("<u8"), int(w))
        row = np.repeat(np.arange(last - first), exceptions)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        tail = (starts + 64 * width)[row]
        where = data[_places(tail + 2 * nth, 2)].view("<u2")[:, 0]
        out[row, where] = data[_places(tail + 2 * exceptions[row] + 4 * nth, 4)].view("<u4")[:, 0]
        out += self.low[first:last, None]
        return out.reshape(-1)[a - first * BLOCK : b - first * BLOCK].astype("<u4")


def write(docs: DataFrame, folder: str, path: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, shard_ids: int = 1_000_000, range_bytes: int = 64 << 20) -> DataFrame:
    """Writes the shards into a shared folder and returns their manifest: pid, number, n_ids.

    Texts, not ids, are shuffled: compressed text takes less room than the ids of short tokens would.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).withColumn("tie", F.xxhash64("t"))
    parts, rows = id_ranges(rows, range_bytes)
    rows = rows.repartitionById(parts, "pid").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "t")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        c, end = tokens.codec(path, "bytes"), end_id.to_bytes(4, "little")
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        pid, number, ids, held, counts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            name = f"{base}/range-{pid:06d}-{number:06d}.pfor"
            data = encode_shard(pid, number, held, counts, np.frombuffer(b"".join(ids), "<u4"))
            with store.open_output_stream(part := f"{base}/_{uuid.uuid4().hex}") as f:
                f.write(data)
            store.move(part, name)
            return pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "number": pa.array([number], pa.int32()), "n_ids": pa.array([size], pa.int64())})

        for b in batches:
            for d, x in zip(b.column("doc_id").to_pylist(), c.each(b.column("t").cast(pa.binary()).to_pylist(), end), strict=True):
                if size >= shard_ids:
                    yield flush()
                    number, ids, held, counts, size = number + 1, [], [], [], 0
                ids.append(x)
                held.append(d)
                counts.append(len(x) // 4)
                size += len(x) // 4
        if held:
            yield flush()

    return materialize(rows.mapInArrow(save, "pid int, number int, n_ids long"), "manifest")


def read(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the shards; starts are the ids before a shard plus those within."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                s = Shard(data.as_buffer())
                ids, ends = memoryview(s.ids()).cast("B"), np.cumsum(s.counts, dtype=np.int64)
                starts = ends - s.counts
                crc = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(s.doc_ids)
                columns = [pa.array(s.doc_ids, pa.int64()), np.full(n, s.pid, np.int32), np.full(n, s.number, np.int32), starts, s.counts.astype(np.int64), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_id", "pid", "number", "at", "n_tokens", "ids_crc32"])

    by_range = manifest.groupBy("pid").agg(F.sum("n_ids").alias("n"))  # a row a range
    by_range = by_range.select("pid", F.coalesce(F.sum("n").over(W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ranges"))
    within = W.partitionBy("pid").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    base = manifest.select("pid", "number", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("shards")).join(by_range, "pid")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "range-*.pfor").schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("content")
    got = files.mapInArrow(load, "doc_id long, pid int, number int, at long, n_tokens long, ids_crc32 long")
    return got.join(base, ["pid", "number"]).select("doc_id", (F.col("at") + F.col("ranges") + F.col("shards")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, **options) -> DataFrame:
    spark, folder = docs.sparkSession, new_path(docs.sparkSession, "tokens")
    manifest = write(docs, folder, path, **options)
    if not manifest.head(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder, manifest)
