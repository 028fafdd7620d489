"""Document fingerprints of content-defined chunks.

A gear hash over the last 32 bytes marks boundaries; normalised chunking asks for more hash bits before the usual
chunk size and fewer after it. A fingerprint is the sorted set of chunk digests with the length that each covers, as
text; containment is the covered length of one's chunks that the other has. An insertion changes the chunks around it
alone. Null and empty texts have an empty fingerprint: like each other 1, like others 0. Equal texts have equal
fingerprints. Very long texts are cut whole, by array operations. Repeated rows are judged each, in order of their ids
(nulls first) and their texts' hashes; an empty table gives an empty result; further columns are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import id_ranges

LEAST, USUAL, MOST, STRICT, LOOSE = 16, 48, 192, 7, 4
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)


def marks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ends of bytes where the gear hash's high bits are zero: by the strict mask, and by the loose one."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # after each, h covers twice as many bytes
        h[step:] += h[:-step] << np.uint32(step)
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0)
    strict = loose[h[loose] >> np.uint32(32 - STRICT) == 0]
    return strict + 1, loose + 1


def chunks(data: bytes) -> dict[int, int]:
    """Digest to covered length."""
    if not data:
        return {}
    strict, loose = (x.tolist() for x in marks(data))
    n, at, i, j, out = len(data), 0, 0, 0, {}
    strict.append(n + MOST)
    loose.append(n + MOST)
    digest = xxhash.xxh64_intdigest
    while at < n:
        while strict[i] < at + LEAST:
            i += 1
        if (end := strict[i]) > at + USUAL:
            while loose[j] < at + USUAL:
                j += 1
            end = min(loose[j], at + MOST, n)
        d = digest(data[at:end]) >> 16
        out[d] = out.get(d, 0) + end - at
        at = end
    return out


def text_of(found: dict[int, int]) -> str:
    return " ".join(f"{d:012x}:{n:x}" for d, n in sorted(found.items()))


def parse(fingerprint: str) -> dict[int, int]:
    return {int(d, 16): int(n, 16) for d, n in (x.split(":") for x in fingerprint.split())}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's length whose chunks b has, each up to the length that b covers with it."""
    total = sum(a.values())
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / total if total else float(not b)


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row, without a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_of(chunks((t or "").encode())) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, fingerprint string")


def with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", range_bytes: int = 64 << 20) -> DataFrame:
    """Every document beside its edited text (its last quarter replaced by the next document's head) and the next one.

    Rows go once to id ranges of about equal bytes; the first row of each range goes to the range before it too (the
    very first to the last), so each range is streamed in order by itself.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).withColumn("tie", F.xxhash64("t"))
    parts, ranged = id_ranges(rows, range_bytes)
    key = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "tie").alias("key")
    firsts = sorted((r["pid"], r["key"]) for r in ranged.select("pid", key).groupBy("pid").agg(F.min("key").alias("key")).collect())  # a row a range
    ahead = [(pid, first["doc_id"], first["tie"], firsts[k - 1][0]) for k, (pid, first) in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(ahead, "h_pid int, h_id long, h_tie long, target int")  # 24 bytes a range
    is_head = (F.col("pid") == F.col("h_pid")) & F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tie") == F.col("h_tie"))
    ranged = ranged.join(F.broadcast(heads), is_head, "left")
    here, there = (F.struct(F.col(c).alias("to"), F.lit(n).alias("ahead")) for c, n in (("pid", 0), ("target", 1)))
    to = F.when(F.col("target").isNull(), F.array(here)).otherwise(F.array(here, there))
    dealt = ranged.withColumn("w", F.explode(to)).select("doc_id", "t", "tie", F.col("w.to").alias("pid"), F.col("w.ahead").alias("ahead"))
    dealt = dealt.repartitionById(parts, "pid").sortWithinPartitions("ahead", F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "t", "ahead")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(d, t, found, after, after_found):
            n = len(t)
            edited = t[: n - n // 4] + after[: n // 4]
            changed = found if edited == t else chunks(edited.encode())
            return (d, n, hashlib.sha256(edited.encode()).hexdigest(), text_of(found), text_of(changed), containment(found, changed), containment(found, after_found))

        held = None
        for b in batches:
            out = []
            for ahead, d, t in zip(*(b.column(c).to_pylist() for c in ("ahead", "doc_id", "t")), strict=True):
                t = t or ""
                found = chunks(t.encode())
                if held is not None and not held[3]:
                    out.append(row(*held[:3], t, found))
                held = (d, t, found, ahead)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return dealt.mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
