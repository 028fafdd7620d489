"""Near copies by the general rule: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

At that similarity SimHash fingerprints lie up to some 20 of 64 bits apart, and pigeonhole keys for such a radius have
two or three bits. So candidates meet by minimum hashes in their place: two sets of similarity 0.8 agree in none of
``BANDS`` bands of ``ROWS`` with probability (1 - 0.8 ** 4) ** 20 = 0.00003. Within a band's group the bit-sliced
SimHash comparison (op6's, at ``RADIUS``) joins what may be near; a pair of 0.8 lies beyond that radius with a chance of
about 0.000002. Each loose component so found is then judged by exact similarity, all pairs, so no text goes for a
chance agreement; every set travels once, to its loose component. Loose components over the limits are dealt out as
pairs of chunks; no pair is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import drop_table, free_others, fresh, in_files, materialize
from .simhash import bits_of, components, group_links

BANDS, ROWS, RADIUS = 20, 4, 26
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, k: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = zip(starts, ends[k - 1 :], strict=False) if len(words) >= k else [(0, len(joined))]
    return np.unique(np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans], np.uint64))


def band_keys(h: np.ndarray) -> list[int]:
    """A key for each band of minimum hashes; none for the empty set."""
    if not len(h):
        return []
    least = np.full(len(_FACTORS), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(h), 2048):
        least = np.minimum(least, (_FACTORS[:, None] * h[None, i : i + 2048]).min(1))
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def forest(sets: list[np.ndarray], least: float) -> np.ndarray:
    """The index of the first set that each is connected to by pairs of a similarity of ``least`` or more."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    label = np.arange(n)
    for i in range(n - 1):
        o = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        o = o[np.minimum(size[o], size[i]) >= least * np.maximum(size[o], size[i]) - 1e-9]
        if not len(o):
            continue
        near = []
        for c in np.split(o, np.flatnonzero(np.diff(np.cumsum(size[o]) // 500_000)) + 1):  # arrays of one slice at a time
            x = np.concatenate([sets[j] for j in c])
            hit = sets[i][np.minimum(np.searchsorted(sets[i], x), size[i] - 1)] == x
            common = np.add.reduceat(hit.astype(np.int32), np.cumsum(size[c]) - size[c])
            near += c[common * (1 + least) >= least * (size[c] + size[i]) - 1e-9].tolist()
        if near:
            joined = np.unique(np.append(label[near], label[i]))
            label[np.isin(label, joined)] = joined[0]
    return label


def exact_links(texts: DataFrame, members: DataFrame, least: float, group_rows: int, group_shingles: int) -> DataFrame:
    """(a, b) of nodes: a spanning forest of the pairs in each loose component with a similarity of ``least`` or more.

    ``texts`` holds file, at (where a row is) and t; ``members`` node, root, size and the row of each set.
    """
    spark = texts.sparkSession
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    share = F.greatest(F.col("n") / group_rows, F.col("total") / group_shingles)
    big = materialize(sizes.where(share > 1).select("root", F.ceil(2 * share).cast("int").alias("chunks")), "big")
    n_big, none = big.count(), F.lit(0).cast("int")
    placed = members.select("node", "root", "file", "at")
    if n_big:
        placed = placed.join(F.broadcast(big) if n_big <= 100_000 else big, "root", "left")
    else:
        placed = placed.withColumn("chunks", F.lit(None).cast("int"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_others()
        for b in batches:
            h = [shingle_set(t).astype(np.uint32) for t in b.column("t").to_pylist()]  # 32 bits tell the shingles of two texts apart
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "root", "chunks")), pa.array([np.unique(x).tobytes() for x in h], pa.binary())], ["node", "root", "chunks", "h"])

    placed = placed.hint("shuffle_hash")  # one way at every size: only the members' side is held, texts are not sorted
    sets = texts.join(placed, ["file", "at"]).select("node", "root", "chunks", "t").mapInArrow(hashes, "node long, root long, chunks int, h binary")
    own = F.coalesce(F.pmod(F.xxhash64("node", F.lit(11)), F.col("chunks")).cast("int"), none)
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(none)).otherwise(F.sequence(none, F.col("chunks") - 1)))
    dealt = sets.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "h")
    by = ["root", "i", "j"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), members.count() // 20_000)
    dealt = dealt.repartition(parts, *by).sortWithinPartitions(*by, "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_others()
        at, nodes, sets = None, [], []

        def done():
            x, label = np.array(nodes, np.int64), forest(sets, least)
            i = np.flatnonzero(label != np.arange(len(x)))
            return pa.RecordBatch.from_arrays([pa.array(x[i]), pa.array(x[label[i]])], ["a", "b"])

        for b in batches:
            for node, *group, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != at:
                    if len(nodes) > 1:
                        yield done()
                    at, nodes, sets = group, [], []
                nodes.append(node)
                sets.append(np.frombuffer(h, np.uint32))
        if len(nodes) > 1:
            yield done()

    return dealt.mapInArrow(work, "a long, b long").distinct()


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: float = 0.8, group_rows: int = 20_000, group_shingles: int = 8_000_000) -> DataFrame:
    """One row of each component of near copies: that of the smallest id, rows without an id last.

    Rows are told apart by their file and place in it, never by their id: rows without ids and different texts under
    one id are judged like any others, and of repeated rows one stays. Null texts and those of white space alone are
    equal; texts under five words are near copies only if equal; very long texts are judged whole; an empty table gives
    an empty result; all columns are kept, whatever their names.
    """
    held = in_files(docs)
    file, at = fresh(docs.columns, "file"), fresh(docs.columns, "at")
    place = [F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at)]
    texts = held.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))
    texts = texts.select("id", "t", F.xxhash64("path").alias("file"), "at")

    def judge(found: pd.Series) -> pd.DataFrame:
        free_others()
        rows = []
        for t in found:
            h = shingle_set(t)
            rows.append((xxhash.xxh128_digest(h.tobytes()), len(h), bits_of(h), band_keys(h)))
        return pd.DataFrame(rows, columns=["digest", "size", "fp", "bands"])

    signed = texts.select("id", "file", "at", F.pandas_udf(judge, "digest binary, size int, fp long, bands array<long>")("t").alias("s"))
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "at").alias("first")
    sets = signed.select(first, "s.*").groupBy("digest").agg(F.min("first").alias("first"), *(F.first(c).alias(c) for c in ("size", "fp", "bands")))
    sets = materialize(sets.select(F.monotonically_increasing_id().alias("node"), "first", "size", "fp", "bands"), "distinct-sets")
    keyed = sets.select("node", "fp", F.explode("bands").alias("key"))
    loose = components(group_links(keyed, ["key"], RADIUS, group_rows, sets.count()))
    loose = loose.unionByName(loose.select(F.col("root").alias("node"), "root")).distinct()
    members = sets.select("node", "size", F.col("first.file").alias("file"), F.col("first.at").alias("at")).join(loose, "node")
    members = materialize(members, "members")
    found = components(exact_links(texts.select("file", "at", "t"), members, least, group_rows, group_shingles))
    rooted = sets.select("node", "first").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.file").alias(file), F.col("first.at").alias(at))
    kept = materialize(kept, "kept")
    for done in (sets, members):
        drop_table(done)
    return held.select("*", *place).join(kept.hint("shuffle_hash"), [file, at], "left_semi").select(*docs.columns)
