"""SimHash near-duplicates: exact links at a small Hamming radius, and their components.

A document's 64-bit fingerprint sums the XXH64 hashes of its word shingles. Distinct fingerprints are grouped by
pigeonhole keys: with m bit blocks and radius r, two linked fingerprints agree on some m - r of them, so every such
choice of blocks is one key. Within a group, fingerprints lie as bit planes (64 lanes a word); all of a query's
distances grow at once by carry-save counters, and (query, word) blocks whose lanes all exceed the radius are
abandoned after every eight planes. A group gives only a spanning forest of its links; components come from
alternating large-star and small-star rounds over distinct fingerprints.

Null and empty texts have fingerprint zero, linked like any other. Equal texts (repeated rows included) share a
fingerprint and so a component; null ids never name one unless a whole component lacks ids. Very long texts are summed
in blocks; an empty table gives an empty result; further columns are not read, whatever their names. Groups over ``group_rows``
fingerprints are dealt out as pairs of chunks, so no key meets in a task; no pair is dropped.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import materialize


def fingerprint(text: str | None, k: int = 4, seed: int = 42) -> int:
    """Bit b is 1 if set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    ends = ends.tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = zip(starts, ends[k - 1 :], strict=False) if len(words) >= k else [(0, len(joined))]
    hash_of = xxhash.xxh64_intdigest
    return bits_of(np.array([hash_of(joined[a:b], seed) for a, b in spans], "<u8"))


def bits_of(h: np.ndarray) -> int:
    """Bit b is 1 if set in over half of the hashes; a signed long."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id and fp (a signed long) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t, shingle) for t in b.column("t").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(work, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


def close(planes: np.ndarray, query: np.ndarray, radius: int, q: np.ndarray, w: np.ndarray, lanes: np.ndarray) -> tuple:
    """Of the blocks (query q, word w) with the lanes to judge: those with lanes within the radius.

    Counters are bits of the distance, lowest first, as many as hold the radius; a carry out of the highest is over it.
    """
    counters = [np.zeros(len(q), np.uint64)] * int(radius).bit_length()
    dead = ~lanes
    for b in range(64):
        carry = planes[b][w] ^ query[b][q]
        for i, c in enumerate(counters):
            counters[i], carry = c ^ carry, c & carry
        dead = dead | carry
        if b % 8 == 7 and b >= radius:
            over, same = np.zeros(len(q), np.uint64), np.full(len(q), 0xFFFFFFFFFFFFFFFF, np.uint64)
            for i in reversed(range(len(counters))):  # distance > radius, highest bit first
                if radius >> i & 1:
                    same = same & counters[i]
                else:
                    over = over | same & counters[i]
                    same = same & ~counters[i]
            dead = dead | over
            alive = np.flatnonzero(dead != np.uint64(0xFFFFFFFFFFFFFFFF))
            if len(alive) < len(q):
                q, w, dead = q[alive], w[alive], dead[alive]
                counters = [c[alive] for c in counters]
            if not len(q):
                break
    return q, w, ~dead


def forest(x: np.ndarray, group: np.ndarray, radius: int, blocks: int = 1 << 16) -> np.ndarray:
    """For fingerprints in runs of equal group, the index of the first one that each is connected to within its group."""
    n = len(x)
    label = np.arange(n)
    if n < 2:
        return label
    bits = np.unpackbits(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((-(-n // 64) * 64, 64), np.uint8)
    padded[:n] = bits
    planes = np.ascontiguousarray(np.packbits(padded, axis=0, bitorder="little").T).view("<u8")
    query = np.where(bits.T > 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    cut = np.flatnonzero(np.diff(group)) + 1
    end = np.repeat(np.concatenate([cut, [n]]), np.diff(np.concatenate([[0], cut, [n]])))
    item = np.flatnonzero(end > np.arange(n) + 1)
    words = (end[item] - 1) // 64 - (item + 1) // 64 + 1
    total = np.cumsum(words)
    low = lambda k: (np.uint64(1) << k.astype(np.uint64)) - np.uint64(1)
    a = 0
    while a < len(item):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + blocks, "right")))
        q = np.repeat(item[a:b], words[a:b])
        w = np.arange(len(q)) - np.repeat(np.cumsum(words[a:b]) - words[a:b], words[a:b]) + (q + 1) // 64
        lanes = np.full(len(q), 0xFFFFFFFFFFFFFFFF, np.uint64)
        first, last = w == (q + 1) // 64, (w == end[q] // 64)
        lanes[first] &= ~low((q[first] + 1) % 64)
        lanes[last] &= low(end[q[last]] % 64)
        q, w, near = close(planes, query, radius, q, w, lanes)
        if len(q):
            at, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            u, v = q[at], w[at] * 64 + lane
            while True:
                lu, lv = label[u], label[v]
                if not (apart := lu != lv).any():
                    break
                u, v, lu, lv = u[apart], v[apart], lu[apart], lv[apart]
                np.minimum.at(label, np.maximum(lu, lv), np.minimum(lu, lv))
                while (label[label] != label).any():
                    label = label[label]
        a = b
    return label


def key_blocks(n: int, radius: int) -> int:
    """Blocks so that a key has about as many bits as there are fingerprints to tell apart, less ten."""
    m = radius + 1
    while 64 * (m - radius) / m < np.log2(max(n, 2)) - 10 and m < radius + 4:
        m += 1
    return m


def group_links(keyed: DataFrame, keys: list[str], radius: int, group_rows: int, n: int) -> DataFrame:
    """(a, b) of nodes: in each group of equal ``keys``, a spanning forest of the pairs whose fingerprints lie within the radius.

    ``keyed`` holds node, fp and the keys, ``n`` nodes in all. Groups of over ``group_rows`` rows are dealt out as pairs
    of chunks: every pair of rows meets in one of them.
    """
    spark = keyed.sparkSession
    hot = keyed.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > group_rows)
    hot = materialize(hot.select(*keys, F.ceil(2 * F.col("n") / group_rows).cast("int").alias("chunks")), "hot")
    n_hot = hot.count()
    none = F.lit(0).cast("int")
    if n_hot:
        with_hot = keyed.join(F.broadcast(hot) if n_hot <= 100_000 else hot, keys, "left")
        own = F.pmod(F.xxhash64(F.col("node"), F.lit(7)), F.col("chunks")).cast("int")
        other = F.explode(F.when(F.col("chunks").isNull(), F.array(none)).otherwise(F.sequence(none, F.col("chunks") - 1)))
        dealt = with_hot.withColumn("own", F.coalesce(own, none)).withColumn("other", other)
        dealt = dealt.select("node", "fp", *keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    else:
        dealt = keyed.select("node", "fp", *keys, none.alias("i"), none.alias("j"))
    by = [*keys, "i", "j"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 200_000)
    dealt = dealt.repartition(parts, *by).sortWithinPartitions(*by)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def done(last: bool):
            node, x, *k = (np.concatenate(c) for c in zip(*held, strict=True))
            new = np.zeros(len(x), bool)
            for c in k:
                new[1:] |= c[1:] != c[:-1]
            stop = len(x) if last else int(np.flatnonzero(new)[-1]) if new.any() else 0
            held[:] = [] if last else [[c[stop:] for c in (node, x, *k)]]
            label = forest(x[:stop].view(np.uint64), np.cumsum(new)[:stop], radius)
            i = np.flatnonzero(label != np.arange(stop))
            return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[label[i]])], ["a", "b"])

        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            if sum(len(x[0]) for x in held) >= 40_000:
                yield done(False)
        if held:
            yield done(True)

    return dealt.mapInArrow(work, "a long, b long").distinct()


def links(fps: DataFrame, radius: int = 4, group_rows: int = 20_000) -> DataFrame:
    """(a, b) whose connected components are those of all pairs of distinct fingerprints within the radius."""
    n = fps.count()
    m = key_blocks(n, radius)
    edges = [64 * i // m for i in range(m + 1)]
    block = [F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << edges[i + 1] - edges[i]) - 1)) for i in range(m)]
    keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(*[block[i] for i in c]).alias("key")) for t, c in enumerate(itertools.combinations(range(m), m - radius))]
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select(F.col("fp").alias("node"), "fp", "k.t", "k.key")
    return group_links(keyed, ["t", "key"], radius, group_rows, n)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an undirected graph, root its component's smallest node."""
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, before = materialize(both, "edges"), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        each = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = each.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = each.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialize(small, "small-star")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4, group_rows: int = 20_000) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row."""
    rows = materialize(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    found = components(links(fps.select("fp"), radius, group_rows))
    linked = found.unionByName(found.select(F.col("root").alias("node"), "root")).distinct().withColumnRenamed("node", "fp")
    linked = materialize(linked.join(fps.select("fp", "least"), "fp"), "linked")
    roots = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = fps.join(linked.select("fp", "root").join(roots, "root").drop("root"), "fp", "left").select("fp", "n", F.coalesce("component", "least").alias("component_id"))
    often = F.col("n") * 1000 > rows.count()  # a thousand fingerprints at most can have over a thousandth of the rows
    hot = F.broadcast(named.where(often).drop("n"))
    every = rows.join(hot, "fp").unionByName(rows.join(hot, "fp", "left_anti").join(named.where(~often).drop("n"), "fp"))
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
