"""Hard negatives by a vector-approximation file.

Components are integers, floor(scale * x). Each dimension is cut into cells at quantiles of a bounded sample; a row's
cells, one byte a dimension, are written beside its vector. For a block of anchors a table a dimension gives each
cell's largest and smallest share in the score, so a row's bounds are sums of looked-up numbers. Positives: of the rows
of the anchor's label only those whose upper bound reaches the ``positives``-th best lower bound are scored exactly.
Negatives: of the rows of other labels only those that may lie in a positive's window, and of these only those that may
still be among its first. Anchors meet rows in blocks (anchor block, row block): tasks hold one block of anchors, rows
stream by in slices, a block gives at most a few rows an anchor and window, and windows merge them. All numbers are
exact; the sample decides only how tight bounds are.

Rows with a null label, a null vector, or a null or non-finite component take no part, nor do those without an id (a
result could not name them) and those whose scores might not fit into 64 bits (a squared norm of 2 ** 56 or more). Of
vectors of several lengths the shorter ones are padded by zeros; an empty vector scores zero. Repeated rows count each,
but an anchor's own id is never its positive; ties go to the smaller id. An anchor without positives, or a positive
without negatives, gives no row; neither does a positive with a negative score, whose window is empty. An empty table
gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import materialize

SLICE = 4096


def shifted(rows: DataFrame, *, vec_id: str = "vec_id", label: str = "label", every: int = 7, labels: int = 10) -> DataFrame:
    """The rows with (label + 1) % labels where the id is divisible by ``every``."""
    return rows.withColumn(label, F.when(F.col(vec_id) % every == 0, (F.col(label) + 1) % labels).otherwise(F.col(label)))


def matrix(column: pa.Array, dim: int, kind) -> np.ndarray:
    """Binary values as rows of ``dim`` numbers, the shorter ones padded by zeros."""
    values, size = column.to_pylist(), dim * np.dtype(kind).itemsize
    return np.frombuffer(b"".join(v if len(v) == size else v.ljust(size, b"\0") for v in values), kind).reshape(len(values), dim)


class Cells:
    """Where each dimension is cut; the outer cells end at the smallest and the largest component of all rows."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int):
        at = np.arange(1, cells) / cells
        self.low, self.high, self.edges = low, high, []
        for d in range(len(low)):
            x = np.sort(sample[:, d]) if len(sample) else low[d : d + 1]
            self.edges.append(np.unique(x[(at * len(x)).astype(int)]))

    def code(self, v: np.ndarray) -> np.ndarray:
        out = np.empty(v.shape, np.uint8)
        for d, e in enumerate(self.edges):
            out[:, d] = np.searchsorted(e, v[:, d], "right")
        return out

    def ends(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The smallest and the largest integer of each cell of a dimension."""
        e = self.edges[d].astype(float)
        return np.append(min(self.low[d], *e[:1]), e), np.append(e - 1, max(self.high[d], *e[-1:]))


class Anchors:
    """A block of anchors and its lookup tables."""

    def __init__(self, cells: Cells, q: np.ndarray):
        self.q = q.astype(np.int64)
        f = self.q.astype(float)
        self.upper, self.lower, most = [], [], np.zeros(len(q))
        for d in range(q.shape[1]):
            a, b = cells.ends(d)
            x, y = a[:, None] * f[:, d], b[:, None] * f[:, d]
            self.upper.append(np.maximum(x, y).astype(np.float32))
            self.lower.append(np.minimum(x, y).astype(np.float32))
            most += np.abs(f[:, d]) * max(abs(a[0]), abs(b[-1]))
        self.slack = (q.shape[1] + 4) * 2.0**-23 * most  # what adding up in 32 bits may lose

    def bounds(self, codes: np.ndarray, tables: list[np.ndarray], of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Sums of looked-up shares, (rows, anchors)."""
        total = np.zeros((len(codes), len(self.q[of])), np.float32)
        for d, t in enumerate(tables):
            total += np.take(t[:, of], codes[:, d], axis=0)
        return total

    def low(self, codes: np.ndarray, j: int) -> np.ndarray:
        return sum((t[codes[:, d], j].astype(float) for d, t in enumerate(self.lower)), np.zeros(len(codes))) - self.slack[j]

    def exact(self, v: np.ndarray, j: int) -> np.ndarray:
        return v.astype(np.int64) @ self.q[j]


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def positives_in(anchors: Anchors, a: dict, rows: dict, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, 0, row, score): the block's first rows of the anchor's label."""
    for label in np.unique(a["label"]):
        at, of = np.flatnonzero(rows["label"] == label), np.flatnonzero(a["label"] == label)
        if not len(at):
            continue
        codes = rows["cells"][at]
        upper, lower = anchors.bounds(codes, anchors.upper, of), anchors.bounds(codes, anchors.lower, of)
        for c, j in enumerate(of):
            other = np.flatnonzero(rows["vec_id"][at] != a["vec_id"][j])
            low = lower[other, c] - anchors.slack[j]
            least = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            near = at[other[upper[other, c] + anchors.slack[j] >= least]]
            score = anchors.exact(rows["v"][near], j)
            for i in best(score, rows["vec_id"][near], k):
                yield j, 0, near[i], score[i]


def negatives_in(anchors: Anchors, a: dict, rows: dict, k: int, share: tuple[int, int]) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, positive score, row, score): for each window the block's first rows of other labels."""
    below, whole = share
    upper = anchors.bounds(rows["cells"], anchors.upper)
    for j, windows in enumerate(a["windows"]):
        windows = [p for p in windows if p >= 0]
        if not windows:
            continue
        slack = anchors.slack[j]
        near = np.flatnonzero((upper[:, j] + slack >= min(windows) * below / whole - 1) & (rows["label"] != a["label"][j]))
        up, low = upper[near, j] + slack, anchors.low(rows["cells"][near], j)
        wanted = np.zeros(len(near), bool)
        for p in windows:
            least = -(-below * p // whole)
            may = (up >= least) & (low <= p)
            sure = low[(low >= least) & (up <= p)]  # in the window whatever the score: the k-th best of these is a bar
            if len(sure) >= k:
                may &= up >= np.partition(sure, len(sure) - k)[len(sure) - k]
            wanted |= may
        near = near[wanted]
        score = anchors.exact(rows["v"][near], j)
        for p in windows:
            inside = np.flatnonzero((score >= -(-below * p // whole)) & (score <= p))
            for i in inside[best(score[inside], rows["vec_id"][near[inside]], k)]:
                yield j, p, near[i], score[i]


def scan(index: DataFrame, anchors: DataFrame, cells: Cells, judge, k: int, anchor_block: int, row_block: int) -> DataFrame:
    """key, window, vec_id, score: what ``judge`` gives for every (anchor block, row block), ``k`` an anchor and window at most."""
    spark = index.sparkSession
    n_rows, n_anchors = index.count(), anchors.count()
    a_blocks = max(1, -(-n_anchors // anchor_block))
    r_blocks = max(spark.sparkContext.defaultParallelism, -(-n_rows // row_block))
    shared = spark.sparkContext.broadcast(cells)
    dim = len(cells.low)
    block = lambda salt, n: F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = anchors.select(block(1, a_blocks).alias("a"), all_of(r_blocks).alias("r"), F.lit(0).alias("kind"), "key", "vec_id", "label", "v", F.lit(None).cast("binary").alias("cells"), "windows")
    each = index.select(all_of(a_blocks).alias("a"), block(2, r_blocks).alias("r"), F.lit(1).alias("kind"), "key", "vec_id", "label", "v", "cells", F.lit(None).cast("array<long>").alias("windows"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mine, tables, found = None, [], None, []

        def merged(rows: list) -> list:
            """The first k of each anchor and window."""
            rows.sort(key=lambda x: (x[0], x[1], -x[3], x[2]))
            return [x for i, x in enumerate(rows) if i < k or rows[i - k][:2] != x[:2]]

        def done():
            columns = list(zip(*merged(found), strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "window", "vec_id", "score"])

        for b in batches:
            at = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "r", "kind")], 1)
            cut = np.flatnonzero((np.diff(at, axis=0) != 0).any(1)) + 1
            for x, y in zip([0, *cut], [*cut, len(at)], strict=True):
                group, kind = tuple(at[x, :2]), at[x, 2]
                if group != now:
                    if found:
                        yield done()
                    now, mine, tables, found = group, [], None, []
                part = b.slice(x, y - x)
                if kind == 0:
                    mine.append(part)
                    continue
                if not mine:
                    continue
                if tables is None:
                    held = pa.Table.from_batches(mine)
                    a = {c: held.column(c).to_numpy() for c in ("key", "vec_id", "label")} | {"windows": held.column("windows").to_pylist()}
                    tables = Anchors(shared.value, matrix(held.column("v"), dim, "<i4"))
                for s in range(0, len(part), SLICE):
                    p = part.slice(s, SLICE)
                    rows = {c: p.column(c).to_numpy() for c in ("vec_id", "label")} | {"v": matrix(p.column("v"), dim, "<i4"), "cells": matrix(p.column("cells"), dim, np.uint8)}
                    found += [(int(a["key"][j]), int(w), int(rows["vec_id"][i]), int(score)) for j, w, i, score in judge(tables, a, rows)]
                    if len(found) > 500_000:
                        found = merged(found)
        if found:
            yield done()

    dealt = one.unionByName(each)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), a_blocks * r_blocks)
    return dealt.repartition(parts, "a", "r").sortWithinPartitions("a", "r", "kind").mapInArrow(work, "key long, window long, vec_id long, score long")


def build(rows: DataFrame, vec_id: str, label: str, vector: str, scale: int, anchors: str, sampled: int, cells: int) -> tuple[DataFrame, Cells]:
    """The written index (key, vec_id, label, anchor, v, cells) of all rows that take part, and its cells."""
    spark = rows.sparkSession
    taking = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.expr(anchors).alias("anchor"), F.col(vector).cast("array<double>").alias("x"))
    taking = taking.where("vec_id is not null and label is not null and x is not null and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    taking = taking.where(F.aggregate("x", F.lit(0.0), lambda s, c: s + (F.abs(c * scale) + 1) * (F.abs(c * scale) + 1)) < 2.0**56)
    whole = taking.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", "anchor", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))
    size = whole.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    dim = size["dim"] or 0

    def numbers(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column("v")
        n, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
        out = np.zeros((len(n), dim), np.int32)
        out[np.arange(dim)[None, :] < n[:, None]] = flat
        return out

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            if len(b):
                v = numbers(b)
                low = v.min(0) if low is None else np.minimum(low, v.min(0))
                high = v.max(0) if high is None else np.maximum(high, v.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(low), pa.array(high)], ["d", "low", "high"])

    ends = whole.select("v").mapInArrow(extremes, "d int, low int, high int").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()  # a row a dimension
    drawn = whole.select("v").sample(min(1.0, 1.2 * sampled / max(1, size["n"])), seed=42).limit(sampled).collect()
    sample = np.zeros((len(drawn), dim), np.int64)
    for i, r in enumerate(drawn):
        sample[i, : len(r["v"])] = r["v"]
    made = Cells(sample, np.array([r["low"] for r in ends], float), np.array([r["high"] for r in ends], float), cells)
    shared = spark.sparkContext.broadcast(made)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = numbers(b)
            codes = shared.value.code(v)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "vec_id", "label", "anchor")), pa.array([x.tobytes() for x in v.astype("<i4")], pa.binary()), pa.array([x.tobytes() for x in codes], pa.binary())], ["key", "vec_id", "label", "anchor", "v", "cells"])

    return materialize(whole.mapInArrow(encode, "key long, vec_id long, label long, anchor boolean, v binary, cells binary"), "approximations"), made


def mine(rows: DataFrame, *, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", anchors: str = "vec_id % 100 = 0", scale: int = 256, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), cells: int = 64, sampled: int = 20_000, anchor_block: int = 1024, row_block: int = 50_000) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on vec_id and label; ``share``: a negative's score is from share[0] / share[1] of the
    positive's up to the positive's own. ``sampled`` rows at most give the cells' ends, 2 to 256 a dimension.
    """
    index, made = build(rows, vec_id, label, vector, scale, anchors, sampled, cells)
    asked = index.where("anchor").select("key", "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("windows"))
    near = scan(index, asked, made, lambda t, a, r: positives_in(t, a, r, positives), positives, anchor_block, row_block)
    first = lambda by, k: F.row_number().over(W.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id")) <= k
    near = materialize(near.withColumn("in", first(["key"], positives)).where("in").select("key", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    windows = near.groupBy("key").agg(F.collect_set("positive_score").alias("windows"))  # ``positives`` scores at most
    asked = index.where("anchor").select("key", "vec_id", "label", "v").join(windows, "key").select("key", "vec_id", "label", "v", "windows")
    far = scan(index, asked, made, lambda t, a, r: negatives_in(t, a, r, negatives, share), negatives, anchor_block, row_block)
    rank = F.row_number().over(W.partitionBy("key", "window").orderBy(F.col("score").desc(), "vec_id"))
    far = far.withColumn("rank", rank).where(F.col("rank") <= negatives)
    found = near.join(far, (near["key"] == far["key"]) & (near["positive_score"] == far["window"])).drop(far["key"])
    named = found.join(index.where("anchor").select("key", F.col("vec_id").alias("anchor_id")), "key")
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH rows_of AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows_of a JOIN rows_of b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""
