"""Cosine retrieval and label transfer over embedding tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F


def neighbours(queries: DataFrame, base: DataFrame, k: int, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block_rows: int = 4096, base_rows: int = 50_000) -> DataFrame:
    """(q_id, q_label, id, label, cosine, rank): the k nearest of the base by cosine, the query's own id excluded, ties by id.

    Both sides are dealt into blocks by hash and each pair of blocks is one group of a task: its queries come first and
    are held, base rows stream past in slices, and a slice gives k candidates a query, which a window merges. Nothing
    passes through the driver. Vectors have one length; rows without an id or a vector take no part.
    """
    spark = queries.sparkSession
    shape = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    q, x = shape(queries), shape(base)
    q_blocks = max(1, -(-q.count() // block_rows))
    x_blocks = max(spark.sparkContext.defaultParallelism, -(-x.count() // base_rows))
    mine = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = q.select(mine(q_blocks).alias("a"), every(x_blocks).alias("b"), F.lit(0).alias("kind"), "*").unionByName(x.select(every(q_blocks).alias("a"), mine(x_blocks).alias("b"), F.lit(1).alias("kind"), "*"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), q_blocks * x_blocks)
    near = dealt.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "kind").mapInArrow(_nearest(k), "q_id long, q_label int, id long, label int, cosine double")
    rank = F.row_number().over(W.partitionBy("q_id").orderBy(F.col("cosine").desc(), "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _nearest(k: int, most: int = 1000):
    """For runs of a group's queries, then its base rows: the k candidates of each slice for each query."""

    def unit(column: pa.Array) -> np.ndarray:
        v = column.flatten().to_numpy().reshape(len(column), -1)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, labels, q = None, [], None, None, None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("a", "b", "kind")], 1)
            cut = np.flatnonzero((np.diff(at, axis=0) != 0).any(1)) + 1
            for i, j in zip([0, *cut], [*cut, len(at)], strict=True):
                if i == j:
                    continue
                if tuple(at[i, :2]) != now:
                    now, held, q = tuple(at[i, :2]), [], None
                part = batch.slice(i, j - i)
                if at[i, 2] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if q is None:
                    ids, labels = (pa.concat_arrays([p.column(c) for p in held]) for c in ("id", "label"))
                    q, own = np.concatenate([unit(p.column("v")) for p in held]), ids.to_numpy()
                part = part.take(pa.array(np.argsort(part.column("id").to_numpy(), kind="stable")))
                x, names = unit(part.column("v")), part.column("id").to_numpy()
                for s in range(0, len(q), most):
                    sims = np.round(q[s : s + most] @ x.T, 9)
                    sims[own[s : s + most, None] == names[None, :]] = -2
                    best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                    row = np.repeat(np.arange(len(best)), best.shape[1])
                    c = sims[row, best.ravel()]
                    row, col, c = row[c > -2] + s, best.ravel()[c > -2], c[c > -2]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), labels.take(pa.array(row)), part.column("id").take(pa.array(col)), part.column("label").take(pa.array(col)), pa.array(c)], ["q_id", "q_label", "id", "label", "cosine"])

    return work


def recall_at(near: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, recall): the share of queries with their own label among the first k."""
    hit = near.groupBy("q_id").agg(*[F.max(((F.col("rank") <= k) & (F.col("label") == F.col("q_label"))).cast("int")).alias(f"k{k}") for k in ks])
    means = hit.agg(*[F.avg(f"k{k}").alias(f"k{k}") for k in ks])
    return means.selectExpr(f"stack({len(ks)}, {', '.join(f'{k}, bround(k{k}, 6)' for k in ks)}) as (k, recall)")


def transfer(near: DataFrame) -> DataFrame:
    """(q_id, q_label, predicted): the label of the greatest sum of 1 / max(distance, 1e-8); ties by the nearest."""
    votes = near.groupBy("q_id", "q_label", "label").agg(F.sum(1 / F.greatest(1 - F.col("cosine"), F.lit(1e-8))).alias("v"), F.min("rank").alias("r"))
    return votes.groupBy("q_id", "q_label").agg(F.max_by("label", F.struct(F.bround("v", 6).alias("v"), -F.col("r"))).alias("predicted"))


def geometry(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(dim, mean, var): population moments of each dimension."""
    x = df.select(F.posexplode(vector).alias("dim", "x"))
    return x.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.var_pop(F.col("x").cast("double")).alias("var"))


def contrastive_loss(df: DataFrame, batch: str, key: str, vector: str, temperature: float) -> DataFrame:
    """Each batch's n and mean normalised temperature-scaled cross entropy; 2i and 2i + 1 are a positive pair.

    A batch is bounded by its caller (as in training), so its members meet in one list; vectors without a partner have
    no loss of their own but stand among the others' negatives.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    member = F.struct(F.col(key).alias("k"), F.col(vector).alias("v"), norm(F.col(vector)).alias("n"))
    x = df.groupBy(batch).agg(F.collect_list(member).alias("all")).select(batch, "all", F.explode("all").alias("me"))
    others = F.filter("all", lambda o: o["k"] != F.col("me.k"))
    x = x.withColumn("s", F.transform(others, lambda o: F.struct(o["k"].alias("k"), (dot(o["v"], F.col("me.v")) / (o["n"] * F.col("me.n")) / temperature).alias("s"))))
    partner = F.when(F.col("me.k") % 2 == 0, F.col("me.k") + 1).otherwise(F.col("me.k") - 1)
    mine = F.try_element_at(F.filter("s", lambda o: o["k"] == partner), F.lit(1))["s"]
    loss = F.log(F.aggregate("s", F.lit(0.0), lambda a, o: a + F.exp(o["s"]))) - mine
    return x.select(batch, loss.alias("loss")).groupBy(batch).agg(F.count("loss").alias("n"), F.avg("loss").alias("loss"))


def kmeans(df: DataFrame, vector: str, k: int, starts: int = 10, seed: int = 0, rounds: int = 100) -> DataFrame:
    """The rows with ``cluster``: Spark's k-means from several starts, the one of the least squared distances; an empty table stays so."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("__v", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    if df.isEmpty():
        return df.withColumn("cluster", F.lit(None).cast("int"))
    fitted = [KMeans(k=k, seed=seed + i, maxIter=rounds, tol=1e-6, featuresCol="__v", predictionCol="cluster").fit(x) for i in range(starts)]
    return min(fitted, key=lambda m: m.summary.trainingCost).transform(x).drop("__v")
