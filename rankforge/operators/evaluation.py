"""Clustering and classification measures from sums, without pairs of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from rankforge.functions.scores import dot


def silhouette(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Cosine silhouette of each row: its distances to a cluster sum to size - x . (sum of the cluster's unit vectors)."""
    x = df.select(key, label, F.transform(vector, lambda v: v.cast("double")).alias("v"))
    x = x.withColumn("n", F.sqrt(dot(F.col("v"), F.col("v")))).select(key, label, F.expr("transform(v, e -> e / n)").alias("v"))
    dims = x.select(label, F.posexplode("v").alias("d", "e")).groupBy(label, "d").agg(F.sum("e").alias("s"))
    sums = dims.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda p: p["s"]).alias("s"))
    sums = sums.join(x.groupBy(label).agg(F.count("*").alias("size")), label).select(F.col(label).alias("c"), "s", "size")
    clusters = F.broadcast(sums.agg(F.collect_list(F.struct("c", "s", "size")).alias("cs")))  # one row: a vector a cluster
    own = F.expr(f"filter(cs, z -> z.c = {label})[0]")
    every = x.crossJoin(clusters).withColumn("own", own)  # with a single row
    a = F.when(F.col("own.size") > 1, (F.col("own.size") - dot(F.col("v"), F.col("own.s"))) / (F.col("own.size") - 1))
    b = F.array_min(F.transform(F.expr(f"filter(cs, z -> z.c <> {label})"), lambda z: (z["size"] - dot(F.col("v"), z["s"])) / z["size"]))
    return every.select(key, label, a.alias("a"), b.alias("b")).select(key, label, F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings."""
    c = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows, cols, total = F.sum("n").over(W.partitionBy(a)), F.sum("n").over(W.partitionBy(b)), F.sum("n").over(W.partitionBy())
    c = c.select(a, b, "n", rows.alias("r"), cols.alias("k"), total.alias("t"))
    pairs = lambda x: x * (x - 1) / 2
    p = c.agg(F.sum(pairs(F.col("n"))).alias("nn"), F.sum(F.col("n") / F.col("r") * pairs(F.col("r"))).alias("rr"), F.sum(F.col("n") / F.col("k") * pairs(F.col("k"))).alias("kk"), F.max(pairs(F.col("t"))).alias("tt"), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / F.col("r") / F.col("k"))).alias("mi"), (-F.sum(F.col("n") / F.col("t") * F.log(F.col("r") / F.col("t")))).alias("hr"), (-F.sum(F.col("n") / F.col("t") * F.log(F.col("k") / F.col("t")))).alias("hk"))
    expected = F.col("rr") * F.col("kk") / F.col("tt")
    return p.select(((F.col("nn") - expected) / ((F.col("rr") + F.col("kk")) / 2 - expected)).alias("ari"), (2 * F.col("mi") / (F.col("hr") + F.col("hk"))).alias("nmi"))


def class_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each label of either side, from the confusion counts."""
    c = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    sides = c.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), "n", (F.col(truth) == F.col(predicted)).alias("hit"))
    s = sides.groupBy(F.col("x.label").alias("label")).agg(F.sum(F.col("x.t") * F.col("n")).alias("support"), F.sum(F.col("x.p") * F.col("n")).alias("picked"), F.sum(F.when(F.col("hit"), F.col("x.t") * F.col("n")).otherwise(0)).alias("hits"))
    return s.withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("support") + F.col("picked")), F.lit(0.0)))
