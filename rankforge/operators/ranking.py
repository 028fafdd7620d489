"""Rank, top-k, dedupe, interleave and window operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key; Spark cuts to k before the shuffle too."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def rank_normalize(x: DataFrame, cell: str, gene: str, value: str, k: int) -> DataFrame:
    """Matrix entries to each cell's ordered list of its k strongest distinct genes (ties by gene)."""
    summed = x.groupBy(cell, gene).agg(F.sum(value).alias("__v"))
    ranked = top_k(summed, [cell], [F.col("__v").desc(), F.col(gene)], k)
    return ranked.groupBy(cell).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", gene))), lambda s: s[gene]).alias("genes"))


def inverse_rank(lists: DataFrame, cell: str, genes: str = "genes") -> DataFrame:
    """Long form of n - rank."""
    return lists.select(cell, F.size(genes).alias("n"), F.posexplode(genes).alias("pos", "gene")).select(cell, "gene", (F.col("n") - F.col("pos")).alias("weight"))


def dedupe_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by aggregation (no sort of whole groups)."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def round_robin(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """k rows, taken in turn from the groups in order of name."""
    first = top_k(df, [group], order, k, "turn")  # no group gives more than k
    return first.orderBy("turn", group).limit(k)


def runs(df: DataFrame, key: str, order: str, on: Column, least: int) -> DataFrame:
    """Maximal runs of consecutive rows where ``on`` holds, of ``least`` rows or more."""
    w = W.partitionBy(key).orderBy(order)
    x = df.withColumn("__on", on).withColumn("__n", F.row_number().over(w))
    x = x.where("__on").withColumn("__g", F.col("__n") - F.row_number().over(w))
    got = x.groupBy(key, "__g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))
    return got.where(F.col("length") >= least).drop("__g")


def change_points(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The rows whose value differs from the one before."""
    w = W.partitionBy(key).orderBy(*order)
    x = df.withColumn("__before", F.lag(value).over(w)).withColumn("__n", F.row_number().over(w))
    return x.where((F.col("__n") == 1) | ~F.col("__before").eqNullSafe(F.col(value))).drop("__before", "__n")
