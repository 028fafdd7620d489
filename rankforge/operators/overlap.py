"""Overlap joins between sets, and co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def set_overlap(df: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, shared, jaccard) of keys that share an item: an equi-join on the item, not a product of the keys.

    For keys from a small catalogue (as datasets are): an item's pairs number its keys' square.
    """
    x = df.select(key, item).distinct()
    sizes = x.groupBy(key).agg(F.count("*").alias("n"))
    a, b = x.select(F.col(key).alias("a"), item), x.select(F.col(key).alias("b"), item)
    shared = a.join(b, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    with_sizes = shared.join(sizes.select(F.col(key).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(key).alias("b"), F.col("n").alias("nb")), "b")
    return with_sizes.select("a", "b", "shared", F.bround(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 6).alias("jaccard"))


def missing(visible: DataFrame, required: DataFrame, key: str, item: str) -> DataFrame:
    """Required items that a key does not show."""
    return required.select(key, item).distinct().join(visible.select(key, item), [key, item], "left_anti")
