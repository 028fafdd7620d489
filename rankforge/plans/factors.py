"""Queries of principal components and of truncated SVD; their values are tested against numpy, SQL cannot say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.functions.text import hash_split
from rankforge.operators import factors, ranking
from rankforge.plans.registry import query, t


def _lists(spark, d):
    """Each customer's parts by ordered quantity, at most 200, and whether it is a training row."""
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").cast("string").alias("part"), "l_quantity").join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    lists = ranking.rank_normalize(x, "o_custkey", "part", "l_quantity", 200)
    return factors.written(lists.withColumn("train", hash_split(F.col("o_custkey").cast("string"), 0.8, 0.1) == "train"), "lists")


def _named(embedded):
    return embedded.select(F.col("row").cast("long").alias("o_custkey"), F.col("v").alias("components"))


@query()
def rank_pca(spark, d):
    """128 principal components of inverse ranks, fitted on training customers, for all of them."""
    lists = _lists(spark, d)
    found = factors.decompose(factors.rank_entries(lists.where("train"), "o_custkey"), 128, centre=True)
    return _named(factors.embed(factors.rank_entries(lists, "o_custkey"), found))


@query()
def tfidf_svd(spark, d):
    """128 uncentred components of TF-IDF rows with every part as a term, fitted on training customers, for all of them."""
    lists = _lists(spark, d)
    train = lists.where("train")
    idf = factors.written(factors.smooth_idf(train, "o_custkey", "genes"), "idf")
    found = factors.decompose(factors.tfidf(train, "o_custkey", "genes", idf), 128, centre=False)
    return _named(factors.embed(factors.tfidf(lists, "o_custkey", "genes", idf), found))
