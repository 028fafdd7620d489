"""Grounded task examples from ranked lists and a marker catalog, and the choice of a split's grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rankforge.functions.text import hash_split


def support(ranked: DataFrame, catalog: DataFrame, sample: str, item: str, rank: str, label: str) -> DataFrame:
    """(sample, label, n, items): a label's markers among a sample's ranked items, in rank order. An equi-join on the
    item with partial counts; a sample's items are the few of its ranked list."""
    hits = ranked.join(catalog.select(item, label).distinct(), item)
    got = hits.groupBy(sample, label).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(rank, item))).alias("__x"))
    return got.select(sample, label, "n", F.transform("__x", lambda x: x[item]).alias("items"))


def annotation(supported: DataFrame, gold: DataFrame, sample: str, label: str, least: int = 2, keep: int = 5) -> DataFrame:
    """Samples whose gold label has ``least`` supporting items, with the first ``keep`` of them as evidence."""
    x = supported.join(gold, [sample, label]).where(F.col("n") >= least)
    return x.select(sample, label, F.slice("items", 1, keep).alias("evidence"))


def differential(annotated: DataFrame, supported: DataFrame, priority: DataFrame, sample: str, label: str, order: str, candidates: int = 4) -> DataFrame:
    """The gold label and, in priority order, those labels that the sample's items do not support; two labels at least.

    ``priority`` holds (gold label, candidate, order), so candidates come by an equi-join on the gold label; an
    anti-join drops what the sample supports.
    """
    x = annotated.join(priority, label).where(F.col("candidate") != F.col(label))
    has = supported.select(sample, F.col(label).alias("candidate"))
    x = x.join(has, [sample, "candidate"], "left_anti")
    x = x.withColumn("__r", F.row_number().over(W.partitionBy(sample).orderBy(order, "candidate"))).where(F.col("__r") < candidates)
    got = x.groupBy(sample, label).agg(F.array_sort(F.collect_list(F.struct("__r", "candidate"))).alias("__x"))
    return got.select(sample, label, F.concat(F.array(label), F.transform("__x", lambda v: v["candidate"])).alias("candidates"))


def choose_strategy(report: DataFrame, least_groups: int = 8, most_error: float = 0.18) -> DataFrame:
    """The strategy of the smallest score (then error, most groups, name) among the viable ones, else among those with
    rows in every split, else among all. The report has one row a strategy."""
    full = (F.col("train") > 0) & (F.col("val") > 0) & (F.col("test") > 0)
    mode = F.when(full & (F.col("groups") >= least_groups) & (F.col("error") <= most_error), 0).when(full, 1).otherwise(2)
    key = F.struct(mode.alias("mode"), F.round("score", 9).alias("score"), F.round("error", 9).alias("error"), (-F.col("groups")).alias("few"), "strategy")
    best = report.agg(F.min(key).alias("k"))
    return best.where("k is not null").select("k.strategy", F.element_at(F.array(*map(F.lit, ("viable", "nonempty", "any"))), F.col("k.mode") + 1).alias("mode"), (-F.col("k.few")).alias("groups"))
