"""Reports over logs: snapshots, survival, operation shares, item use, attribution and pairs that help each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_last(snapshots: DataFrame, order: str, metrics: list[str]) -> DataFrame:
    """One row: each metric at the first and the last snapshot, and how many there are."""
    ends = [f(m, order).alias(f"{m}_{k}") for m in metrics for k, f in (("first", F.min_by), ("last", F.max_by))]
    return snapshots.agg(F.count("*").alias("n"), *ends)


def survival(lives: DataFrame, death: str, score: str) -> DataFrame:
    """One row: rules, those alive, their share (0 without rules) and the mean score."""
    alive = F.count_if(F.col(death).isNull())
    return lives.agg(F.count("*").alias("rules"), alive.alias("alive"), F.coalesce(F.try_divide(alive, F.count("*")), F.lit(0.0)).alias("survival"), F.avg(score).alias("effectiveness"))


def learning_patterns(ops: DataFrame, epoch: str, op: str, shares: dict[str, tuple[str, float]], few: int) -> DataFrame:
    """Each epoch's operations and the names of the patterns whose operation has over its share; 'convergence' under ``few``."""
    counted = ops.groupBy(epoch).agg(F.count("*").alias("n"), *[F.count_if(F.col(op) == k).alias(f"__{name}") for name, (k, _) in shares.items()])
    found = [F.when(F.col(f"__{name}") > F.col("n") * share, F.lit(name)) for name, (_, share) in shares.items()]
    return counted.select(epoch, "n", F.array_compact(F.array(*found, F.when(F.col("n") < few, F.lit("convergence")))).alias("patterns"))


def selection(steps: DataFrame, step: str, ids: str, often: int) -> DataFrame:
    """One row: steps, items a step, and the share of items used over ``often`` times."""
    total = steps.agg(F.count("*").alias("steps"), F.avg(F.size(ids)).alias("mean_used"))
    uses = steps.select(F.explode(ids).alias("i")).groupBy("i").agg(F.count("*").alias("n"))
    return total.crossJoin(uses.agg(F.try_divide(F.count_if(F.col("n") > often), F.count("*")).alias("reused")))  # a row each


def consistency(said: DataFrame, role: str, text: str) -> DataFrame:
    """For each role its non-empty texts, the share of distinct ones, and what is left to 1; texts meet by digests."""
    some = said.where(F.trim(text) != "").groupBy(role, F.sha2(text, 256).alias("h")).agg(F.count("*").alias("n"))
    x = some.groupBy(role).agg(F.sum("n").alias("said"), (F.count("*") / F.sum("n")).alias("diversity"))
    return x.withColumn("repetition", 1 - F.col("diversity"))


def attribution(uses: DataFrame, item: str, section: str, success: Column, value: Column, full: int) -> DataFrame:
    """Each item's uses, success rate, impact (its mean value less that of all other uses) and score: 0.3 of its uses up
    to ``full``, 0.4 of its success, 0.3 of a positive impact."""
    per = uses.groupBy(item, section).agg(F.count("*").alias("n"), F.avg(success.cast("int")).alias("success"), F.sum(value).alias("s"))
    whole = per.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))  # one row
    x = per.crossJoin(F.broadcast(whole))
    rest = F.try_divide(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n"))
    x = x.withColumn("impact", F.coalesce(F.col("s") / F.col("n") - rest, F.lit(0.0)))
    score = 0.3 * F.least(F.col("n") / full, F.lit(1.0)) + 0.4 * F.col("success") + 0.3 * F.greatest(F.lit(0.0), "impact")
    return x.withColumn("score", score).drop("all_n", "all_s")


def synergies(uses: DataFrame, event: str, item: str, value: str, least: int, gain: float) -> DataFrame:
    """Pairs of items of ``least`` shared events or more whose joint mean is over the mean of their own by ``gain``.

    An event's items are few (a step's rules); pairs are made inside an event's distinct list.
    """
    per = uses.groupBy(event).agg(F.array_sort(F.collect_set(item)).alias("__i"), F.avg(value).alias("__m"))
    own = per.select(F.explode("__i").alias("i"), "__m").groupBy("i").agg(F.avg("__m").alias("own"))
    each = per.select("__m", "__i", F.posexplode("__i").alias("at", "a"))
    pairs = each.select("a", F.explode(F.expr("slice(__i, at + 2, size(__i))")).alias("b"), "__m")
    joint = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.avg("__m").alias("joint")).where(F.col("shared") >= least)
    x = joint.join(own.withColumnRenamed("i", "a").withColumnRenamed("own", "own_a"), "a").join(own.withColumnRenamed("i", "b").withColumnRenamed("own", "own_b"), "b")
    x = x.withColumn("synergy", F.col("joint") - (F.col("own_a") + F.col("own_b")) / 2)
    return x.where(F.col("synergy") > gain).select("a", "b", "shared", "synergy")
