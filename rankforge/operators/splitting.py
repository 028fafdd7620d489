"""Target counts, stratified and leakage-free grouped splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def target_counts(n: Column, train: float, validation: float) -> tuple[Column, Column, Column]:
    """Rows for train, val and test.

    Train gets floor(n * train) but 1 at least; val none under ten rows, else floor(n * validation) but 1 at least, and
    no more than train leaves. Then train gives one row to an empty test (of three rows or more) and one to an empty
    val (of ten or more), as long as it has two.
    """
    t = F.greatest(F.lit(1), F.floor(n * train + 1e-9)).cast("long")
    v = F.when(n < 10, 0).otherwise(F.greatest(F.lit(1), F.floor(n * validation + 1e-9))).cast("long")
    v = F.least(v, F.greatest(F.lit(0), n - t)).cast("long")
    t, v = F.when(n <= 0, 0).otherwise(t), F.when(n <= 0, 0).otherwise(v)
    to_test = ((n >= 3) & (n - t - v == 0) & (t > 1)).cast("long")
    to_val = ((n >= 10) & (v == 0) & (t - to_test > 1)).cast("long")
    t, v = t - to_test - to_val, v + to_val
    return t.cast("long"), v.cast("long"), (n - t - v).cast("long")


def stratified_split(df: DataFrame, sample: str, label: str, seed: str, train: float, validation: float) -> DataFrame:
    """Each label's rows in hash order, dealt out by the label's target counts.

    A rank within a hot label is counted in hash buckets and shifted by the buckets before, so no label meets in a task.
    """
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col(sample).cast("string")), 256)
    x = df.select(sample, label, h.alias("__h")).withColumn("__b", F.substring("__h", 1, 3))
    counts = x.groupBy(label, "__b").agg(F.count("*").alias("__n"))
    by = W.partitionBy(label)
    counts = counts.select(label, "__b", F.coalesce(F.sum("__n").over(by.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__n").over(by).alias("__all"))
    ranked = x.withColumn("__rn", F.row_number().over(W.partitionBy(label, "__b").orderBy("__h", sample))).join(counts, [label, "__b"])
    rank, (t, v, _) = F.col("__rn") + F.col("__before"), target_counts(F.col("__all"), train, validation)
    return ranked.select(sample, label, F.when(rank <= t, "train").when(rank <= t + v, "val").otherwise("test").alias("split"))


def deal(histogram: dict[int, int], train: float, validation: float) -> list[tuple]:
    """(size, rank from, rank to, splits in turn): the greedy fold over groups by falling size, in runs of equal size.

    The next group goes to the split furthest below its target. Within a run each pick lowers a deficit by the same size,
    so picks repeat with period one, two or three; whole stretches are dealt at once, with a margin before each change.
    """
    total = sum(n * c for n, c in histogram.items())
    targets, fill, runs = [total * train, total * validation, total * round(1 - train - validation, 9)], [0.0] * 3, []

    def picks(n: int, count: int) -> list[int]:
        d, out = list(fill), []
        for _ in range(count):
            a, b, c = (t - x for t, x in zip(targets, d, strict=True))
            out.append(0 if a >= b and a >= c else 1 if b >= c else 2)
            d[out[-1]] += n
        return out

    for n in sorted(histogram, reverse=True):
        rank, left = 0, histogram[n]
        while left:
            d, turn = [t - x for t, x in zip(targets, fill, strict=True)], picks(n, 3)
            if n:
                one = int((d[turn[0]] - max(d[i] for i in range(3) if i != turn[0])) // n) - 1
                two = int((min(d[i] for i in turn[:2]) - min(d[i] for i in range(3) if i not in turn[:2])) // n) - 2 if turn[0] != turn[1] else 0
                p, times = (1, one) if one > 0 else (2, two) if two > 0 else (3, left // 3) if len(set(turn)) == 3 else (1, 1)
            else:
                p, times = 1, left
            times = min(times, left // p)
            if not times:
                p, times = 1, 1
            for i in turn[:p]:
                fill[i] += n * times
            runs.append((n, rank, rank + p * times, turn[:p]))
            rank, left = rank + p * times, left - p * times
    return runs


def grouped_split(groups: DataFrame, group: str, size: str, train: float, validation: float) -> DataFrame:
    """Whole groups to splits, largest first (ties by group), each to the split that lies furthest below its target.

    One rule at any number of groups: the driver sees only the histogram of sizes (under sqrt(2 x rows) of them), and a
    group finds its split by its place in the distributed order.
    """
    from rankforge.operators.grouping import places

    spark = groups.sparkSession
    histogram = {r["n"]: r["c"] for r in groups.groupBy(F.col(size).alias("n")).agg(F.count("*").alias("c")).collect()}
    runs, by_size, before, at = deal(histogram, train, validation), {}, {}, 0
    for n, a, b, turn in runs:
        by_size.setdefault(n, []).append((a, b, [("train", "val", "test")[i] for i in turn]))
    for n in sorted(histogram, reverse=True):
        before[n], at = at, at + histogram[n]
    plan = spark.createDataFrame([(n, before[n], r) for n, r in by_size.items()], "n long, before long, runs array<struct<a: long, b: long, turn: array<string>>>")
    placed = places(groups.select(F.col(group).alias("g"), F.col(size).cast("long").alias("n")), [F.col("n").desc(), F.col("g").asc_nulls_last()])
    placed = placed.join(plan, "n").withColumn("rank", F.col("place") - F.col("before"))
    run = F.filter("runs", lambda r: (r["a"] <= F.col("rank")) & (F.col("rank") < r["b"]))[0]
    return placed.withColumn("run", run).select(F.col("g").cast("string").alias(group), F.expr("run.turn[cast((rank - run.a) % size(run.turn) as int)]").alias("split"))


def leaks(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that lie in more than one split."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")
