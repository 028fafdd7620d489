"""Leak-free splits that follow label quotas, and the choice of what to group by.

Groups come in a fixed order (largest label count, rarity, size, name) and each goes to the split of least cost. The
rule is a fold: a choice depends on all before it. So all that touches rows is distributed (counts, the order, the
look-up of each row's split), and the fold itself sees runs: neighbouring groups of the same size and label counts are
one row, whatever their number, streamed through one task for each way to group with a state of three numbers a label.
Its answer is a letter a group in blocks of ``BLOCK``, which groups join by their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rankforge.operators.splitting import target_counts
from rankforge.sources.scratch import new_path

SPLITS, BLOCK = ("train", "val", "test"), 4096
#: Fixed values of the cost: overshoot of a split, bonus of an empty one, a label's fill and overshoot, a label without a quota, room left.
OVER, EMPTY, LABEL_FILL, LABEL_OVER, NO_QUOTA, ROOM = 4.0, 0.15, 0.35, 1.5, 0.15, 0.05


def places(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with ``place``, from 0 in the given order: a distributed sort, written once, and counts by partition."""
    spark = df.sparkSession
    part = F.spark_partition_id()
    path = new_path(spark, "sorted")
    df.orderBy(*order).withColumn("__part", part).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).write.parquet(path)
    done = spark.read.parquet(path)
    counts = done.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a partition
    before = counts.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return done.join(before, "__part").withColumn("place", F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def profiles(entries: DataFrame, by: str, group: str, label: str, train: float, validation: float) -> DataFrame:
    """by, g, size, most, rarity and labels, array of (label, n, and the label's quotas), of every group."""
    cells = entries.groupBy(F.col(by).alias("by"), F.col(group).alias("g"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    totals = cells.groupBy("by", "label").agg(F.sum("n").alias("all"))
    quotas = totals.select(F.col("by").alias("by0"), F.col("label").alias("label0"), "all", F.array(*target_counts(F.col("all"), train, validation)).alias("quota"))
    cells = cells.join(quotas, F.col("by").eqNullSafe(F.col("by0")) & F.col("label").eqNullSafe(F.col("label0"))).drop("by0", "label0")
    vector = F.array_sort(F.collect_list(F.struct("label", "n", "quota")))  # as many as a group has labels
    return cells.groupBy("by", "g").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.round(F.sum(F.col("n") / F.col("all")), 9).alias("rarity"), vector.alias("labels"))


def in_order(groups: DataFrame) -> DataFrame:
    """Groups with their place: ways to group in turn, then the largest label count, the rarest labels, the size, the name."""
    return places(groups, [F.col("by").asc_nulls_last(), F.col("most").desc(), F.col("rarity").desc(), F.col("size").desc(), F.col("g").asc_nulls_last()])


class Fold:
    """The fold's state, and the split of least cost for the next group."""

    def __init__(self, quotas: list[int], total: int):
        self.quotas, self.total, self.filled, self.held = quotas, max(1, total), [0, 0, 0], {}

    def cost(self, s: int, size: int, labels: list[tuple]) -> float:
        quota, filled = self.quotas[s], self.filled[s]
        over = max(0, filled + size - quota) / max(1, quota)
        cost = filled / max(1, quota) + OVER * over * over
        if filled == 0 and quota > 0:
            cost -= EMPTY
        for label, n, wanted in labels:
            share, want, have = n / max(1, size), wanted[s], self.held.get(label, (0, 0, 0))[s]
            if want > 0:
                over = max(0, have + n - want) / want
                cost += share * (LABEL_FILL * (have / want) + LABEL_OVER * over * over)
            else:
                cost += NO_QUOTA * share
        return cost - max(0, quota - filled) / self.total * ROOM

    def place(self, size: int, labels: list[tuple]) -> int:
        costs = [self.cost(s, size, labels) for s in range(3)]
        best = costs.index(min(costs))
        self.filled[best] += size
        for label, n, _ in labels:
            self.held.setdefault(label, [0, 0, 0])[best] += n
        return best


def assign(entries: DataFrame, group: str, label: str, train: float, validation: float, by: str | None = None) -> DataFrame:
    """by, g, size, split: the split of every group of every way to group.

    A null group or label counts as a value of its own; an empty table gives an empty result. Of splits of equal cost
    the first wins. Rarity is rounded to nine places, so that the order of sums does not decide.
    """
    entries = entries.select((F.col(by) if by else F.lit("all")).alias("by"), F.col(group).alias("g"), F.col(label).alias("label"))
    placed = in_order(profiles(entries, "by", "g", "label", train, validation))
    wanted = target_counts(F.col("total"), train, validation)
    totals = placed.groupBy("by").agg(F.sum("size").alias("total"), F.count("*").alias("n")).select(F.col("by").alias("by1"), "total", F.col("n").alias("groups"), F.array(*wanted).alias("quotas"))
    last = placed.select((F.col("place") + 1).alias("place"), F.col("by").alias("by0"), F.col("size").alias("size0"), F.col("labels").alias("labels0"), F.lit(True).alias("there"))
    again = F.coalesce(F.col("there") & F.col("by").eqNullSafe(F.col("by0")) & (F.col("size") == F.col("size0")) & (F.col("labels") == F.col("labels0")), F.lit(False))
    runs = placed.join(last, "place", "left").where(~again).select("by", "place", "size", "labels")
    runs = runs.join(totals, F.col("by").eqNullSafe(F.col("by1"))).drop("by1")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, open_run, first, letters = object(), None, None, 0, []

        def close(end: int) -> None:
            size, labels, at = open_run
            letters.extend("tve"[state.place(size, labels)] for _ in range(end - at))

        def blocks(whole: bool):
            """Letters up to the last whole block, or all."""
            nonlocal first
            while letters and (whole or len(letters) >= BLOCK - first % BLOCK):
                n = BLOCK - first % BLOCK
                part = "".join(letters[:n])
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([first // BLOCK], pa.int64()), pa.array([first], pa.int64()), pa.array([part], pa.string())], ["by", "block", "first", "letters"])
                del letters[:n]
                first += len(part)

        end = None
        for b in batches:
            for r in b.to_pylist():
                if r["by"] != now:
                    if open_run:
                        close(end)
                        yield from blocks(True)
                    now, state, open_run, first = r["by"], Fold(r["quotas"], r["total"]), None, r["place"]
                    end = first + r["groups"]
                if open_run:
                    close(r["place"])
                    yield from blocks(False)
                open_run = (r["size"], [(x["label"], x["n"], x["quota"]) for x in r["labels"]], r["place"])
        if open_run:
            close(end)
            yield from blocks(True)

    runs = runs.withColumn("by", F.col("by").cast("string")).repartition("by").sortWithinPartitions("by", "place")
    chosen = runs.mapInArrow(fold, "by string, block long, first long, letters string")
    found = placed.withColumn("by", F.col("by").cast("string")).withColumn("block0", F.expr(f"place div {BLOCK}"))
    found = found.join(chosen.withColumnRenamed("by", "by0"), F.col("by").eqNullSafe(F.col("by0")) & (F.col("block0") == F.col("block")))
    letter = F.expr("substr(letters, int(place - first) + 1, 1)")
    return found.select("by", "g", "size", F.when(letter == "t", "train").when(letter == "v", "val").otherwise("test").alias("split"))


def split_rows(df: DataFrame, group: str, label: str, train: float, validation: float) -> DataFrame:
    """The rows with ``split``, that of their group."""
    chosen = assign(df, group, label, train, validation).select(F.col("g").alias("__g"), "split")
    return df.join(chosen, df[group].eqNullSafe(chosen["__g"])).drop("__g")


def strategy_report(entries: DataFrame, label: str, ways: dict[str, Column], train: float, validation: float) -> DataFrame:
    """For each way to group entries: its groups, entries a split, the largest ratio error, and a score (squared errors, 10 for each empty split).

    All ways are dealt in one pass; their folds run side by side.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("strategy"), c.cast("string").alias("g")) for k, c in ways.items()])).alias("s")
    dealt = assign(entries.select(F.col(label).alias("label"), each).select("label", "s.*"), "g", "label", train, validation, by="strategy")
    part = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("size"))), F.lit(0))
    got = dealt.groupBy(F.col("by").alias("strategy")).agg(F.count("*").alias("groups"), *[part(s).alias(s) for s in SPLITS])
    total = F.col("train") + F.col("val") + F.col("test")
    off = [F.abs(F.col(s) / total - w) for s, w in zip(SPLITS, (train, validation, 1 - train - validation), strict=True)]
    empty = sum((F.when(F.col(s) == 0, 10.0).otherwise(0.0) for s in SPLITS), F.lit(0.0))
    return got.withColumn("error", F.greatest(*off)).withColumn("score", off[0] * off[0] + off[1] * off[1] + off[2] * off[2] + empty)
