import random
from collections import Counter

from pyspark.sql import functions as F
from rankforge.operators import grouping


def quota(n, train, validation):
    """Target counts, as plain arithmetic."""
    a = max(1, int(n * train + 1e-9))
    b = 0 if n < 10 else max(1, int(n * validation + 1e-9))
    b = min(b, max(0, n - a))
    if n >= 3 and n - a - b == 0 and a > 1:
        a -= 1
    if n >= 10 and b == 0 and a > 1:
        a, b = a - 1, b + 1
    return [a, b, n - a - b]


def plain(entries, train, validation):
    """The whole rule over lists, one group after another."""
    groups, totals = {}, Counter(x for _, x in entries)
    for g, x in entries:
        groups.setdefault(g, Counter())[x] += 1
    rare = {g: round(sum(n / totals[x] for x, n in c.items()), 9) for g, c in groups.items()}
    order = sorted(groups, key=lambda g: (-max(groups[g].values()), -rare[g], -sum(groups[g].values()), g is None, g or ""))
    want, all_of = {x: quota(n, train, validation) for x, n in totals.items()}, quota(len(entries), train, validation)
    filled, held, out = [0] * 3, {x: [0] * 3 for x in totals}, {}
    for g in order:
        n, costs = sum(groups[g].values()), []
        for s in range(3):
            q = max(1, all_of[s])
            c = filled[s] / q + 4 * (max(0, filled[s] + n - all_of[s]) / q) ** 2 - (0.15 if not filled[s] and all_of[s] else 0)
            for x, k in groups[g].items():
                w = want[x][s]
                c += k / n * (0.35 * held[x][s] / w + 1.5 * (max(0, held[x][s] + k - w) / w) ** 2) if w else 0.15 * k / n
            costs.append(round(c - max(0, all_of[s] - filled[s]) / len(entries) * 0.05, 12))
        s = costs.index(min(costs))
        filled[s] += n
        for x, k in groups[g].items():
            held[x][s] += k
        out[g] = ("train", "val", "test")[s]
    return out


def test_assign_is_the_plain_fold(spark, monkeypatch):
    r = random.Random(5)
    monkeypatch.setattr(grouping, "BLOCK", 7)  # several blocks of letters
    for n, labels in ((30, 3), (200, 2), (400, 6)):
        entries = [(f"g{r.randrange(n)}", r.choice([f"l{i}" for i in range(labels)])) for _ in range(3 * n)]
        entries += [(f"one{i}", "l0") for i in range(n)] + [("hot", "l1")] * n  # many groups alike, and a large one
        df = spark.createDataFrame(entries, "g string, x string").repartition(5)
        got = {row["g"]: row["split"] for row in grouping.assign(df, "g", "x", 0.8, 0.1).collect()}
        assert got == plain(entries, 0.8, 0.1)


def test_nulls_several_ways_and_nothing(spark):
    entries = [(None, "a"), (None, None), ("g", None), ("h", "a"), ("h", "a"), ("i", "b")] * 3
    df = spark.createDataFrame(entries, "g string, x string")
    got = {row["g"]: row["split"] for row in grouping.assign(df, "g", "x", 0.8, 0.1).collect()}
    assert set(got) == {None, "g", "h", "i"} and grouping.split_rows(df, "g", "x", 0.8, 0.1).count() == len(entries)
    both = df.select("x", F.explode(F.array(F.struct(F.lit("p").alias("way"), "g"), F.struct(F.lit("q").alias("way"), F.col("x").alias("g")))).alias("s")).select("x", "s.*")
    found = grouping.assign(both, "g", "x", 0.8, 0.1, by="way").collect()
    assert {row["g"]: row["split"] for row in found if row["by"] == "p"} == got  # each way is dealt as if alone
    assert {row["by"] for row in found} == {"p", "q"} and sum(row["size"] for row in found) == 2 * len(entries)
    assert grouping.assign(df.where("false"), "g", "x", 0.8, 0.1).count() == 0


def test_places(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(500)], "n int").repartition(6)
    got = grouping.places(df, [F.col("n")]).orderBy("place").collect()
    assert [row["place"] for row in got] == list(range(500)) and [row["n"] for row in got] == sorted(row["n"] for row in got)
