import hashlib
import random

from pyspark.sql import functions as F
from rankforge.operators import sampling


def u(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:12], 16) / 281474976710655.0


def plain(items, key, seed, dropout, swap, most):
    gone = int(len(items) * (dropout[0] + (dropout[1] - dropout[0]) * u(seed, key, "rate")))
    out = set(sorted(range(len(items)), key=lambda i: (u(seed, key, "drop", i), i))[:gone])
    x = [v for i, v in enumerate(items) if i not in out]
    for i in range(len(x) - 1):  # one after another: an item can travel
        if u(seed, key, "swap", i) < swap:
            x[i], x[i + 1] = x[i + 1], x[i]
    return x[: most[0] + int(u(seed, key, "length") * (most[1] - most[0] + 1))]


def test_augmentation_is_the_plain_loop_at_any_partitioning(spark):
    rows = [(i, [f"g{j}" for j in range(i % 31)]) for i in range(60)]
    want = {k: plain(v, k, "s", (0.1, 0.3), 0.5, (4, 25)) for k, v in rows}
    df = spark.createDataFrame(rows, "k long, v array<string>")
    for parts in (1, 40):
        got = df.repartition(parts).select("k", sampling.augmented(F.col("v"), F.col("k"), "s", swap=0.5, most=(4, 25)).alias("v")).collect()
        assert {r["k"]: r["v"] for r in got} == want


def test_names_are_the_nested_loop(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("ab _") for _ in range(n))
    aliases = [(word(r.randrange(7)), f"n{i % 5}", i) for i in range(12)]
    values = [word(r.randrange(9)) for _ in range(80)] + ["zz", None, "a" * 40]
    norm = lambda x: " ".join((x or "").lower().replace("_", " ").split())
    known = {}
    for a, n, _ in aliases:
        known[norm(a)] = n  # the first place, the last name
    known.pop("", None)
    want = {}
    for v in values:
        x = norm(v)
        if x:
            name = known.get(x) or next((n for a, n in known.items() if x in a or a in x), None)
            if name:
                want[v] = name
    df = spark.createDataFrame([(v,) for v in values], "value string").repartition(3)
    table = spark.createDataFrame(aliases, "alias string, name string, at int")
    resolved = sampling.resolve_names(df, table)
    assert {row["value"]: row["name"] for row in resolved.collect()} == want
    plan = resolved._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert sampling.resolve_names(df, table.where("false")).count() == 0


def test_clusters_of_few_labels(spark):
    rows = [(i, "a") for i in range(4)] + [(9, "b"), (None, "a"), (8, None)]
    got = sampling.clusters(spark.createDataFrame(rows, "k long, x string"), "k", "x", 3, 6, "s").collect()
    assert {r["mode"] for r in got} == {"coherent"} and {r["label"] for r in got} == {"a"} and len(got) == 9
    assert sampling.clusters(spark.createDataFrame(rows, "k long, x string").where("false"), "k", "x", 3, 6, "s").count() == 0
    many = spark.createDataFrame([(i, i % 4) for i in range(40)], "k long, x int")
    mixed = [r for r in sampling.clusters(many, "k", "x", 5, 24, "s").collect() if r["mode"] == "mixed"]
    by = {}
    for r in mixed:
        by.setdefault(r["example"], []).append((r["member"], r["label"]))
    assert all(sorted(m for m, _ in v) == [1, 2, 3, 4, 5] and len({x for _, x in v}) == 2 for v in by.values()) and len(by) == 12
    assert len({frozenset(x for _, x in v) for v in by.values()}) == 3  # odd numbers modulo six pairs
