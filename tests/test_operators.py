"""Edge rules of the operators on small rows."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rankforge.functions import scores, text
from rankforge.operators import building, playbook, ranking, splitting, vectors
from rankforge.sources import files
from rankforge.streaming import playbook as stream


def test_target_counts(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 9, 10, 20, 100)], "n long")
    got = df.select(*[c.alias(a) for c, a in zip(splitting.target_counts(F.col("n"), 0.8, 0.1), "tvs", strict=True)]).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0), (1, 0, 1), (2, 0, 1), (7, 0, 2), (8, 1, 1), (16, 2, 2), (80, 10, 10)]


def test_rank_normalize_orders_and_drops_repeats(spark):
    x = spark.createDataFrame([("c", "b", 5.0), ("c", "a", 5.0), ("c", "d", 1.0), ("c", "e", 0.5)], "cell string, gene string, value double")
    assert ranking.rank_normalize(x, "cell", "gene", "value", 3).first()["genes"] == ["a", "b", "d"]


def test_parse_field(spark):
    df = spark.createDataFrame([("LABEL: alpha\nfinal: a:b\nLABEL: beta",), ("no key",), (None,)], "x string")
    got = df.select(text.parse_field(F.col("x"), "LABEL"), text.parse_field(F.col("x"), "FINAL")).collect()
    assert [tuple(r) for r in got] == [("beta", "a:b"), (None, None), (None, None)]


def test_set_f1_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), (["a"], []), (["a", "b"], ["b"])], "a array<string>, b array<string>")
    assert [round(r[0], 4) for r in df.select(scores.set_f1(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.6667]


def test_playbook_fold(spark):
    ops = [("r", 1, "ADD", 0), ("r", 2, "TAG", 2), ("r", 3, "UPDATE", 7), ("r", 4, "TAG", 1), ("z", 5, "TAG", 1), ("q", 6, "ADD", 1), ("q", 7, "REMOVE", 0)]
    got = playbook.fold(spark.createDataFrame(ops, "k string, seq long, op string, amount long"), "k", ["seq"], "op", "amount").collect()
    assert [(r["k"], r["counter"], r["tags"]) for r in got] == [("r", 8, 2)]


def test_runs(spark):
    df = spark.createDataFrame([("u", i, i in (1, 2, 4, 5, 6)) for i in range(8)], "k string, n int, on boolean")
    got = ranking.runs(df, "k", "n", F.col("on"), 3).collect()
    assert [(r["first"], r["last"], r["length"]) for r in got] == [(4, 6, 3)]


def test_grouped_split_keeps_groups_whole(spark):
    g = spark.createDataFrame([(f"g{i}", i) for i in range(1, 12)], "g string, n long")
    got = {r["g"]: r["split"] for r in splitting.grouped_split(g, "g", "n", 0.8, 0.1).collect()}
    assert len(got) == 11 and set(got.values()) == {"train", "val", "test"}


def test_jsonl_repair(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": "p\\\\_q"}\n{"a": "a\\_b"}\n')
    assert sorted(r["a"] for r in files.read_repaired_jsonl(spark, str(tmp_path / "x.jsonl"), "a string").collect()) == ["a\\_b", "p\\_q"]
    (tmp_path / "y.jsonl").write_text('{"a": 1}\n{broken\n')
    assert {r["_corrupt"] for r in files.read_jsonl(spark, str(tmp_path / "y.jsonl"), "a int").collect()} == {None, "{broken"}


def test_stream_windows_append(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 3} 0{i}:00:00", "view", 1.0) for i in range(9)]
    spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    got = stream.run_to_end(stream.event_windows(source), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(r["n"] for r in got.collect()) == [3, 3]  # the last window is still open


def test_fold_stream_equals_batch_fold(spark, tmp_path):
    kinds = ["ADD", "TAG", "UPDATE", "TAG", "REMOVE", "TAG"]
    ops = [(f"k{i * 7 % 5}", i, kinds[i * 11 % 13 % 6], i % 4) for i in range(300)] + [(None, 300, "ADD", 1)]
    schema = "k string, n long, op string, amount long"
    for part in range(3):
        spark.createDataFrame(ops[part * 100 : part * 100 + 100 + (part == 2)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={part}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = stream.upsert_to_end(stream.fold_stream(source, "k", "n", "op", "amount"), f"{tmp_path}/out", f"{tmp_path}/check", "k")
    expected = playbook.fold(spark.createDataFrame(ops[:300], schema), "k", ["n"], "op", "amount")
    rows = sorted((r["k"], r["counter"], r["tags"]) for r in expected.collect())
    assert rows and sorted((r["k"], r["counter"], r["tags"]) for r in got.where("live").collect()) == rows


def test_label_scores(spark):
    pair = lambda a, b: scores.label_pair_score(a, b, {"fibre": ("thread",)}, {"cell": ()}, [("alpha", "beta")])
    df = spark.createDataFrame([("a b", "a b"), ("alpha cell", "beta cell"), ("wool thread", "fibre x"), ("cell one", "cell two"), ("x", "y x z"), ("p", "q")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(pair(F.col("a"), F.col("b"))).collect()] == [1.0, 0.45, 0.85, 0.7, 0.85, 0.0]
    lists = spark.createDataFrame([([], []), (["a"], []), (["a"], ["b", "a"]), (["a", "b"], ["a", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in lists.select(scores.label_field_score(F.col("a"), F.col("b"), pair)).collect()] == [1.0, 0.0, 1.0, 0.5]


def test_choose_strategy(spark):
    names = "strategy string, groups long, train long, val long, test long, error double, score double"
    pick = lambda rows: [tuple(r) for r in building.choose_strategy(spark.createDataFrame(rows, names)).collect()]
    assert pick([("a", 9, 8, 1, 1, 0.01, 0.1), ("b", 20, 8, 1, 1, 0.01, 0.1), ("c", 2, 8, 1, 1, 0.0, 0.0)]) == [("b", "viable", 20)]
    assert pick([("a", 3, 8, 1, 1, 0.1, 0.1), ("b", 3, 10, 0, 0, 0.0, 20.0)]) == [("a", "nonempty", 3)]
    assert pick([("b", 1, 10, 0, 0, 0.2, 20.0)]) == [("b", "any", 1)] and pick([]) == []


def test_neighbours_in_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    rows = [(i, x[i].tolist(), i % 3) for i in range(60)]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 9)
    np.fill_diagonal(sims, -2)
    expected = {i: sorted(range(60), key=lambda j: (-sims[i, j], j))[:4] for i in range(0, 60, 2)}
    for block, size in ((7, 3), (30, 50_000), (4096, 9)):  # more pairs of blocks than tasks
        got = {}
        for r in vectors.neighbours(base.where("vec_id % 2 = 0"), base, 4, block_rows=block, base_rows=size).orderBy("q_id", "rank").collect():
            got.setdefault(r["q_id"], []).append(r["id"])
        assert got == expected
    assert vectors.neighbours(base.where("vec_id < 0"), base, 4).count() == 0


def greedy(sizes, train, validation):
    total = sum(sizes.values())
    targets, fill, out = (total * train, total * validation, total * round(1 - train - validation, 9)), [0, 0, 0], {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        a, b, c = (t - f for t, f in zip(targets, fill, strict=True))
        at = 0 if a >= b and a >= c else 1 if b >= c else 2
        fill[at] += sizes[g]
        out[g] = ("train", "val", "test")[at]
    return out


def test_grouped_split_is_greedy_at_any_number_of_groups(spark):
    r = random.Random(3)
    some = [{f"g{i}": r.choice([1, 1, 1, 2, 3, 40, r.randrange(1, 500)]) for i in range(r.randrange(1, 400))} for _ in range(200)]
    for sizes in some:
        runs, at = splitting.deal(Counter(sizes.values()), 0.8, 0.1), {}
        for n, a, b, turn in runs:
            at.update({(n, k): ("train", "val", "test")[turn[(k - a) % len(turn)]] for k in range(a, b)})
        rank, got = Counter(), {}
        for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
            got[g] = at[sizes[g], rank[sizes[g]]]
            rank[sizes[g]] += 1
        assert got == greedy(sizes, 0.8, 0.1)
    sizes = {f"g{i}": 1 + i % 3 for i in range(100_050)} | {"hot": 100_000}
    df = spark.createDataFrame(list(sizes.items()), "g string, n long")
    assert {x["g"]: x["split"] for x in splitting.grouped_split(df, "g", "n", 0.8, 0.1).collect()} == greedy(sizes, 0.8, 0.1)
