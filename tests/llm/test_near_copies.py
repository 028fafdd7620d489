"""The near-dedup stage against all pairs at a Jaccard similarity of 0.8 of five-word shingles."""

import random
from itertools import combinations

import corpus_pipeline
import pytest
from rankforge.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            a, b = up[a], up[b]
            up = [min(a, b) if u in (a, b) else u for u in up]
    return up


def stay(spark, rows):
    docs = spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in rows], SCHEMA)
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return [(r["doc_id"], r["text"]) for r in out.collect()]


def planted(r, n):
    rows = []
    for g in range(n):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([30, 120, 400]))]
        rows.append((10 * g, " ".join(base)))
        for c in range(r.randrange(4)):
            w = list(base)
            for _ in range(max(1, len(w) * r.choice([1, 2, 3]) // 100)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((10 * g + c + 1, " ".join(w)))
    r.shuffle(rows)
    return rows


def test_planted_near_copies(spark):
    rows = planted(random.Random(1), 60)
    up = groups(rows)
    first = {}
    for (i, _), u in zip(rows, up, strict=True):
        first[u] = min(i, first.get(u, i))
    assert 60 <= len(first) < len(rows)
    assert sorted(i for i, _ in stay(spark, rows)) == sorted(first.values())


def test_rows_without_ids_and_shared_ids(spark):
    text = lambda s: " ".join(f"{s}{j}" for j in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("a")), (7, text("c")), (7, text("d")), (7, text("c")), (3, text("b")), (None, None), (8, "")]
    got = stay(spark, rows)
    assert sorted(got, key=str) == sorted([(None, text("a")), (7, text("c")), (7, text("d")), (3, text("b")), (8, "")], key=str)


@pytest.mark.parametrize("limits", [{"group_rows": 5}, {"group_shingles": 300}])
def test_large_groups_in_chunks(spark, limits):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in ((i, i % 110) for i in range(40))]
    docs = spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in rows], SCHEMA)
    assert [r["doc_id"] for r in near_copies.keep_one(docs, **limits).collect()] == [0]
