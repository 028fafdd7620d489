"""Operators 11 to 13, and what changed in 5, against brute force."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from rankforge.llm import decontaminate, hard_negatives, near_copies, phrases, pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
TEXTS = ["mail ann.lee{0}@mail{1}.example.org now", "host 10.{0}.{1}.7 is up", "pay 4539 5787 6362 1486 by {0}{1}", "card 4539578763621486 end {0}", "call +1 (4{0}7) 555-0{1}9 soon", "token {0}{1}3344 and 20{0}1 words", "v1.{0}.{1} came on 2021-0{0}-1{1}", "no data here at all {0}"]


def checked(t):
    """The patterns as they are stated."""
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            bad = k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (16 <= len(d) <= 19 and pii.luhn(d)) or k == 3 and not 8 <= len(d) <= 15
            if not bad:
                out.append((k, *m.span()))
    return out


def corpus(n, seed):
    r = random.Random(seed)
    words = "the ble ou rier enth stion and thand reha".split()
    some = lambda: " ".join(r.choices(words, k=r.randrange(3, 9)))
    return [f"{some()} {r.choice(TEXTS).format(r.randrange(1, 9), r.randrange(1, 9))} {some()}" for _ in range(n)]


def test_base_spans_are_the_patterns():
    r = random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choices("a1.@-+ (9%_é0\n", k=r.randrange(40)))
        assert pii.base_spans(t) == checked(t)
    for t in ("1" * 50_000, "a@" * 20_000, "1.2.3" * 10_000, "+1 " * 20_000, "a" * 50_000 + "@"):
        assert pii.base_spans(t) == [] or len(t) < 60_001


def model():
    return pii.fit(corpus(240, 1), steps=60)


@pytest.fixture(scope="module")
def learned():
    return model()


def test_decoding_is_the_best_of_all_segmentations(learned):
    def total(t, tokens, parts):
        """The score of one segmentation, (kind or None, first token, end token) by part."""
        k, s, before = len(pii.KINDS), 0.0, len(pii.KINDS)
        for y, i, j in parts:
            now = k if y is None else y
            s += learned.trans[before, now]
            if y is None:
                s += learned.out.get(pii.outside(t, tokens[i]), 0.0)
            else:
                x, z = tokens[i][0], tokens[j - 1][1]
                s += (learned.shape(t[x:z]) + learned.total(pii.before(t, x)) + learned.total(pii.after(t, z)))[y]
            before = now
        return s

    for t in ("a 10.1.2.3 b", "x (at) y.org", "pay 4539 5787", "call 437-555-0129"):
        tokens = pii.tokens_of(t, 0, len(t))
        spans = list(pii.candidates(t, tokens))
        every = [[[]]] + [[] for _ in tokens]
        for j in range(1, len(tokens) + 1):
            every[j] = [[*p, (None, j - 1, j)] for p in every[j - 1]]
            every[j] += [[*p, (y, a, b)] for a, b in spans if b == j for y in range(4) for p in every[a]]
        best = max(every[-1], key=lambda p: total(t, tokens, p))
        assert learned.decode(t, 0, len(t)) == [(y, tokens[a][0], tokens[b - 1][1]) for y, a, b in best if y is not None]


def test_islands_give_what_the_whole_text_gives(learned):
    r = random.Random(4)
    for t in corpus(30, 9):
        k, a, b = (checked(t) or [(0, 0, 0)])[0]
        t = t[:a] + pii.variants(k, t[a:b], np.random.default_rng(r.randrange(99))) + t[b:] if b else t
        assert [x for i, j in pii.islands(t) for x in learned.decode(t, i, j)] == learned.decode(t, 0, len(t))


def test_variants_are_found_and_decoys_left(learned):
    rng, hit, n, wrong = np.random.default_rng(7), 0, 0, 0
    for t in corpus(300, 2):
        for k, a, b in checked(t):
            v = pii.variants(k, t[a:b], rng)
            u = t[:a] + v + t[b:]
            n += 1
            hit += (k, a, a + len(v)) in learned.added(u, pii.base_spans(u)) + pii.base_spans(u)
            w = pii.decoys(t[a:b], k, rng)
            u = t[:a] + w + t[b:]
            wrong += bool([x for x in learned.added(u, pii.base_spans(u)) if x[2] > a and x[1] < a + len(w)])
    assert n > 100 and hit >= 0.9 * n and wrong <= 0.05 * n


def test_personal_data_on_odd_rows(spark, learned):
    texts = [None, "", "x@y.zz x@y.zz", "é 10.0.0.1", "word " * 50_000 + "10.0.0.2", "x@y.zz x@y.zz"]
    df = spark.createDataFrame([(i if i else None, t, "other") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.personal_data(df, learned).collect()}
    assert [got[i]["n_email"] for i in (None, 1, 2, 5)] == [0, 0, 2, 2] and got[4]["n_ip"] == 1
    assert got[3]["spans"] == "ip:2:10" and got[2]["spans"] == "email:0:6,email:7:13" == got[5]["spans"]
    assert [r["text"] for r in pii.redacted(df.where("doc_id = 3"), learned).collect()] == ["é [ip]"]
    assert pii.personal_data(df.where("false"), learned).count() == 0 and pii.fit([]).added("x (at) y (dot) z", []) == []
    assert pii.train(df, per_kind=2).names is not None


def plain_negatives(rows, share=(80, 100)):
    out, part = [], [(i, x, np.array(v, dtype=object)) for i, x, v in rows]
    for i, x, v in part:
        if i % 100:
            continue
        scored = sorted((-int((np.floor(np.array(v, float) * 256) @ np.floor(np.array(w, float) * 256))), j, y) for j, y, w in part if j != i)
        for s, j, _ in [z for z in scored if z[2] == x][:5]:
            found = [z for z in scored if z[2] != x and share[0] * -s <= 100 * -z[0] <= 100 * -s][:5]
            out += [(i, j, n, z[1], -s, -z[0]) for n, z in enumerate(found, 1)]
    return sorted(out)


def test_hard_negatives_are_all_pairs(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 12))
    rows = [(int(i), int(i % 4), (0.3 * centres[i % 6] + 0.1 * r.normal(size=12)).round(3).tolist()) for i in range(700)]
    rows += [(700, 1, rows[0][2]), (707, 2, rows[0][2])]  # ties
    odd = [(None, 1, rows[0][2]), (801, None, rows[0][2]), (802, 1, None), (803, 1, [float("nan")] * 12), (804, 1, [None] * 12), (805, 1, [1e300] * 12), (806, 1, [float("inf")] * 12)]
    df = spark.createDataFrame([(*x, 7) for x in rows + odd], "vec_id long, label int, embedding array<double>, key int").repartition(4)
    want = plain_negatives(rows)
    for options in ({}, {"anchor_block": 3, "row_block": 60, "cells": 16}, {"cells": 2, "sampled": 5}):
        assert sorted(map(tuple, hard_negatives.mine(df, **options).collect())) == want
    assert want and hard_negatives.mine(df.where("false")).count() == 0
    short = [(0, 1, [0.5]), (1, 1, [0.5, 1.0]), (2, 2, [0.4, 9.0, 1.0]), (3, 2, []), (100, 1, [])]
    padded = [(i, x, (v + [0.0] * 3)[:3]) for i, x, v in short]
    assert sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(short, "vec_id long, label int, embedding array<double>")).collect())) == plain_negatives(padded)


def test_bounds_hold_every_score():
    r = np.random.default_rng(6)
    v = r.integers(-300, 300, (500, 9)).astype(np.int32)
    cells = hard_negatives.Cells(v[:40].astype(int), v.min(0).astype(float), v.max(0).astype(float), 8)
    codes = cells.code(v)
    a = hard_negatives.Anchors(cells, v[:7])
    exact = v.astype(np.int64) @ v[:7].T.astype(np.int64)
    assert (a.bounds(codes, a.upper) + a.slack >= exact).all() and (a.bounds(codes, a.lower) - a.slack <= exact).all()
    assert all((a.low(codes, j) <= exact[:, j]).all() for j in range(7))


def plain_phrases(rows, least, top=2000):
    counts, n = {}, Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, c in counts.items():
        cand, kept = {p: a for p, a in c.items() if len(p) > 1 and a >= least}, []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            s, k = min((int(Fraction(2_000_000 * a, c[p[:k]] + c[p[k:]])), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def test_phrases_are_plain_counts(spark, monkeypatch):
    r = random.Random(8)
    words = ["la", "La", "été", "b", "c d", "e\tf", "g,", "h.", "x\ny", "日本", "\x1fz", "..", ""]
    texts = [(r.choice(["de", "en", None, "und"]), " ".join(r.choices(words, k=r.randrange(60)))) for _ in range(250)]
    texts += [("en", None), ("en", ""), ("en", "la la la la la " * 30), ("fr", "one two three four " * 40)]
    df = spark.createDataFrame([(*x, "p") for x in texts], "lang string, text string, phrase string").repartition(3)
    for options in ({}, {"width": 1 << 16, "task_bytes": 500}, {"min_count": 6, "top": 15}):
        got = sorted(map(tuple, phrases.mine(df, **options).collect()))
        assert got == plain_phrases(texts, options.get("min_count", 30), options.get("top", 2000)) and got
    assert phrases.mine(df.where("false")).count() == 0
    long = "ab cd ef. " * 3000
    for size in (50, 999, 10**6):  # phrases across slices are counted once
        seen = Counter()
        for w, old in phrases.slices([long.encode(), None, b""], size):
            _, ids, h = phrases.word_hashes(w, "x")
            for n, at, _ in phrases.ngrams(ids, h, old):
                seen.update((n, b" ".join(w[i : i + n])) for i in at.tolist())
        assert seen == {(n, g.encode()): 3000 for n, g in ((1, "ab"), (1, "cd"), (1, "ef"), (2, "ab cd"), (2, "cd ef"), (3, "ab cd ef"))}


def test_sketch_never_says_less():
    r = np.random.default_rng(9)
    h = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    s = phrases.Sketch(1 << 8)  # far too small: every estimate is too high, none too low
    times = r.integers(1, 60, 3000)
    s.add(np.repeat(h, times))
    assert s.reaches(h[times >= 30], 30).all()


def test_counters_that_no_task_holds(spark, monkeypatch):
    r = random.Random(3)
    texts = [(r.choice(["de", None]), " ".join(r.choices(["a", "b", "c", "d.", "e", *(str(i) for i in range(3000))], [300] * 5 + [1] * 3000, k=80))) for _ in range(400)]
    df = spark.createDataFrame(texts, "lang string, text string").repartition(3)
    monkeypatch.setattr(phrases, "MOST", 1 << 8)
    monkeypatch.setattr(phrases, "BUFFER", 5000)  # several counts a counter
    bits = phrases.marks(phrases.texts_of(df, "text", "lang"), 1 << 20, 30)
    assert 0 < np.unpackbits(bits).sum() < 1000  # of some 80,000 n-grams those that are frequent, where 2^8 counters let all pass
    got = sorted(map(tuple, phrases.mine(df).collect()))
    assert got == plain_phrases(texts, 30) and got


def plain_edit(item, text):
    """The least distance of the item to a part of the text; of its first end the shortest such part."""
    row = [[(0, j) for j in range(len(text) + 1)]]
    for i, c in enumerate(item, 1):
        row.append([(i, 0)])
        for j, x in enumerate(text, 1):
            row[i].append(min((row[i - 1][j - 1][0] + (c != x), -row[i - 1][j - 1][1]), (row[i - 1][j][0] + 1, -row[i - 1][j][1]), (row[i][j - 1][0] + 1, -row[i][j - 1][1])))
            row[i][j] = (row[i][j][0], -row[i][j][1])
    end = min(range(len(text) + 1), key=lambda j: (row[-1][j][0], j))
    return row[-1][end][0], row[-1][end][1], end


def test_places_of_changed_items():
    r = random.Random(11)
    words = "alpha beta gamma delta omega sigma kappa theta".split()
    for _ in range(40):
        item = " ".join(r.choices(words, k=14))
        changed = list(item)
        for _ in range(r.randrange(4)):
            i = r.randrange(1, len(changed) - 1)
            changed[i : i + 1] = r.choice([[], [changed[i], "q"], ["q"]])
        before = "some words go first "[: r.randrange(20)]
        text = decontaminate.normal(before + " " + "".join(changed) + " and last")
        d, a, b = plain_edit(item, text)
        got = decontaminate.Finder([(1, item)], 0.06, 40).search(text)
        assert [(x["distance"], x["start"], x["end"]) for x in got] == [(d, a, b)]


def test_items_without_an_id_and_several_lists(spark):
    items = [(None, "one question that has no number but has a text of its own"), (None, "two questions that have no number and other words in them"), (3, "the third of the questions has a number and many words too")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [items[0][1] + " and " + items[1][1], items[2][1], "a clean text", None]
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in enumerate(texts)], "doc_id long, text string, file string, at int")
    for most in (20_000, 1):
        got = {r["doc_id"]: r["hits"] for r in decontaminate.with_hits(df, bench, "hits", most_items=most).collect()}
        assert {k: sorted(str(h["item_id"]) for h in v) for k, v in got.items()} == {0: ["None", "None"], 1: ["3"], 2: [], 3: []}
    assert decontaminate.with_hits(df, bench, "hits", most_items=1).columns == [*df.columns, "hits"]


def test_helper_columns_may_clash(spark):
    words = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, words, "a", 1), (2, words, "b", 2), (3, "other words", "c", 3)], "doc_id long, text string, file string, At int")
    got = near_copies.keep_one(df)
    assert got.columns == df.columns and sorted((r["doc_id"], r["file"], r["At"]) for r in got.collect()) == [(1, "a", 1), (3, "c", 3)]
    assert near_copies.keep_one(df.where(F.lit(False))).count() == 0
