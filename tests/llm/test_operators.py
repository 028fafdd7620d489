"""Each operator against brute force, and on nulls, empty, long and repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from rankforge.llm import chunk_fingerprints, decontaminate, language_id, licenses, packing, simhash, token_counts, token_files, tokens, toxicity, urls

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, score double, fp string, pid int, t string, hits int"
BASE = "It was released under the MIT License, they said; the rest of these words is only here to fill it up."
ROWS = [(1, BASE), (2, None), (3, ""), (4, "  \n "), (5, "word " * 30_000), (1, BASE), (None, "no id here"), (6, BASE.replace("rest", "remainder")), (7, "日本語 é <|endoftext|> \x1c 12"), (8, "x" * 5000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0.5, "a", 1, "b", 2) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(BPE)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def ids_of(whole, t):
    return whole.encode(t or "", add_special_tokens=False).ids


def key(i):
    return (i is not None, i or 0)


def test_codec_equals_library(whole):
    parts = [" ", "  ", "\n", "\t", "a", "the", "'s", "é", "1", "!", ".", "\u3000", "日本", "<|endoftext|>", "😀", "\x1c", "\x85", "\r"]
    codec = tokens.Codec(BPE, "bytes")
    for seed in range(5000):
        r = random.Random(seed)
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert np.frombuffer(codec.text(t), "<u4").tolist() == ids_of(whole, t), repr(t)


def test_codec_slices_equal_library(whole, monkeypatch):
    """Texts encoded together, each pre-token by the model once; also with hardly any room in the cache and in a slice."""
    parts = [" ", "  ", "\n", "\t", "a", "the", "'", "'s", "'re", "ll", "é", "ß\u0301", "1", "²", "!", ".", "\xa0", "\x85", "\x1c", "\0", "\u052f", "\r"]
    odd = ["\u0530", "\u3000", "日本", "<|endoftext|>", "😀"]
    texts = [None, "", "x" * 100, "it's 'so' they''ll\n\n 'd", *("".join(r.choice(parts + odd * (seed % 2)) for _ in range(r.randint(0, 12))) for seed in range(5000) for r in [random.Random(seed)])]
    want = [[*ids_of(whole, t), 7] for t in texts]
    for slots, size in ((tokens.SLOTS, tokens.SLICE), (50, 3000), (0, 1)):
        monkeypatch.setattr(tokens, "SLOTS", slots)
        monkeypatch.setattr(tokens, "SLICE", size)
        codec = tokens.Codec(BPE, "bytes")
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.each([t if t is None else t.encode() for t in texts], b"\7\0\0\0")] == want
        assert len(codec.slots) <= slots and len(codec.stops) == len(codec.slots) + 1 and len(codec.flat) == codec.stops[-1]
    assert [bytes(x) for x in codec.each([b"a b", None])] == [np.array(ids_of(whole, "a b"), "<u4").tobytes(), b""] and not [*codec.each([])]


def test_model_sees_each_pretoken_once(monkeypatch):
    """Words with other marks and lines around them are no new words (they were encoded anew, and cut in Python)."""
    codec, seen = tokens.Codec(BPE, "bytes"), []

    class Model:
        tokenize = staticmethod(lambda p, real=codec.model: seen.append(p) or real.tokenize(p))

    codec.model = Model
    monkeypatch.setattr(tokens.Codec, "pretokens", lambda *_: pytest.fail("a unit was cut in Python"))
    texts = [f"kabelo{a}\nMatori{b} kabelo" for a in ("", ",", ".", "!") for b in ("", "'s", ";", "\n")]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.each([t.encode() for t in texts])] == [ids_of(codec.whole, t) for t in texts]
    assert len(seen) == len(set(seen))


def test_token_counts(docs, none, whole):
    got = token_counts.token_counts(docs, BPE).collect()
    want = [(i, len((t or "").encode()), len(ids_of(whole, t))) for i, t in ROWS]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.token_counts(none, BPE).count() == 0


def test_token_counts_sentencepiece(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t in ROWS}


def brute_fit(lengths, most):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(x, i) for i, x in enumerate(bins) if x >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(most - n)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    for seed in range(100):
        r = random.Random(seed)
        most = r.choice([10, 64, 100])
        h = {r.randint(1, most): r.randint(1, 30) for _ in range(r.randint(1, 12))}
        bins = {}
        for n, a, b, per, first, _ in packing.plan(h, most):
            for k in range(b - a):
                bins[first + k // per] = bins.get(first + k // per, 0) + n
        assert sorted(most - x for x in bins.values()) == brute_fit([n for n, c in h.items() for _ in range(c)], most)


def test_pack(docs, none, whole):
    got = packing.pack(docs, BPE, max_tokens=64).collect()
    want = []
    for i, t in ROWS:
        x = [*ids_of(whole, t), 0]
        cuts = [0, *range(len(x) % 64 or 64, len(x) + 1, 64)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) == len(brute_fit([x[3] for x in want], 64))
    assert packing.pack(none, BPE).count() == 0


def test_token_files(docs, none, whole):
    got = sorted(token_files.round_trip(docs, BPE, shard_ids=100).collect(), key=lambda r: r.start)
    want = sorted(((i, [*ids_of(whole, t), 0]) for i, t in ROWS), key=lambda x: key(x[0]))
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want]
    assert [r.start for r in got] == np.cumsum([0, *(len(x) for _, x in want)])[:-1].tolist()
    assert token_files.round_trip(none, BPE).count() == 0


def test_token_files_encode_plain_texts_in_slices(spark, whole, monkeypatch):
    """Plain texts are not cut or joined word by word; shards need not end with slices."""

    def slices_only(path, kind):
        c = tokens.Codec(path, kind)
        c.text = c.pretokens = None
        return c

    texts = [None if i % 50 == 7 else " ".join(f"w{i * k % 91},\nitem's" for k in range(i % 9)) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(token_files, "tokens", type("Codecs", (), {"codec": staticmethod(slices_only)}))
    got = sorted(token_files.round_trip(docs, BPE, shard_ids=500).collect(), key=lambda r: r.start)
    want = [[*ids_of(whole, t), 0] for t in texts]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(want)]
    assert [r.start for r in got] == np.cumsum([0, *map(len, want)])[:-1].tolist()


def test_shard_round_trip_and_ranges():
    rng = np.random.default_rng(0)
    for n in (1, 511, 512, 513, 5000):
        ids = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32 - 1, n), rng.integers(100, 1000, n)).astype("<u4")
        s = token_files.Shard(token_files.encode_shard(3, 1, [None], [n], ids))
        assert (s.ids() == ids).all() and (s.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all() and s.doc_ids == [None]


def brute_simhash(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_forest_against_all_pairs():
    rng = np.random.default_rng(0)
    for n, groups in ((300, 3), (500, 1), (130, 40)):
        x = rng.integers(0, 1 << 63, n // 3 + 1, dtype=np.uint64)
        x = np.concatenate([x, x[: n // 3] ^ np.uint64(5), x[: n // 3] ^ np.uint64(0b1111100000)])[:n]
        rng.shuffle(x)
        g = np.sort(rng.integers(0, groups, len(x)))
        want = components(range(len(x)), [(i, j) for i, j in combinations(range(len(x)), 2) if g[i] == g[j] and int(x[i] ^ x[j]).bit_count() <= 4])
        assert simhash.forest(x, g, 4).tolist() == [want[i] for i in range(len(x))]


@pytest.mark.parametrize("group_rows", [4, 20_000])
def test_near_duplicates(spark, docs, none, group_rows):
    more = spark.createDataFrame([(100 + i, " ".join(f"w{j}" if j != i % 7 else f"x{i}" for j in range(150)), 0.0, "", 0, "", 0) for i in range(60)], SCHEMA)
    every = docs.union(more)
    rows = [(r.doc_id, r.text) for r in every.collect()]
    got = simhash.near_duplicates(every, group_rows=group_rows).collect()
    prints = {t: brute_simhash(t) for _, t in rows}
    assert sorted((str(r.doc_id), int(r.fingerprint, 16)) for r in got) == sorted((str(i), prints[t]) for i, t in rows)
    fps = sorted(set(prints.values()))
    root = components(fps, [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4])
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[prints[t]]] = min(i, least.get(root[prints[t]], i))
    assert all(r.component_id == least.get(root[int(r.fingerprint, 16)]) for r in got)
    assert simhash.near_duplicates(none).count() == 0


def test_license_scan(docs, none):
    got = licenses.digest(licenses.scan(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert (by[1].n_words, by[1].n_base, by[1].first_word, by[1].last_word, by[1].base_labels) == (21, 1, 5, 5, "mit")
    assert (by[2].n_words, by[2].n_base, by[2].first_word, by[2].base_labels, by[2].score) == (0, 0, None, "", 0.0)
    assert licenses.digest(licenses.scan(none)).count() == 0


def test_license_places_against_brute_force():
    phrases = {n.phrase: n.label for n in licenses.NOTICES if n.base}
    vocabulary = "gnu general public license apache mit cc by the of".split()
    for seed in range(300):
        r = random.Random(seed)
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 30))]
        n, found = licenses.Scanner().search(", ".join(w))
        want = sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        assert n == len(w) and sorted((f, x.label) for x, f, _, e, _ in found if x.base and not e) == want
    _, found = licenses.Scanner().search("GNU Genral Public Licence and apache licence")
    assert {(x.label, e) for x, _, _, e, _ in found} == {("gpl", 2), ("apache", 1)}


def test_urls_against_every_rule(spark):
    odd = ["http://a.NET/x?y", "https://example.net/en/1", "ftp://www.example.net/en", "http://example.com/de/#a", "x.org/fr/", "http://b.org/fr/2", "", None, "http://net", "http://net/", "http://notnet.xnet/", "://org/fr/", "http://u:p@h.example.com:80/de/1", "http://a.b/casino/q", "http://h/login/a/redirect?x", "http://x/a://b.net/"]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(odd + odd)], "page_id long, url string, host string, rule string")
    got = sorted(tuple(r) for r in urls.judge(pages).drop("candidates").collect())
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?)", [[i, u] for i, u in enumerate(odd + odd)])
    rows = c.execute(f"SELECT page_id, coalesce(host, ''), coalesce(path, ''), rule, verdict FROM ({urls.SQL}) ORDER BY 1").fetchall()
    assert got == rows
    assert urls.judge(pages.limit(0)).count() == 0


def test_chunk_fingerprints(docs, none):
    got = chunk_fingerprints.with_next(docs).collect()
    assert len(got) == len(ROWS)
    ordered = sorted(ROWS, key=lambda x: key(x[0]))
    by = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(t)
        if i != 1:
            assert by[i].n_chars == n and by[i].edited_sha256 == hashlib.sha256((t[: n - n // 4] + after[: n // 4]).encode()).hexdigest()
    assert by[3].fingerprint == "" and by[2].near_next == 1.0 and all(0 <= r.near_edited <= 1 for r in got)
    assert chunk_fingerprints.with_next(none).count() == 0


def test_chunks_cover_and_resist_shifts():
    r = random.Random(0)
    data = bytes(r.randrange(256) for _ in range(20_000))
    a, b = chunk_fingerprints.chunks(data), chunk_fingerprints.chunks(b"shift" + data)
    assert sum(a.values()) == len(data) and chunk_fingerprints.containment(a, b) > 0.97
    assert chunk_fingerprints.parse(chunk_fingerprints.text_of(a)) == a


def test_toxicity_generalises_to_misspellings(spark, docs, none):
    r = random.Random(0)
    plain = [f"{a}{b}" for a in ("ka", "lo", "mi", "ter", "sun") for b in ("ra", "do", "ven", "pol")]
    texts = [[r.choice(plain) for _ in range(30)] for _ in range(300)]
    for t in texts[:150]:
        t[r.randrange(30)] = r.choice(["idiot", "moron"])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i < 150)) for i, _ in rows] + [(None, 1), (999, None)], "doc_id long, toxic int"))
    assert model.score("ka lora mira idioot terven") > 0.5 > model.score("sunra lodo miven")
    got = toxicity.toxicity(docs, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    nothing = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.toxicity(docs, nothing).agg({"score": "max"}).first()[0] == 0 and toxicity.toxicity(none, model).count() == 0


def test_language_id(spark, docs, none):
    r = random.Random(0)
    words = {"aa": ["kala", "mito", "suna", "toka"], "bb": ["gröx", "schunt", "pfeld", "wrisk"]}
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(r.randint(1, 600))), x) for i, x in enumerate(["aa", "bb"] * 40)]
    model = language_id.train(spark.createDataFrame([*rows, (None, "x", "aa"), (500, None, "bb"), (501, "x", None)], "doc_id long, text string, lang string"))
    assert [x for x, _ in model.predict([t for _, t, _ in rows])] == [x for *_, x in rows]
    lang, score = model.predict(["kala mito suna toka kala gröx schunt"])[0]
    assert lang == "aa" and 0.5 < score < 1
    got = {r.doc_id: r for r in language_id.language_id(docs, model).collect()}
    assert len(got) == len({i for i, _ in ROWS}) and (got[2].lang_pred, got[3].lang_pred, got[4].score) == ("und", "und", 0.0)
    nothing = language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.language_id(docs, nothing).collect()} == {"und"} and language_id.language_id(none, model).count() == 0


def test_forward_backward_against_paths():
    rng = np.random.default_rng(0)
    e, trans, start = rng.random((4, 1, 3)) + 0.1, rng.random((3, 3)) + 0.1, rng.random(3) + 0.1
    want, total = np.zeros((4, 3)), 0.0
    for path in np.ndindex(3, 3, 3, 3):
        p = start[path[0]] * np.prod([e[t, 0, s] for t, s in enumerate(path)]) * np.prod([trans[a, b] for a, b in zip(path, path[1:], strict=False)])
        total += p
        for t, s in enumerate(path):
            want[t, s] += p
    mask = np.ones((4, 1), bool)
    assert np.allclose(language_id.marginals(e, trans, start, mask)[:, 0], want / total)
    assert np.allclose(language_id.forward_backward(e, trans, start, mask)[0][:, 0], want / total)


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_against_the_table():
    for seed in range(200):
        r = random.Random(seed)
        p, t = ("".join(r.choice("ab ") for _ in range(r.randint(a, 60))) for a in (1, 0))
        assert decontaminate.myers(p, t, 100)[0] == edit_distance(p, t)


def test_decontamination_against_all_windows(spark, docs, none):
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    items = [" ".join(word() for _ in range(20)) for _ in range(5)]
    rows = []
    for i in range(40):
        t = [word() for _ in range(60)]
        if i % 2:
            x = list(items[i % 5])
            for _ in range(i % 9):
                x[r.randrange(len(x))] = r.choice("xyz")
            t[30:30] = ["".join(x).title()]
        rows.append((i, "  ".join(t)))
    bench = spark.createDataFrame([*enumerate(items), (None, "x" * 50), (9, None), (10, ""), (11, "short")], "item_id long, text string")
    want = {(i, j) for i, t in rows for j, x in enumerate(items) if edit_distance(x, decontaminate.normal(t)) <= int(0.06 * len(x))}
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (20_000, 2):
        assert {(h.doc_id, h.item_id) for h in decontaminate.decontaminate(made, bench, most_items=most).collect()} == want
    named = bench.where("item_id is not null")
    assert decontaminate.decontaminate(docs, named).count() == 0 == decontaminate.decontaminate(none, bench).count()
    assert {h.item_id for h in decontaminate.decontaminate(docs, bench).collect()} == {None}  # an item without an id is searched too
    assert decontaminate.decontaminate(made, bench.limit(0)).count() == 0


def test_toxicity_reads_the_end_of_a_long_word():
    from rankforge.llm import toxicity

    texts = ["you idiot", "such idiots", "a nice day", "good work here"] * 5
    model = toxicity.fit(texts, [1, 1, 0, 0] * 5)
    assert model.score("x" * 500 + "idiot") > model.score("x" * 505)
    assert "".join(p[4:] if i else p for i, p in enumerate(toxicity.pieces("ab" * 77))) == "ab" * 77
    assert toxicity.pieces("y" * 40) == ["y" * 40]


def test_language_reads_the_end_of_a_long_word_and_wants_letters():
    from rankforge.llm import language_id

    model = language_id.fit(["the cat and the dog"] * 4 + ["der hund und die katze"] * 4, ["en"] * 4 + ["de"] * 4)
    got = model.predict(["q" * 45 + "derhundunddiekatze" * 20, "q" * 45 + "thecatandthedog" * 20, "½ ² 7", "", None])
    assert [x for x, _ in got] == ["de", "en", "und", "und", "und"]


ODD_IDS = [None, 2**53 + 1, 2**53 + 3, 2**63 - 1, -(2**63) + 1, -5, None, 0]


def test_ids_stay_whole_beside_null_ones(spark):
    docs = spark.createDataFrame([(i, f"text {k} of these", 1.0) for k, i in enumerate(ODD_IDS)], "doc_id long, text string, score double").coalesce(1)
    pages = spark.createDataFrame([(i, "http://a.net/", "x") for i in ODD_IDS], "page_id long, url string, host string").coalesce(1)
    model, langs = toxicity.fit(["you idiot", "good work"], [1, 0]), language_id.fit(["the cat", "der hund"], ["en", "de"])
    bench = spark.createDataFrame([(2**53 + 1, "of these")], "item_id long, text string")
    found = [
        toxicity.toxicity(docs, model), licenses.digest(licenses.scan(docs)), urls.judge(pages), packing.pack(docs, BPE), decontaminate.decontaminate(docs, bench), simhash.near_duplicates(docs),
        chunk_fingerprints.with_next(docs), chunk_fingerprints.fingerprints(docs), token_files.round_trip(docs, BPE), token_counts.token_counts(docs, BPE), language_id.language_id(docs, langs), language_id.language_spans(docs, langs),
    ]
    for got in found:
        assert sorted((r[0] for r in got.select("page_id" if "page_id" in got.columns else "doc_id").collect()), key=key) == sorted(ODD_IDS, key=key), got.columns
    assert decontaminate.decontaminate(docs, bench).first().item_id == 2**53 + 1


def test_id_ranges_follow_the_order(spark):
    from rankforge.llm.common import id_ranges

    r = random.Random(3)
    ids = [None] * 40 + [7] * 40 + [r.randrange(-(2**62), 2**62) for _ in range(80)]
    rows = spark.createDataFrame([(i, "x" * r.randrange(2000), k) for k, i in enumerate(ids)], "doc_id long, t string, tie long")
    parts, ranged = id_ranges(rows, 1000)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.tie), r.pid) for r in ranged.collect())
    assert [p for _, p in got] == sorted(p for _, p in got) and 40 < parts < 200 and {p for _, p in got} <= set(range(parts))
    assert len({p for (some, d, _), p in got if not some}) > 3 and len({p for (some, d, _), p in got if some and d == 7}) > 3


def test_many_ranges(spark, docs, whole):
    got = sorted(token_files.round_trip(docs, BPE, range_bytes=50).collect(), key=lambda r: r.start)
    want = sorted(((i, [*ids_of(whole, t), 0]) for i, t in ROWS), key=lambda x: key(x[0]))
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want]
    near, far = (sorted(map(tuple, chunk_fingerprints.with_next(docs, range_bytes=n).collect()), key=str) for n in (50, 1 << 30))
    assert near == far


def words_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_fuzzy_license_places_against_all_windows():
    scanner = licenses.Scanner()
    for seed in range(150):
        r = random.Random(seed)
        parts = ["mit license", "mit licence", "apache license", "apach license", "gnu general public licence", "gnu general public license", "all right reserved", "the", "of", "cc by nc", "licensed under cc by nd", "mi t licens"]
        w = " ".join(r.choice(parts) for _ in range(r.randint(1, 7))).split()
        _, found = scanner.search(" ".join(w))
        for n in licenses.NOTICES:
            mine = sorted((a, b, e) for x, a, b, e, _ in found if x is n)
            assert all(words_distance(n.phrase, " ".join(w[a:b])) <= e <= n.errors for a, b, e in mine)
            assert all(x[1] <= y[0] for x, y in zip(mine, mine[1:], strict=False))
            for a in range(len(w)):
                for b in range(a + 1, min(len(w), a + len(n.phrase.split()) + n.errors) + 1):
                    if words_distance(n.phrase, " ".join(w[a:b])) <= n.errors:
                        assert any(x < b and y > a for x, y, _ in mine), (w, n.label, a, b, mine)


def test_both_places_beside_each_other_are_kept():
    _, found = licenses.Scanner().search("mit license mit licence; gnu general public license; gnu general public licence")
    assert sorted((x.label, e) for x, _, _, e, _ in found) == [("gpl", 0), ("gpl", 1), ("mit", 0), ("mit", 1)]


def test_many_notices_take_linear_time():
    import time

    took = []
    for n in (5_000, 20_000):
        began = time.process_time()
        _, found = licenses.Scanner().search("mit licence or mit license " * n)
        took.append(time.process_time() - began)
        assert len(found) == 2 * n
    assert took[1] < 10 * took[0]
    assert len(licenses.Scanner().search("icense" * 200_000)[1]) == 0


def test_a_hundred_thousand_rules_from_a_table(spark):
    made = spark.range(100_000).selectExpr("concat('host', id, '.example/p', id % 7, '/') AS text", "if(id % 2 = 0, 'block', 'allow') AS verdict", "true AS host")
    made = made.unionByName(spark.createDataFrame([("/x*y", "block", False), ("example/", "block", True), (None, "block", True)], "text string, verdict string, host boolean"))
    rules, patterns = urls.rules_of(made)
    assert (len(rules), len(patterns)) == (100_001, 1)
    pages = spark.createDataFrame([(i, f"http://a.host{i}.example/p{i % 7}/{'z' * 100_000 if i == 9 else 'q'}") for i in range(20)] + [(99, "http://h/x1y"), (100, "http://h/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.candidates) for r in urls.judge(pages, rules, patterns).collect()}
    assert all(got[i][:2] == (f"host{i}.example/p{i % 7}/", "block" if i % 2 == 0 else "allow") and got[i][2] < 10 for i in range(20))
    assert got[99][:2] == (None, "block") and got[100][:2] == (None, "allow")
    with pytest.raises(ValueError):
        urls.rules_of(made, most_rules=100)


def test_short_items_and_several_texts_of_an_item(spark):
    docs = spark.createDataFrame([(1, "They asked: what is Blue?"), (2, "what is bluest"), (3, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "What is blue"), (2, "b C"), (2, "c d e"), (3, "z")], "item_id long, text string")
    got = sorted(tuple(r)[:3] for r in decontaminate.decontaminate(docs, bench).collect())
    assert got == [(1, 1, 0), (3, 2, 0)]


def slow_chunks(data):
    """Byte by byte: the same rule without arrays."""
    h, at, out = 0, 0, {}
    for end, b in enumerate(data, 1):
        h = (h << 1) + int(chunk_fingerprints.GEAR[b]) & 0xFFFFFFFF
        n = end - at
        strict, loose = h >> 32 - chunk_fingerprints.STRICT == 0, h >> 32 - chunk_fingerprints.LOOSE == 0
        if end == len(data) or n == chunk_fingerprints.MOST or chunk_fingerprints.LEAST <= n <= chunk_fingerprints.USUAL and strict or n >= chunk_fingerprints.USUAL and loose:
            d = xxhash.xxh64_intdigest(data[at:end]) >> 16
            out[d] = out.get(d, 0) + n
            at = end
    return out


def test_chunks_against_byte_by_byte(spark, docs):
    for seed in range(120):
        r = random.Random(seed)
        data = bytes(r.randrange(97, 123) if r.random() < 0.9 else 32 for _ in range(r.choice([0, 1, 15, 16, 17, 48, 49, 192, 193, 700, 3000])))
        assert chunk_fingerprints.chunks(data) == slow_chunks(data), len(data)
    ordered = sorted(ROWS, key=lambda x: key(x[0]))
    by = {r.doc_id: r for r in chunk_fingerprints.with_next(docs).collect()}
    share = lambda a, b: sum(min(n, b.get(d, 0)) for d, n in a.items()) / sum(a.values()) if a else float(not b)
    for k, (i, t) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        if i != 1:
            own, edited, other = (slow_chunks(x.encode()) for x in (t, t[: len(t) - len(t) // 4] + after[: len(t) // 4], after))
            assert (by[i].fingerprint, by[i].edited_fingerprint) == (chunk_fingerprints.text_of(own), chunk_fingerprints.text_of(edited))
            assert by[i].near_edited == pytest.approx(share(own, edited)) and by[i].near_next == pytest.approx(share(own, other))


def test_close_counts_any_radius():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    x[100:] = x[:100] ^ rng.integers(0, 1 << 20, 100, dtype=np.uint64)
    for radius in (0, 1, 3, 7, 8, 12, 26):
        want = components(range(200), [(i, j) for i, j in combinations(range(200), 2) if int(x[i] ^ x[j]).bit_count() <= radius])
        assert simhash.forest(x, np.zeros(200, np.int64), radius).tolist() == [want[i] for i in range(200)]


def test_sentencepiece_words_against_the_library():
    import sentencepiece

    for name in ("piece_bpe_32k.model",):
        path = public_tokenizers.path(name)
        sp, mine = sentencepiece.SentencePieceProcessor(model_file=path), tokens.Pieces(path)
        parts = ["the", "word", " ", "  ", "re-do", "(x)", "12.5", "é", "日本", "\n", "　", "<s>", "don't", "ﬁ"]
        for seed in range(1500):
            r = random.Random(seed)
            t = r.choice(["", " "]).join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 8)))
            assert mine.text(t) == len(sp.encode(t)), repr(t)


def test_training_samples_skip_long_and_repeated_rows(spark):
    from rankforge.llm.common import smallest_hashes
    from pyspark.sql import functions as F

    long = "word " * 30
    rows = [(i, long if i < 400 else f"good day {i}" if i % 2 else f"you idiot {i}") for i in range(460)] + [(401, "good day 401")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(460)] + [(401, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, per_class=40, max_chars=100)
    assert model.score("an idiot") > 0.5 > model.score("a good day")
    langs = language_id.train(spark.createDataFrame([(i, long if i < 400 else "the cat sat" if i % 2 else "der hund sass", "en" if i % 2 else "de") for i in range(460)], "doc_id long, text string, lang string"), per_lang=20, max_chars=100)
    assert [x for x, _ in langs.predict(["the cat", "der hund"])] == ["en", "de"]
    many = spark.range(5000).select(F.col("id"), F.xxhash64("id").alias("h"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = smallest_hashes(many, "y", [F.col("h"), F.col("id")], 100).collect()
    for y in (0, 1):
        assert sorted(r.h for r in got if r.y == y) == sorted(r.h for r in many.collect() if r.y == y)[:100]


def test_language_spans_of_mixed_texts(spark):
    r = random.Random(5)
    words = {"aa": ["kala", "mito", "suna", "toka", "nelu"], "bb": ["gröx", "schunt", "pfeld", "wrisk", "dremp"]}
    text = lambda x, n: [r.choice(words[x]) for _ in range(n)]
    model = language_id.fit([" ".join(text(x, 60)) for x in ["aa", "bb"] * 20], ["aa", "bb"] * 20)
    mixed = " ".join(["12", *text("aa", 6), "--", *text("bb", 5), *text("aa", 4), "!"])
    assert model.spans(mixed) == [(0, 8, "aa"), (8, 13, "bb"), (13, 18, "aa")]
    docs = spark.createDataFrame([(1, mixed, "x"), (2, None, "y"), (None, "1 2", "z")], "doc_id long, text string, spans string")
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in language_id.language_spans(docs, model).collect()}
    assert got == {1: [(0, 8, "aa"), (8, 13, "bb"), (13, 18, "aa")], 2: [], None: []}
    assert model.trans.min() > 0 and model.trans[0, 1] > model.trans[0, 0] / 200
