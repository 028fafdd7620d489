"""The pipeline's stages against their rules, on small documents."""

import random

import corpus_pipeline
from rankforge.llm import decontaminate


def test_stages(spark, tmp_path):
    r = random.Random(0)
    words = {"aa": [x + y for x in ("ka", "lo", "mi", "ter") for y in ("ra", "do", "ven", "pol")], "bb": [x + y for x in ("grö", "schu", "pfel", "wri") for y in ("xt", "nkt", "lmm", "sk")]}
    text = lambda x: " ".join(r.choice(words[x]) for _ in range(80))
    item = text("aa").title()
    docs, labels = [], []
    for i in range(200):
        t = text(lang := "aa" if i % 2 else "bb").split()
        if toxic := i % 5 == 1:
            for _ in range(3):
                t[r.randrange(80)] = "idiot"
        docs.append((i, " ".join(t), lang, f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    toxic = {i for i, _, y in labels if y}
    clean = [d for d in docs if d[0] not in toxic]
    docs += [(300, clean[0][1], "bb", "s", 0), (301, clean[0][1], "bb", "s", 0), clean[3], (302, None, "aa", "s", 0), (303, "12 34", None, "s", 0), (304, f"{text('aa')} {item}. {text('aa')}", "aa", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = now.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert k == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append(sorted(x["doc_id"] for x in now.select("doc_id").collect()))
    ids = sorted(d[0] for d in docs)
    assert kept[0] == [i for i in ids if i not in (302, 303)]
    assert kept[1] == [i for i in kept[0] if i not in toxic]
    assert kept[2] == sorted(set(kept[1]) - {300, 301})
    assert kept[3] == [i for i in kept[2] if i != 304] and decontaminate.normal(item)
    assert sorted(set(kept[4])) == kept[3]


def test_language_stage_keeps_mixed_texts(spark):
    r = random.Random(0)
    words = {x: [f"{x}{a}{b}{x}" for a in "aeiou" for b in "klmnp"] for x in ("qu", "zh", "tv", "br")}
    docs = [(i, " ".join(r.choice(words[x]) for _ in range(40)), x, "s", 0) for i in range(120) for x in [list(words)[i % 4]]]
    mixed = " ".join(r.choice(words[x]) for x in words for _ in range(4))
    docs += [(1000, mixed, None, "s", 0), (1001, "12 34", "qu", "s", 0), (1002, None, "qu", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    kept = lambda rows: sorted(x["doc_id"] for x in corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, schema), "").collect())
    assert kept(docs) == [*range(120), 1000]
    assert kept([(i, t, None, s, n) for i, t, _, s, n in docs]) == [*range(120), 1000]


def saved(spark, folder, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double, hits int, root long, t string, size int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_on_empty_tables_and_odd_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, saved(spark, tmp_path / "none", [], [], [])).count() == 0
    r = random.Random(2)
    words = {x: [f"{x}{a}{b}" for a in "aeiou" for b in "klmnp"] for x in ("qu", "zh")}
    text = lambda x, n=60: " ".join(r.choice(words[x]) for _ in range(n))
    extra = (0.1, 1, 2, "x", 3)
    item = text("zh", 20)
    docs = [(i, text(x) + (" awful idiot" if i % 4 == 0 else ""), x, "s", 0, *extra) for i in range(60) for x in [list(words)[i % 2]]]
    plain = docs[1][1]
    near = plain.replace(plain.split()[30], "qqq", 1)
    docs += [(None, plain, None, None, None, *extra), (None, text("qu"), None, None, None, *extra), (70, near, "qu", None, 0, *extra), (1, text("qu"), "qu", "s", 0, *extra), (1, plain, "qu", "s", 0, *extra), (71, f"{text('qu')} {item.upper()} {text('zh')}", "qu", "s", 0, *extra), (72, None, "qu", "s", 0, *extra), (73, "", None, "s", 0, *extra), (74, text("qu", 40_000), "qu", "s", 0, *extra)]
    folder = saved(spark, tmp_path / "some", docs, [(i, 1, int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (1, 1, None)], [(5, item), (None, text("qu")), (6, None)])
    got = corpus_pipeline.run(spark, folder)
    counted = {x["doc_id"]: x["n"] for x in got.where("piece = 0").groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    want = {i: 1 for i in range(60) if i % 4} | {74: 1, None: 1, 1: 2}
    assert counted == want
    assert got.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_planted_near_copies_are_found(spark, tmp_path):
    """Recall of near copies whose five-word Jaccard similarity is 0.8 or more: 0.99 at least; none of the others goes."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    docs = []
    for i in range(300):
        w = [word() for _ in range(r.choice([40, 150, 600]))]
        docs.append((2 * i, " ".join(w)))
        for _ in range(max(1, len(w) // 60)):
            w[r.randrange(len(w))] = word()
        docs.append((2 * i + 1, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    near = {2 * i + 1 for i in range(300) if 5 * len(sets[2 * i] & sets[2 * i + 1]) >= 4 * len(sets[2 * i] | sets[2 * i + 1])}
    kept = {x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()}
    assert len(near) > 100 and len(near - kept) >= 0.99 * len(near) and {i for i, _ in docs} - near <= kept
