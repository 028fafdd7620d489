import random

from rankforge.operators import playbook
from rankforge.streaming import playbook as stream

SCHEMA = "book string, seq long, step long, op string, section string, content string, id string, metadata map<string,long>"


def plain(ops):
    """The operations one after another."""
    made, state = {}, {}
    for book, seq, _, op, section, content, name, told in sorted(ops, key=lambda r: (r[0] or "", r[1])):
        op, told = op.upper(), {k: v for k, v in (told or {}).items() if v is not None and k in playbook.TAGS}
        if op == "ADD":
            if name is None:
                made[book] = made.get(book, 0) + 1
                name = f"{section.split()[0].lower() if section and section.split() else ''}-{made[book]:05d}"
            state[book, name] = [section, content or "", *(told.get(t, 0) for t in playbook.TAGS), seq]
        elif (book, name) in state:
            have = state[book, name]
            if op == "REMOVE":
                del state[book, name]
            elif op == "UPDATE":
                have[1] = have[1] if content is None else content
                have[2:5] = [told.get(t, have[i + 2]) for i, t in enumerate(playbook.TAGS)]
            elif op == "TAG":
                have[2:5] = [have[i + 2] + told.get(t, 0) for i, t in enumerate(playbook.TAGS)]
    return sorted((*k, *v) for k, v in state.items())


def some_ops(n, seed):
    r = random.Random(seed)
    ops = []
    for i in range(n):
        op = r.choice(["ADD", "add", "UPDATE", "TAG", "tag", "REMOVE", "other"])
        told = r.choice([None, {}, {"helpful": r.randrange(5)}, {"harmful": 1, "strange": 9}, {"neutral": None, "helpful": -2}])
        ops.append((r.choice("ab"), i, i // 10, op, r.choice(["Tips and tricks", "facts", "", None]), r.choice([None, "", "text"]), r.choice([None, "x", "y", "z", "tips-00001", "facts-00002"]), told))
    return ops


def rows(df):
    return sorted(tuple(r) for r in df.select("book", "id", "section", "content", *playbook.TAGS, "at").collect())


def test_books_are_the_plain_fold(spark):
    ops = some_ops(400, 1)
    df = spark.createDataFrame(ops, SCHEMA).repartition(5)
    assert rows(playbook.books(df)) == plain(ops)
    assert playbook.books(df.where("false")).count() == 0
    one = [("b", 2, 0, "ADD", "S", "late", "q", None), ("b", 1, 0, "ADD", "S", "early", "p", {"helpful": 2}), ("b", 3, 0, "ADD", "A", None, None, None)]
    got = playbook.as_prompt(playbook.books(spark.createDataFrame(one, SCHEMA))).collect()
    assert [r["prompt"] for r in got] == ["## A\n- [a-00001]  (helpful=0, harmful=0, neutral=0)\n## S\n- [p] early (helpful=2, harmful=0, neutral=0)\n- [q] late (helpful=0, harmful=0, neutral=0)"]


def test_stream_of_several_batches_is_the_batch_fold(spark, tmp_path):
    ops = some_ops(300, 2) + [(None, 300, 30, "ADD", "facts", "x", "n", None)]
    for part in range(3):
        spark.createDataFrame(ops[part * 100 : part * 100 + 100 + (part == 2)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={part}")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    log = stream.drain_by_kind(stream.book_stream(source), f"{tmp_path}/out", f"{tmp_path}/check")
    assert rows(stream.latest_bullets(log)) == plain(ops[:300])
    changes = log.where("kind = 'change'")
    assert changes.count() == 300 and changes.where("op = 'ADD' and not done").count() == 0 and changes.where("op = 'OTHER' and done").count() == 0
    last = {r["book"]: r["bullets"] for r in log.where("kind = 'snapshot' and step = 29").collect()}
    before = plain([o for o in ops[:300] if o[2] < 29])
    assert last == {b: sum(1 for x in before if x[0] == b) for b in last}
