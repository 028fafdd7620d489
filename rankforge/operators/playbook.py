"""Event-sourced rule store: state from ordered operations, lifetimes and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankforge.operators.grouping import places


TAGS = ("helpful", "harmful", "neutral")


def fold(ops: DataFrame, key: str, seq: list[str], op: str, amount: str) -> DataFrame:
    """Current counters of each live key.

    ADD sets the counter to its amount, UPDATE sets it if the key lives, TAG adds to it, REMOVE ends it; other
    operations on a key that does not live are ignored. Two grouped sums with map-side parts: where the last epoch
    begins and the counter was last set, then the tags that count.
    """
    x = ops.select(F.col(key).alias("k"), F.struct(*seq).alias("at"), F.col(op).alias("op"), F.col(amount).alias("amount"))
    last = lambda when, what: F.max(F.when(when, what))
    sets = F.col("op").isin("ADD", "UPDATE")
    ends = x.groupBy("k").agg(last(F.col("op") == "ADD", F.col("at")).alias("born"), last(F.col("op") == "REMOVE", F.col("at")).alias("gone"), last(sets, F.struct("at", "amount")).alias("set"))
    live = ends.where(F.col("born").isNotNull() & (F.col("gone").isNull() | (F.col("gone") < F.col("born"))))
    tags = x.where(F.col("op") == "TAG").join(live, "k").where(F.col("at") > F.col("born"))
    summed = tags.groupBy("k").agg(F.count("*").alias("tags"), F.sum(F.when(F.col("at") > F.col("set.at"), F.col("amount"))).alias("added"))
    counter = F.coalesce("set.amount", F.lit(0)) + F.coalesce("added", F.lit(0))
    return live.join(summed, "k", "left").select(F.col("k").alias(key), counter.alias("counter"), F.coalesce("tags", F.lit(0)).alias("tags"))


def with_ids(ops: DataFrame) -> DataFrame:
    """Operations (book, seq, op, section, content, id, metadata) with upper-cased op, and an id for each ADD without one:
    the section's first word and the book's running number of such ADDs, counted by a distributed sort."""
    x = ops.withColumn("op", F.upper("op"))
    bare = (F.col("op") == "ADD") & F.col("id").isNull()
    ranked = places(x.where(bare).select("book", "seq", "section"), [F.col("book"), F.col("seq")])
    first = ranked.groupBy("book").agg(F.min("place").alias("first"))
    prefix = F.lower(F.regexp_extract(F.coalesce("section", F.lit("")), r"^\s*(\S+)", 1))
    made = ranked.join(first, "book").select("book", "seq", F.format_string("%s-%05d", prefix, F.col("place") - F.col("first") + 1).alias("made"))
    return x.join(made, ["book", "seq"], "left").withColumn("id", F.coalesce("id", "made")).drop("made")


def books(ops: DataFrame) -> DataFrame:
    """(book, id, section, content, helpful, harmful, neutral, at) of the bullets that live after all operations.

    ADD opens a bullet (content null is empty; counters from metadata, else 0) and moves an id that lives to a new entry;
    UPDATE sets content and counters that it names, TAG adds the counters it names, REMOVE ends; these three do nothing
    without an id or to one that does not live. ``at`` is the ADD's seq: a section's bullets stand in its order. A seq
    occurs once a book; other metadata keys and ops are ignored.
    """
    x = with_ids(ops).where("id is not null")
    by = ["book", "id"]
    is_add, is_set = F.col("op") == "ADD", F.col("op").isin("ADD", "UPDATE")
    last = lambda when, *what: F.max(F.when(when, F.struct("seq", *what)))
    told = F.when(is_add, F.coalesce("content", F.lit(""))).otherwise(F.col("content"))
    value = lambda t: F.when(is_add, F.coalesce(F.col("metadata")[t], F.lit(0))).otherwise(F.col("metadata")[t])
    sets = [last(is_set & value(t).isNotNull(), value(t).alias("n")).alias(t) for t in TAGS]
    ends = x.groupBy(*by).agg(last(is_add, "section").alias("born"), F.max(F.when(F.col("op") == "REMOVE", F.col("seq"))).alias("gone"), last(is_set & told.isNotNull(), told.alias("text")).alias("said"), *sets)
    live = ends.where("born is not null and (gone is null or gone < born.seq)")
    after = lambda t: F.sum(F.when(F.col("seq") > F.col(f"{t}.seq"), F.col("metadata")[t])).alias(f"{t}_added")
    added = x.where(F.col("op") == "TAG").select(*by, "seq", "metadata").join(live.select(*by, *TAGS), by).groupBy(*by).agg(*map(after, TAGS))
    counters = [(F.col(f"{t}.n") + F.coalesce(f"{t}_added", F.lit(0))).alias(t) for t in TAGS]
    return live.join(added, by, "left").select(*by, F.col("born.section").alias("section"), F.col("said.text").alias("content"), *counters, F.col("born.seq").alias("at"))


def as_prompt(state: DataFrame) -> DataFrame:
    """(book, prompt): sections by name, each with its bullets in order. A book's live bullets are what one prompt holds."""
    line = F.concat(F.lit("- ["), "id", F.lit("] "), "content", F.lit(" ("), F.concat_ws(", ", *[F.concat(F.lit(f"{t}="), F.col(t)) for t in TAGS]), F.lit(")"))
    sections = state.groupBy("book", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda b: b["line"]), "\n").alias("lines"))
    text = F.struct("section", F.concat(F.lit("## "), "section", F.lit("\n"), "lines").alias("text"))
    return sections.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda s: s["text"]), "\n").alias("prompt"))


def lifetimes(ops: DataFrame, key: str, seq: str, op: str) -> DataFrame:
    """Birth (first ADD) and death (last REMOVE after it) of each key."""
    x = ops.groupBy(key).agg(F.min(F.when(F.col(op) == "ADD", F.col(seq))).alias("birth"), F.max(F.when(F.col(op) == "REMOVE", F.col(seq))).alias("death"))
    return x.where("birth is not null").withColumn("death", F.when(F.col("death") > F.col("birth"), F.col("death")))


def prune(state: DataFrame, key: str, score: str, newest: str, keep: int, limit: int) -> DataFrame:
    """The ``keep`` best by score and the newest others, ``limit`` together."""
    best = state.orderBy(F.col(score).desc(), key).limit(keep)
    late = state.join(best.select(key), key, "left_anti").orderBy(F.col(newest).desc(), key).limit(limit - keep)
    return best.unionByName(late)
