"""Samples and augmentations that repeat at any partitioning: every random number is a hash of a seed, a key and a counter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankforge.functions.text import hash_fraction
from rankforge.operators.grouping import places
from rankforge.operators.ranking import top_k


def uniform(seed: str, key: Column, what: str, counter: Column | None = None) -> Column:
    """A number from 0 to 1 of a stream for each (seed, key, what)."""
    parts = [F.lit(seed), key.cast("string"), F.lit(what), *([] if counter is None else [counter.cast("string")])]
    return hash_fraction(F.concat_ws("|", *parts))


def augmented(items: Column, key: Column, seed: str, dropout: tuple[float, float] = (0.10, 0.30), swap: float = 0.10, most: tuple[int, int] = (120, 200)) -> Column:
    """A list with a share of its items dropped, neighbours swapped, and cut to a random length.

    Swaps go from the front: an item that is swapped is the next one's neighbour, so it can travel; the fold carries it.
    """
    low, high = dropout
    gone = F.floor(F.size(items) * (low + (high - low) * uniform(seed, key, "rate"))).cast("int")
    drawn = F.array_sort(F.transform(items, lambda x, i: F.struct(uniform(seed, key, "drop", i).alias("u"), i.alias("i"))))
    out = F.transform(F.slice(drawn, F.lit(1), gone), lambda x: x["i"])
    kept = F.filter(items, lambda x, i: ~F.array_contains(out, i))
    numbered = F.transform(kept, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    start = F.struct(F.slice(kept, 1, 0).alias("done"), F.slice(kept, 1, 1).alias("carried"))

    def step(s: Column, item: Column) -> Column:
        one = F.array(item["x"])
        swapped = uniform(seed, key, "swap", item["i"] - 1) < swap
        return F.struct(F.concat(s["done"], F.when(swapped, one).otherwise(s["carried"])).alias("done"), F.when(swapped, s["carried"]).otherwise(one).alias("carried"))

    moved = F.aggregate(F.slice(numbered, F.lit(2), F.size(numbered)), start, step, lambda s: F.concat(s["done"], s["carried"]))
    k = most[0] + F.floor(uniform(seed, key, "length") * (most[1] - most[0] + 1)).cast("int")
    return F.slice(moved, F.lit(1), F.least(k, F.lit(most[1])))


def clusters(rows: DataFrame, key: str, label: str, size: int, examples: int, seed: str) -> DataFrame:
    """(example, mode, member, label, key): coherent clusters on even examples, mixed ones of two labels on odd ones.

    Labels of at least ``size`` rows take part, in hash order; a label's rows too, of which only the first ``size``
    leave a map task. An even example takes the label of its number, an odd one the pair of its number, each modulo how
    many there are; half of a mixed cluster (rounded down, one at least) is the first label's. Pairs are reckoned from
    their number, not listed. Fewer than two labels give no mixed ones. Rows without a key or a label take no part.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(key).alias("key"), F.col(label).alias("label")).where("key is not null and label is not null")
    first = top_k(rows, ["label"], [uniform(seed, F.col("key"), "row"), F.col("key")], size, "member")
    able = rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= size).select("label")
    placed = places(able, [uniform(seed, F.col("label"), "label"), F.col("label")]).select("label", "place")
    g = placed.count()
    pairs = g * (g - 1) // 2
    half = max(1, size // 2)
    told = spark.range(examples).withColumnRenamed("id", "example")
    even = told.where("example % 2 = 0").select("example", F.lit("coherent").alias("mode"), F.expr(f"example % {max(g, 1)}").alias("place"), F.lit(1).alias("a"), F.lit(size).alias("b"), F.lit(0).alias("shift"))
    p = F.expr(f"example % {max(pairs, 1)}")
    left = g - 2 - F.floor((F.sqrt(4.0 * g * (g - 1) - 7 - 8 * p) - 1) / 2)
    odd = told.where(f"example % 2 = 1 and {pairs} > 0").withColumn("left", left.cast("long"))
    right = p + F.col("left") + 1 - pairs + F.expr(f"({g} - left) * ({g} - left - 1) div 2")
    both = F.explode(F.array(F.struct(F.col("left").alias("place"), F.lit(half).alias("b"), F.lit(0).alias("shift")), F.struct(right.cast("long").alias("place"), F.lit(size - half).alias("b"), F.lit(half).alias("shift"))))
    odd = odd.select("example", F.lit("mixed").alias("mode"), both.alias("x")).select("example", "mode", "x.place", F.lit(1).alias("a"), "x.b", "x.shift")
    chosen = even.unionByName(odd).join(placed, "place").join(first, "label").where("member between a and b")
    return chosen.select("example", "mode", (F.col("member") + F.col("shift")).alias("member"), "label", "key")


def normalized(c: Column) -> Column:
    """Lower case, underscores and runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[_\s]+", " "))


def resolve_names(values: DataFrame, aliases: DataFrame) -> DataFrame:
    """(value, name): the name that each value stands for.

    ``aliases``: alias, name, at (their order; of equal aliases the first place and the last name count). A value equal
    to an alias has its name; else the first alias counts that holds the value or that the value holds. Both directions
    are joins by equality on substrings: those of aliases of any length, those of values of lengths that aliases have.
    Empty values and aliases resolve to nothing.
    """
    known = aliases.select(normalized(F.col("alias")).alias("alias"), "name", "at").where("alias <> ''").groupBy("alias").agg(F.min("at").alias("at"), F.max_by("name", "at").alias("name"))
    plain = values.select("value", normalized(F.col("value")).alias("v")).where("v <> ''").distinct()
    distinct = plain.select("v").distinct()
    lengths = sorted(r["n"] for r in known.select(F.length("alias").alias("n")).distinct().collect())  # as many as names have lengths
    pieces = lambda c, sizes: F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(F.col(c), i, n)))))
    sizes = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("v"))
    inside = known.select("at", "name", F.explode(pieces("alias", F.sequence(F.lit(1), F.length("alias")))).alias("v")).join(distinct, "v")
    around = distinct.select("v", F.explode(pieces("v", sizes)).alias("alias")).join(known, "alias")
    hits = inside.select("v", "at", "name", F.lit(1).alias("rank")).unionByName(around.select("v", "at", "name", F.when(F.col("alias") == F.col("v"), 0).otherwise(1).alias("rank")))
    best = hits.groupBy("v").agg(F.min_by("name", F.struct("rank", "at")).alias("name"))
    return plain.join(best, "v").select("value", "name")


def candidate_names(rows: DataFrame, key: str, lists: list[str], aliases: DataFrame) -> DataFrame:
    """(key, names): the distinct names of a row's values, list after list, in their order."""
    each = F.posexplode(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists]))
    long = rows.select(key, each.alias("pos", "value"))
    found = long.join(resolve_names(long.select("value"), aliases), "value").groupBy(key, "name").agg(F.min("pos").alias("pos"))
    named = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    return rows.select(key).join(named, key, "left").select(key, F.coalesce("names", F.array().cast("array<string>")).alias("names"))
