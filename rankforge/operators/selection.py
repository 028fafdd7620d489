"""Choosing rows: lookups with fallbacks, data sets near to or apart from a row, pools, samples and targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def split_lookup(df: DataFrame, sample: str, group: str, samples: DataFrame, groups: DataFrame, fallback: Column) -> DataFrame:
    """Adds split (that of the sample, else of the group, else the fallback) and how it was found."""
    x = df.withColumn("__hash", fallback)
    x = x.join(samples.withColumnRenamed("split", "__s"), sample, "left").join(groups.withColumnRenamed("split", "__g"), group, "left")
    how = F.when(F.col("__s").isNotNull(), "sample").when(F.col("__g").isNotNull(), "group").otherwise("hash")
    return x.withColumn("split", F.coalesce("__s", "__g", "__hash")).withColumn("how", how).drop("__s", "__g", "__hash")


def first_known(df: DataFrame, key: str, candidates: list[Column], aliases: DataFrame) -> DataFrame:
    """key and the label of its first candidate that the alias table (alias, label) holds; null without any."""
    each = df.select(key, F.posexplode(F.array(*candidates)).alias("at", "alias"))
    found = each.join(aliases, "alias").groupBy(key).agg(F.min_by("label", "at").alias("label"))
    return df.select(key).join(found, key, "left")


def _by(pairs: DataFrame, by: str, ds: str, name: str) -> DataFrame:
    return pairs.groupBy(by).agg(F.collect_set(ds).alias(name))


def _placed(rows: DataFrame, key: str, ds: str, every: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Each row with all data sets but its own, and those that hold its label and its class: arrays over a catalog of few sets."""
    whole = every.agg(F.collect_set(ds).alias("every"))  # one row
    x = rows.join(_by(labels, "label", ds, "with_label"), "label", "left").join(_by(classes, "class", ds, "with_class"), "class", "left").crossJoin(F.broadcast(whole))
    none = F.array().cast(x.schema["every"].dataType)
    x = x.withColumn("with_label", F.coalesce("with_label", none)).withColumn("with_class", F.coalesce("with_class", none))
    return x.withColumn("every", F.array_remove("every", F.col(ds)))


def _hashed(key: str, e: Column) -> Column:
    return F.sha1(F.concat_ws(":", F.col(key).cast("string"), e.cast("string")))


def apart(rows: DataFrame, key: str, ds: str, every: DataFrame, labels: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """key and the first n data sets in hash order that hold neither its label nor its class; rows without any go."""
    x = _placed(rows, key, ds, every, labels, classes)
    left = F.array_except(F.array_except("every", "with_label"), "with_class")
    order = F.array_sort(F.transform(left, lambda e: F.struct(_hashed(key, e).alias("h"), e.alias("ds"))))
    return x.select(key, F.transform(F.slice(order, 1, n), lambda e: e["ds"]).alias("experts")).where(F.size("experts") > 0)


def near(rows: DataFrame, key: str, ds: str, every: DataFrame, labels: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """key and n other data sets as (tier, h, ds): 0 with its label, 1 with its class, 2 others; in hash order within a tier."""
    x = _placed(rows, key, ds, every, labels, classes)
    tier = lambda e: F.when(F.array_contains("with_label", e), 0).when(F.array_contains("with_class", e), 1).otherwise(2)
    order = F.array_sort(F.transform("every", lambda e: F.struct(tier(e).alias("tier"), _hashed(key, e).alias("h"), e.alias("ds"))))
    return x.select(key, F.slice(order, 1, n).alias("experts"))


def distinct_first(df: DataFrame, group: str, kind: str, order: list[Column], n: int) -> DataFrame:
    """n rows a group: the first of each kind in order, then the others; ``rank`` tells their places.

    The first n rows of a (group, kind) are all that can be chosen, so only they meet in the group's window.
    """
    x = df.withColumn("__k", F.row_number().over(W.partitionBy(group, kind).orderBy(*order))).where(F.col("__k") <= n)
    x = x.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy((F.col("__k") > 1).cast("int"), *order)))
    return x.where(F.col("rank") <= n).drop("__k")


def random_split(df: DataFrame, key: str, seed: str, ratio: float) -> DataFrame:
    """The first round(n * ratio) rows in hash order are 'train', one at least and one at most left out; ranks by hash bucket."""
    h = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    x = df.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, 3))
    counts = x.groupBy("__b").agg(F.count("*").alias("__n"))  # 4096 rows at most
    before = W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy()).alias("__all"))
    rank = F.row_number().over(W.partitionBy("__b").orderBy("__h", key)) + F.col("__before")
    take = F.least(F.greatest(F.round(F.col("__all") * ratio), F.lit(1)), F.col("__all") - 1)
    return x.join(F.broadcast(counts), "__b").select(*df.columns, F.when(rank <= take, "train").otherwise("test").alias("split"))


def targets(spark: SparkSession, pool: DataFrame, key: str, k: int, families: tuple[str, ...]) -> DataFrame:
    """k targets (j, key, family): j-th pool row by turns, families by turns. The pool is bounded by its caller's limit."""
    order = W.orderBy(F.sha1(F.col(key).cast("string")), key)
    numbered = pool.select(key, (F.row_number().over(order) - 1).alias("i"))
    n = numbered.count()
    j = spark.range(k).withColumnRenamed("id", "j").withColumn("i", (F.col("j") % n).cast("int"))
    family = F.element_at(F.array(*map(F.lit, families)), (F.col("j") % len(families) + 1).cast("int"))
    return j.join(F.broadcast(numbered), "i").select("j", key, family.alias("family"))


def excerpts(cites: DataFrame, key: str, rule: str, at: str, rules: DataFrame, content: str) -> DataFrame:
    """key and its cited rules that are known, one a line, each once, by first citation."""
    first = cites.groupBy(key, rule).agg(F.min(at).alias("__at")).join(rules, rule)
    line = F.concat(F.lit("["), rule, F.lit("] "), content)
    got = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__at", line.alias("line")))).alias("x"))
    return got.select(key, F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("excerpt"))


def locked(sent: DataFrame, canonical: DataFrame, key: str, given: str, own: str) -> DataFrame:
    """key and state of a given list against the canonical one: missing, length, changed or same."""
    state = F.when(F.col(own).isNull(), "missing").when(F.size(given) != F.size(own), "length").when(F.col(given) != F.col(own), "changed").otherwise("same")
    return sent.join(canonical, key, "left").select(key, state.alias("state"))


def pool(df: DataFrame, group: str, eligible: str, order: list[Column], most: int) -> DataFrame:
    """``most`` eligible rows a group by order, with the group's count over all rows (total) and their interleaved place."""
    totals = df.groupBy(group).agg(F.count("*").alias("total"))
    x = df.where(eligible).withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("__r") <= most)
    place = F.row_number().over(W.orderBy("__r", group))  # over the bounded pool alone
    return x.join(totals, group).withColumn("place", place.cast("long")).drop("__r")


def state_examples(df: DataFrame, keys: dict[str, Column], context: dict[str, Column]) -> DataFrame:
    """Adds key and value of the first key with a value, and the context of all others as 'k=v; k=v'; rows without a key go."""
    filled = {k: F.when(v != "", v) for k, v in keys.items()}
    name = F.coalesce(*[F.when(v.isNotNull(), F.lit(k)) for k, v in filled.items()])
    x = df.withColumn("key", name).withColumn("value", F.coalesce(*filled.values())).where("key is not null")
    parts = [F.when((F.col("key") != k) & (v != ""), F.concat(F.lit(f"{k}="), v)) for k, v in context.items()]
    return x.withColumn("context", F.concat_ws("; ", *parts))
