"""Rules that give each row a list of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def verify(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds issues (names of the rules whose condition holds, in order) and passed; a null condition is no issue."""
    found = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]
    issues = F.array_compact(F.array(*found))
    return df.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0)


def report(verified: DataFrame) -> DataFrame:
    """Issue counts, beside the rows and the passed ones."""
    total = verified.agg(F.count("*").alias("rows"), F.count_if("passed").alias("passed")).selectExpr("stack(2, 'rows', rows, 'passed', passed) as (issue, n)")
    return total.unionByName(verified.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n")))


def answer_shape(keys: Column, required: tuple[str, ...]) -> Column:
    """Issues of an answer's keys: one given twice, one that is required and missing."""
    twice = F.exists(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda x: x == k)) > 1)
    missing = F.size(F.array_except(F.array(*map(F.lit, required)), keys)) > 0
    return codes({"duplicate_key": twice, "missing_key": missing})


def codes(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order; a null condition does not hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def detail_items(details: Column, key: str) -> Column:
    """The comma list under a key of 'k=v;k=v' details."""
    value = F.coalesce(F.try_element_at(F.str_to_map(details, F.lit(";"), F.lit("=")), F.lit(key)), F.lit(""))
    return F.filter(F.split(value, ","), lambda x: x != "")


def context(claims: Column, metadata: Column, allowed: tuple[str, ...]) -> Column:
    """Issues of context claims (value, verified, source, key): later tests only where the earlier ones hold."""
    some = lambda test: F.exists(claims, test)
    ours = lambda c: c["source"] == "source_metadata"
    known = lambda c: ours(c) & c["key"].isin(*allowed)
    given = lambda c: F.try_element_at(metadata, c["key"])
    return codes({
        "unverified": some(lambda c: ~F.coalesce(c["verified"], F.lit(False))),
        "source": some(lambda c: ~F.coalesce(ours(c), F.lit(False))),
        "key": some(lambda c: ours(c) & ~c["key"].isin(*allowed)),
        "value": some(lambda c: known(c) & ~F.coalesce(c["value"] == F.concat_ws("=", c["key"], given(c)), F.lit(False)) | known(c) & given(c).isNull()),
    })


def leakage(claims: Column, gold: Column, task: Column, forbidden: dict[str, tuple[str, ...]]) -> Column:
    """Issues where context bears the label: a key that the task forbids, or the label's text in a claim."""
    label = F.lower(F.trim(F.coalesce(gold, F.lit(""))))
    keys = F.lit(False)
    for name, ks in forbidden.items():
        keys = keys | (task == name) & F.arrays_overlap(F.transform(claims, lambda c: c["key"]), F.array(*map(F.lit, ks)))
    return codes({"forbidden_key": (label != "") & keys, "label_in_context": (label != "") & F.exists(claims, lambda c: F.contains(F.lower(c["value"]), label))})


def alignment(fields: dict[str, Column], wanted: dict[str, Column], levels: tuple[str, ...]) -> Column:
    """Issues where an answer's fields differ from what the claims say, and a confidence outside its levels."""
    rules = {k.lower(): ~fields[k].eqNullSafe(F.coalesce(F.when(v != "", v), F.lit("none"))) for k, v in wanted.items()}
    return codes({**rules, "confidence": ~F.coalesce(F.lower(fields["CONFIDENCE"]), F.lit("")).isin(*levels)})
