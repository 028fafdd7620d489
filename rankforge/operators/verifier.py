"""The verifier: task examples and their claims against a marker catalog and the examples' own data.

Claims come in long form, one row each, so that the catalog is looked up by equality: a claim meets the row of its
(label, marker) and of its label, not a label's list. Each example then holds its own few claims and is judged by
column expressions alone. An issue is (field, code, value): where, what, and which value it names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from rankforge.operators.verify import detail_items

ISSUES = "array<struct<field: string, code: string, value: string>>"


@dataclass(frozen=True)
class Rules:
    """What examples are held against: fixed words of the format, given by the caller."""

    fields: tuple[str, ...]
    panel: str
    levels: tuple[str, ...]
    context_keys: tuple[str, ...]
    reason: str
    differential: str
    generic: str
    forbidden: dict[str, tuple[str, ...]] = field(default_factory=dict)
    by_source: tuple[str, ...] = ()

    @property
    def tasks(self) -> list[str]:
        return [*self.forbidden, *self.by_source]


def sure(c: Column) -> Column:
    """A condition whose null is false."""
    return F.coalesce(c, F.lit(False))


def _issue(where: str, code: str, value: Column | None = None) -> Column:
    return F.struct(F.lit(where).alias("field"), F.lit(code).alias("code"), (F.lit("") if value is None else F.coalesce(value.cast("string"), F.lit(""))).alias("value"))


def one(where: str, code: str, holds: Column, value: Column | None = None) -> Column:
    """At most one issue, of the example itself."""
    return F.when(sure(holds), F.array(_issue(where, code, value))).otherwise(F.array().cast(ISSUES))


def each(claims: Column, where: str, code: str, test, value=lambda c: c["value"]) -> Column:
    """An issue for every claim that a test holds for."""
    return F.transform(F.filter(claims, lambda c: sure(test(c))), lambda c: _issue(where, code, value(c)))


def joined(*parts: Column) -> Column:
    return F.concat(*[p.cast(ISSUES) for p in parts])


def answer_fields(text: Column) -> Column:
    """(key, value) of each line with a colon, trimmed, in order; keys as they are written."""
    edges = r"^\s+|\s+$"
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.regexp_replace(x, edges, "")), lambda x: F.instr(x, ":") > 0)
    return F.transform(lines, lambda x: F.struct(F.regexp_replace(F.substring_index(x, ":", 1), edges, "").alias("key"), F.regexp_replace(F.regexp_replace(x, "^[^:]*:", ""), edges, "").alias("value")))


def said(fields: Column, key: str) -> Column:
    """The last value of a key; null where there is none."""
    return F.try_element_at(F.filter(fields, lambda f: f["key"] == key), F.lit(-1))["value"]


def shape(fields: Column, required: tuple[str, ...]) -> Column:
    keys = F.transform(fields, lambda f: f["key"])
    again = F.filter(F.transform(keys, lambda k, i: F.when(F.array_contains(F.slice(keys, F.lit(1), i), k), k)), lambda k: k.isNotNull())
    return joined(F.transform(again, lambda k: _issue("answer_text", "duplicate_key", k)), F.transform(F.array_except(F.array(*map(F.lit, required)), keys), lambda k: _issue("answer_text", "missing_key", k)))


def evidence(claims: Column, observed: Column, generic: str, sources: tuple[str, ...] = ("observed_gene", "marker_catalog")) -> Column:
    """Claims: value, verified, source, direction, profile (the label looked up), has_profile, approved (its marker)."""
    listed = lambda c: sure(c["source"] == "marker_catalog")
    repeated = F.size(F.array_distinct(F.transform(claims, lambda c: c["value"]))) != F.size(claims)
    return joined(
        one("evidence", "missing", F.size(claims) == 0),
        each(claims, "evidence", "unverified", lambda c: ~sure(c["verified"])),
        each(claims, "evidence", "source", lambda c: ~sure(c["source"].isin(*sources)), lambda c: c["source"]),
        each(claims, "evidence", "unobserved", lambda c: ~sure(F.array_contains(observed, c["value"]))),
        each(claims, "evidence", "generic", lambda c: F.upper(c["value"]).rlike(generic)),
        each(claims, "evidence", "no_profile", lambda c: listed(c) & ~c["has_profile"], lambda c: c["profile"]),
        each(claims, "evidence", "not_approved", lambda c: listed(c) & c["has_profile"] & ~c["approved"]),
        each(claims, "evidence", "direction", lambda c: listed(c) & ~sure(c["direction"] == "supports_gold")),
        one("evidence", "duplicate", repeated),
    )


def exclusions(claims: Column, gold: Column, candidates: Column, observed: Column, differential: Column, reason: str) -> Column:
    """Claims as for evidence, with details and marks: array of (marker, approved) of the details."""
    listed = lambda c: sure(c["source"] == "marker_catalog")
    told = lambda c: listed(c) & sure(F.contains(c["details"], F.lit(f"reason={reason}")))
    marks = lambda c, test: F.transform(F.filter(c["marks"], lambda m: sure(test(m))), lambda m: m["marker"])
    named = lambda code, test: F.flatten(F.transform(F.filter(claims, lambda c: told(c) & c["has_profile"]), lambda c: F.transform(marks(c, test), lambda m: _issue("exclusions", code, m))))
    return joined(
        one("candidate_labels", "few_candidates", differential & (F.size(candidates) < 2)),
        one("candidate_labels", "gold_not_candidate", differential & ~sure(F.array_contains(candidates, gold))),
        each(claims, "exclusions", "unverified", lambda c: ~sure(c["verified"])),
        each(claims, "exclusions", "gold_excluded", lambda c: c["value"] == gold),
        each(claims, "exclusions", "not_candidate", lambda c: (F.size(candidates) > 0) & ~sure(F.array_contains(candidates, c["value"]))),
        each(claims, "exclusions", "source", lambda c: ~sure(c["source"].isin("candidate_set", "marker_catalog")), lambda c: c["source"]),
        each(claims, "exclusions", "no_profile", lambda c: listed(c) & ~c["has_profile"], lambda c: c["profile"]),
        each(claims, "exclusions", "direction", lambda c: listed(c) & ~sure(c["direction"] == "against_candidate")),
        each(claims, "exclusions", "no_reason", lambda c: listed(c) & ~told(c)),
        each(claims, "exclusions", "no_markers", lambda c: told(c) & (F.size(c["marks"]) == 0)),
        named("not_approved", lambda m: ~m["approved"]),
        named("marker_observed", lambda m: F.array_contains(observed, m["marker"])),
        one("exclusions", "coverage", differential & (F.size(claims) != F.greatest(F.lit(0), F.size(candidates) - 1))),
    )


def context(claims: Column, metadata: Column, allowed: tuple[str, ...]) -> Column:
    """Later tests of a claim only where the earlier ones hold."""
    ours = lambda c: sure(c["source"] == "source_metadata")
    known = lambda c: ours(c) & sure(c["key"].isin(*allowed))
    given = lambda c: F.try_element_at(metadata, c["key"])
    return joined(
        each(claims, "context", "unverified", lambda c: ~sure(c["verified"])),
        each(claims, "context", "source", lambda c: ~ours(c), lambda c: c["source"]),
        each(claims, "context", "key", lambda c: ours(c) & ~known(c), lambda c: c["key"]),
        each(claims, "context", "value", lambda c: known(c) & ~sure(c["value"] == F.concat(c["key"], F.lit("="), given(c)))),
    )


def leakage(claims: Column, gold: Column, task: Column, source_key: Column, rules: Rules) -> Column:
    """Keys that the task forbids (fixed ones, or the one that the row's own label came from), and the label in a claim."""
    label = F.lower(F.trim(F.coalesce(gold, F.lit(""))))
    fixed = F.coalesce(*[F.when(task == t, F.array(*map(F.lit, ks))) for t, ks in rules.forbidden.items()], F.array().cast("array<string>"))
    own = F.when(task.isin(*rules.by_source) & (source_key != ""), F.array(source_key)) if rules.by_source else F.lit(None).cast("array<string>")
    keys = F.concat(fixed, F.coalesce(own, F.array().cast("array<string>")))
    return joined(
        each(claims, "context", "forbidden_key", lambda c: (label != "") & F.array_contains(keys, c["key"]), lambda c: c["key"]),
        each(claims, "context", "label_in_context", lambda c: (label != "") & F.contains(F.lower(c["value"]), label)),
    )


def alignment(fields: Column, gold: Column, claims: dict[str, Column], negative: Column, has_panel: Column, rules: Rules) -> Column:
    """The answer's fields against the label, the claims in their order, and the label's negative markers (their list's SHA-256)."""
    label = F.trim(F.coalesce(gold, F.lit("")))
    listed = lambda c, sep: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x["value"]), sep)).otherwise(F.lit("none"))
    wanted = {"LABEL": label, "FINAL": label, "EVIDENCE": listed(claims["evidence"], ", "), "EXCLUSIONS": listed(claims["exclusion"], ", "), "CONTEXT": listed(claims["context"], "; ")}
    level = F.coalesce(said(fields, "CONFIDENCE"), F.lit(""))
    return joined(
        *[one("answer_text", "differs", ~sure(said(fields, k) == v), F.lit(k)) for k, v in wanted.items()],
        one("answer_text", "differs", has_panel & said(fields, rules.panel).isNotNull() & ~sure(F.sha2(said(fields, rules.panel), 256) == negative), F.lit(rules.panel)),
        one("answer_text", "confidence", ~F.lower(level).isin(*rules.levels), level),
    )


#: Labels that are sent to all tasks; more are joined as other rows are.
FEW_LABELS = 20_000


def small(labels: DataFrame) -> DataFrame:
    """A table of one row a label, told to be broadcast if it is small, so that rows need not move to their labels."""
    return F.broadcast(labels) if labels.limit(FEW_LABELS + 1).count() <= FEW_LABELS else labels


def looked_up(claims: DataFrame, profiles: DataFrame) -> DataFrame:
    """Claims (id, kind, n, value, verified, source, matched, direction, details, key) as one row an id: ``claims``, an array in order.

    A claim's profile is that of its matched label, an exclusion's otherwise of its value. ``profiles``: label, marker,
    positive. Labels and pairs are joined by equality. Claims move once, to their id; only (id, label, marker) goes to
    the catalog, and the pairs found there come back.
    """
    labels = small(profiles.select(F.col("label").alias("profile"), F.lit(True).alias("has_profile")).distinct())
    pairs = profiles.where("positive").select(F.col("label").alias("profile"), F.col("marker").alias("value"))
    label = F.when(F.col("kind") == "exclusion", F.coalesce(F.when(F.col("matched") != "", F.col("matched")), F.col("value"))).otherwise(F.col("matched"))
    items = lambda c: F.when(c("kind") == "exclusion", detail_items(c("details"), "candidate_markers")).otherwise(F.array().cast("array<string>"))
    c = claims.withColumn("profile", label)
    asked = c.where("profile is not null").select("id", "profile", F.explode(F.array_distinct(F.concat(F.array("value"), items(F.col)))).alias("value"))
    found = asked.join(pairs, ["profile", "value"], "left_semi").groupBy("id").agg(F.collect_set(F.struct("profile", "value")).alias("found"))
    row = F.struct("n", "kind", "value", "verified", "source", "direction", "details", "key", "profile", F.coalesce("has_profile", F.lit(False)).alias("has_profile"))
    held = c.join(labels, "profile", "left").groupBy("id").agg(F.collect_list(row).alias("claims")).join(found, "id", "left")
    found = F.coalesce("found", F.array().cast(dict(held.dtypes)["found"]))
    approved = lambda c, v: sure(F.array_contains(found, F.struct(c["profile"].alias("profile"), v.alias("value")))).alias("approved")
    marks = lambda c: F.transform(items(lambda k: c[k]), lambda m, at: F.struct(at.alias("at"), m.alias("marker"), approved(c, m)))
    told = ("n", "kind", "value", "verified", "source", "direction", "details", "key", "profile", "has_profile")
    whole = F.transform("claims", lambda c: F.struct(*[c[k].alias(k) for k in told], approved(c, c["value"]), marks(c).alias("marks")))
    return held.select("id", F.array_sort(whole).alias("claims"))


def verify_examples(examples: DataFrame, claims: DataFrame, profiles: DataFrame, rules: Rules) -> DataFrame:
    """id, task, passed and issues of every example.

    ``examples``: id, task, label, source_key, canonical (the label to look up, else the label's own), genes, candidates,
    metadata (a map), answer, current (whether its schema has the panel field). Alignment is judged only where an
    answer's shape is right. Null lists are empty, a null flag is not verified.
    """
    none = F.array().cast("array<string>")
    negative = profiles.where("not positive").groupBy(F.col("label").alias("lookup")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "marker"))).getField("marker"), ", ").alias("negative")).select("lookup", F.sha2("negative", 256).alias("negative"))  # lists are long, and each goes to many rows
    x = examples.withColumn("lookup", F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in (F.col("canonical"), F.col("label"))]))
    x = x.join(looked_up(claims, profiles), "id", "left").join(small(negative), "lookup", "left")
    x = x.withColumns({"genes": F.coalesce("genes", none), "candidates": F.coalesce("candidates", none), "answer_fields": answer_fields(F.col("answer")), "current": F.coalesce("current", F.lit(False))})
    kinds = ("evidence", "exclusion", "context")
    held = F.coalesce("claims", F.array().cast(dict(x.dtypes)["claims"]))
    x = x.withColumns({f"{k}_claims": F.filter(held, _of(k)) for k in kinds}).withColumn("shape", shape(F.col("answer_fields"), rules.fields))
    e, ex, co = (F.col(f"{k}_claims") for k in kinds)
    differential = F.coalesce(F.col("task") == rules.differential, F.lit(False))
    aligned = alignment(F.col("answer_fields"), F.col("label"), {"evidence": e, "exclusion": ex, "context": co}, F.coalesce("negative", F.sha2(F.lit("none"), 256)), F.col("current"), rules)
    issues = joined(
        one("genes", "empty", F.size("genes") == 0),
        one("gold_fields", "no_label", F.coalesce(F.col("label"), F.lit("")) == ""),
        one("task_type", "unknown_task", ~sure(F.col("task").isin(*rules.tasks)), F.col("task")),
        F.col("shape"),
        one("answer_text", "missing_key", F.col("current") & said(F.col("answer_fields"), rules.panel).isNull(), F.lit(rules.panel)),
        evidence(e, F.col("genes"), rules.generic),
        exclusions(ex, F.col("label"), F.col("candidates"), F.col("genes"), differential, rules.reason),
        context(co, F.col("metadata"), rules.context_keys),
        leakage(co, F.col("label"), F.col("task"), F.col("source_key"), rules),
        F.when(F.size("shape") == 0, aligned).otherwise(F.array().cast(ISSUES)),
    )
    return x.select("id", "task", issues.alias("issues")).withColumn("passed", F.size("issues") == 0)


def _of(kind: str):
    return lambda c: c["kind"] == kind


def report(results: DataFrame) -> DataFrame:
    """task, field, code and n: how many issues of each sort; rows and passed ones have an empty field."""
    count = lambda where, code, n: F.struct(where.alias("field"), code.alias("code"), n.cast("long").alias("n"))
    whole = F.array(count(F.lit(""), F.lit("rows"), F.lit(1)), count(F.lit(""), F.lit("passed"), F.col("passed")))
    each_one = F.concat(whole, F.transform("issues", lambda i: count(i["field"], i["code"], F.lit(1))))  # the results are made once
    return results.select("task", F.explode(each_one).alias("i")).groupBy("task", "i.field", "i.code").agg(F.sum("i.n").alias("n"))


def sample_issues(samples: DataFrame, experts: DataFrame, families: dict[str, str]) -> DataFrame:
    """id, n, family and issues of samples of every family.

    ``samples``: n (their order), id, family, candidates, oracles, genes, support, abstain, profiles and profile_support
    (maps from a profile's name to items), combined. ``experts`` (expert) are the known ones, looked up by equality.
    ``families`` names those with rules of their own: ``cross`` needs two candidates, ``ood`` no oracles and an
    abstention, ``bundle`` two profiles, each one's support among its items, and combined items among any profile's. Of
    rows with one id all but the first are repeats. Null lists and maps are empty, a null flag is no abstention.
    """
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string, array<string>>")
    x = samples.withColumns({c: F.coalesce(c, none) for c in ("candidates", "oracles", "genes", "support", "combined")} | {c: F.coalesce(c, empty) for c in ("profiles", "profile_support")})
    first = x.groupBy("id").agg(F.min("n").alias("first"))
    known = experts.select("expert", F.lit(True).alias("known")).distinct()
    strange = x.select("n", F.explode("candidates").alias("expert")).join(known, "expert", "left").where("known is null").groupBy("n").agg(F.array_sort(F.collect_set("expert")).alias("strange"))
    x = x.join(first, "id", "left").join(strange, "n", "left")
    named = lambda code, values, say=lambda v: v: F.transform(values, lambda v: _issue("sample", code, say(v)))
    is_of = lambda k: F.col("family") == families[k]
    within = lambda when, issues: F.when(sure(when), issues.cast(ISSUES)).otherwise(F.array().cast(ISSUES))
    items = F.flatten(F.map_values("profiles"))
    astray = F.flatten(F.transform(F.map_entries("profile_support"), lambda e: F.transform(F.filter(e["value"], lambda v: ~F.array_contains(F.coalesce(F.try_element_at(F.col("profiles"), e["key"]), none), v)), lambda v: F.concat_ws(":", e["key"], v))))
    issues = joined(
        one("sample", "duplicate_id", F.col("n") > F.col("first"), F.col("id")),
        named("unknown_expert", F.coalesce("strange", none)),
        named("oracle_not_candidate", F.array_except("oracles", "candidates")),
        named("support_not_given", F.filter("support", lambda v: ~F.array_contains("genes", v))),
        one("sample", "few_candidates", is_of("cross") & (F.size("candidates") < 2)),
        one("sample", "oracle_of_none", is_of("ood") & (F.size("oracles") > 0)),
        one("sample", "no_abstention", is_of("ood") & ~sure(F.col("abstain"))),
        one("sample", "few_profiles", is_of("bundle") & (F.size("profiles") < 2)),
        within(is_of("bundle"), named("profile_support_not_given", astray)),
        within(is_of("bundle"), named("combined_not_given", F.filter("combined", lambda v: ~F.array_contains(items, v)))),
    )
    return x.select("id", "n", "family", issues.alias("issues"))
