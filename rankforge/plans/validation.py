"""Queries of the verifier: six rule sets over claims, checks of samples and of role outputs. Claims come from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.functions import parsing as ps, text as tx
from rankforge.operators import verifier, verify
from rankforge.operators.factors import written
from rankforge.plans.registry import query, t

_CODES = "SELECT k, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS issues FROM {} GROUP BY 1"
_PROFILES = "prof AS (SELECT p_type, list('P' || p_partkey) AS m FROM part WHERE p_size <= 40 AND p_type <> 'PROMO' GROUP BY 1)"
_CLAIMS = f"""{_PROFILES}, c AS (SELECT l_orderkey AS k, 'P' || l_partkey AS v, l_discount <= 0.08 AS verified, l_returnflag AS flag, l_linenumber AS line, p_type, m,
    CASE WHEN l_quantity > 48 THEN 'guess' WHEN l_linestatus = 'O' THEN 'observed_gene' ELSE 'marker_catalog' END AS src FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN prof USING (p_type)),
  g AS (SELECT o_orderkey AS k, coalesce(list(DISTINCT 'P' || l_partkey) FILTER (l_returnflag <> 'A'), []) AS genes FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"""


def _text(issues):
    return F.array_join(F.array_sort(issues), ",").alias("issues")


def _claims(spark, d):
    """Each order's lines as claims in long form, its observed items, and the profiles: items of small parts by type."""
    part = t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", "p_size")
    profiles = part.where("p_size <= 40 and p_type <> 'PROMO'").select(F.col("p_type").alias("label"), F.concat(F.lit("P"), "l_partkey").alias("marker"), F.lit(True).alias("positive"))
    lines = t(spark, d, "lineitem").join(part, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag", "l_discount", "p_type")
    lines = written(lines, "lines").withColumn("value", F.concat(F.lit("P"), "l_partkey"))  # read three times
    source = F.when(F.col("l_quantity") > 48, "guess").when(F.col("l_linestatus") == "O", "observed_gene").otherwise("marker_catalog")
    n = F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("n")
    claims = lines.select(F.col("l_orderkey").alias("id"), n, "value", (F.col("l_discount") <= 0.08).alias("verified"), source.alias("source"), F.col("p_type").alias("matched"), F.col("l_returnflag").alias("flag"), F.lit("").alias("details"), F.lit("").alias("key"))
    genes = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.when(F.col("l_returnflag") != "A", F.col("value"))).alias("genes"))
    return claims, genes, profiles


def _codes(issues):
    return _text(F.array_distinct(F.transform(issues, lambda i: i["code"])))


_KEYS = ("LABEL", "EVIDENCE", "EXCLUSIONS", "CONTEXT", "CONFIDENCE", "FINAL")


@query(_CODES.format("""(SELECT o_orderkey AS k, 'duplicate_key' AS code FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'missing_key' FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, NULL FROM orders)"""))
def verify_shape(spark, d):
    """Answers with a key twice (in another case) or without their last key."""
    k = F.col("o_orderkey")
    whole = tx.render_fields({x: F.lit("v: w") for x in _KEYS[:-1]})
    answer = F.concat(whole, F.when(k % 5 == 0, F.lit("\nlabel: again")).otherwise(F.lit("")), F.when(k % 3 == 0, F.lit("\nno key here")).otherwise(F.lit("\nFinal: v")))
    return t(spark, d, "orders").select(k.alias("k"), _text(verify.answer_shape(ps.answer_keys(answer), _KEYS)))


@query(f"WITH {_CLAIMS}, i AS (SELECT k, NULL AS code FROM g UNION ALL SELECT k, 'missing' FROM g ANTI JOIN c USING (k) UNION ALL SELECT k, 'unverified' FROM c WHERE NOT verified UNION ALL SELECT k, 'source' FROM c WHERE src = 'guess' "
       "UNION ALL SELECT k, 'unobserved' FROM c JOIN g USING (k) WHERE NOT list_contains(genes, v) UNION ALL SELECT k, 'generic' FROM c WHERE regexp_matches(v, '^P1[0-9]7$') UNION ALL SELECT k, 'no_profile' FROM c WHERE src = 'marker_catalog' AND m IS NULL "
       "UNION ALL SELECT k, 'not_approved' FROM c WHERE src = 'marker_catalog' AND NOT list_contains(m, v) UNION ALL SELECT k, 'direction' FROM c WHERE src = 'marker_catalog' AND flag = 'R' "
       "UNION ALL SELECT k, 'duplicate' FROM c GROUP BY k HAVING count(*) > count(DISTINCT v)) " + _CODES.format("i"))  # fmt: skip
def verify_evidence(spark, d):
    claims, genes, profiles = _claims(spark, d)
    claims = claims.withColumn("kind", F.lit("evidence")).withColumn("direction", F.when(F.col("flag") == "R", "against").otherwise("supports_gold"))
    x = t(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(genes, "id", "left").join(verifier.looked_up(claims, profiles), "id", "left")
    x = x.withColumn("claims", F.coalesce("claims", F.array().cast(dict(x.dtypes)["claims"]))).withColumn("genes", F.coalesce("genes", F.array().cast("array<string>")))
    return x.select(F.col("id").alias("k"), _codes(verifier.evidence(F.col("claims"), F.col("genes"), "^P1[0-9]7$")))


_EXCLUSIONS = f"""{_CLAIMS}, e AS (SELECT c.*, k % 2 = 0 AS diff, CASE k % 3 WHEN 0 THEN 'candidate_set' ELSE src END AS s, line % 3 <> 0 AS told, line % 4 <> 0 AS marked,
    CASE k % 7 WHEN 0 THEN v ELSE 'gold' END AS gold, genes FROM c JOIN g USING (k)),
  n AS (SELECT k, k % 2 = 0 AS diff, list('P' || l_partkey) AS vs, count(*) AS n, CASE k % 5 WHEN 0 THEN ['gold'] ELSE list_concat(list_distinct(list('P' || l_partkey)), CASE k % 7 WHEN 1 THEN [] ELSE ['gold'] END) END AS cand
    FROM (SELECT o_orderkey AS k, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY k)"""


@query(f"WITH {_EXCLUSIONS}, i AS (SELECT k, NULL AS code FROM n UNION ALL SELECT k, 'few_candidates' FROM n WHERE diff AND len(cand) < 2 UNION ALL SELECT k, 'gold_not_candidate' FROM n WHERE diff AND NOT list_contains(cand, 'gold') "
       "UNION ALL SELECT k, 'unverified' FROM e WHERE NOT verified UNION ALL SELECT k, 'not_candidate' FROM e JOIN n USING (k) WHERE NOT list_contains(cand, v) UNION ALL SELECT k, 'source' FROM e WHERE s NOT IN ('candidate_set', 'marker_catalog') "
       "UNION ALL SELECT k, 'no_profile' FROM e WHERE s = 'marker_catalog' AND m IS NULL UNION ALL SELECT k, 'direction' FROM e WHERE s = 'marker_catalog' AND flag = 'R' UNION ALL SELECT k, 'no_reason' FROM e WHERE s = 'marker_catalog' AND NOT told "
       "UNION ALL SELECT k, 'no_markers' FROM e WHERE s = 'marker_catalog' AND told AND NOT marked UNION ALL SELECT k, 'not_approved' FROM e WHERE s = 'marker_catalog' AND told AND marked AND NOT list_contains(m, v) "
       "UNION ALL SELECT k, 'marker_observed' FROM e WHERE s = 'marker_catalog' AND told AND marked AND m IS NOT NULL AND list_contains(genes, v) UNION ALL SELECT k, 'coverage' FROM n WHERE diff AND n <> greatest(0, len(cand) - 1)) " + _CODES.format("i"))  # fmt: skip
def verify_exclusions(spark, d):
    """An order's lines as exclusions of a differential question (even orders), their own item as the marker told."""
    claims, genes, profiles = _claims(spark, d)
    k, line = F.col("id"), F.col("n.l_linenumber")
    told = F.when(line % 3 != 0, F.lit("reason=missing_candidate_markers;")).otherwise(F.lit("note;"))
    mark = F.when(line % 4 != 0, F.concat(F.lit("candidate_markers="), "value", F.lit(","))).otherwise(F.lit("candidate_markers="))
    claims = claims.withColumns({"kind": F.lit("exclusion"), "source": F.when(k % 3 == 0, "candidate_set").otherwise(F.col("source")), "direction": F.when(F.col("flag") == "R", "supports").otherwise("against_candidate"), "details": F.concat(told, mark)})
    x = verifier.looked_up(claims, profiles).join(genes, "id")
    values, gold = F.array_distinct(F.transform("claims", lambda c: c["value"])), F.array(F.lit("gold"))
    candidates = F.when(k % 5 == 0, gold).when(k % 7 == 1, values).otherwise(F.concat(values, gold))
    issues = verifier.exclusions(F.col("claims"), F.lit("gold"), candidates, F.col("genes"), k % 2 == 0, "missing_candidate_markers")
    return x.select(k.alias("k"), _codes(issues))


_CONTEXT = """c AS (SELECT l_orderkey AS k, ['status', 'priority', 'secret', 'absent'][l_linenumber % 4 + 1] AS key, l_quantity > 48 AS other, l_discount <= 0.08 AS verified, l_tax > 0.07 AS wrong, o_orderstatus AS status, o_orderpriority AS priority
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def _context(spark, d):
    """Context claims of an order's lines: one key each, some not allowed, absent, unverified or with another value."""
    keys = F.array(*map(F.lit, ("status", "priority", "secret", "absent")))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority")
    x = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k").join(o, "k")
    key = F.element_at(keys, (F.col("l_linenumber") % 4 + 1).cast("int"))
    given = F.when(key == "status", F.col("o_orderstatus")).when(key == "priority", F.col("o_orderpriority")).otherwise(F.lit("x"))
    value = F.concat(key, F.lit("="), given, F.when(F.col("l_tax") > 0.07, F.lit("!")).otherwise(F.lit("")))
    source = F.when(F.col("l_quantity") > 48, "guess").otherwise("source_metadata")
    claim = F.struct(value.alias("value"), key.alias("key"), (F.col("l_discount") <= 0.08).alias("verified"), source.alias("source"))
    return x.groupBy("k", "o_orderstatus", "o_orderpriority").agg(F.collect_list(claim).alias("claims"))


@query(f"WITH {_CONTEXT}, i AS (SELECT k, NULL AS code FROM c UNION ALL SELECT k, 'unverified' FROM c WHERE NOT verified UNION ALL SELECT k, 'source' FROM c WHERE other UNION ALL SELECT k, 'key' FROM c WHERE NOT other AND key = 'secret' "
       "UNION ALL SELECT k, 'value' FROM c WHERE NOT other AND (key = 'absent' OR (key IN ('status', 'priority') AND wrong))) " + _CODES.format("i"))  # fmt: skip
def verify_context(spark, d):
    metadata = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("secret"), F.lit("x"))
    return _context(spark, d).select("k", _text(verify.context(F.col("claims"), metadata, ("status", "priority", "absent"))))


@query(f"WITH {_CONTEXT}, i AS (SELECT k, NULL AS code FROM c UNION ALL SELECT k, 'forbidden_key' FROM c WHERE k % 4 <> 3 AND (k % 3 = 0 AND key IN ('status', 'secret') OR k % 3 = 1 AND key = 'priority') "
       "UNION ALL SELECT k, 'label_in_context' FROM c WHERE k % 4 <> 3 AND key = 'priority') " + _CODES.format("i"))  # fmt: skip
def verify_leakage(spark, d):
    """The priority is the label (none on every fourth order); two task kinds forbid keys, a third none."""
    k = F.col("k")
    gold = F.when(k % 4 != 3, F.upper("o_orderpriority"))
    task = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (k % 3 + 1).cast("int"))
    return _context(spark, d).select("k", _text(verify.leakage(F.col("claims"), gold, task, {"a": ("status", "secret"), "b": ("priority",)})))


@query("SELECT k, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') AS issues FROM (SELECT o_orderkey AS k, unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'label' END, CASE WHEN o_orderkey % 5 = 0 THEN 'evidence' END, CASE WHEN o_orderkey % 7 = 0 THEN 'context' END, "
       "CASE WHEN o_orderkey % 2 = 0 THEN 'confidence' END, CASE WHEN o_orderkey % 11 = 0 THEN 'final' END]) AS code FROM orders) GROUP BY 1")  # fmt: skip
def verify_alignment(spark, d):
    """Answers of order fields, with one field altered by each rule; the exclusions are empty and rendered as none."""
    k = F.col("o_orderkey")
    wrong = lambda n, c: F.when(k % n == 0, F.concat(c, F.lit("!"))).otherwise(c)
    label, clerk = F.col("o_orderpriority"), F.col("o_custkey").cast("string")
    wanted = {"LABEL": label, "EVIDENCE": clerk, "EXCLUSIONS": F.lit(""), "CONTEXT": F.col("o_orderstatus"), "FINAL": label}
    level = F.when(k % 2 == 0, F.lit("sure")).otherwise(F.lit("High"))
    said = {"LABEL": wrong(3, label), "EVIDENCE": wrong(5, clerk), "EXCLUSIONS": F.lit(""), "CONTEXT": wrong(7, F.col("o_orderstatus")), "FINAL": wrong(11, label), "CONFIDENCE": level}
    answer = tx.render_fields(said)
    fields = {x: tx.parse_field(answer, x) for x in said}
    return t(spark, d, "orders").select(k.alias("k"), _text(verify.alignment(fields, wanted, ("high", "medium", "low"))))


@query("""WITH s AS (SELECT l_orderkey AS k, l_orderkey // 2 AS id, list(DISTINCT l_suppkey) AS experts, list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R') AS oracle, list(DISTINCT l_partkey) FILTER (l_linestatus = 'O') AS genes, list(DISTINCT l_partkey) FILTER (l_returnflag = 'N') AS support FROM lineitem GROUP BY 1),
  c AS (SELECT *, count(*) OVER (PARTITION BY id) > 1 AS twice FROM s)
  SELECT k, concat_ws(',', CASE WHEN twice THEN 'duplicate_id' END, CASE WHEN len(list_filter(experts, lambda x: x > 90)) > 0 THEN 'unknown_expert' END, CASE WHEN len(list_filter(coalesce(oracle, []), lambda x: x % 10 = 0)) > 0 THEN 'oracle_not_candidate' END,
    CASE WHEN len(coalesce(support, [])) > len(list_intersect(coalesce(support, []), coalesce(genes, []))) THEN 'support_not_given' END, CASE WHEN k % 3 = 0 AND len(experts) <> 1 THEN 'family' END) AS issues FROM c""")
def sample_checks(spark, d):
    """Samples with repeated ids, experts nobody knows, oracles outside the candidates, support outside the items, or
    a wrong number of experts for their family. Known experts are a table that a left join looks up."""
    back, open_, new = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("l_returnflag") == "N"
    some = lambda c, v: F.collect_set(F.when(c, F.col(v)))
    x = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_suppkey").alias("experts"), some(back, "l_suppkey").alias("oracle"), some(open_, "l_partkey").alias("genes"), some(new, "l_partkey").alias("support"))
    x = x.withColumn("id", F.floor(F.col("k") / 2))
    known = t(spark, d, "supplier").where("s_suppkey <= 90").select(F.col("s_suppkey").alias("expert"), F.lit(True).alias("there"))
    strange = x.select("k", F.explode("experts").alias("expert")).join(known, "expert", "left").groupBy("k").agg(F.bool_or(F.col("there").isNull()).alias("strange"))
    twice = x.groupBy("id").agg((F.count("*") > 1).alias("twice"))
    x = x.join(strange, "k").join(twice, "id")
    candidates = F.filter("experts", lambda e: e % 10 != 0)
    rules = {"duplicate_id": F.col("twice"), "unknown_expert": F.col("strange"), "oracle_not_candidate": F.size(F.array_except("oracle", candidates)) > 0, "support_not_given": F.size(F.array_except("support", "genes")) > 0, "family": (F.col("k") % 3 == 0) & (F.size("experts") != 1)}
    return x.select("k", F.array_join(verify.codes(rules), ",").alias("issues"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'not_json' ELSE concat_ws(',', CASE WHEN event_type = 'click' THEN 'empty:reasoning' END, CASE WHEN event_type = 'view' THEN 'missing:answer' END, CASE WHEN value > 60 THEN 'ids_not_list' END) END AS errors FROM events""")
def role_outputs(spark, d):
    """Outputs of a role against its schema: no JSON, a missing or empty key, a list that is none."""
    ids = F.when(F.col("value") > 60, F.lit('"x"')).otherwise(F.lit('["x"]'))
    answer = F.when(F.col("event_type") == "view", F.lit("")).otherwise(F.lit(', "answer": "y"'))
    reason = F.when(F.col("event_type") == "click", F.lit(" ")).otherwise(F.lit("because"))
    said = F.when(F.col("event_type") == "error", F.lit("no {json")).otherwise(F.concat(F.lit('{"reasoning": "'), reason, F.lit('", "bullet_ids": '), ids, answer, F.lit("}")))
    return t(spark, d, "events").select("event_id", F.array_join(ps.schema_errors(said, ("reasoning", "answer"), {"bullet_ids": "ids_not_list"}), ",").alias("errors"))
