"""The query of generation checks: orders as rows with their own labels, markers and generated texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.operators import generations
from rankforge.plans.registry import query, t

_W = "' ' || trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')) || ' '"


@query(f"""WITH l AS (SELECT l_orderkey AS k, 'P' || l_partkey AS p, 'S-' || l_suppkey AS s, l_returnflag AS flag, p_name, p_type, p_brand, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey),
  a AS (SELECT k, coalesce(list(DISTINCT p) FILTER (flag = 'N'), []) AS ev, coalesce(list(DISTINCT s) FILTER (flag = 'R'), []) AS ne FROM l GROUP BY 1),
  x AS (SELECT l.*, ev, ne, round(o_totalprice * 100)::BIGINT % 100 AS c, o_orderstatus = 'O' AS needs, c_mktsegment AS place FROM l JOIN a USING (k) JOIN orders ON o_orderkey = k JOIN customer ON c_custkey = o_custkey WHERE n = 1),
  y AS (SELECT *, CASE c % 6 WHEN 0 THEN 'Which part has (' || lower(p) || ')?' WHEN 1 THEN 'Is it a ' || upper(p_name) || ', or not?' WHEN 2 THEN 'By ' || replace(p_brand, '#', ' - ') || '0?' WHEN 3 THEN '  ' WHEN 4 THEN 'Tell x' || p || ' of ' || p || '7 things' ELSE 'Of ' || s || '/x' END AS q,
    CASE c % 5 WHEN 0 THEN 'LABEL: ' || p_name || chr(10) || 'uses ' || lower(p) || ' in ' || place WHEN 1 THEN 'It is the ' || p_type || '; ' || p || ' ' || s WHEN 2 THEN NULL WHEN 3 THEN 'FINAL_LABEL: none' || chr(10) || 'the ' || p_name ELSE p_name || 's ' || p END AS ans,
    CASE c % 3 WHEN 0 THEN p_name || '.' WHEN 1 THEN upper(p_brand) ELSE '' END AS said, CASE WHEN c % 7 = 0 THEN [] WHEN c % 2 = 0 THEN [p, 'P1'] ELSE [p] END AS ue, CASE WHEN c % 7 > 4 THEN [s] ELSE [] END AS un,
    list_distinct(list_concat([p_name, p_type, p_brand], CASE WHEN ends_with(p_name, ' ring') THEN [p_name[:-6] || ' hoop'] ELSE [] END)) AS vs FROM x),
  z AS (SELECT *, coalesce(ans, '') AS t, CASE WHEN c % 5 = 0 THEN p_name WHEN c % 5 = 3 THEN 'none' ELSE coalesce(ans, '') END AS lt FROM y),
  i AS (SELECT k, unnest([CASE WHEN trim(q) = '' THEN 'missing_question' END, CASE WHEN t = '' THEN 'missing_answer' END, CASE WHEN len(list_filter(vs, lambda v: contains({_W.format('q')}, {_W.format('v')}))) > 0 THEN 'question_leaks_label' END,
    CASE WHEN len(list_filter(list_concat(ev, ne), lambda m: regexp_matches(upper(q), '(^|[^A-Z0-9])' || m || '([^A-Z0-9]|$)'))) > 0 THEN 'question_names_marker' END, CASE WHEN said <> '' AND len(list_filter(vs, lambda v: {_W.format('v')} = {_W.format('said')})) = 0 THEN 'label_mismatch' END,
    CASE WHEN len(list_filter(vs, lambda v: contains({_W.format('lt')}, {_W.format('v')}))) = 0 THEN 'answer_lacks_label' END, CASE WHEN needs AND NOT contains(lower(t), lower(place)) THEN 'answer_lacks_place' END, CASE WHEN len(ue) + len(un) = 0 THEN 'no_markers' END,
    CASE WHEN len(list_filter(ue, lambda m: NOT list_contains(ev, m))) > 0 THEN 'unsupported_evidence' END, CASE WHEN len(list_filter(un, lambda m: NOT list_contains(ne, m))) > 0 THEN 'unsupported_negative' END]) AS code FROM z UNION ALL SELECT k, 'not_in_text:' || m FROM (SELECT k, t, unnest(list_concat(ue, un)) AS m FROM z) WHERE NOT contains(lower(t), lower(m)))
  SELECT z.k AS k, coalesce(string_agg(code, ',' ORDER BY code), '') AS issues FROM z LEFT JOIN i ON i.k = z.k AND code IS NOT NULL GROUP BY z.k""")
def generation_checks(spark, d):
    """Faults of questions and answers that leak, lack or misname what their own order's first line says."""
    part = t(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    p, s, n = F.concat(F.lit("P"), "l_partkey"), F.concat(F.lit("S-"), "l_suppkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey")
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), n.alias("n"), "l_partkey", p.alias("p"), s.alias("s"), "l_returnflag")
    some = lambda flag, c: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col(c)))
    x = lines.groupBy("k").agg(F.min(F.struct("n", "l_partkey", "p", "s")).alias("f"), some("N", "p").alias("ev"), some("R", "s").alias("ne")).select("k", "f.l_partkey", "f.p", "f.s", "ev", "ne")
    o = t(spark, d, "orders").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("place")), "o_custkey").select(F.col("o_orderkey").alias("k"), "place", (F.col("o_orderstatus") == "O").alias("needs"), F.pmod(F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(100)).alias("c"))
    x = x.join(part, F.col("l_partkey") == F.col("p_partkey")).join(o, "k")
    c, text = F.col("c"), lambda *parts: F.concat(*[F.lit(v[1:]) if v[0] == "=" else F.col(v) for v in parts])
    pick = lambda m, *forms: F.when(c % m == 0, forms[0]) if len(forms) == 1 else F.coalesce(*[F.when(c % m == i, f) for i, f in enumerate(forms)])
    question = pick(6, F.concat(F.lit("Which part has ("), F.lower("p"), F.lit(")?")), F.concat(F.lit("Is it a "), F.upper("p_name"), F.lit(", or not?")), F.concat(F.lit("By "), F.replace("p_brand", F.lit("#"), F.lit(" - ")), F.lit("0?")), F.lit("  "), text("=Tell x", "p", "= of ", "p", "=7 things"), text("=Of ", "s", "=/x"))
    answer = pick(5, F.concat(F.lit("LABEL: "), "p_name", F.lit("\nuses "), F.lower("p"), F.lit(" in "), "place"), text("=It is the ", "p_type", "=; ", "p", "= ", "s"), F.lit(None).cast("string"), text("=FINAL_LABEL: none\nthe ", "p_name"), text("p_name", "=s ", "p"))
    said = pick(3, text("p_name", "=."), F.upper("p_brand"), F.lit(""))
    none = F.array().cast("array<string>")
    used = {"evidence": F.when(c % 7 == 0, none).when(c % 2 == 0, F.array(F.col("p"), F.lit("P1"))).otherwise(F.array("p")), "negative": F.when(c % 7 > 4, F.array("s")).otherwise(none)}
    variants = generations.label_variants(F.col("p_name"), F.array("p_type", "p_brand"), ((" ring", (" hoop",)),))
    x = x.withColumn("variants", variants)
    issues = generations.generation_issues(question, answer, said, F.col("variants"), {"evidence": F.col("ev"), "negative": F.col("ne")}, used, F.col("place"), F.col("needs"))
    return x.select("k", F.array_join(F.array_sort(issues), ",").alias("issues"))
