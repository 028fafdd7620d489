"""Queries of the whole verifier: orders as task examples, their lines and metadata as claims, answers as damaged texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.operators import verifier
from rankforge.operators.factors import written
from rankforge.plans.registry import query, t

RULES = verifier.Rules(
    fields=("LABEL", "EVIDENCE", "EXCLUSIONS", "CONTEXT", "CONFIDENCE", "FINAL"), panel="NEGATIVE_MARKERS", levels=("high", "medium", "low"), context_keys=("status", "segment", "type"),
    reason="missing_candidate_markers", differential="differential", generic="^P1[0-9]7$", forbidden={"annotation": ("type",), "place": ("segment",), "differential": ("type",)}, by_source=("state",),
)
_TASKS = {"1-URGENT": "annotation", "2-HIGH": "place", "3-MEDIUM": "state", "4-NOT SPECIFIED": "differential"}


def _examples(spark, d):
    """Examples, claims and profiles. Labels are the type of an order's first line, observed items its parts but for some."""
    part = t(spark, d, "part").select("p_partkey", "p_type", "p_size")
    value = F.concat(F.lit("P"), F.col("p_partkey"))
    some = part.where("p_type <> 'PROMO'").select(F.col("p_type").alias("label"), value.alias("marker"), "p_size", F.col("p_partkey").alias("rank"))
    profiles = some.where("p_size <= 40 or p_size = 50").select("label", "marker", (F.col("p_size") <= 40).alias("positive"), "rank")
    lines = t(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey").join(part, "p_partkey")
    lines = written(lines.select("l_orderkey", "l_linenumber", "p_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_tax", "l_discount", "p_type"), "lines")  # read many times
    n = F.struct("l_linenumber", "p_partkey", "l_suppkey")
    lines = lines.select(F.col("l_orderkey").alias("id"), n.alias("n"), value.alias("v"), "p_type", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_tax", F.when(F.col("l_tax") > 0, F.col("l_discount") <= 0.08).alias("verified"))
    cases = lines.groupBy("id").agg(F.min(F.struct("n", "p_type"))["p_type"].alias("first"), F.collect_set(F.when(~((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")), F.col("v"))).alias("genes"), F.collect_set(F.when(F.col("l_linenumber") >= 6, F.col("p_type"))).alias("others"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") <= 2, F.struct("n", "v")))), lambda x: x["v"]), ", ").alias("evidence"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") >= 6, F.struct("n", "p_type")))), lambda x: x["p_type"]), ", ").alias("exclusions"))
    o = t(spark, d, "orders").join(t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment")), "o_custkey").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "segment", F.pmod(F.round(F.col("o_totalprice") * 100).cast("long"), F.lit(100)).alias("cents"))
    o = o.join(cases, "id", "left").withColumn("label", F.when((F.col("status") == "P") & (F.col("priority") == "2-HIGH"), F.lit(None)).otherwise(F.col("first")))
    key = F.when(F.col("segment") == "FURNITURE", "type").when(F.col("segment") == "HOUSEHOLD", "secret").otherwise("segment")
    told = F.when(key == "type", F.coalesce("label", F.lit("?"))).when(key == "secret", F.lit("x")).otherwise(F.concat("segment", F.when(F.col("priority") == "5-LOW", F.lit("!")).otherwise(F.lit(""))))
    o = written(o.withColumn("key", key).withColumn("second", F.concat(key, F.lit("="), told)), "orders")
    mine, none = F.coalesce("label", F.lit("")), lambda c: F.when(F.col(c) != "", F.col(c)).otherwise(F.lit("none"))
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    answer = F.concat_ws("\n", line("LABEL", F.when(F.col("cents") < 3, F.lower(mine)).otherwise(mine)), F.when(F.col("cents") < 95, line("EVIDENCE", none("evidence"))), line("EXCLUSIONS", none("exclusions")), F.when((F.col("status") == "O") & (F.col("cents") % 5 > 0), line("NEGATIVE_MARKERS", F.lit("none"))),
        F.concat(F.lit("  CONTEXT : status="), "status", F.lit("; "), "second", F.lit("\t")), line("CONFIDENCE", F.when(F.col("priority") == "5-LOW", F.lit("sure")).otherwise(F.lit("High"))), F.when((F.col("cents") >= 90) & (F.col("cents") < 93), F.lit("LABEL: again")), F.lit("words alone"), line("FINAL", mine))
    task = F.coalesce(*[F.when(F.col("priority") == p, F.lit(x)) for p, x in _TASKS.items()], F.lit("other"))
    candidates = F.when(F.col("status") == "O", F.col("others")).otherwise(F.array_distinct(F.concat("others", F.array("label"))))
    metadata = F.create_map(F.lit("status"), F.col("status"), F.lit("segment"), F.col("segment"), F.lit("type"), F.col("label"), F.lit("secret"), F.lit("x"))
    examples = o.select("id", task.alias("task"), "label", F.when(F.col("status") == "O", F.lit("status")).alias("source_key"), F.when(F.col("cents") % 7 == 0, F.lit("SMALL")).alias("canonical"), "genes", candidates.alias("candidates"), metadata.alias("metadata"), answer.alias("answer"), (F.col("status") != "F").alias("current"))
    source = F.when(F.col("l_quantity") > 48, "guess").when(F.col("l_linestatus") == "O", "observed_gene").otherwise("marker_catalog")
    text, nothing = lambda v: F.lit(v), F.lit(None).cast("string")
    same = ["id", F.col("n.l_linenumber").alias("n1"), F.col("n.p_partkey").alias("n2"), F.col("n.l_suppkey").alias("n3")]
    evidence = lines.where("l_linenumber <= 2").select(*same, text("evidence").alias("kind"), F.col("v").alias("value"), "verified", source.alias("source"), F.col("p_type").alias("matched"), F.when(F.col("l_returnflag") == "R", "against").otherwise("supports_gold").alias("direction"), nothing.alias("details"), nothing.alias("key"))
    marks = F.when(F.col("l_tax") > 0.06, F.lit("")).otherwise(F.concat(F.col("v"), F.lit(",P"), F.col("l_suppkey")))
    details = F.when(F.col("l_tax") > 0.07, F.lit("note")).otherwise(F.concat(F.lit("reason=missing_candidate_markers;candidate_markers="), marks))
    exclusion = lines.where("l_linenumber >= 6").select(*same, text("exclusion").alias("kind"), F.col("p_type").alias("value"), "verified", F.when(F.col("l_linestatus") == "O", "candidate_set").otherwise("marker_catalog").alias("source"), nothing.alias("matched"), F.when(F.col("l_returnflag") == "R", "supports").otherwise("against_candidate").alias("direction"), details.alias("details"), nothing.alias("key"))
    meta = lambda i, v, k, s: o.select("id", F.lit(i).alias("n1"), F.lit(0).cast("long").alias("n2"), F.lit(0).cast("long").alias("n3"), text("context").alias("kind"), v.alias("value"), F.lit(True).alias("verified"), s.alias("source"), nothing.alias("matched"), nothing.alias("direction"), nothing.alias("details"), k.alias("key"))
    first = meta(0, F.concat(F.lit("status="), "status"), F.lit("status"), F.lit("source_metadata"))
    second = meta(1, F.col("second"), F.col("key"), F.when((F.col("priority") == "3-MEDIUM") & (F.col("status") == "P"), F.lit("guess")).otherwise(F.lit("source_metadata")))
    claims = evidence.unionByName(exclusion).unionByName(first).unionByName(second).withColumn("n", F.struct("n1", "n2", "n3")).drop("n1", "n2", "n3")
    return examples, claims, profiles


_SQL = """pr AS (SELECT p_type AS label, 'P' || p_partkey AS marker, p_size <= 40 AS positive, p_partkey AS rank FROM part WHERE p_type <> 'PROMO' AND (p_size <= 40 OR p_size = 50)),
 lb AS (SELECT DISTINCT label FROM pr), pos AS (SELECT label, marker FROM pr WHERE positive), neg AS (SELECT label AS lookup, string_agg(marker, ', ' ORDER BY rank, marker) AS negative FROM pr WHERE NOT positive GROUP BY 1),
 ln AS (SELECT l_orderkey AS k, l_linenumber AS a, l_partkey AS b, l_suppkey AS c, 'P' || l_partkey AS v, p_type, CASE WHEN l_tax > 0 THEN l_discount <= 0.08 END AS ok, l_returnflag AS flag, l_linestatus AS st, l_quantity AS q, l_tax AS tax FROM lineitem JOIN part ON p_partkey = l_partkey),
 ca AS (SELECT k, arg_min(p_type, (a, b, c)) AS first, coalesce(list(DISTINCT v) FILTER (NOT (flag = 'A' AND st = 'F')), []) AS genes, coalesce(list(DISTINCT p_type) FILTER (a >= 6), []) AS others,
   coalesce(string_agg(v, ', ' ORDER BY a, b, c) FILTER (a <= 2), 'none') AS evidence, coalesce(string_agg(p_type, ', ' ORDER BY a, b, c) FILTER (a >= 6), 'none') AS exclusions FROM ln GROUP BY 1),
 o AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment, round(o_totalprice * 100)::BIGINT % 100 AS cents, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '2-HIGH' THEN NULL ELSE first END AS label, coalesce(genes, []) AS genes, others,
   coalesce(evidence, 'none') AS evidence, coalesce(exclusions, 'none') AS exclusions FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN ca ON k = o_orderkey),
 x0 AS (SELECT *, CASE segment WHEN 'FURNITURE' THEN 'type' WHEN 'HOUSEHOLD' THEN 'secret' ELSE 'segment' END AS key,
   CASE priority WHEN '1-URGENT' THEN 'annotation' WHEN '2-HIGH' THEN 'place' WHEN '3-MEDIUM' THEN 'state' WHEN '4-NOT SPECIFIED' THEN 'differential' ELSE 'other' END AS task,
   coalesce(CASE WHEN status = 'O' THEN others WHEN label IS NULL THEN list_concat(others, [NULL]) ELSE list_distinct(list_concat(others, [label])) END, []) AS cand, CASE WHEN cents % 7 = 0 THEN 'SMALL' ELSE label END AS lookup, others IS NULL AS bare FROM o),
 x1 AS (SELECT *, key || '=' || CASE key WHEN 'type' THEN coalesce(label, '?') WHEN 'secret' THEN 'x' ELSE segment || CASE WHEN priority = '5-LOW' THEN '!' ELSE '' END END AS second FROM x0),
 x AS (SELECT x1.*, coalesce(negative, 'none') AS negative, concat_ws(chr(10), 'LABEL: ' || CASE WHEN cents < 3 THEN lower(coalesce(label, '')) ELSE coalesce(label, '') END, CASE WHEN cents < 95 THEN 'EVIDENCE: ' || evidence END, 'EXCLUSIONS: ' || exclusions,
   CASE WHEN status = 'O' AND cents % 5 > 0 THEN 'NEGATIVE_MARKERS: none' END, '  CONTEXT : status=' || status || '; ' || second || chr(9), 'CONFIDENCE: ' || CASE WHEN priority = '5-LOW' THEN 'sure' ELSE 'High' END, CASE WHEN cents BETWEEN 90 AND 92 THEN 'LABEL: again' END, 'words alone', 'FINAL: ' || coalesce(label, '')) AS answer
   FROM x1 LEFT JOIN neg USING (lookup)),
 w AS (SELECT k, i, trim(split_part(l, ':', 1), ' ' || chr(9)) AS f, trim(substr(l, strpos(l, ':') + 1), ' ' || chr(9)) AS v FROM (SELECT k, unnest(string_split(answer, chr(10))) AS l, generate_subscripts(string_split(answer, chr(10)), 1) AS i FROM x) WHERE strpos(l, ':') > 0),
 last AS (SELECT k, f, arg_max(v, i) AS v FROM w GROUP BY ALL), need AS (SELECT unnest(['LABEL', 'EVIDENCE', 'EXCLUSIONS', 'CONTEXT', 'CONFIDENCE', 'FINAL']) AS f),
 sh AS (SELECT k, 'answer_text' AS field, 'duplicate_key' AS code, f AS value FROM w QUALIFY row_number() OVER (PARTITION BY k, f ORDER BY i) > 1 UNION ALL SELECT k, 'answer_text', 'missing_key', f FROM x, need ANTI JOIN last ON last.k = x.k AND last.f = need.f),
 e AS (SELECT ln.*, CASE WHEN q > 48 THEN 'guess' WHEN st = 'O' THEN 'observed_gene' ELSE 'marker_catalog' END AS src, lb.label IS NOT NULL AS has, pos.marker IS NOT NULL AS good FROM ln LEFT JOIN lb ON lb.label = p_type LEFT JOIN pos ON pos.label = p_type AND pos.marker = v WHERE a <= 2),
 xc AS (SELECT ln.*, CASE WHEN st = 'O' THEN 'candidate_set' ELSE 'marker_catalog' END AS src, lb.label IS NOT NULL AS has, tax <= 0.07 AS told, CASE WHEN tax > 0.06 THEN [] ELSE [v, 'P' || c] END AS marks FROM ln LEFT JOIN lb ON lb.label = p_type WHERE a >= 6),
 mk AS (SELECT k, p_type, unnest(marks) AS m FROM xc WHERE src = 'marker_catalog' AND told AND has),
 co AS (SELECT k, 'status' AS key, 'status=' || status AS value, 'source_metadata' AS src, status AS given FROM x UNION ALL SELECT k, key, second, CASE WHEN priority = '3-MEDIUM' AND status = 'P' THEN 'guess' ELSE 'source_metadata' END, CASE key WHEN 'type' THEN label WHEN 'segment' THEN segment ELSE 'x' END FROM x),
 want AS (SELECT k, 'LABEL' AS f, coalesce(label, '') AS v FROM x UNION ALL SELECT k, 'FINAL', coalesce(label, '') FROM x UNION ALL SELECT k, 'EVIDENCE', evidence FROM x UNION ALL SELECT k, 'EXCLUSIONS', exclusions FROM x UNION ALL SELECT k, 'CONTEXT', 'status=' || status || '; ' || second FROM x),
 al AS (SELECT want.k AS k, 'answer_text' AS field, 'differs' AS code, want.f AS value FROM want JOIN last ON last.k = want.k AND last.f = want.f WHERE want.v <> last.v UNION ALL SELECT x.k, 'answer_text', 'differs', f FROM x JOIN last ON last.k = x.k WHERE f = 'NEGATIVE_MARKERS' AND status <> 'F' AND v <> negative
   UNION ALL SELECT k, 'answer_text', 'confidence', v FROM last WHERE f = 'CONFIDENCE' AND lower(v) NOT IN ('high', 'medium', 'low')),
 i AS (SELECT k, 'genes' AS field, 'empty' AS code, '' AS value FROM x WHERE len(genes) = 0 UNION ALL SELECT k, 'gold_fields', 'no_label', '' FROM x WHERE label IS NULL UNION ALL SELECT k, 'task_type', 'unknown_task', task FROM x WHERE task = 'other'
  UNION ALL SELECT * FROM sh UNION ALL SELECT k, 'answer_text', 'missing_key', 'NEGATIVE_MARKERS' FROM x WHERE status <> 'F' AND NOT (status = 'O' AND cents % 5 > 0)
  UNION ALL SELECT k, 'evidence', 'missing', '' FROM x ANTI JOIN e USING (k) UNION ALL SELECT k, 'evidence', 'unverified', v FROM e WHERE ok IS NOT TRUE UNION ALL SELECT k, 'evidence', 'source', src FROM e WHERE src = 'guess'
  UNION ALL SELECT k, 'evidence', 'unobserved', v FROM e JOIN x USING (k) WHERE NOT list_contains(genes, v) UNION ALL SELECT k, 'evidence', 'generic', v FROM e WHERE regexp_matches(v, '^P1[0-9]7$')
  UNION ALL SELECT k, 'evidence', 'no_profile', p_type FROM e WHERE src = 'marker_catalog' AND NOT has UNION ALL SELECT k, 'evidence', 'not_approved', v FROM e WHERE src = 'marker_catalog' AND has AND NOT good
  UNION ALL SELECT k, 'evidence', 'direction', v FROM e WHERE src = 'marker_catalog' AND flag = 'R' UNION ALL SELECT k, 'evidence', 'duplicate', '' FROM e GROUP BY k HAVING count(*) > count(DISTINCT v)
  UNION ALL SELECT k, 'candidate_labels', 'few_candidates', '' FROM x WHERE task = 'differential' AND NOT bare AND len(cand) < 2 UNION ALL SELECT k, 'candidate_labels', 'few_candidates', '' FROM x WHERE task = 'differential' AND bare
  UNION ALL SELECT k, 'candidate_labels', 'gold_not_candidate', '' FROM x WHERE task = 'differential' AND NOT coalesce(list_contains(cand, label), false)
  UNION ALL SELECT k, 'exclusions', 'unverified', p_type FROM xc WHERE ok IS NOT TRUE UNION ALL SELECT k, 'exclusions', 'gold_excluded', p_type FROM xc JOIN x USING (k) WHERE p_type = label
  UNION ALL SELECT k, 'exclusions', 'not_candidate', p_type FROM xc JOIN x USING (k) WHERE len(cand) > 0 AND NOT list_contains(cand, p_type)
  UNION ALL SELECT k, 'exclusions', 'no_profile', p_type FROM xc WHERE src = 'marker_catalog' AND NOT has UNION ALL SELECT k, 'exclusions', 'direction', p_type FROM xc WHERE src = 'marker_catalog' AND flag = 'R'
  UNION ALL SELECT k, 'exclusions', 'no_reason', p_type FROM xc WHERE src = 'marker_catalog' AND NOT told UNION ALL SELECT k, 'exclusions', 'no_markers', p_type FROM xc WHERE src = 'marker_catalog' AND told AND len(marks) = 0
  UNION ALL SELECT k, 'exclusions', 'not_approved', m FROM mk ANTI JOIN pos ON pos.label = p_type AND pos.marker = m UNION ALL SELECT k, 'exclusions', 'marker_observed', m FROM mk JOIN x USING (k) WHERE list_contains(genes, m)
  UNION ALL SELECT x.k, 'exclusions', 'coverage', '' FROM x LEFT JOIN (SELECT k, count(*) AS n FROM xc GROUP BY 1) y USING (k) WHERE task = 'differential' AND coalesce(n, 0) <> greatest(0, len(cand) - 1)
  UNION ALL SELECT k, 'context', 'source', src FROM co WHERE src <> 'source_metadata' UNION ALL SELECT k, 'context', 'key', key FROM co WHERE src = 'source_metadata' AND key = 'secret'
  UNION ALL SELECT k, 'context', 'value', value FROM co WHERE src = 'source_metadata' AND key <> 'secret' AND (given IS NULL OR value <> key || '=' || given)
  UNION ALL SELECT k, 'context', 'forbidden_key', co.key FROM co JOIN x USING (k) WHERE label <> '' AND (task IN ('annotation', 'differential') AND co.key = 'type' OR task = 'place' AND co.key = 'segment' OR task = 'state' AND status = 'O' AND co.key = 'status')
  UNION ALL SELECT k, 'context', 'label_in_context', value FROM co JOIN x USING (k) WHERE label <> '' AND contains(lower(value), lower(label)) UNION ALL SELECT al.* FROM al ANTI JOIN sh ON sh.k = al.k),
 r AS (SELECT x.k AS k, any_value(task) AS task, count(code) = 0 AS passed, coalesce(string_agg(field || '|' || code || '|' || value, chr(10) ORDER BY field || '|' || code || '|' || value), '') AS issues FROM x LEFT JOIN i ON i.k = x.k GROUP BY x.k)"""


def _results(spark, d):
    return verifier.verify_examples(*_examples(spark, d), RULES)


@query(f"WITH {_SQL} SELECT k, task, passed, issues FROM r")
def verify_examples(spark, d):
    """Every order's issues under all rule sets, each with the value that it names."""
    text = F.array_join(F.array_sort(F.transform("issues", lambda i: F.concat_ws("|", i["field"], i["code"], i["value"]))), "\n")
    return _results(spark, d).select(F.col("id").alias("k"), "task", "passed", text.alias("issues"))


@query(f"WITH {_SQL} SELECT task, field, code, count(*) AS n FROM i JOIN x USING (k) GROUP BY ALL UNION ALL SELECT task, '', 'rows', count(*) FROM r GROUP BY ALL UNION ALL SELECT task, '', 'passed', count(*) FILTER (passed) FROM r GROUP BY ALL")
def verify_examples_report(spark, d):
    """Issues by task, field and code."""
    return verifier.report(_results(spark, d))


_FAMILIES = {"cross": "cross_expert", "ood": "out_of_domain", "bundle": "profile_bundle"}


@query("""WITH ln AS (SELECT l_orderkey AS k, l_suppkey::VARCHAR AS s, 'P' || l_partkey AS v, l_returnflag AS flag, l_linestatus AS st, l_quantity AS q, CASE WHEN l_linenumber <= 2 THEN 'A' WHEN l_linenumber <= 4 THEN 'B' ELSE 'C' END AS p FROM lineitem),
  o AS (SELECT o_orderkey AS k, 's' || o_custkey || '-' || o_orderkey % 4 AS id, o_orderstatus AS status, CASE o_orderpriority WHEN '2-HIGH' THEN 'cross_expert' WHEN '3-MEDIUM' THEN 'out_of_domain' WHEN '4-NOT SPECIFIED' THEN 'profile_bundle' ELSE 'single' END AS family FROM orders),
  ca AS (SELECT DISTINCT k, s FROM ln WHERE q > 10), ora AS (SELECT DISTINCT k, s FROM ln WHERE flag = 'R' UNION SELECT k, 'x' FROM o WHERE status = 'P' AND family = 'single'), ge AS (SELECT DISTINCT k, v FROM ln WHERE st = 'O'), su AS (SELECT DISTINCT k, v FROM ln WHERE flag = 'N'),
  pr AS (SELECT DISTINCT k, p, v FROM ln WHERE flag <> 'A'), ps AS (SELECT DISTINCT k, p, v FROM ln WHERE st = 'O'), co AS (SELECT DISTINCT k, v FROM ln WHERE q > 25),
  i AS (SELECT k, 'duplicate_id' AS code, id AS value FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) > 1 UNION ALL SELECT k, 'unknown_expert', s FROM ca ANTI JOIN (SELECT s_suppkey::VARCHAR AS s FROM supplier WHERE s_acctbal > 0) USING (s)
    UNION ALL SELECT k, 'oracle_not_candidate', s FROM ora ANTI JOIN ca USING (k, s)
    UNION ALL SELECT k, 'support_not_given', v FROM su ANTI JOIN ge USING (k, v) UNION ALL SELECT k, 'few_candidates', '' FROM o WHERE family = 'cross_expert' AND (SELECT count(*) FROM ca WHERE ca.k = o.k) < 2
    UNION ALL SELECT DISTINCT k, 'oracle_of_none', '' FROM o JOIN ora USING (k) WHERE family = 'out_of_domain' UNION ALL SELECT k, 'no_abstention', '' FROM o WHERE family = 'out_of_domain' AND status <> 'F'
    UNION ALL SELECT k, 'few_profiles', '' FROM o WHERE family = 'profile_bundle' AND (SELECT count(DISTINCT p) FROM pr WHERE pr.k = o.k) < 2
    UNION ALL SELECT k, 'profile_support_not_given', p || ':' || v FROM o JOIN (SELECT * FROM ps ANTI JOIN pr USING (k, p, v)) USING (k) WHERE family = 'profile_bundle' UNION ALL SELECT k, 'combined_not_given', v FROM o JOIN (SELECT * FROM co ANTI JOIN pr USING (k, v)) USING (k) WHERE family = 'profile_bundle')
  SELECT o.k AS k, family, coalesce(string_agg(code || '|' || value, chr(10) ORDER BY code || '|' || value), '') AS issues FROM o LEFT JOIN i ON i.k = o.k GROUP BY ALL""")
def sample_rules(spark, d):
    """Orders as samples of four families, with every rule of each family."""
    l, part = t(spark, d, "lineitem"), F.concat(F.lit("P"), F.col("l_partkey"))
    some = lambda when, v: F.collect_set(F.when(when, v))
    profile = F.when(F.col("l_linenumber") <= 2, "A").when(F.col("l_linenumber") <= 4, "B").otherwise("C")
    kept, open_ = F.col("l_returnflag") != "A", F.col("l_linestatus") == "O"
    held = {f"{n}{p}": some((profile == p) & c, part).alias(f"{n}{p}") for n, c in (("p", kept), ("s", open_)) for p in "ABC"}
    x = l.groupBy(F.col("l_orderkey").alias("n")).agg(some(F.col("l_quantity") > 10, F.col("l_suppkey").cast("string")).alias("candidates"), some(F.col("l_returnflag") == "R", F.col("l_suppkey").cast("string")).alias("back"), some(open_, part).alias("genes"), some(F.col("l_returnflag") == "N", part).alias("support"), some(F.col("l_quantity") > 25, part).alias("combined"), *held.values())
    family = F.when(F.col("o_orderpriority") == "2-HIGH", "cross_expert").when(F.col("o_orderpriority") == "3-MEDIUM", "out_of_domain").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "profile_bundle").otherwise("single")
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("n"), F.concat(F.lit("s"), "o_custkey", F.lit("-"), F.col("o_orderkey") % 4).alias("id"), family.alias("family"), "o_orderstatus").join(x, "n", "left")
    by_name = lambda n: F.map_filter(F.create_map(*[y for p in "ABC" for y in (F.lit(p), F.col(f"{n}{p}"))]), lambda _, v: F.size(v) > 0)
    more = F.when((F.col("o_orderstatus") == "P") & (F.col("family") == "single"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    samples = o.withColumns({"oracles": F.concat(F.coalesce("back", F.array().cast("array<string>")), more), "abstain": F.col("o_orderstatus") == "F", "profiles": by_name("p"), "profile_support": by_name("s")})
    found = verifier.sample_issues(samples, t(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("expert")), _FAMILIES)
    return found.select(F.col("n").alias("k"), "family", F.array_join(F.array_sort(F.transform("issues", lambda i: F.concat_ws("|", i["code"], i["value"]))), "\n").alias("issues"))
