"""Queries of task building, label scores and the choice of a grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.functions import scores
from rankforge.operators import building
from rankforge.plans.registry import _LISTS, _lists, query, t

SPECIFIC, BROAD, CONFLICTS = {"ring": (), "metal part": ("gear", "bolt")}, {"tinted": ("red", "blue")}, [("hot", "cold"), ("small", "large")]
_NAMED = lambda a, b: f"""CASE WHEN {a} = {b} THEN 1.0 ELSE least(CASE WHEN {' OR '.join(f"contains({a}, '{x}') AND contains({b}, '{y}') OR contains({a}, '{y}') AND contains({b}, '{x}')" for x, y in CONFLICTS)} THEN 0.45 ELSE 1.0 END,
  greatest(2.0 * len(list_intersect(string_split({a}, ' '), string_split({b}, ' '))) / (len(list_distinct(string_split({a}, ' '))) + len(list_distinct(string_split({b}, ' ')))), CASE WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 0.85 ELSE 0 END,
  CASE WHEN regexp_matches({a}, 'ring') AND regexp_matches({b}, 'ring') OR regexp_matches({a}, 'metal part|gear|bolt') AND regexp_matches({b}, 'metal part|gear|bolt') THEN 0.85 WHEN regexp_matches({a}, 'tinted|red|blue') AND regexp_matches({b}, 'tinted|red|blue') THEN 0.7 ELSE 0 END)) END"""  # noqa: E731


def _pair(a, b):
    return scores.label_pair_score(a, b, SPECIFIC, BROAD, CONFLICTS)


@query(f"SELECT a.p_partkey, round_even({_NAMED('a.p_name', 'b.p_name')}, 6)::double AS score FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def label_pair_scores(spark, d):
    p = t(spark, d, "part")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("after"))
    return p.join(after, "p_partkey").select("p_partkey", F.bround(_pair(F.col("p_name"), F.col("after")), 6).alias("score"))


@query(f"""WITH x AS (SELECT DISTINCT l_orderkey AS k, p_name AS v FROM lineitem JOIN part ON p_partkey = l_partkey), p AS (SELECT a.k, a.v AS e, b.v AS o, {_NAMED('a.v', 'b.v')} AS s FROM x a JOIN x b ON b.k = a.k + 1),
  e AS (SELECT k, avg(m) AS c, max(m) AS top, count(*) AS n FROM (SELECT k, e, max(s) AS m FROM p GROUP BY ALL) GROUP BY 1), o AS (SELECT k, avg(m) AS c, count(*) AS n FROM (SELECT k, o, max(s) AS m FROM p GROUP BY ALL) GROUP BY 1)
  SELECT k AS l_orderkey, round_even(CASE WHEN e.n = 1 OR o.n = 1 THEN top ELSE 0.5 * (e.c + o.c) END, 6)::double AS score FROM e JOIN o USING (k)""")
def label_field_scores(spark, d):
    """The labels of an order's parts against those of the next order."""
    x = t(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(t(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    x = x.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_name")).alias("a"))
    after = x.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("a").alias("b"))
    return x.join(after, "l_orderkey").select("l_orderkey", F.bround(scores.label_field_score(F.col("a"), F.col("b"), _pair), 6).alias("score"))


_F1 = lambda a, b: f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len(list_intersect({a}, {b})) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


@query(f"""WITH x AS (SELECT l_orderkey AS k, coalesce(list(DISTINCT l_suppkey) FILTER (l_returnflag <> 'R'), []) AS s, coalesce(list(DISTINCT l_suppkey) FILTER (l_returnflag = 'R'), []) AS n FROM lineitem GROUP BY 1)
  SELECT a.k AS l_orderkey, round_even(0.9 * {_F1('a.s', 'b.s')} + 0.1 * {_F1('a.n', 'b.n')}, 6)::double AS alignment, round_even(CASE WHEN len(b.s) = 0 THEN 0.25 ELSE len(list_intersect(b.s, a.s)) / len(b.s) END, 6)::double AS grounding FROM x a JOIN x b ON b.k = a.k + 1""")
def evidence_alignment(spark, d):
    """Suppliers of an order's kept and returned lines as supporting and negative evidence, against the next order."""
    kept = lambda c: F.collect_set(F.when(c, F.col("l_suppkey")))
    x = t(spark, d, "lineitem").groupBy("l_orderkey").agg(kept(F.col("l_returnflag") != "R").alias("s"), kept(F.col("l_returnflag") == "R").alias("n"))
    after = x.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("s").alias("s2"), F.col("n").alias("n2"))
    got = x.join(after, "l_orderkey")
    return got.select("l_orderkey", F.bround(scores.evidence_alignment(F.col("s"), F.col("s2"), F.col("n"), F.col("n2")), 6).alias("alignment"), F.bround(scores.support_grounding(F.col("s2"), F.col("s"), F.lit("text")), 6).alias("grounding"))


_BUILT = f"""{_LISTS}, s AS (SELECT l_suppkey AS sample, p_type AS label, count(*) AS n, list(l_partkey ORDER BY r) AS items FROM lists JOIN part ON p_partkey = l_partkey WHERE p_size <= 25 GROUP BY ALL),
  gold AS (SELECT o.s_suppkey AS sample, p_type AS label FROM supplier o JOIN part ON p_partkey = s_suppkey), a AS (SELECT sample, label, items[1:5] AS evidence FROM s JOIN gold USING (sample, label) WHERE n >= 2),
  z AS (SELECT DISTINCT p_type, p_size FROM part), pr AS (SELECT x.p_type AS label, y.p_type AS candidate, -count(*) AS rank FROM z x JOIN z y USING (p_size) GROUP BY ALL),
  c AS (SELECT a.sample, a.label, candidate, row_number() OVER (PARTITION BY a.sample ORDER BY rank, candidate) AS r FROM a JOIN pr USING (label) ANTI JOIN s ON s.sample = a.sample AND s.label = pr.candidate WHERE candidate <> a.label),
  df AS (SELECT sample, label, label || ',' || string_agg(candidate, ',' ORDER BY r) AS candidates FROM c WHERE r < 4 GROUP BY sample, label)"""


def _built(spark, d):
    """A supplier's ranked parts as items, small parts as their type's markers, the type of the part of its number as its gold label; candidates that share most sizes with the gold label come first."""
    ranked = _lists(spark, d).select(F.col("l_suppkey").alias("sample"), F.posexplode("genes").alias("rank", "item"))
    part = t(spark, d, "part")
    catalog = part.where("p_size <= 25").select(F.col("p_partkey").alias("item"), F.col("p_type").alias("label"))
    gold = t(spark, d, "supplier").select(F.col("s_suppkey").alias("sample")).join(part.select(F.col("p_partkey").alias("sample"), F.col("p_type").alias("label")), "sample")
    supported = building.support(ranked, catalog, "sample", "item", "rank", "label")
    sizes = part.select(F.col("p_type").alias("label"), "p_size").distinct()
    pools = sizes.join(sizes.withColumnRenamed("label", "candidate"), "p_size")
    priority = pools.groupBy("label", "candidate").agg((-F.count("*")).alias("order"))
    annotated = building.annotation(supported, gold, "sample", "label")
    return annotated, building.differential(annotated, supported, priority, "sample", "label", "order")


_TEXT = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")


@query(f"WITH {_BUILT} SELECT sample, label, array_to_string(evidence, ',') AS evidence FROM a")
def build_annotation(spark, d):
    return _built(spark, d)[0].withColumn("evidence", _TEXT("evidence"))


@query(f"""WITH {_BUILT} SELECT sample, 'annotation' AS task, label, array_to_string(evidence, ',') AS payload FROM a UNION ALL SELECT sample, 'differential', label, candidates FROM df
  UNION ALL SELECT s_suppkey, 'place', n_name, f FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN (SELECT l_suppkey, string_agg(l_partkey::varchar, ',' ORDER BY r) AS f FROM lists WHERE r <= 5 GROUP BY 1) ON l_suppkey = s_suppkey""")
def build_examples(spark, d):
    """The union of three task families over the same samples."""
    annotated, differential = _built(spark, d)
    first = _lists(spark, d).select(F.col("l_suppkey").alias("sample"), F.slice("genes", 1, 5).alias("payload"))
    places = t(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("n_nationkey")).join(t(spark, d, "nation"), "n_nationkey").join(first, "sample")
    every = [annotated.select("sample", F.lit("annotation").alias("task"), "label", _TEXT("evidence").alias("payload")), differential.select("sample", F.lit("differential").alias("task"), "label", _TEXT("candidates").alias("payload")), places.select("sample", F.lit("place").alias("task"), F.col("n_name").alias("label"), _TEXT("payload").alias("payload"))]
    return every[0].unionByName(every[1]).unionByName(every[2])
