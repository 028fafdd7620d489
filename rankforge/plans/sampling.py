"""Queries of augmentation, cluster samples and alias resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.operators import sampling
from rankforge.plans.registry import _LISTS, _lists, query, t


def _u(*parts: str) -> str:
    return f"(('0x' || substr(sha256({chr(32).join(f'{p} ||' for p in parts)} ''), 1, 12))::BIGINT / 281474976710655.0)"


@query(f"""WITH {_LISTS}, x AS (SELECT l_suppkey AS k, l_partkey AS x, (r - 1)::BIGINT AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lists),
  d AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {_u("'7|'", "k", "'|drop|'", "i")}, i) > floor(n * (0.1 + (0.3 - 0.1) * {_u("'7|'", "k", "'|rate'")})) AS kept FROM x),
  e AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d WHERE kept),
  s AS (SELECT *, i < n - 1 AND {_u("'7|'", "k", "'|swap|'", "i")} < 0.4 AS swap, i = 0 OR NOT {_u("'7|'", "k", "'|swap|'", "i - 1")} < 0.4 AS begins FROM e),
  h AS (SELECT *, max(CASE WHEN begins THEN i END) OVER (PARTITION BY k ORDER BY i) AS held, lead(x) OVER (PARTITION BY k ORDER BY i) AS after FROM s),
  o AS (SELECT h.k AS k, h.i AS i, CASE WHEN h.swap THEN h.after ELSE c.x END AS x FROM h JOIN e c ON c.k = h.k AND c.i = h.held)
  SELECT k AS l_suppkey, string_agg(x::VARCHAR, ' ' ORDER BY i) AS sentence FROM o WHERE i < least(15, 8 + floor({_u("'7|'", "k", "'|length'")} * 8)) GROUP BY 1""")
def augmented_lists(spark, d):
    """Each supplier's ranked parts with dropout, travelling swaps and a random length."""
    x = _lists(spark, d)
    return x.select("l_suppkey", F.array_join(sampling.augmented(F.col("genes"), F.col("l_suppkey"), "7", swap=0.4, most=(8, 15)).cast("array<string>"), " ").alias("sentence"))


@query(f"""WITH r AS (SELECT c_custkey AS key, c_nationkey AS label, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_u("'3|'", "c_custkey", "'|row'")}, c_custkey) AS member FROM customer),
  a AS (SELECT label, row_number() OVER (ORDER BY {_u("'3|'", "label", "'|label'")}, label) - 1 AS place FROM r GROUP BY label HAVING count(*) >= 5), g AS (SELECT count(*) AS g FROM a),
  p AS (SELECT x.label AS l, y.label AS r, row_number() OVER (ORDER BY x.place, y.place) - 1 AS p FROM a x JOIN a y ON x.place < y.place), e AS (SELECT unnest(range(700)) AS example)
  SELECT example, 'coherent' AS mode, member, label, key FROM e, g JOIN a ON true JOIN r USING (label) WHERE example % 2 = 0 AND place = example % g AND member <= 5
  UNION ALL SELECT example, 'mixed', CASE WHEN label = l THEN member ELSE member + 2 END, label, key FROM e JOIN p ON p.p = example % (SELECT count(*) FROM p) JOIN r ON label = l AND member <= 2 OR label = p.r AND member <= 3 WHERE example % 2 = 1""")
def cluster_samples(spark, d):
    """Seven hundred clusters of five customers, of one nation or of two in turn."""
    return sampling.clusters(t(spark, d, "customer"), "c_custkey", "c_nationkey", 5, 700, "3")


_N = "trim(regexp_replace(lower(coalesce({}, '')), '[_\\s]+', ' ', 'g'))"


@query(f"""WITH al AS (SELECT n_name AS alias, 'N' || n_nationkey AS name, n_nationkey * 3 AS ord FROM nation UNION ALL SELECT r_name || ' region', 'N' || n_nationkey, n_nationkey * 3 + 1 FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'on ' || n_nationkey END, 'N' || n_nationkey, n_nationkey * 3 + 2 FROM nation),
  kn AS (SELECT {_N.format('alias')} AS alias, min(ord) AS ord, arg_max(name, ord) AS name FROM al GROUP BY 1 HAVING {_N.format('alias')} <> ''),
  v AS (SELECT s_suppkey AS k, unnest([n_name, CASE WHEN s_suppkey % 3 = 0 THEN 'The  ' || r_name || '_Region of old' ELSE r_name END, substr(n_name, 3, 4), CASE WHEN s_acctbal < 0 THEN NULL ELSE 'x' || s_suppkey END, '', r_name]) AS value, unnest(range(6)) AS pos FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
  f AS (SELECT k, pos, (SELECT arg_min(name, CASE WHEN alias = {_N.format('value')} THEN -1 ELSE ord END) FROM kn WHERE contains(alias, {_N.format('value')}) OR contains({_N.format('value')}, alias)) AS name FROM v WHERE {_N.format('value')} <> ''),
  u AS (SELECT k, name, min(pos) AS pos FROM f WHERE name IS NOT NULL GROUP BY ALL)
  SELECT s_suppkey, coalesce(string_agg(name, ',' ORDER BY pos), '') AS names FROM supplier LEFT JOIN u ON k = s_suppkey GROUP BY 1""")
def candidate_names(spark, d):
    """Nations that a supplier's words stand for: equal aliases first, then the first alias that holds a word or lies in it."""
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    name, at = F.concat(F.lit("N"), "n_nationkey"), F.col("n_nationkey") * 3
    forms = [(F.col("n_name"), at), (F.concat("r_name", F.lit(" region")), at + 1), (F.when(F.col("n_nationkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("on "), "n_nationkey")), at + 2)]
    aliases = n.select(name.alias("name"), F.explode(F.array(*[F.struct(a.alias("alias"), p.alias("at")) for a, p in forms])).alias("x")).select("x.*", "name")
    s = t(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    region = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("The  "), "r_name", F.lit("_Region of old"))).otherwise(F.col("r_name"))
    own = F.array("n_name", region, F.substring("n_name", 3, 4), F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("x"), "s_suppkey")), F.lit(""))
    got = sampling.candidate_names(s.select("s_suppkey", own.alias("own"), F.array("r_name").alias("others")), "s_suppkey", ["own", "others"], aliases)
    return got.select("s_suppkey", F.array_join("names", ",").alias("names"))
