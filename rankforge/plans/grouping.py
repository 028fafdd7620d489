"""Queries of leak-free splits and of the choice of a grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.functions.text import hash_split
from rankforge.operators import building, grouping, splitting
from rankforge.plans.registry import _targets, query, t


def _fold(entries: str) -> str:
    """SQL relations o (groups in order) and f (splits, a step a group) over a relation with columns way, g and label."""
    return f"""RECURSIVE cells AS (SELECT way, g, label, count(*)::BIGINT AS n FROM ({entries}) GROUP BY ALL),
 lab AS (SELECT way, label, sum(n)::BIGINT AS n FROM cells GROUP BY ALL), whole AS (SELECT way, sum(n)::BIGINT AS n FROM cells GROUP BY 1),
 lq AS (SELECT way, label, n AS every, [t, v, n - t - v] AS q, row_number() OVER (PARTITION BY way ORDER BY label)::INTEGER AS i FROM ({_targets('lab', '0.8', '0.1')})),
 tq AS (SELECT way, n AS total, [t, v, n - t - v] AS q FROM ({_targets('whole', '0.8', '0.1')})),
 ql AS (SELECT way, list(q ORDER BY i) AS quotas FROM lq GROUP BY 1),
 og AS (SELECT c.way AS way, g, sum(n)::BIGINT AS size, max(n)::BIGINT AS most, round(sum(n / every), 9) AS rarity, list(i ORDER BY i) AS li, list(n ORDER BY i) AS ln FROM cells c JOIN lq ON lq.way = c.way AND lq.label = c.label GROUP BY ALL),
 o AS (SELECT og.*, quotas, q, total, row_number() OVER (PARTITION BY og.way ORDER BY most DESC, rarity DESC, size DESC, g) AS k FROM og JOIN ql ON ql.way = og.way JOIN tq ON tq.way = og.way),
 f AS (SELECT way, 0::BIGINT AS k, ''::VARCHAR AS g, 0::BIGINT AS size, 0::BIGINT AS s, [0, 0, 0]::BIGINT[] AS filled, list_transform(range(3 * len(quotas)), lambda x: 0::BIGINT) AS held FROM ql
  UNION ALL
  SELECT way, k, g, size, s, list_transform(filled, lambda v, j: v + CASE WHEN j = s THEN size ELSE 0 END), list_transform(held, lambda v, j: v + coalesce(ln[list_position(li, ((j - 1) // 3 + 1)::INTEGER)] * ((j - 1) % 3 + 1 = s)::BIGINT, 0))
  FROM (SELECT *, list_position(costs, list_min(costs))::BIGINT AS s FROM (
   SELECT o.*, filled, held, list_transform([1, 2, 3], lambda s: list_reduce(list_concat(
      [filled[s] / greatest(1, q[s]) + 4.0 * (greatest(0, filled[s] + o.size - q[s]) / greatest(1, q[s])) * (greatest(0, filled[s] + o.size - q[s]) / greatest(1, q[s])) - CASE WHEN filled[s] = 0 AND q[s] > 0 THEN 0.15 ELSE 0.0 END],
      list_transform(range(1, len(li) + 1), lambda x: CASE WHEN quotas[li[x]][s] > 0
        THEN ln[x] / greatest(1, o.size) * (0.35 * (held[3 * li[x] - 3 + s] / quotas[li[x]][s]) + 1.5 * (greatest(0, held[3 * li[x] - 3 + s] + ln[x] - quotas[li[x]][s]) / quotas[li[x]][s]) * (greatest(0, held[3 * li[x] - 3 + s] + ln[x] - quotas[li[x]][s]) / quotas[li[x]][s]))
        ELSE 0.15 * (ln[x] / greatest(1, o.size)) END)), lambda a, b: a + b) - greatest(0, q[s] - filled[s]) / greatest(1, total) * 0.05) AS costs
   FROM f JOIN o ON o.way = f.way AND o.k = f.k + 1)))"""


_NAMES = "CASE s WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'test' END AS split"
_SOURCES = _fold("SELECT 'all' AS way, source AS g, lang AS label FROM documents")
_CUSTOMERS = _fold("SELECT 'all' AS way, o_custkey AS g, o_orderpriority AS label FROM orders").replace("''::VARCHAR AS g", "0::BIGINT AS g")


@query(f"WITH {_SOURCES} SELECT g AS source, {_NAMES} FROM f WHERE k > 0")
def grouped_split(spark, d):
    """Sources whole, by quotas of each language."""
    return grouping.assign(t(spark, d, "documents"), "source", "lang", 0.8, 0.1).select(F.col("g").alias("source"), "split")


@query(f"WITH {_CUSTOMERS} SELECT g AS o_custkey, size, {_NAMES} FROM f WHERE k > 0")
def grouped_split_customers(spark, d):
    """Customers whole, by quotas of each order priority."""
    return grouping.assign(t(spark, d, "orders"), "o_custkey", "o_orderpriority", 0.8, 0.1).select(F.col("g").alias("o_custkey"), "size", "split")


_BY_ROW = "CASE WHEN (('0x' || substr(sha256(o_orderkey::varchar), 1, 12))::bigint / 281474976710655.0) < 0.8 THEN 'train' WHEN (('0x' || substr(sha256(o_orderkey::varchar), 1, 12))::bigint / 281474976710655.0) < 0.9 THEN 'val' ELSE 'test' END"


@query(f"""WITH {_CUSTOMERS}, x AS (SELECT 'whole groups' AS rule, o_custkey, {_NAMES} FROM orders JOIN f ON g = o_custkey WHERE k > 0 UNION ALL SELECT 'row by row', o_custkey, {_BY_ROW} FROM orders),
  y AS (SELECT rule, o_custkey, count(*) AS n, count(DISTINCT split) AS splits FROM x GROUP BY ALL)
  SELECT rule, count(*) AS groups, sum(n)::BIGINT AS n, count(*) FILTER (splits > 1) AS leaking FROM y GROUP BY 1""")
def split_leakage(spark, d):
    """Customers that lie in more than one split: none where groups stay whole, most where rows are dealt singly."""
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    whole = grouping.split_rows(orders, "o_custkey", "o_orderpriority", 0.8, 0.1).select(F.lit("whole groups").alias("rule"), "o_custkey", "split")
    single = orders.select(F.lit("row by row").alias("rule"), "o_custkey", hash_split(F.col("o_orderkey").cast("string"), 0.8, 0.1).alias("split"))
    both = whole.unionByName(single)
    leaking = splitting.leaks(both.withColumn("k", F.struct("rule", "o_custkey")), "k").groupBy("k.rule").agg(F.count("*").alias("leaking"))
    counts = both.groupBy("rule", "o_custkey").agg(F.count("*").alias("n")).groupBy("rule").agg(F.count("*").alias("groups"), F.sum("n").alias("n"))
    return counts.join(leaking, "rule", "left").select("rule", "groups", "n", F.coalesce("leaking", F.lit(0)).alias("leaking"))


@query(f"WITH {_SOURCES} SELECT g AS source, size AS n, rarity, k AS place FROM o")
def group_order(spark, d):
    """Sources in the order in which they are dealt."""
    groups = grouping.profiles(t(spark, d, "documents").withColumn("by", F.lit("all")), "by", "source", "lang", 0.8, 0.1)
    return grouping.in_order(groups).select(F.col("g").alias("source"), F.col("size").alias("n"), "rarity", (F.col("place") + 1).alias("place"))


_WAYS = """SELECT s.way AS way, s.g AS g, label FROM (SELECT unnest([{'way': 'source', 'g': source}, {'way': 'lang', 'g': lang}, {'way': 'source_lang', 'g': concat_ws('/', source, lang)}, {'way': 'prefix', 'g': (doc_id // 10)::varchar}]) AS s, lang AS label FROM documents)"""
_REPORT = f"""{_fold(_WAYS)}, r AS (SELECT way AS strategy, count(*) AS groups, coalesce(sum(size) FILTER (s = 1), 0)::bigint AS train, coalesce(sum(size) FILTER (s = 2), 0)::bigint AS val, coalesce(sum(size) FILTER (s = 3), 0)::bigint AS test FROM f WHERE k > 0 GROUP BY 1),
  d AS (SELECT *, train / (train + val + test) - 0.8 AS a, val / (train + val + test) - 0.1 AS b, test / (train + val + test) - 0.1 AS c FROM r),
  x AS (SELECT *, greatest(abs(a), abs(b), abs(c)) AS error, a * a + b * b + c * c + CASE WHEN train = 0 THEN 10 ELSE 0 END + CASE WHEN val = 0 THEN 10 ELSE 0 END + CASE WHEN test = 0 THEN 10 ELSE 0 END AS score FROM d)"""


def _report(spark, d):
    ways = {"source": F.col("source"), "lang": F.col("lang"), "source_lang": F.concat_ws("/", "source", "lang"), "prefix": F.floor(F.col("doc_id") / 10)}
    return grouping.strategy_report(t(spark, d, "documents"), "lang", ways, 0.8, 0.1)


@query(f"WITH {_REPORT} SELECT strategy, groups, train, val, test, round_even(error, 6)::double AS error, round_even(score, 6)::double AS score FROM x")
def strategy_report(spark, d):
    """Four ways to group documents, each dealt by the language quotas."""
    return _report(spark, d).withColumn("error", F.bround("error", 6)).withColumn("score", F.bround("score", 6))


@query(f"""WITH {_REPORT}, y AS (SELECT *, CASE WHEN train > 0 AND val > 0 AND test > 0 THEN CASE WHEN groups >= 8 AND error <= 0.18 THEN 'viable' ELSE 'nonempty' END ELSE 'any' END AS mode FROM x)
  SELECT strategy, mode, groups FROM y ORDER BY CASE mode WHEN 'viable' THEN 0 WHEN 'nonempty' THEN 1 ELSE 2 END, round(score, 9), round(error, 9), groups DESC, strategy LIMIT 1""")
def choose_strategy(spark, d):
    return building.choose_strategy(_report(spark, d))
