"""Queries of reports over logs: how a rule store evolves, what its rules bring, how steps and checkpoints go.

Events are the log: a user is an epoch, an event type a section, a signup adds a rule, an error removes it, a click tags
it and anything else updates it.
"""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from rankforge.operators import reports
from rankforge.plans.registry import _OP, _ops, query, t

_LIVES = f"""o AS (SELECT user_id, event_id, {_OP} AS op, value FROM events), l AS (SELECT user_id, min(event_id) FILTER (op = 'ADD') AS birth, max(event_id) FILTER (op = 'REMOVE') AS last FROM o GROUP BY 1),
  v AS (SELECT user_id, birth, CASE WHEN last > birth THEN last END AS death FROM l WHERE birth IS NOT NULL), m AS (SELECT user_id, avg(value) AS score FROM o GROUP BY 1), b AS (SELECT v.*, score, death - birth AS span FROM v JOIN m USING (user_id))"""


def _lives(spark, d):
    from rankforge.operators import playbook

    lives = playbook.lifetimes(_ops(spark, d), "user_id", "event_id", "op").select("user_id", "birth", "death")
    score = t(spark, d, "events").groupBy("user_id").agg(F.avg("value").alias("score"))
    return lives.join(score, "user_id").withColumn("span", F.col("death") - F.col("birth"))


@query(f"""WITH {_LIVES}, s AS (SELECT date_trunc('day', ts)::date AS day, count(DISTINCT user_id) AS rules, avg(value) AS m FROM events GROUP BY 1), e AS (SELECT arg_min(rules, day) AS r0, arg_max(rules, day) AS r1, arg_min(m, day) AS m0, arg_max(m, day) AS m1, count(*) AS snapshots FROM s)
  SELECT snapshots, r1 - r0 AS growth, round_even((m1 - m0) / m0, 5)::double AS trend, (SELECT count(*) FROM b) AS rules, (SELECT count(*) FROM b WHERE death IS NULL) AS alive, (SELECT round_even(count(*) FILTER (death IS NULL) / count(*), 6)::double FROM b) AS survival,
    (SELECT round_even(avg(score), 4)::double FROM b) AS effectiveness, (SELECT count(*) FROM o WHERE op = 'ADD') AS adds, (SELECT count(*) FROM o WHERE op = 'REMOVE') AS removes FROM e""")
def evolution_summary(spark, d):
    """First against last snapshot, how many rules survive, and operation counts; one row."""
    snaps = t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("rules"), F.avg("value").alias("m"))
    ends = reports.first_last(snaps, "day", ["rules", "m"])
    a = ends.select(F.col("n").alias("snapshots"), (F.col("rules_last") - F.col("rules_first")).alias("growth"), F.bround(F.try_divide(F.col("m_last") - F.col("m_first"), F.col("m_first")), 5).alias("trend"))
    b = reports.survival(_lives(spark, d), "death", "score").withColumn("survival", F.bround("survival", 6)).withColumn("effectiveness", F.bround("effectiveness", 4))
    c = _ops(spark, d).agg(F.count_if(F.col("op") == "ADD").alias("adds"), F.count_if(F.col("op") == "REMOVE").alias("removes"))
    return a.crossJoin(b).crossJoin(c)  # a row each


@query(f"""WITH {_LIVES} SELECT span // 1000 AS span, count(*) AS n, round_even(avg(score), 4)::double AS effectiveness, min(span) AS least, max(span) AS most FROM b WHERE span IS NOT NULL GROUP BY span // 1000""")
def lifespan_report(spark, d):
    x = _lives(spark, d).where("span is not null").withColumn("k", F.floor(F.col("span") / 1000))
    return x.groupBy(F.col("k").alias("span")).agg(F.count("*").alias("n"), F.bround(F.avg("score"), 4).alias("effectiveness"), F.min("span").alias("least"), F.max("span").alias("most"))


@query(f"WITH {_LIVES} SELECT user_id FROM b WHERE death IS NULL OR span > (SELECT avg(span) FROM b)")
def long_lived(spark, d):
    x = _lives(spark, d)
    mean = x.agg(F.avg("span").alias("mean"))  # one row
    return x.crossJoin(F.broadcast(mean)).where("death is null or span > mean").select("user_id")


@query(f"""WITH o AS (SELECT user_id, {_OP} AS op, count(*) AS n FROM events GROUP BY ALL), c AS (SELECT user_id, sum(n) AS n, coalesce(sum(n) FILTER (op = 'ADD'), 0) AS a, coalesce(sum(n) FILTER (op = 'REMOVE'), 0) AS r, coalesce(sum(n) FILTER (op = 'UPDATE'), 0) AS u FROM o GROUP BY 1)
  SELECT user_id, n::bigint AS n, concat_ws(',', CASE WHEN a > n * 0.25 THEN 'rapid' END, CASE WHEN r > n * 0.25 THEN 'pruning' END, CASE WHEN u > n * 0.45 THEN 'refinement' END, CASE WHEN n < 90 THEN 'convergence' END) AS patterns FROM c""")
def learning_patterns(spark, d):
    """Epochs named by the shares of their operations; the thresholds are parameters."""
    x = reports.learning_patterns(_ops(spark, d), "user_id", "op", {"rapid": ("ADD", 0.25), "pruning": ("REMOVE", 0.25), "refinement": ("UPDATE", 0.45)}, 90)
    return x.select("user_id", "n", F.array_join("patterns", ",").alias("patterns"))


@query("""WITH s AS (SELECT date_trunc('day', ts)::date AS day, event_type, avg(value) AS m FROM events GROUP BY ALL), j AS (SELECT *, lag(m) OVER (PARTITION BY event_type ORDER BY day) AS p FROM s)
  SELECT day::varchar AS day, event_type, round_even((m - p) / p, 5)::double AS gain FROM j WHERE p > 0 AND (m - p) / p > 0.1""")
def performance_jumps(spark, d):
    x = t(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.avg("value").alias("m"))
    x = x.withColumn("p", F.lag("m").over(W.partitionBy("event_type").orderBy("day"))).withColumn("gain", (F.col("m") - F.col("p")) / F.col("p"))
    return x.where("p > 0 and gain > 0.1").select(F.col("day").cast("string").alias("day"), "event_type", F.bround("gain", 5).alias("gain"))


@query("""WITH s AS (SELECT l_orderkey AS k, l_suppkey AS i FROM lineitem), n AS (SELECT i, count(*) AS n FROM s GROUP BY 1)
  SELECT (SELECT count(DISTINCT k) FROM s) AS steps, round_even((SELECT count(*) FROM s) / (SELECT count(DISTINCT k) FROM s), 6)::double AS mean_used, round_even(count(*) FILTER (n > 600) / count(*), 6)::double AS reused FROM n""")
def selection_patterns(spark, d):
    """How many items a step uses, and the share of items used more often than 600 times."""
    used = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("ids"))
    x = reports.selection(used, "l_orderkey", "ids", 600)
    return x.select("steps", F.bround("mean_used", 6).alias("mean_used"), F.bround("reused", 6).alias("reused"))


@query("""SELECT role, count(*) FILTER (trim(text) <> '') AS said, round_even(count(DISTINCT text) FILTER (trim(text) <> '') / count(*) FILTER (trim(text) <> ''), 6)::double AS diversity,
  round_even(1 - count(DISTINCT text) FILTER (trim(text) <> '') / count(*) FILTER (trim(text) <> ''), 6)::double AS repetition FROM conversations GROUP BY 1""")
def reasoning_consistency(spark, d):
    x = reports.consistency(t(spark, d, "conversations"), "role", "text")
    return x.select("role", "said", F.bround("diversity", 6).alias("diversity"), F.bround("repetition", 6).alias("repetition"))


@query("""WITH x AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b, value FROM events)
  SELECT a || '>' || b AS loop, count(*) AS n, round_even(avg(value), 4)::double AS mean, CASE WHEN a = 'error' AND b = 'signup' THEN 'error_to_strategy' WHEN a = 'click' AND b = 'view' THEN 'reflection_to_curation' END AS kind FROM x WHERE b IS NOT NULL GROUP BY a, b""")
def feedback_loops(spark, d):
    """Pairs of following events as loops: how often, their mean value, and the named kinds."""
    x = t(spark, d, "events").withColumn("b", F.lead("event_type").over(W.partitionBy("user_id").orderBy("event_id"))).where("b is not null")
    kind = F.when((F.col("event_type") == "error") & (F.col("b") == "signup"), "error_to_strategy").when((F.col("event_type") == "click") & (F.col("b") == "view"), "reflection_to_curation")
    return x.groupBy("event_type", "b").agg(F.count("*").alias("n"), F.bround(F.avg("value"), 4).alias("mean")).select(F.concat_ws(">", "event_type", "b").alias("loop"), "n", "mean", kind.alias("kind"))


_USE = """u AS (SELECT s_suppkey AS i, s_nationkey AS section, count(*) AS n, avg((l_returnflag = 'N')::int) AS success, avg(l_discount) AS used, sum(l_discount) AS s FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
  g AS (SELECT count(*) AS n, sum(l_discount) AS s FROM lineitem), a AS (SELECT u.*, used - (g.s - u.s) / (g.n - u.n) AS impact FROM u, g), r AS (SELECT *, 0.3 * least(n / 600, 1) + 0.4 * success + 0.3 * greatest(0, impact) AS score FROM a)"""


def _attributed(spark, d):
    line = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return reports.attribution(line, "s_suppkey", "s_nationkey", F.col("l_returnflag") == "N", F.col("l_discount"), 600)


@query(f"WITH {_USE} SELECT section, count(*) AS items, round_even(avg(score), 6)::double AS mean, round_even(max(score), 6)::double AS best FROM r GROUP BY 1")
def section_attribution(spark, d):
    x = _attributed(spark, d).groupBy(F.col("s_nationkey").alias("section"))
    return x.agg(F.count("*").alias("items"), F.bround(F.avg("score"), 6).alias("mean"), F.bround(F.max("score"), 6).alias("best"))


@query(f"WITH {_USE} SELECT DISTINCT i, l_linestatus AS metric FROM r JOIN lineitem ON l_suppkey = i WHERE impact > 0.0002 AND l_discount > 0.09")
def performance_drivers(spark, d):
    """Items with an impact, by the kinds of lines on which they did well."""
    good = _attributed(spark, d).where("impact > 0.0002").select("s_suppkey")
    x = t(spark, d, "lineitem").where("l_discount > 0.09").join(good, F.col("l_suppkey") == F.col("s_suppkey"))
    return x.select(F.col("s_suppkey").alias("i"), F.col("l_linestatus").alias("metric")).distinct()


@query("""WITH x AS (SELECT DISTINCT user_id || ':' || date_trunc('day', ts)::date AS s, event_type AS i FROM events), y AS (SELECT user_id || ':' || date_trunc('day', ts)::date AS s, avg(value) AS m FROM events GROUP BY 1), n AS (SELECT i, avg(m) AS m FROM x JOIN y USING (s) GROUP BY 1),
  p AS (SELECT a.i AS a, b.i AS b, count(*) AS shared, avg(m) AS m FROM x a JOIN x b ON a.s = b.s AND a.i < b.i JOIN y ON y.s = a.s GROUP BY ALL)
  SELECT a, b, shared, round_even(p.m - (u.m + v.m) / 2, 5)::double AS synergy FROM p JOIN n u ON u.i = a JOIN n v ON v.i = b WHERE shared >= 3 AND p.m - (u.m + v.m) / 2 > 0.01""")
def synergies(spark, d):
    """Pairs that do better together than each of them on the mean: three meetings at least."""
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string"))
    x = t(spark, d, "events").select(key.alias("s"), F.col("event_type").alias("i"), "value")
    return reports.synergies(x, "s", "i", "value", 3, 0.01).withColumn("synergy", F.bround("synergy", 5))


@query("""WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, sum(n)::bigint AS samples, string_agg(lang || '=' || n, ',' ORDER BY lang) AS labels FROM n GROUP BY 1""")
def group_histogram(spark, d):
    """A group's label histogram from partial counts; no list of its samples."""
    n = t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    labels = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", "n"))), lambda x: F.concat_ws("=", x["lang"], x["n"].cast("string"))), ",")
    return n.groupBy("source").agg(F.sum("n").alias("samples"), labels.alias("labels"))


@query("SELECT key, count(DISTINCT v) AS groups FROM (SELECT unnest(['lang', 'source', 'both']) AS key, unnest([lang, source, lang || '/' || source]) AS v FROM documents) WHERE v IS NOT NULL GROUP BY 1")
def key_cardinality(spark, d):
    keys = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("both"), F.concat("lang", F.lit("/"), "source"))
    x = t(spark, d, "documents").select(F.explode(keys).alias("key", "v")).where("v is not null")
    return x.distinct().groupBy("key").agg(F.count("*").alias("groups"))


@query("SELECT lang, round_even(avg((quality = 1)::int), 6)::double AS accuracy, coalesce(round_even(avg(quality) FILTER (toxic = 1), 6), 0)::double AS hits, count(*) FILTER (toxic IS NULL) AS failed FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def hit_rates(spark, d):
    x = t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id", "left")
    hit = F.avg(F.when(F.col("toxic") == 1, F.col("quality")))
    return x.groupBy("lang").agg(F.bround(F.avg((F.col("quality") == 1).cast("int")), 6).alias("accuracy"), F.coalesce(F.bround(hit, 6), F.lit(0.0)).alias("hits"), F.count_if(F.col("toxic").isNull()).alias("failed"))


@query(f"SELECT count(DISTINCT event_type) AS sections, count(DISTINCT user_id) AS rules, count(*) FILTER (op = 'TAG') AS tags, sum(floor(value)) FILTER (op = 'TAG')::bigint AS amount FROM (SELECT *, {_OP} AS op FROM events)")
def store_stats(spark, d):
    tag = F.col("op") == "TAG"
    return t(spark, d, "events").withColumn("op", F.expr(_OP)).agg(F.countDistinct("event_type").alias("sections"), F.countDistinct("user_id").alias("rules"), F.count_if(tag).alias("tags"), F.sum(F.when(tag, F.floor("value"))).cast("long").alias("amount"))


@query("SELECT source, count(*) AS before, count(*) FILTER (toxic = 0 AND quality = 1) AS after, count(DISTINCT lang) AS labels FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def kept_by_dataset(spark, d):
    x = t(spark, d, "documents").select("doc_id", "source", "lang").join(t(spark, d, "labels"), "doc_id", "left")
    return x.groupBy("source").agg(F.count("*").alias("before"), F.count_if((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("after"), F.countDistinct("lang").alias("labels"))


@query("""WITH c AS (SELECT date_trunc('day', ts)::date AS day, count(DISTINCT user_id) AS n, avg(value) AS m FROM events GROUP BY 1) SELECT day::varchar AS day, n, round_even(m, 4)::double AS mean FROM c WHERE n = (SELECT max(n) FROM c)""")
def full_checkpoints(spark, d):
    """Checkpoints that hold the full number of samples."""
    c = t(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("n"), F.avg("value").alias("m"))
    full = c.agg(F.max("n").alias("full"))
    return c.join(F.broadcast(full), F.col("n") == F.col("full")).select(F.col("day").cast("string").alias("day"), "n", F.bround("m", 4).alias("mean"))


@query("SELECT role, (turn // 2)::bigint AS step, count(*) AS n, count(*) FILTER (length(text) > 200) AS long FROM conversations GROUP BY ALL")
def role_activity(spark, d):
    return t(spark, d, "conversations").groupBy("role", F.floor(F.col("turn") / 2).alias("step")).agg(F.count("*").alias("n"), F.count_if(F.length("text") > 200).alias("long"))
