"""Queries over the driver tables with their SQL equivalents."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from rankforge.functions import scores, text as tx
from rankforge.operators import overlap, playbook, ranking, splitting, vectors, verify

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LISTS = """lists AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_partkey) AS r
  FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL) QUALIFY r <= 20)"""


def _lists(spark, d, k=20):
    return ranking.rank_normalize(t(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity", k)


@query(f"WITH {_LISTS} SELECT l_suppkey, string_agg(l_partkey::varchar, ' ' ORDER BY r) AS sentence, count(*) AS n FROM lists GROUP BY 1")
def rank_normalize_topk(spark, d):
    return _lists(spark, d).select("l_suppkey", F.array_join(F.col("genes").cast("array<string>"), " ").alias("sentence"), F.size("genes").cast("long").alias("n"))


@query(f"WITH {_LISTS} SELECT l_suppkey, l_partkey AS gene, count(*) OVER (PARTITION BY l_suppkey) - r + 1 AS weight FROM lists")
def inverse_rank_matrix(spark, d):
    return ranking.inverse_rank(_lists(spark, d), "l_suppkey").withColumn("weight", F.col("weight").cast("long"))


@query("SELECT doc_id, CASE WHEN lower(trim(source)) IN ('', 'na', 'n/a', 'nan', 'none', 'null', 'unknown') THEN NULL ELSE trim(source) END AS source, trim(regexp_replace(lower(lang || '_' || source), '[^a-z0-9]+', ' ', 'g')) AS token FROM documents")
def null_token_clean(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.clean_value(F.col("source")).alias("source"), tx.normalized_token(F.concat_ws("_", "lang", "source")).alias("token"))


@query("SELECT doc_id, 'LABEL: ' || lang || chr(10) || 'CONTEXT: source=' || source || chr(10) || 'TOXIC: ' || coalesce(toxic::varchar, 'none') AS answer, lang AS label, coalesce(toxic::varchar, 'none') AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def render_and_parse_answer(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    answer = tx.render_fields({"LABEL": F.col("lang"), "CONTEXT": F.concat(F.lit("source="), "source"), "TOXIC": F.col("toxic").cast("string")})
    x = x.select("doc_id", answer.alias("answer"))
    return x.select("doc_id", "answer", tx.parse_field(F.col("answer"), "LABEL").alias("label"), tx.parse_field(F.col("answer"), "TOXIC").alias("toxic"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), 'https?://[^ \\t\\n\\r)]+', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS cleaned FROM pages")
def reasoning_clean(spark, d):
    return t(spark, d, "pages").select("page_id", tx.strip_links(F.col("html")).alias("cleaned"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9-]+'), lambda t:
  length(t) >= 3 AND (length(regexp_replace(t, '[^A-Z]', '', 'g')) >= 2 OR regexp_matches(t, '[0-9]'))))), ' ') AS mentions FROM documents""")
def symbol_mentions(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(tx.symbol_mentions(F.col("text")), " ").alias("mentions"))


@query("""WITH x AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations),
  y AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM x)
  SELECT conv_id, turn, round_even(CASE WHEN len(w) = 0 AND len(p) = 0 THEN 1.0 WHEN len(list_intersect(w, p)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(w, p)) / (len(w) + len(p)) END, 6)::double AS f1 FROM y WHERE p IS NOT NULL""")
def turn_set_f1(spark, d):
    x = t(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"))).alias("w"))
    x = x.withColumn("p", F.lag("w").over(W.partitionBy("conv_id").orderBy("turn"))).where("p is not null")
    return x.select("conv_id", "turn", F.bround(scores.set_f1(F.col("w"), F.col("p")), 6).alias("f1"))


_MARKS = ("the", "und", "les", "que", "idiot")


@query("SELECT doc_id, round_even((" + " + ".join(f"contains(lower(text), '{m}')::int" for m in _MARKS) + f") / {len(_MARKS)}.0, 6)::double AS recall FROM documents")
def mention_recall(spark, d):
    return t(spark, d, "documents").select("doc_id", F.bround(scores.mention_recall(F.lower("text"), F.array(*map(F.lit, _MARKS))), 6).alias("recall"))


@query("SELECT p_partkey, p_name FROM part WHERE coalesce(contains(lower(p_name), 're'), false) AND p_size BETWEEN 5 AND 30")
def null_safe_contains(spark, d):
    return t(spark, d, "part").where(F.coalesce(F.contains(F.lower("p_name"), F.lit("re")), F.lit(False)) & F.col("p_size").between(5, 30)).select("p_partkey", "p_name")


@query("SELECT o_orderkey, 'segment=' || c_mktsegment || '; priority=' || o_orderpriority || '; status=' || o_orderstatus AS context FROM orders JOIN customer ON o_custkey = c_custkey")
def context_claims(spark, d):
    x = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return x.select("o_orderkey", F.concat_ws("; ", *[F.concat(F.lit(f"{k}="), c) for k, c in (("segment", "c_mktsegment"), ("priority", "o_orderpriority"), ("status", "o_orderstatus"))]).alias("context"))


@query("SELECT event_id, TRY_CAST(props AS JSON) IS NOT NULL AS valid, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return t(spark, d, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha1('7|' || doc_id::varchar)) AS rank FROM documents QUALIFY rank <= 5")
def stable_hash_order(spark, d):
    x = t(spark, d, "documents").select("doc_id", "source")
    return ranking.top_k(x, ["source"], [F.sha1(F.concat_ws("|", F.lit("7"), F.col("doc_id").cast("string")))], 5).withColumn("rank", F.col("rank").cast("long"))


_FRACTION = "(('0x' || substr(sha256(doc_id::varchar), 1, 12))::bigint / 281474976710655.0)"


@query(f"SELECT doc_id, CASE WHEN {_FRACTION} < 0.8 THEN 'train' WHEN {_FRACTION} < 0.9 THEN 'val' ELSE 'test' END AS split FROM documents")
def hash_split(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.hash_split(F.col("doc_id").cast("string"), 0.8, 0.1).alias("split"))


@query("SELECT doc_id, (('0x' || substr(sha1(doc_id::varchar), 1, 8))::bigint % 3)::int AS template, concat_ws(':', lang, source, substr(sha1(doc_id::varchar), 1, 12)) AS id FROM documents")
def template_choice_and_id(spark, d):
    key = F.col("doc_id").cast("string")
    return t(spark, d, "documents").select("doc_id", tx.choice(key, 3).alias("template"), tx.stable_id(F.col("lang"), F.col("source"), key).alias("id"))


def _targets(n: str, train: str, val: str) -> str:
    """SQL columns t and v of the split counts, step by step, over a relation with these columns."""
    return f"""SELECT * EXCLUDE (t0, v0, v1, t2), t2 - (n >= 10 AND v1 = 0 AND t2 > 1)::bigint AS t, v1 + (n >= 10 AND v1 = 0 AND t2 > 1)::bigint AS v
      FROM (SELECT *, t0 - (n >= 3 AND n - t0 - v1 = 0 AND t0 > 1)::bigint AS t2
      FROM (SELECT *, CASE WHEN t0 + v0 > n THEN greatest(0, n - t0) ELSE v0 END AS v1
      FROM (SELECT *, greatest(1, floor(n * {train} + 1e-9))::bigint AS t0,
        CASE WHEN n < 10 THEN 0 ELSE greatest(1, floor(n * {val} + 1e-9)) END::bigint AS v0 FROM {n})))"""


_RATIOS = ((0.8, 0.1), (0.7, 0.15), (0.5, 0.5), (0.95, 0.2), (0.34, 0.33))
_COUNTED = "(SELECT n, a, b FROM (SELECT DISTINCT count(*) AS n FROM orders GROUP BY o_custkey UNION SELECT count(*) FROM documents GROUP BY lang), (VALUES {}) r(a, b))"


@query(f"SELECT a, b, n, t AS train, v AS val, n - t - v AS test FROM ({_targets(_COUNTED.format(', '.join(f'({a}::double, {b}::double)' for a, b in _RATIOS)), 'a', 'b')})")
def target_counts(spark, d):
    """Counts at several ratios for every number of orders that a customer has, and of documents of a language."""
    n = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select("n")
    n = n.unionByName(t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("n")).distinct()
    out = None
    for a, b in _RATIOS:
        counts = zip(splitting.target_counts(F.col("n"), a, b), ("train", "val", "test"), strict=True)
        x = n.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", *[c.alias(k) for c, k in counts])
        out = x if out is None else out.unionByName(x)
    return out


_RANKED = "(SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id::varchar), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)"


@query(f"SELECT doc_id, lang, CASE WHEN k <= t THEN 'train' WHEN k <= t + v THEN 'val' ELSE 'test' END AS split FROM ({_targets(_RANKED, '0.8', '0.1')})")
def stratified_split(spark, d):
    return splitting.stratified_split(t(spark, d, "documents"), "doc_id", "lang", "7", 0.8, 0.1)


def _by_size(spark, d):
    groups = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return splitting.grouped_split(groups, "source", "n", 0.8, 0.1)


_BY_SIZE = """RECURSIVE g AS (SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS k, sum(n) OVER () AS total FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)),
 f AS (SELECT 0::bigint AS k, ''::varchar AS source, ''::varchar AS split, 0.0::double AS a, 0.0::double AS b, 0.0::double AS c
  UNION ALL SELECT g.k, g.source, s, a + CASE WHEN s = 'train' THEN n ELSE 0 END, b + CASE WHEN s = 'val' THEN n ELSE 0 END, c + CASE WHEN s = 'test' THEN n ELSE 0 END
  FROM (SELECT f.*, g.k AS gk, CASE WHEN total*0.8-a >= total*0.1-b AND total*0.8-a >= total*0.1-c THEN 'train' WHEN total*0.1-b >= total*0.1-c THEN 'val' ELSE 'test' END AS s FROM f JOIN g ON g.k = f.k + 1) f JOIN g ON g.k = f.gk)"""


@query(f"WITH {_BY_SIZE} SELECT source, split FROM f WHERE k > 0")
def size_split(spark, d):
    return _by_size(spark, d)


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedupe_first(spark, d):
    return t(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("text")


@query("SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 3")
def topk_per_group(spark, d):
    x = t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return ranking.top_k(x, ["lang", "source"], [F.col("n_chars").desc(), F.col("doc_id")], 3).drop("n_chars").withColumn("rank", F.col("rank").cast("long"))


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) SELECT * FROM r ORDER BY turn, source LIMIT 50")
def round_robin(spark, d):
    return ranking.round_robin(t(spark, d, "documents").select("doc_id", "source"), "source", [F.col("doc_id")], 50).withColumn("turn", F.col("turn").cast("long"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY n DESC, f) AS pool FROM c GROUP BY 1")
def candidate_pool(spark, d):
    c = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "f", "event_type")))
    return c.groupBy("user_id").agg(F.array_join(F.transform(order, lambda x: x["event_type"]), ",").alias("pool"))


@query("""WITH x AS (SELECT DISTINCT c_nationkey AS k, p_brand || p_size AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
  s AS (SELECT k, count(*) AS n FROM x GROUP BY 1), p AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM x a JOIN x b ON a.i = b.i AND a.k < b.k GROUP BY ALL)
  SELECT a, b, shared, round_even(shared / (u.n + v.n - shared), 6)::double AS jaccard FROM p JOIN s u ON u.k = a JOIN s v ON v.k = b""")
def dataset_overlap(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = x.join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("c_nationkey").alias("k"), F.concat("p_brand", F.col("p_size").cast("string")).alias("i"))
    return overlap.set_overlap(x, "k", "i")


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM lineitem WHERE l_returnflag = 'R'), v AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS i FROM lineitem WHERE l_returnflag <> 'R')
  SELECT * FROM r EXCEPT SELECT * FROM v""")
def evidence_missing(spark, d):
    x = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("i"), "l_returnflag")
    return overlap.missing(x.where("l_returnflag <> 'R'"), x.where("l_returnflag = 'R'"), "k", "i")


def _verified(spark, d):
    x = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left")
    return verify.verify(x, {"short": F.length("text") < 200, "unlabelled": F.col("quality").isNull(), "toxic": F.col("toxic") == 1, "low_quality": F.col("quality") == 0, "count_mismatch": F.length("text") != F.col("n_chars")})


_RULES = """SELECT doc_id, 'short' AS issue FROM documents WHERE length(text) < 200 UNION ALL SELECT doc_id, 'unlabelled' FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL
  UNION ALL SELECT doc_id, 'toxic' FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 UNION ALL SELECT doc_id, 'low_quality' FROM documents JOIN labels USING (doc_id) WHERE quality = 0
  UNION ALL SELECT doc_id, 'count_mismatch' FROM documents WHERE length(text) <> n_chars"""


@query(_RULES)
def verify_rules(spark, d):
    return _verified(spark, d).select("doc_id", F.explode("issues").alias("issue"))


@query(f"WITH i AS ({_RULES}) SELECT 'rows' AS issue, count(*) AS n FROM documents UNION ALL SELECT 'passed', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM i) UNION ALL SELECT issue, count(*) FROM i GROUP BY 1")
def verify_report(spark, d):
    return verify.report(_verified(spark, d))


_NEAR = """v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings),
 n AS (SELECT q.vec_id AS q_id, q.label AS q_label, b.vec_id AS id, b.label AS label, round(list_cosine_similarity(q.e, b.e), 9) AS c FROM v q JOIN v b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY c DESC, id) AS r FROM n QUALIFY r <= 10)"""


def _near(spark, d, k=10):
    e = t(spark, d, "embeddings")
    return vectors.neighbours(e.where("vec_id % 50 = 0"), e, k)


@query(f"WITH {_NEAR}, h AS (SELECT q_id, max((r <= 1 AND label = q_label)::int) AS a, max((r <= 5 AND label = q_label)::int) AS b, max((label = q_label)::int) AS c FROM k GROUP BY 1) SELECT unnest([1, 5, 10]) AS k, unnest([round_even(avg(a), 6), round_even(avg(b), 6), round_even(avg(c), 6)])::double AS recall FROM h")
def knn_recall(spark, d):
    return vectors.recall_at(_near(spark, d), (1, 5, 10))


@query(f"""WITH {_NEAR}, w AS (SELECT q_id, q_label, label, round_even(sum(1 / greatest(1 - c, 1e-8)), 6) AS s, min(r) AS r FROM k GROUP BY ALL)
  SELECT q_id, q_label, label AS predicted FROM w QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY s DESC, r) = 1""")
def knn_transfer(spark, d):
    return vectors.transfer(_near(spark, d))


@query("SELECT dim::int AS dim, round_even(avg(x), 6)::double AS mean, round_even(var_pop(x), 6)::double AS var FROM (SELECT unnest(range(64)) AS dim, unnest(embedding::double[]) AS x FROM embeddings) GROUP BY 1")
def embedding_geometry(spark, d):
    return vectors.geometry(t(spark, d, "embeddings")).select("dim", F.bround("mean", 6).alias("mean"), F.bround("var", 6).alias("var"))


_DAYS = "d AS (SELECT date_trunc('day', ts)::date::varchar AS day, event_type, round_even(avg(value), 4)::double AS m FROM events GROUP BY ALL)"


def _days(spark, d):
    return t(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.bround(F.avg("value"), 4).alias("m"))


@query(f"WITH {_DAYS} SELECT * FROM d")
def checkpoint_means(spark, d):
    return _days(spark, d)


@query(f"WITH {_DAYS} SELECT day, event_type, round_even(m - first_value(m) OVER (PARTITION BY event_type ORDER BY day), 4)::double AS delta, round_even(m - lag(m) OVER (PARTITION BY event_type ORDER BY day), 4)::double AS step FROM d")
def delta_first(spark, d):
    w = W.partitionBy("event_type").orderBy("day")
    return _days(spark, d).select("day", "event_type", F.bround(F.col("m") - F.first("m").over(w), 4).alias("delta"), F.bround(F.col("m") - F.lag("m").over(w), 4).alias("step"))


@query(f"""WITH {_DAYS}, x AS (SELECT event_type, m - first_value(m) OVER (PARTITION BY event_type ORDER BY day) AS c FROM d)
  SELECT event_type, count(*) FILTER (c > 1e-9) AS improved, count(*) FILTER (abs(c) <= 1e-9) AS same, count(*) FILTER (c < -1e-9) AS regressed FROM x GROUP BY 1""")
def change_counts(spark, d):
    x = _days(spark, d).withColumn("c", F.col("m") - F.first("m").over(W.partitionBy("event_type").orderBy("day")))
    return x.groupBy("event_type").agg(F.count_if(F.col("c") > 1e-9).alias("improved"), F.count_if(F.abs("c") <= 1e-9).alias("same"), F.count_if(F.col("c") < -1e-9).alias("regressed"))


@query(f"WITH {_DAYS} SELECT day, " + ", ".join(f"max(m) FILTER (event_type = '{e}') AS {e}" for e in ("click", "error", "purchase", "signup", "view")) + " FROM d GROUP BY 1")
def pivot_metric(spark, d):
    return _days(spark, d).groupBy("day").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.max("m"))


@query("""WITH r AS (SELECT l_suppkey, sum(l_quantity) FILTER (l_returnflag = 'R') / sum(l_quantity) AS x FROM lineitem GROUP BY 1)
  SELECT count(*) AS n, round_even(avg(coalesce(x, 0)), 6)::double AS macro, round_even(stddev_samp(coalesce(x, 0)), 6)::double AS sd, (SELECT round_even(sum(l_quantity) FILTER (l_returnflag = 'R') / sum(l_quantity), 6)::double FROM lineitem) AS micro FROM r""")
def micro_macro_rates(spark, d):
    back = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")))
    per = t(spark, d, "lineitem").groupBy("l_suppkey").agg(back.alias("b"), F.sum("l_quantity").alias("q")).withColumn("x", F.coalesce(F.try_divide("b", "q"), F.lit(0.0)))
    return per.agg(F.count("*").alias("n"), F.bround(F.avg("x"), 6).alias("macro"), F.bround(F.stddev_samp("x"), 6).alias("sd"), F.bround(F.sum("b") / F.sum("q"), 6).alias("micro"))


@query("""WITH x AS (SELECT DISTINCT user_id || ':' || date_trunc('day', ts)::date AS s, event_type AS i FROM events), n AS (SELECT i, count(*) AS n FROM x GROUP BY 1), p AS (SELECT a.i AS a, b.i AS b, count(*) AS shared FROM x a JOIN x b ON a.s = b.s AND a.i < b.i GROUP BY ALL)
  SELECT a, b, shared, round_even(shared / (u.n + v.n - shared), 6)::double AS jaccard FROM p JOIN n u ON u.i = a JOIN n v ON v.i = b""")
def cooccurrence(spark, d):
    x = t(spark, d, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("s"), F.col("event_type").alias("i"))
    return overlap.set_overlap(x, "i", "s")


@query("""WITH u AS (SELECT user_id, event_type, avg(value) AS m, count(*) AS n FROM events GROUP BY ALL), a AS (SELECT event_type, user_id, sum(value) AS s, count(*) AS n FROM events GROUP BY ALL), tot AS (SELECT event_type, sum(s) AS s, sum(n) AS n, count(*) AS users FROM a GROUP BY 1), g AS (SELECT sum(s) AS s, sum(n) AS n FROM tot)
  SELECT event_type, users, round_even(tot.s / tot.n, 4)::double AS used, round_even((g.s - tot.s) / (g.n - tot.n), 4)::double AS unused, round_even(tot.s / tot.n - (g.s - tot.s) / (g.n - tot.n), 4)::double AS impact FROM tot, g""")
def attribution(spark, d):
    a = t(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("s"), F.count("value").alias("n"), F.countDistinct("user_id").alias("users"))
    w = W.partitionBy()
    used, rest = F.col("s") / F.col("n"), (F.sum("s").over(w) - F.col("s")) / (F.sum("n").over(w) - F.col("n"))
    return a.select("event_type", "users", F.bround(used, 4).alias("used"), F.bround(rest, 4).alias("unused"), F.bround(used - rest, 4).alias("impact"))


@query("""WITH n AS (SELECT user_id, event_id, event_type = 'view' AS o, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM n WHERE o)
  SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g GROUP BY user_id, g HAVING count(*) >= 3""")
def decision_chains(spark, d):
    return ranking.runs(t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", F.col("event_type") == "view", 3)


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def change_points(spark, d):
    return ranking.change_points(t(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type")


@query("SELECT conv_id, turn, string_agg(role, '>') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent FROM conversations")
def sliding_reflections(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0)
    return t(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.collect_list("role").over(w), ">").alias("recent"))


_OP = "CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'error' THEN 'REMOVE' WHEN 'click' THEN 'TAG' ELSE 'UPDATE' END"


def _ops(spark, d):
    return t(spark, d, "events").select("user_id", "event_id", F.expr(_OP).alias("op"), F.floor("value").cast("long").alias("amount"))


@query(f"SELECT user_id, birth, CASE WHEN death > birth THEN death END AS death FROM (SELECT user_id, min(event_id) FILTER (op = 'ADD') AS birth, max(event_id) FILTER (op = 'REMOVE') AS death FROM (SELECT *, {_OP} AS op FROM events) GROUP BY 1) WHERE birth IS NOT NULL")
def lifespans(spark, d):
    return playbook.lifetimes(_ops(spark, d), "user_id", "event_id", "op")


_FOLD = f"""o AS (SELECT user_id, event_id, {_OP} AS op, floor(value)::bigint AS amount FROM events),
 l AS (SELECT user_id, max(event_id) FILTER (op IN ('ADD', 'REMOVE')) AS e, max(event_id) FILTER (op = 'ADD') AS a FROM o GROUP BY 1),
 z AS (SELECT o.*, max(event_id) FILTER (op IN ('ADD', 'UPDATE')) OVER (PARTITION BY user_id) AS s FROM o JOIN l USING (user_id) WHERE e = a AND event_id >= a),
 f AS (SELECT user_id, sum(CASE WHEN event_id = s OR (event_id > s AND op = 'TAG') THEN amount ELSE 0 END)::bigint AS counter, count(*) FILTER (op = 'TAG') AS tags FROM z GROUP BY 1)"""


@query(f"WITH {_FOLD} SELECT * FROM f")
def playbook_fold(spark, d):
    return playbook.fold(_ops(spark, d), "user_id", ["event_id"], "op", "amount")


@query(f"WITH {_FOLD}, b AS (SELECT * FROM f ORDER BY counter DESC, user_id LIMIT 10), c AS (SELECT * FROM f WHERE user_id NOT IN (SELECT user_id FROM b) ORDER BY tags DESC, user_id LIMIT 10) SELECT * FROM b UNION ALL SELECT * FROM c")
def prune_top(spark, d):
    return playbook.prune(playbook_fold(spark, d), "user_id", "counter", "tags", 10, 20)


@query("SELECT 'both' AS kind, count(*) AS n FROM (SELECT p_partkey FROM part INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'unsold', count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'any', count(*) FROM (SELECT p_partkey FROM part UNION SELECT l_suppkey FROM lineitem)")
def set_ops(spark, d):
    p, line = t(spark, d, "part").select("p_partkey"), t(spark, d, "lineitem")
    back = line.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    kinds = {"both": p.intersect(back), "unsold": p.exceptAll(back.distinct()).distinct(), "any": p.union(line.select("l_suppkey")).distinct()}
    out = None
    for k, x in kinds.items():
        x = x.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
        out = x if out is None else out.unionByName(x)
    return out


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::double AS qty, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_counts(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"), F.grouping_id().alias("g"))


@query("SELECT date_trunc('day', ts)::date::varchar AS day, event_type, count(*) AS n, round_even(sum(value), 2)::double AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """The stream drained to its end: complete mode into memory holds one row a day and type."""
    e = t(spark, d, "events")
    x = spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = x.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    name = f"windows_{abs(hash(d)) % 10**9}_{next(_serial)}"
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = folder or tempfile.mkdtemp(prefix="spark-rankforge-")
    q = counted.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.to_date("w.start").cast("string").alias("day"), "event_type", "n", F.bround("total", 2).alias("total"))


_serial = iter(range(10**9))


from rankforge.plans import more as _more  # noqa: E402, F401  registers further queries
from rankforge.plans import building as _building  # noqa: E402, F401
from rankforge.plans import books as _books, factors as _factors, generations as _generations, grouping as _grouping, sampling as _sampling, splits as _splits, verifier as _verifier  # noqa: E402, F401
from rankforge.plans import parsing as _parsing, validation as _validation, reports as _reports, selection as _selection  # noqa: E402, F401
