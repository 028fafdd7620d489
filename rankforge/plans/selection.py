"""Queries that choose: splits by lookup, labels by priority, experts, pools, samples and pairs of vectors."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from rankforge.functions import text as tx
from rankforge.operators import selection as sel, vectors
from rankforge.plans.registry import _LISTS, _lists, query, t

_PART = lambda c: f"('0x' || substr(sha256({c}), 1, 12))::bigint / 281474976710655.0"
_SPLIT = lambda c: f"CASE WHEN {_PART(c)} < 0.8 THEN 'train' WHEN {_PART(c)} < 0.9 THEN 'val' ELSE 'test' END"


@query(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_SPLIT("'s' || doc_id")} WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5') THEN {_SPLIT("'g' || source")} ELSE {_SPLIT("source || ':' || doc_id")} END AS split,
  CASE WHEN doc_id % 3 = 0 THEN 'sample' WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5') THEN 'group' ELSE 'hash' END AS how FROM documents""")
def split_lookup(spark, d):
    """A row's split by its id, else by its group, else by hash."""
    docs = t(spark, d, "documents").select("doc_id", "source")
    k = F.col("doc_id").cast("string")
    samples = docs.where("doc_id % 3 = 0").select("doc_id", tx.hash_split(F.concat(F.lit("s"), k), 0.8, 0.1).alias("split"))
    groups = docs.where("source in ('src1', 'src2', 'src3', 'src4', 'src5')").select("source").distinct().withColumn("split", tx.hash_split(F.concat(F.lit("g"), "source"), 0.8, 0.1))
    return sel.split_lookup(docs, "doc_id", "source", samples, groups, tx.hash_split(F.concat_ws(":", "source", k), 0.8, 0.1)).select("doc_id", "split", "how")


_ALIASES = (("brand#11", "first"), ("brand#12", "second"), ("small", "little"), ("red", "tinted"), ("promo", "offer"), ("economy", "cheap"))


@query("WITH m(a, l) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _ALIASES) + """) SELECT p_partkey, coalesce(x.l, y.l, z.l) AS label FROM part
  LEFT JOIN m x ON x.a = lower(p_brand) LEFT JOIN m y ON y.a = split_part(p_name, ' ', 1) LEFT JOIN m z ON z.a = lower(p_type)""")
def label_lookup(spark, d):
    """The label of the first of several keys that an alias table knows."""
    aliases = spark.createDataFrame(list(_ALIASES), "alias string, label string")
    p = t(spark, d, "part")
    return sel.first_known(p, "p_partkey", [F.lower("p_brand"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lower("p_type")], aliases)


_SETS = """ds AS (SELECT c_custkey % 40 AS ds, c_nationkey AS label, c_mktsegment AS class, c_acctbal FROM customer), dl AS (SELECT DISTINCT ds, label FROM ds WHERE c_acctbal > 7000), dc AS (SELECT DISTINCT ds, class FROM ds WHERE c_acctbal > 9700), al AS (SELECT DISTINCT ds FROM ds),
  r AS (SELECT c_custkey AS k, c_custkey % 40 AS own, c_nationkey AS label, c_mktsegment AS class FROM customer)"""


def _experts(spark, d):
    x = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 40).alias("ds"), F.col("c_nationkey").alias("label"), F.col("c_mktsegment").alias("class"), "c_acctbal")
    labels, classes = x.where("c_acctbal > 7000").select("ds", "label").distinct(), x.where("c_acctbal > 9700").select("ds", "class").distinct()
    return x.drop("c_acctbal"), x.select("ds").distinct(), labels, classes


@query(f"""WITH {_SETS}, p AS (SELECT k, al.ds, row_number() OVER (PARTITION BY k ORDER BY sha1(k || ':' || al.ds), al.ds) AS r FROM r, al WHERE al.ds <> own
    AND NOT EXISTS (SELECT 1 FROM dl WHERE dl.ds = al.ds AND dl.label = r.label) AND NOT EXISTS (SELECT 1 FROM dc WHERE dc.ds = al.ds AND dc.class = r.class))
  SELECT k, string_agg(ds::varchar, ',' ORDER BY r) AS experts FROM p WHERE r <= 3 GROUP BY k""")
def ood_experts(spark, d):
    """Three data sets, in hash order, that share neither a row's label nor its class."""
    rows, every, labels, classes = _experts(spark, d)
    return sel.apart(rows, "k", "ds", every, labels, classes, 3).select("k", F.array_join(F.col("experts").cast("array<string>"), ",").alias("experts"))


@query(f"""WITH {_SETS}, p AS (SELECT k, al.ds, CASE WHEN EXISTS (SELECT 1 FROM dl WHERE dl.ds = al.ds AND dl.label = r.label) THEN 0 WHEN EXISTS (SELECT 1 FROM dc WHERE dc.ds = al.ds AND dc.class = r.class) THEN 1 ELSE 2 END AS tier FROM r, al WHERE al.ds <> own),
  q AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, sha1(k || ':' || ds), ds) AS n FROM p) SELECT k, string_agg(tier || ':' || ds, ',' ORDER BY n) AS experts FROM q WHERE n <= 2 GROUP BY k""")
def cross_experts(spark, d):
    """Two other data sets for each row: those with its label first, then those with its class, then any."""
    rows, every, labels, classes = _experts(spark, d)
    x = sel.near(rows, "k", "ds", every, labels, classes, 2)
    return x.select("k", F.array_join(F.transform("experts", lambda e: F.concat_ws(":", e["tier"].cast("string"), e["ds"].cast("string"))), ",").alias("experts"))


@query("""WITH a AS (SELECT doc_id, source, lang, sha1(doc_id::varchar) AS h FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY h, doc_id) AS tr FROM a),
  c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (tr > 1)::int, h, doc_id) AS r FROM b) SELECT source, doc_id, r FROM c WHERE r <= 6""")
def distinct_types_first(spark, d):
    """Six documents a source: one of each language in hash order, then others."""
    x = t(spark, d, "documents").select("doc_id", "source", "lang")
    return sel.distinct_first(x, "source", "lang", [F.sha1(F.col("doc_id").cast("string")), F.col("doc_id")], 6).select("source", "doc_id", F.col("rank").cast("long").alias("r"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('5:' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM documents)
  SELECT doc_id, CASE WHEN k <= least(greatest(round(n * 0.85), 1), n - 1) THEN 'train' ELSE 'test' END AS split FROM r""")
def random_split(spark, d):
    """The first 85 % in hash order, at least one row on either side; ranks are counted in hash buckets."""
    return sel.random_split(t(spark, d, "documents").select("doc_id"), "doc_id", "5", 0.85)


@query("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY sha1(doc_id::varchar), doc_id) - 1 AS i FROM documents QUALIFY i < 30), k AS (SELECT unnest(range(100)) AS j)
  SELECT j, doc_id, CASE j % 2 WHEN 0 THEN 'single' ELSE 'bundle' END AS family FROM k JOIN p ON p.i = j % 30""")
def generation_targets(spark, d):
    """A hundred targets that cycle over a pool of thirty documents and alternate between two families."""
    pool = t(spark, d, "documents").select("doc_id").orderBy(F.sha1(F.col("doc_id").cast("string")), "doc_id").limit(30)
    return sel.targets(spark, pool, "doc_id", 100, ("single", "bundle"))


@query("SELECT source, count(*) AS n, string_agg(lang || '=' || c, ',' ORDER BY c DESC, lang) AS labels, first FROM (SELECT source, lang, count(*) AS c, first FROM documents JOIN (SELECT source, arg_min(lang, doc_id) AS first FROM documents GROUP BY 1) USING (source) GROUP BY ALL) GROUP BY source, first".replace("count(*) AS n", "sum(c)::bigint AS n"))
def dataset_index(spark, d):
    x = t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("c"), F.min("doc_id").alias("at"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("m"), "lang", "c")))
    return x.groupBy("source").agg(F.sum("c").alias("n"), F.array_join(F.transform(order, lambda e: F.concat_ws("=", e["lang"], e["c"].cast("string"))), ",").alias("labels"), F.min_by("lang", "at").alias("first"))


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS seen FROM events WHERE value > 30 GROUP BY ALL), c(event_type, content) AS (VALUES ('view', 'look first'), ('click', 'then press'), ('error', 'try again'))
  SELECT user_id, string_agg('[' || event_type || '] ' || content, chr(10) ORDER BY seen) AS excerpt FROM f JOIN c USING (event_type) GROUP BY 1""")
def rule_excerpts(spark, d):
    """The known rules that a user's steps cite, each once, by their first citation."""
    rules = spark.createDataFrame([("view", "look first"), ("click", "then press"), ("error", "try again")], "event_type string, content string")
    return sel.excerpts(t(spark, d, "events").where("value > 30"), "user_id", "event_type", "event_id", rules, "content")


@query(f"""WITH {_LISTS}, a AS (SELECT l_suppkey AS k, list(l_partkey ORDER BY r) AS g FROM lists GROUP BY 1)
  SELECT k, CASE k % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'length' WHEN 2 THEN CASE WHEN g[1] = g[2] THEN 'same' ELSE 'changed' END ELSE 'same' END AS state FROM a""")
def locked_lists(spark, d):
    """Lists that came with a request against the canonical ones: missing profile, another length, changed, same."""
    own = _lists(spark, d).select(F.col("l_suppkey").alias("k"), F.col("genes").alias("g"))
    n = F.size("g")
    swapped = F.concat(F.slice("g", 2, 1), F.slice("g", 1, 1), F.slice("g", F.lit(3), n))
    sent = own.select("k", F.when(F.col("k") % 5 == 1, F.slice("g", F.lit(1), n - 1)).when(F.col("k") % 5 == 2, swapped).otherwise(F.col("g")).alias("sent"))
    return sel.locked(sent, own.where("k % 5 <> 0"), "k", "sent", "g")


@query("""WITH n AS (SELECT source, count(*) AS total FROM documents GROUP BY 1), e AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha1(doc_id::varchar), doc_id) AS r FROM documents WHERE length(text) > 400)
  SELECT doc_id, source, total, row_number() OVER (ORDER BY r, source) AS place FROM e JOIN n USING (source) WHERE r <= 3""")
def source_pool(spark, d):
    """A bounded pool of eligible rows, interleaved over the groups, with counts over all rows."""
    x = t(spark, d, "documents").select("doc_id", "source", (F.length("text") > 400).alias("ok"))
    return sel.pool(x, "source", "ok", [F.sha1(F.col("doc_id").cast("string")), F.col("doc_id")], 3).select("doc_id", "source", "total", "place")


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality IS NOT NULL THEN 'quality' ELSE 'lang' END AS key, CASE WHEN toxic = 1 THEN '1' WHEN quality IS NOT NULL THEN quality::varchar ELSE lang END AS value,
  CASE WHEN toxic = 1 OR quality IS NOT NULL THEN 'source=' || source || '; lang=' || lang ELSE 'source=' || source END AS context FROM documents LEFT JOIN labels USING (doc_id)""")
def state_examples(spark, d):
    """The first state key that a row has with its value, and a context without that key."""
    x = t(spark, d, "documents").select("doc_id", "lang", "source").join(t(spark, d, "labels"), "doc_id", "left")
    keys = {"toxic": F.when(F.col("toxic") == 1, F.lit("1")), "quality": F.col("quality").cast("string"), "lang": F.col("lang")}
    return sel.state_examples(x, keys, {"source": F.col("source"), "lang": F.col("lang")}).select("doc_id", "key", "value", "context")


@query("""WITH v AS (SELECT vec_id, vec_id // 16 AS b, embedding::double[] AS e FROM embeddings), s AS (SELECT a.b, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.e, b.e) / 0.1 AS s FROM v a JOIN v b ON a.b = b.b AND a.vec_id <> b.vec_id),
  l AS (SELECT b, i, ln(sum(exp(s))) - max(s) FILTER (j = CASE i % 2 WHEN 0 THEN i + 1 ELSE i - 1 END) AS loss FROM s GROUP BY ALL) SELECT b, count(loss) AS n, round_even(avg(loss), 4)::double AS loss FROM l GROUP BY 1""")
def contrastive_loss(spark, d):
    """Neighbouring vectors as positive pairs in batches of sixteen, temperature 0.1."""
    x = t(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 16).alias("b"), "embedding")
    return vectors.contrastive_loss(x, "b", "vec_id", "embedding", 0.1).select("b", "n", F.bround("loss", 4).alias("loss"))
