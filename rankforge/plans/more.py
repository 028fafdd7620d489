"""Further queries: phrases, evaluation, ordering and checks."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from rankforge.operators import evaluation, ranking, vectors
from rankforge.plans.registry import query, t

_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@query(f"""WITH p AS (SELECT item_id, array_to_string(({_WORDS.format('text')})[1:3], ' ') AS phrase FROM benchmark), d AS (SELECT doc_id, ' ' || array_to_string({_WORDS.format('text')}, ' ') || ' ' AS x FROM documents)
  SELECT DISTINCT doc_id, phrase FROM d JOIN p ON contains(x, ' ' || phrase || ' ') WHERE len(string_split(phrase, ' ')) = 3""")
def identity_mentions(spark, d):
    """An equi-join on three-word shingles in place of a product of texts and phrases."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"))
    phrases = t(spark, d, "benchmark").select(F.array_join(F.slice(words("text"), 1, 3), " ").alias("phrase"), F.size(words("text")).alias("n")).where("n >= 3").select("phrase").distinct()
    docs = t(spark, d, "documents").select("doc_id", words("text").alias("w")).where("size(w) >= 3")
    grams = docs.select("doc_id", F.explode(F.array_distinct(F.expr("transform(sequence(0, size(w) - 3), i -> concat_ws(' ', w[i], w[i + 1], w[i + 2]))"))).alias("phrase"))
    return grams.join(phrases, "phrase").select("doc_id", "phrase")


@query("""WITH v AS (SELECT vec_id, label, embedding::double[] AS e FROM embeddings), p AS (SELECT a.vec_id, a.label, b.label AS c, sum(1 - list_cosine_similarity(a.e, b.e)) AS s, count(*) AS n FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY ALL),
  m AS (SELECT vec_id, label, max(s / n) FILTER (c = label) AS a, min(s / n) FILTER (c <> label) AS b FROM p GROUP BY ALL)
  SELECT label, count(*) AS n, round_even(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5)::double AS silhouette FROM m GROUP BY 1""")
def silhouette_cosine(spark, d):
    s = evaluation.silhouette(t(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.bround(F.avg("silhouette"), 5).alias("silhouette"))


@query("""WITH c AS (SELECT label AS a, vec_id % 5 AS b, count(*) AS n FROM embeddings GROUP BY ALL), r AS (SELECT a, sum(n)::double AS r FROM c GROUP BY 1), k AS (SELECT b, sum(n)::double AS k FROM c GROUP BY 1), t AS (SELECT sum(n)::double AS t FROM c),
  s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS nn, (SELECT sum(r * (r - 1) / 2) FROM r) AS rr, (SELECT sum(k * (k - 1) / 2) FROM k) AS kk, t * (t - 1) / 2 AS tt,
   (SELECT sum(n / t * ln(n * t / r / k)) FROM c JOIN r USING (a) JOIN k USING (b)) AS mi, (SELECT -sum(r / t * ln(r / t)) FROM r) AS hr, (SELECT -sum(k / t * ln(k / t)) FROM k) AS hk FROM t)
  SELECT round_even((nn - rr * kk / tt) / ((rr + kk) / 2 - rr * kk / tt), 6)::double AS ari, round_even(2 * mi / (hr + hk), 6)::double AS nmi FROM s""")
def cluster_nmi_ari(spark, d):
    x = t(spark, d, "embeddings").select("label", (F.col("vec_id") % 5).alias("part"))
    return evaluation.contingency(x, "label", "part").select(F.bround("ari", 6).alias("ari"), F.bround("nmi", 6).alias("nmi"))


@query("""WITH x AS (SELECT toxic AS a, 1 - quality AS b FROM labels), l AS (SELECT unnest([0, 1])::int AS label)
  SELECT label, count(*) FILTER (a = label) AS support, count(*) FILTER (b = label) AS picked, count(*) FILTER (a = label AND b = label) AS hits, round_even(2.0 * count(*) FILTER (a = label AND b = label) / (count(*) FILTER (a = label) + count(*) FILTER (b = label)), 6)::double AS f1 FROM l, x GROUP BY 1""")
def macro_f1(spark, d):
    x = t(spark, d, "labels").select("toxic", (1 - F.col("quality")).alias("guess"))
    return evaluation.class_scores(x, "toxic", "guess").withColumn("f1", F.bround("f1", 6))


@query("""WITH f AS (SELECT event_type, user_id, first(value ORDER BY event_id) AS a, last(value ORDER BY event_id) AS b FROM events GROUP BY ALL)
  SELECT event_type, count(*) AS users, count(*) FILTER (b > a) AS improved, count(*) FILTER (b = a) AS same, count(*) FILTER (b < a) AS regressed FROM f GROUP BY 1""")
def first_vs_last(spark, d):
    f = t(spark, d, "events").groupBy("event_type", "user_id").agg(F.min_by("value", "event_id").alias("a"), F.max_by("value", "event_id").alias("b"))
    return f.groupBy("event_type").agg(F.count("*").alias("users"), F.count_if(F.col("b") > F.col("a")).alias("improved"), F.count_if(F.col("b") == F.col("a")).alias("same"), F.count_if(F.col("b") < F.col("a")).alias("regressed"))


@query("SELECT a.p_brand AS a, b.p_brand AS b FROM (SELECT DISTINCT p_brand FROM part) a JOIN (SELECT DISTINCT p_brand FROM part) b ON a.p_brand < b.p_brand AND left(a.p_brand, 7) <> left(b.p_brand, 7)")
def cluster_pairs(spark, d):
    """Pairs of a catalogue's labels (brands) of different families; the catalogue is small by nature."""
    x = t(spark, d, "part").select("p_brand").distinct()
    a, b = x.select(F.col("p_brand").alias("a")), x.select(F.col("p_brand").alias("b"))
    return a.join(b, (F.col("a") < F.col("b")) & (F.substring("a", 1, 7) != F.substring("b", 1, 7)))


@query("SELECT props, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, props LIMIT 25")
def top_values(spark, d):
    return t(spark, d, "events").groupBy("props").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "props").limit(25)


@query("SELECT user_id, event_id, (value - p) / p AS change FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p > 0 AND abs((value - p) / p) > 0.1")
def relative_change(spark, d):
    p = F.lag("value").over(W.partitionBy("user_id").orderBy("event_id"))
    c = (F.col("value") - F.col("p")) / F.col("p")
    return t(spark, d, "events").withColumn("p", p).where(F.col("p") > 0).withColumn("c", c).where(F.abs("c") > 0.1).select("user_id", "event_id", F.col("c").alias("change"))


@query("SELECT conv_id, turn, string_agg(turn::varchar, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS bundle FROM conversations WHERE length(text) >= 20")
def forward_bundles(spark, d):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(0, 2)
    return t(spark, d, "conversations").where(F.length("text") >= 20).select("conv_id", "turn", F.array_join(F.collect_list(F.col("turn").cast("string")).over(w), ",").alias("bundle"))


@query("SELECT doc_id, left(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '_', 'g'), 24) AS slug, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('the', 'of', 'and', 'a', 'to', 'in')))) AS n_tokens FROM documents")
def slugs_and_tokens(spark, d):
    tokens = F.array_distinct(F.array_except(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)")), F.array(*map(F.lit, ("the", "of", "and", "a", "to", "in")))))
    return t(spark, d, "documents").select("doc_id", F.substring(F.regexp_replace(F.lower(F.concat_ws(" ", "source", "lang")), "[^a-z0-9]+", "_"), 1, 24).alias("slug"), F.size(tokens).cast("long").alias("n_tokens"))


@query("SELECT source, lang, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS labelled, grouping_id(source, lang) AS g FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())")
def manifest_counts(spark, d):
    labelled = t(spark, d, "labels").select("doc_id").distinct().withColumn("l", F.lit(1))
    x = t(spark, d, "documents").select("doc_id", "source", "lang").join(labelled, "doc_id", "left")
    return x.cube("source", "lang").agg(F.count("*").alias("n"), F.count("l").alias("labelled"), F.grouping_id().alias("g"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT e AS epoch, doc_id, row_number() OVER (PARTITION BY e ORDER BY sha1(e::varchar || '|' || doc_id::varchar)) AS rank FROM labels, (SELECT unnest([1, 2])::int AS e) QUALIFY rank <= 20")
def epoch_samples(spark, d):
    x = t(spark, d, "labels").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("epoch"))
    got = ranking.top_k(x, ["epoch"], [F.sha1(F.concat_ws("|", F.col("epoch").cast("string"), F.col("doc_id").cast("string")))], 20)
    return got.withColumn("rank", F.col("rank").cast("long"))


@query("SELECT page_id, CASE WHEN contains(html, 'title>') THEN trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) END AS title, starts_with(html, '{') OR length(html) - length(replace(html, ' ', '')) < 12 AS malformed FROM pages")
def page_fields(spark, d):
    words = F.length("html") - F.length(F.replace("html", F.lit(" "), F.lit("")))
    return t(spark, d, "pages").select("page_id", F.when(F.contains("html", F.lit("title>")), F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))).alias("title"), (F.startswith("html", F.lit("{")) | (words < 12)).alias("malformed"))


@query()
def kmeans_labels(spark, d):
    """The embeddings in ten clusters, the best of ten starts."""
    return vectors.kmeans(t(spark, d, "embeddings"), "embedding", 10, starts=10, seed=7).select("vec_id", "label", "cluster")
