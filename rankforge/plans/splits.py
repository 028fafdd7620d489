"""Queries of split files, of manifests and of result files of several runs, written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.functions.text import hash_split
from rankforge.operators import grouping
from rankforge.plans.grouping import _fold
from rankforge.plans.registry import _FRACTION, query, t
from rankforge.sources import splits
from rankforge.sources.scratch import new_path

_HASHED = f"CASE WHEN {_FRACTION} < 0.8 THEN 'train' WHEN {_FRACTION} < 0.9 THEN 'val' ELSE 'test' END"


def _written(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text", "lang", hash_split(F.col("doc_id").cast("string"), 0.8, 0.1).alias("part"))
    path = new_path(spark, "splits")
    return path, splits.write_splits(docs, path, "lang", "part")


@query(f"SELECT lang AS family, {_HASHED} AS split, count(*) AS rows FROM documents GROUP BY ALL")
def split_manifest(spark, d):
    """The manifest of documents written by language and split."""
    return _written(spark, d)[1]


@query(f"SELECT doc_id, lang AS family, length(text) AS n FROM documents WHERE {_HASHED} = 'val'")
def split_rows_read(spark, d):
    """One split of all families, read again."""
    got = splits.read_splits(spark, _written(spark, d)[0], "doc_id long, text string, family string, split string", "val")
    return got.select("doc_id", "family", F.length("text").cast("long").alias("n"))


_DEALT = _fold("SELECT 'all' AS way, doc_id // 7 AS g, lang AS label FROM documents WHERE n_chars >= 900").replace("''::VARCHAR AS g", "0::BIGINT AS g")


@query(f"""WITH {_DEALT}, m AS (SELECT g, CASE s WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'test' END AS split FROM f WHERE k > 0), x AS (SELECT CASE WHEN lang = 'es' AND n_chars < 300 THEN NULL ELSE doc_id END AS doc, doc_id // 7 AS grp, n_chars, source FROM documents),
  y AS (SELECT source, CASE WHEN doc IS NULL THEN 'missing' WHEN n_chars >= 900 THEN 'sample' WHEN m.g IS NOT NULL THEN 'group' ELSE 'hash' END AS how, CASE WHEN doc IS NOT NULL THEN coalesce(m.split, {_HASHED.replace('doc_id', 'grp')}) END AS split FROM x LEFT JOIN m ON m.g = grp)
  SELECT source AS file, count(*) AS total, count(split) AS written, count(*) FILTER (how = 'missing') AS missing, count(*) FILTER (how = 'group') AS reused, count(*) FILTER (how = 'hash') AS hashed, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM y GROUP BY 1""")
def manifest_report(spark, d):
    """Documents dealt by the manifest of the longer ones: by their own entry, by their group's, or by hash; a report a source."""
    docs = t(spark, d, "documents").withColumn("g", F.floor(F.col("doc_id") / 7))
    anchors = docs.where("n_chars >= 900")
    groups = grouping.assign(anchors, "g", "lang", 0.8, 0.1).select("g", "split")
    samples = anchors.join(groups, "g").select(F.col("doc_id").alias("sample"), "split")
    records = docs.withColumn("doc_id", F.when(~((F.col("lang") == "es") & (F.col("n_chars") < 300)), F.col("doc_id")))
    return splits.file_report(splits.deal_by_manifest(records, "doc_id", F.col("g"), samples, groups, 0.8, 0.1), F.col("source"))


_RUNS = """r AS (SELECT 'run' || user_id % 4 AS run, CASE WHEN event_type = 'view' THEN 'test_summary' ELSE 'train' END AS phase, CASE WHEN value > 40 THEN 'L' || event_id % 3 END AS label, CASE WHEN event_type <> 'click' THEN event_id % 5 END AS step, event_id % 2 AS epoch, CASE WHEN event_type <> 'error' THEN 's' || user_id % 30 END AS sample_id, event_id, value FROM events),
  p AS (SELECT unnest(['run0', 'run1', 'run2', 'run3']) AS run, unnest([2, 0, 3, 1]) AS place),
  x AS (SELECT r.*, place, coalesce(label, 'after ' || step || ' training samples', 'epoch ' || epoch) AS told FROM r JOIN p USING (run) WHERE phase = 'train' AND sample_id IS NOT NULL)"""


@query(f"WITH {_RUNS}, l AS (SELECT sample_id, told, max(place) AS place FROM x GROUP BY ALL) SELECT x.run, x.told AS label, sample_id, event_id AS index, x.place::BIGINT AS place FROM x JOIN l USING (sample_id, told, place)")
def latest_results(spark, d):
    """Events as result files of four runs, one of them without a manifest: of each sample and label the latest run's records."""
    e, path = t(spark, d, "events"), new_path(spark, "runs")
    run = F.concat(F.lit("run"), F.col("user_id") % 4)
    record = F.struct(F.when(F.col("event_type") == "view", "test_summary").otherwise("train").alias("phase"), F.when(F.col("value") > 40, F.concat(F.lit("L"), F.col("event_id") % 3)).alias("label"), F.when(F.col("event_type") != "click", F.col("event_id") % 5).alias("step"), (F.col("event_id") % 2).alias("epoch"), F.when(F.col("event_type") != "error", F.concat(F.lit("s"), F.col("user_id") % 30)).alias("sample_id"), F.col("event_id").alias("index"))
    told = {"run0": "2024-03-01", "run1": "2024-01-01", "run3": "2024-02-01"}
    for name in ("run0", "run1", "run2", "run3"):  # the four runs' folders
        e.where(run == name).select(F.to_json(record).alias("value")).write.text(f"{path}/{name}/train_results.jsonl")
        if name in told:
            spark.range(1).select(F.lit(f'{{"created_at_utc": "{told[name]}"}}').alias("value")).write.text(f"{path}/{name}/run_manifest.json")
    found = splits.read_runs(spark, path, "train", "phase string, label string, step long, epoch long, sample_id string, index long")
    return splits.last_runs(found, "sample_id", "label").select("run", "label", "sample_id", "index", "place")
