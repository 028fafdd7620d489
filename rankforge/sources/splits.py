"""Split files with a manifest, rows dealt by an earlier manifest, and result files of several runs in their order."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankforge.functions.text import hash_split


def _files(spark: SparkSession, path: str):
    """The file system that holds a path, and the path, by Hadoop: any store that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_splits(df: DataFrame, path: str, family: str, split: str, overwrite: bool = False) -> DataFrame:
    """JSON Lines by family and split under ``path``, and a manifest (family, split, rows) beside them, which is returned.

    All is written under a name of its own first and takes its place by one rename, so a reader sees the old folder, none or
    the whole new one. A folder that is there is kept unless ``overwrite``. Rows of all families of a split are read by
    the split's part of every family; nothing is written twice. An empty table gives a manifest without rows; a null
    family or split has a folder of Spark's own name for it.
    """
    spark = df.sparkSession
    fs, target = _files(spark, path)
    if fs.exists(target) and not overwrite:
        raise FileExistsError(f"{path} is there; overwrite was not asked for")
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    rows = df.withColumns({"family": F.col(family), "split": F.col(split)})
    rows.write.partitionBy("family", "split").json(f"{staged}/rows")
    schema = rows.select("family", "split").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    counts = spark.read.schema(schema).json(f"{staged}/rows").groupBy("family", "split").agg(F.count("*").alias("rows"))
    counts.coalesce(1).write.json(f"{staged}/manifest")  # a row a family and split
    _, new = _files(spark, staged)
    if fs.exists(target):
        _, old = _files(spark, f"{path}.old-{uuid.uuid4().hex}")
        if not (fs.rename(target, old) and fs.rename(new, target)):
            raise OSError(f"{path} could not be replaced")
        fs.delete(old, True)
    elif not fs.rename(new, target):
        raise OSError(f"{path} could not be put in place")
    return read_manifest(spark, path, schema)


def read_manifest(spark: SparkSession, path: str, schema: str = "family string, split string") -> DataFrame:
    return spark.read.schema(f"{schema}, rows long").json(f"{path}/manifest")


def read_splits(spark: SparkSession, path: str, schema: str, split: str | None = None) -> DataFrame:
    """The rows of all families, or those of one split alone (a pruned scan)."""
    rows = spark.read.schema(schema).json(f"{path}/rows")
    return rows if split is None else rows.where(F.col("split") == split)


def deal_by_manifest(records: DataFrame, sample: str, group: Column, samples: DataFrame, groups: DataFrame, train: float, validation: float) -> DataFrame:
    """The records with ``split`` and ``how``: by their sample, else by their group, else by the group's hash.

    ``samples`` (sample, split) and ``groups`` (g, split) are an earlier manifest, one row a key. A record without a
    sample id has neither group nor split: how is ``missing``.
    """
    x = records.withColumn("__g", group.cast("string"))
    x = x.join(samples.select(F.col("sample").alias(sample), F.col("split").alias("__s")), sample, "left")
    x = x.join(groups.select(F.col("g").cast("string").alias("__g"), F.col("split").alias("__t")), "__g", "left")
    none = F.col(sample).isNull() | (F.trim(F.col(sample).cast("string")) == "")
    how = F.when(none, "missing").when(F.col("__s").isNotNull(), "sample").when(F.col("__t").isNotNull(), "group").otherwise("hash")
    split = F.when(~none, F.coalesce("__s", "__t", hash_split(F.col("__g"), train, validation)))
    return x.withColumns({"how": how, "split": split}).drop("__g", "__s", "__t")


def file_report(dealt: DataFrame, file: Column) -> DataFrame:
    """file, total, written, missing, reused, hashed, and the rows of each split."""
    count = lambda c: F.count_if(c)
    kinds = [count(F.col("how") == k).alias(n) for k, n in (("missing", "missing"), ("group", "reused"), ("hash", "hashed"))]
    return dealt.groupBy(file.alias("file")).agg(F.count("*").alias("total"), F.count("split").alias("written"), *kinds, *[count(F.col("split") == s).alias(s) for s in ("train", "val", "test")])


def run_of(file: str, name: str) -> Column:
    """The folder above ``name``, be that a file or a folder of parts."""
    return F.regexp_extract(F.col(file), f"([^/]+)/{name.replace('.', '[.]')}(?:/|$)", 1)


def run_sources(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(run, created, place): the folders under ``path`` that hold ``name``, by their manifests' time, those without one last."""
    runs = spark.read.format("binaryFile").load(f"{path}/*/{name}").select(run_of("_metadata.file_path", name).alias("run")).distinct()
    fs, at = _files(spark, f"{path}/*/run_manifest.json")
    told = spark.createDataFrame([], "run string, created string")
    if fs.globStatus(at):
        texts = spark.read.text(f"{path}/*/run_manifest.json", wholetext=True)
        told = texts.select(run_of("_metadata.file_path", "run_manifest.json").alias("run"), F.nullif(F.get_json_object("value", "$.created_at_utc"), F.lit("")).alias("created"))
    from rankforge.operators.grouping import places

    return places(runs.join(told, "run", "left"), [F.col("created").isNull(), F.col("created"), F.col("run")])


def read_runs(spark: SparkSession, path: str, phase: str, schema: str) -> DataFrame:
    """The records of a phase of all runs: run, place, label, and the fields of ``schema`` (phase, label, step, epoch, index, sample_id at least).

    Lines of other phases, summaries, those without a sample id and, in the test phase, those without an index are left
    out; a missing label is told from the step, else from the epoch, else ``unlabeled``. A line that is no JSON raises,
    naming its file. One scan of the files, by Spark's own reader.
    """
    lines = spark.read.text(f"{path}/*/{phase}_results.jsonl").select("value", F.col("_metadata.file_path").alias("file"))
    blank, parsed = F.trim("value") == "", F.from_json("value", schema)
    kind = lines.select(parsed.alias("r")).schema["r"].dataType
    fault = F.raise_error(F.concat(F.lit("unreadable line in "), "file")).cast(kind)  # blank lines are told apart here: filters may change places
    strict = lines.select("file", F.when(blank, F.lit(None)).when(F.try_parse_json("value").isNotNull(), parsed).otherwise(fault).alias("r"))
    rows = strict.select(run_of("file", f"{phase}_results.jsonl").alias("run"), "r.*").where((F.col("phase") == phase) & (F.coalesce("sample_id", F.lit("")) != ""))
    rows = rows.where(F.col("index").isNotNull()) if phase == "test" else rows
    told = F.coalesce(F.nullif("label", F.lit("")), *([F.concat(F.lit("after "), "step", F.lit(" training samples")), F.concat(F.lit("epoch "), "epoch")] if phase == "train" else []), F.lit("unlabeled"))
    places_of = run_sources(spark, path, f"{phase}_results.jsonl").select("run", "place")
    return rows.withColumn("label", told).join(places_of, "run")


def last_runs(records: DataFrame, *keys: str) -> DataFrame:
    """Of each key's records those of the latest run that has some."""
    last = records.groupBy(*keys).agg(F.max("place").alias("place"))
    return records.join(last, [*keys, "place"], "left_semi")
