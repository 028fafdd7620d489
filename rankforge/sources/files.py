"""JSON Lines, JSON, CSV and Parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, *, bad: str = "_corrupt") -> DataFrame:
    """Rows by schema; a line that cannot be read is kept whole in the bad column."""
    given = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    return spark.read.schema(T.StructType([*given, T.StructField(bad, T.StringType())])).option("columnNameOfCorruptRecord", bad).json(path)


def read_repaired_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_jsonl, after doubling backslashes that begin no JSON escape; what stays unreadable raises, naming file and line."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file")).where(F.trim("value") != "")
    fixed = F.regexp_replace("value", r'(?<!\\)((?:\\\\)*)\\(?!["\\/bfnrtu])', r"$1\\\\")
    strict = F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", schema)).when(F.try_parse_json(fixed).isNotNull(), F.from_json(fixed, schema))
    checked = lines.select(F.coalesce(strict, F.when(F.lit(True), F.raise_error(F.concat(F.lit("unreadable line in "), "file", F.lit(": "), "value"))).cast(read_type(spark, schema))).alias("r"))
    return checked.select("r.*")


def read_type(spark: SparkSession, schema: str) -> str:
    return f"struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in spark.createDataFrame([], schema).schema)}>"


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("ignoreNullFields", "true")
    (w.partitionBy(*by) if by else w).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def latex_rows(df: DataFrame, columns: list[str]):
    """A table's body as one LaTeX row a row."""
    return df.select(F.concat(F.concat_ws(" & ", *[F.col(c).cast("string") for c in columns]), F.lit(" \\\\")).alias("row"))
