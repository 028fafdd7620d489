"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity, train

    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, train(docs, table(spark, sf_dir, "labels")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages")).drop("candidates")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunk_fingerprints import with_next

    return with_next(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"), _tokenizer())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), _tokenizer())


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id, train

    docs = table(spark, sf_dir, "documents")
    return language_id(docs, train(docs))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data, train

    docs = table(spark, sf_dir, "documents")
    return personal_data(docs, train(docs))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine, shifted

    return mine(shifted(table(spark, sf_dir, "embeddings")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import mine

    return mine(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from . import hard_negatives, phrases, urls

    return {"op3_url_filter": urls.SQL, "op12_hard_negatives": hard_negatives.SQL, "op13_collocations": phrases.SQL}
