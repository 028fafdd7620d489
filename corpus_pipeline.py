"""The corpus pipeline: language ID, toxicity, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept; all but the last return
the columns of documents. Language ID rejects texts without a language (null, no letters), however mixed the
others are, and goes by letters alone where no language could be learned; toxicity rejects scores of 0.5 or more; near copies are linked at a Jaccard
similarity of 0.8 or more of their five-word shingles (op6's SimHash contract is tighter and holds for op6 alone), and
one row of each component stays, that of the smallest id; documents with a benchmark item go; the rest is packed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankforge.llm import decontaminate, language_id, near_copies, packing, toxicity
from rankforge.llm.common import fresh, materialize, table
from rankforge.llm.queries import _tokenizer


def identify_language(spark, docs, sf_dir):
    """Keeps texts that have a language; null texts and those without a letter go, repeated rows are judged each."""
    model = language_id.train(docs)
    if not model.langs:  # no language could be learned: letters decide
        return docs.where(F.col("text").rlike("\\p{L}"))
    found = fresh(docs.columns, "found")
    return docs.withColumn(found, language_id.predictor(docs, model)(F.col("text"))).where(F.col(found)["lang"] != "und").drop(found)


def filter_toxicity(spark, docs, sf_dir):
    """Keeps scores under 0.5; null and empty texts have the score of no words, and without labels all score 0."""
    model, score = toxicity.train(docs, table(spark, sf_dir, "labels")), fresh(docs.columns, "score")
    return docs.withColumn(score, toxicity.scorer(docs, model)(F.col("text"))).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark, docs, sf_dir):
    """Keeps one row of each component of near copies, that of the smallest id (ties by place in the files, rows without an id last)."""
    return near_copies.keep_one(docs)


def remove_benchmark(spark, docs, sf_dir):
    """Keeps texts in which no benchmark item is found, items without an id included; null texts hold none."""
    hits = fresh(docs.columns, "hits")
    return decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"), hits).where(F.size(hits) == 0).drop(hits)


def pack_sequences(spark, docs, sf_dir):
    """All documents' tokens in sequences, a row a piece; null and empty texts are one piece, the end id."""
    return packing.pack(docs, _tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("toxicity", filter_toxicity),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("best_fit_packing", pack_sequences),
]
#: The models, edit distances and tokens cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
