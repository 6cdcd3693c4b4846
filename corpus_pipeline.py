"""The corpus pipeline: language ID, near duplicates, personal data, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trimlake.llm import bpe, langid, mixing, near_dups, pii
from trimlake.llm.common import fresh
from trimlake.session import shared_folder

#: Documents in a known language with at least this probability stay.
LEAST_SCORE = 0.34


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that may be learned from; those that it rejects (no letters, or no language likely) go."""
    model = langid.train(langid.learn_rows(docs))
    names = [fresh(docs, x) for x in ("lang_pred", "score")]
    judged = langid.predict(docs, model, *names)
    return judged.where((F.col(names[0]) != langid.UNKNOWN) & (F.col(names[1]) >= LEAST_SCORE)).drop(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least doc_id."""
    return near_dups.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kinds."""
    return pii.redact_table(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and decoded text of every document that is left."""
    return bpe.bpe_encode(docs)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing", source_mix),
    ("BPE", bpe_tokens),
]

#: SQL has no tokenizer, regression or alignment: a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_folder(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
