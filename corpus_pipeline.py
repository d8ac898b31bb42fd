"""A training corpus from raw documents: quality, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All stages but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import bpe, mixing, quality, secrets, simhash
from kgspark.llm.common import table
from kgspark.llm.queries import vocabulary
from kgspark.session import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under trusted text is beyond their language's quantile go.

    Null and empty texts go; without trusted labels all rows stay; repeated rows share their fate; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words and a similarity of 0.8 or more, stays: that of the smallest id.

    Rows without an id stay; null and empty texts are copies of each other; of rows repeated under one id one stays; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced within their documents; every row stays, null texts as null; an empty table stays empty."""
    return secrets.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mixture takes it.

    Null texts have size 0, null sources are a source of their own; rows of one id and text are taken or left together; an empty table stays empty.
    """
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of texts, each decoded again to prove that nothing was lost.

    One row for each row; null and empty texts have no ids; an empty table gives no rows.
    """
    return bpe.encode_checked(docs, vocabulary())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_dedup", simhash_dedup),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
    ("bpe_encoding", bpe_encoding),
]

#: None: no SQL for perplexities, fingerprints and token ids; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
