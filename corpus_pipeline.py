"""From raw documents to packed training sequences: four stages, each written and read again.

Every stage but the last returns the columns of ``documents``. Null and empty texts go in the
first stage, as they have no language; repeated rows in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluicework.llm import findings, langid, packing, simhash
from sluicework.session import scratch_path

LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose best language has a mean probability below ``LEAST_SCORE``, go."""
    return langid.keep_identified(docs, langid.train(docs), LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints of 3-word shingles are linked over 2 or fewer differing bits stays, the one with the smallest id."""
    return simhash.deduplicate(docs, words=3, radius=2)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes a mark; all documents stay."""
    return findings.redact(docs, findings.train(docs), size_col="n_chars")


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of every document with bucket, batch and slot."""
    return packing.pack(docs.select("doc_id", packing.word_tokens().alias("n_tokens")), "n_tokens")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("length_buckets", length_buckets)]

# Languages and secrets are judged by networks, which SQL cannot express; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what one stage returns is stored and is the next one's input."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
