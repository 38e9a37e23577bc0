"""Documents to token ids in five stages, each on all that the one before it kept.

Quality classifier, SimHash near-dedup, substring dedup, mixing to target weights, byte-level BPE.
Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. SQL cannot express the stages' hashes and model, so ORACLE_SQL is None.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfmark import session
from shelfmark.llm import bpe, mixing, quality, repeats, simhash

MIX_WEIGHTS = [3, 1, 2]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of good quality is a half or more."""
    session.tune(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality.good(docs, quality.train(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, on five-word shingles."""
    session.tune(spark)
    return simhash.representatives(docs, shingle=5, max_bits=simhash.NEAR_BITS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more that occur earlier are cut."""
    session.tune(spark)
    return repeats.cut_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares; a document that the mix takes twice has two rows."""
    session.tune(spark)
    return mixing.mixed_documents(docs, MIX_WEIGHTS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and n_tokens of every row."""
    session.tune(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.encode(docs, ranks, pattern, keep=("doc_id", "source")).selectExpr("*", "size(ids) AS n_tokens")


STAGES = [("quality", good_documents), ("near_dedup", one_of_each), ("substring_dedup", without_repeats),
          ("mix", mixed), ("encode", encoded)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = session.work_path(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
