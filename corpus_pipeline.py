"""Cleaning of the documents table for training, in five stages.

Each stage works on all that the one before kept, and its decisions take effect: toxic documents go, one document of
each group of near copies stays, repeated passages are cut out of later documents, documents that hold a benchmark
item go, and what is left is encoded and decoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txlens.llm import bpe, decontaminate, near_copies, op4_query, toxicity, word_spans
from txlens.llm.common import table
from txlens.session import materialise

VOCABULARY = "word_bpe_49k.json"


def _columns(documents: DataFrame) -> list:
    return [F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars")]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    return toxicity.without_toxic(docs.select(*_columns(docs)), op4_query.model(spark, sf_dir, docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash fingerprints that link."""
    return near_copies.keep_one_by_simhash(docs.select(*_columns(docs)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without windows of 13 words that start in an earlier one; those left without any word go."""
    return word_spans.cut_out(docs.select(*_columns(docs))).withColumn("n_chars", F.length("text").cast("long"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_matches(docs.select(*_columns(docs)), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of each document left."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

# Learned weights, SimHash bands and byte-pair merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
