"""Toxicity scores of all documents; one fifth of the ids is never learned from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txlens.llm import toxicity
from txlens.llm.common import crc_of_id, table


def model(spark: SparkSession, sf_dir: str, documents: DataFrame) -> toxicity.Model:
    return toxicity.learn(documents.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"), crc_of_id(F.col("id")) % 5 != 0)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(documents, model(spark, sf_dir, documents))
    return scored.select("doc_id", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")
