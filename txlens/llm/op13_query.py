"""Near copies among all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txlens.llm import embedding_copies
from txlens.llm.common import table


def op13_embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_copies.near_copies(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
