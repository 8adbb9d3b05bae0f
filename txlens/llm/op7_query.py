"""Languages of all documents; a quarter of the ids is never learned from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txlens.llm import language
from txlens.llm.common import crc_of_id, table


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(documents, crc_of_id(F.col("id")) % 4 != 2)
    return language.predict(documents, model).select("doc_id", (crc_of_id(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score")
