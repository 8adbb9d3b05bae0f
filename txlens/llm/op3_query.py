"""Token ids and decoded texts of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from txlens.llm import bpe
from txlens.llm.common import table

VOCABULARY = "word_bpe_49k.json"


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(documents, public_tokenizers.path(VOCABULARY), digest=True)
