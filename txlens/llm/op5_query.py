"""Token counts of all documents under a unigram model."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from txlens.llm import token_counts
from txlens.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
