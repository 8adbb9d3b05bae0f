"""Benchmark items in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txlens.llm import decontaminate
from txlens.llm.common import table


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
