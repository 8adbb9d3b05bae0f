"""Models of transactions: what is fitted, the value a decision may expect of them, and when a model is taken into use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txlens.operators import boosting as B
from txlens.operators.boosting import Model, Settings

# Fixed values
COMPACT_VALUE, COMPACT_FAILURES = 0.90, 0.97


def fit_classifier(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, kinds: Mapping[str, str] | None = None, settings: Settings | None = None,
                   folder: str | None = None) -> Model:
    """Boosted classifier of the train rows, stopped on the average precision of the val rows."""
    return B.fit(df, features, label, "classifier", weight, kinds, settings=settings, folder=folder)


def fit_regressor(df: DataFrame, features: Sequence[str], label: str, kinds: Mapping[str, str] | None = None, settings: Settings | None = None, folder: str | None = None) -> Model:
    """Boosted regression of the train rows, stopped on the squared error of the val rows."""
    return B.fit(df, features, label, "regressor", None, kinds, settings=settings, folder=folder)


def score(model: Model, df: DataFrame, name: str) -> DataFrame:
    return B.score(model, df, name)


def importance(model: Model, spark: SparkSession) -> DataFrame:
    """Share of all gains per input, largest first."""
    return spark.createDataFrame(B.importance(model), "feature string, gain double").orderBy(F.desc("gain"), "feature")


def save_model(model: Model, spark: SparkSession, path: str) -> None:
    B.save(model, spark, path)


def load_model(spark: SparkSession, path: str, features: Sequence[str]) -> Model:
    """Refuses a model whose feature order is not the expected one."""
    return B.load(spark, path, features)


def ev_size(p: str, size: str) -> Column:
    """Probability of a positive times the profit that the size model expects of one."""
    return F.col(p) * F.exp(F.col(size))


def ev_landing(p: str, size: str, landed: str) -> Column:
    """The same, for a send that lands with this probability."""
    return F.col(landed) * ev_size(p, size)


def ev_score(p: str, size: str, landed: str | None = None, has_candidate: str = "has_candidate", encoded: Column | None = None) -> Column:
    """What a threshold applies to: the expected value, minus infinity without a candidate or when not encoded."""
    value = ev_size(p, size) if landed is None else ev_landing(p, size, landed)
    sendable = F.col(has_candidate) & (F.col("encode_status") == 0 if encoded is None else encoded)
    return F.when(F.coalesce(sendable, F.lit(False)), F.coalesce(value, F.lit(float("-inf")))).otherwise(F.lit(float("-inf")))


def accept_ranker(learned_top1: float | None, static_top1: float | None) -> bool:
    """Whether to order pairs by the model: on validation it must put a right pack first more often than the catalog does."""
    return (learned_top1 or 0.0) > (static_top1 or 0.0)


def accept_compact(full_value: float, compact_value: float, least: float = COMPACT_VALUE) -> bool:
    """Whether a smaller model keeps enough of the value captured by the full one."""
    return compact_value >= least * full_value


def accept_compact_gate(full_removed: float, compact_removed: float, least: float = COMPACT_FAILURES) -> bool:
    """Whether a smaller landing model keeps enough of the failures that the full one removes."""
    return compact_removed >= least * full_removed
