"""Train-fitted vocabularies and the model matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from txlens.functions.bits import unsigned_order

# Fixed values
MAX_VOCAB = 255
MIN_COUNT = 5


def fit_vocab(train: DataFrame, columns: Sequence[str], max_vocab: int = MAX_VOCAB, min_count: int = MIN_COUNT) -> DataFrame:
    """(feature, value, code): values seen at least `min_count` times, most frequent first, then by unsigned value.

    All hash columns are counted in one aggregation; the rank filter is applied per task before the shuffle.
    """
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("bigint").alias("value")) for c in columns])).alias("s")).select("s.*")
    n = long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    w = W.partitionBy("feature").orderBy(F.desc("n"), *unsigned_order(F.col("value")))
    ranked = n.withColumn("code", F.row_number().over(w)).where(F.col("code") <= max_vocab)  # the bare rank: Spark then limits groups before the shuffle
    return ranked.select("feature", "value", "n", (F.col("code") - 1).alias("code"))


def encode(df: DataFrame, kinds: Mapping[str, str], vocab: DataFrame) -> DataFrame:
    """Numeric and categorical columns as doubles, hash columns as vocabulary codes; an unseen hash is NaN.

    Each vocabulary has at most 255 rows, so it is broadcast.
    """
    out = df
    for c, kind in kinds.items():
        if kind == "hash":
            v = F.broadcast(vocab.where(F.col("feature") == c).select(F.col("value").alias("_v"), F.col("code").cast("double").alias("_c")))
            out = out.join(v, F.col(c).cast("bigint") == F.col("_v"), "left").withColumn(c, F.coalesce("_c", F.lit(float("nan")))).drop("_v", "_c")
        else:
            out = out.withColumn(c, F.col(c).cast("double"))
    return out


def save_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
