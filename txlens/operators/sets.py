"""Unions where the first source wins, and bounded choices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def first_wins(parts: Sequence[DataFrame], key: str, needed: Sequence[str] = (), prio: str = "prio") -> DataFrame:
    """One row per key from the first part that has it, with the number of that part; columns are those all parts have.

    Rows without a key, or with a null in a needed column, are left out before. Two rows of a key in one part: the
    smaller one by its other columns. Rows meet by key after each task has kept its first.
    """
    shared = [c for c in parts[0].columns if c != key and all(c in p.columns for p in parts[1:])]
    rest = reduce(DataFrame.unionByName, [p.select(key, *shared, F.lit(i).alias(prio)) for i, p in enumerate(parts)])
    whole = rest.where(F.col(key).isNotNull() & reduce(lambda a, c: a & F.col(c).isNotNull(), needed, F.lit(True)))
    best = whole.groupBy(key).agg(F.min(F.struct(prio, *shared)).alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in shared], F.col("_r")[prio].alias(prio))


def universe_union(existing: DataFrame, required: DataFrame, discovered: DataFrame, key: str = "pool", cap: int | None = None) -> DataFrame:
    """Pools in force, required and discovered: the first source wins, none is pruned; beyond `cap` the later sources wait.

    With a cap, pools are taken in the order of sources and then of keys, and `deferred` marks the rest.
    """
    u = first_wins([existing, required, discovered], key)
    if cap is None:
        return u.withColumn("deferred", F.lit(False))
    # the cap is the feature: at most `cap` rows leave each task
    kept = u.orderBy("prio", key).limit(cap).select(key, F.lit(True).alias("_k"))
    return u.join(kept, key, "left").withColumn("deferred", F.col("_k").isNull()).drop("_k")


def case_union(sources: Sequence[DataFrame], needed: Sequence[str], key: str = "sig") -> DataFrame:
    """Cases of several sources, incomplete ones dropped, the first source of a signature wins; `source` is its number."""
    return first_wins(sources, key, needed, "source")


def keep_scored(df: DataFrame, frequency: str, bonus: Column, n: int, key: str = "pool") -> DataFrame:
    """The n best rows by frequency plus bonus; a missing frequency is 0, ties go to the smaller key."""
    scored = df.withColumn("score", F.coalesce(F.col(frequency), F.lit(0)) + bonus)
    return scored.orderBy(F.desc("score"), key).limit(n)


def best_per_key(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows per key in an order, with their rank from 0; the bare rank is filtered, so tasks send at most n rows per key."""
    r = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("_r", r).where(F.col("_r") <= n).withColumn(rank, F.col("_r") - 1).drop("_r")
