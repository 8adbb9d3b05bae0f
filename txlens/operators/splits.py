"""Time-ordered splits, folds and windows over slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from txlens.functions import ordstat
from txlens.functions.numbers import beside, count_if

# Fixed values
FRACTIONS = (0.70, 0.15, 0.15)
FOLDS = 5
SPLITS = ("train", "val", "test")


def slot_boundaries(df: DataFrame, fractions=FRACTIONS, slot: str = "slot") -> dict:
    """Inclusive slot range of each split, cut over the sorted distinct slots (cut points rounded half to even)."""
    if abs(sum(fractions) - 1.0) > 1e-9:
        raise ValueError("fractions must sum to 1")
    r = ordstat.values_at_ranks(df, slot, [fractions[0], fractions[0] + fractions[1]], "round")
    if r.n is None or not 0 < r.k0 < r.k1 < r.n:
        raise ValueError(f"too few slots ({r.n}) to split")
    return {"train": (r["first"], r.before0), "val": (r.at0, r.before1), "test": (r.at1, r["last"]), "distinct_slots": r.n}


def bounds_frame(spark, b: dict) -> DataFrame:
    return spark.createDataFrame([(s, *b[s]) for s in SPLITS], "split string, lo bigint, hi bigint")


def assign_split(df: DataFrame, b: dict, slot: str = "slot") -> DataFrame:
    s = F.col(slot)
    return df.withColumn("split", F.when(s <= b["train"][1], "train").when(s <= b["val"][1], "val").otherwise("test"))


def landing_cuts(df: DataFrame, slot: str = "slot") -> tuple:
    r = ordstat.values_at_ranks(df, slot, [0.70, 0.85], "trunc")
    return r.at0, r.at1


def landing_split(df: DataFrame, cuts: tuple, slot: str = "slot") -> DataFrame:
    """Half-open cut at truncated positions of the distinct slots."""
    s = F.col(slot)
    return df.withColumn("split", F.when(s < cuts[0], "train").when(s < cuts[1], "val").otherwise("test"))


def fold_edges(df: DataFrame, k: int = FOLDS, slot: str = "slot") -> list[float]:
    return ordstat.quantile_list(df, slot, [i / k for i in range(1, k)])


def cut_bin(value, edges, name=None) -> Column:
    """Right-closed bins: a value on an edge falls in the lower bin."""
    c = F.col(value) if isinstance(value, str) else value
    b = ordstat.bucket_of(c, sorted(set(edges)))
    return b.alias(name) if name else b


def with_folds(df: DataFrame, edges, slot: str = "slot") -> DataFrame:
    return df.withColumn("fold", cut_bin(slot, edges))


def embargo_cut(train: DataFrame, share: float, slot: str = "slot") -> int:
    """Last slot kept when the final share of distinct train slots is dropped."""
    r = ordstat.values_at_ranks(train, slot, [1 - share], "trunc")
    return r.before0


def embargo(df: DataFrame, cut: int, slot: str = "slot") -> DataFrame:
    return df.where((F.col("split") != "train") | (F.col(slot) <= cut))


def split_problems(df: DataFrame, key: str = "tx_id", slot: str = "slot") -> DataFrame:
    """Ranges per split with an overlap flag, and the number of ids found in more than one split."""
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    ranges = df.groupBy("split").agg(F.min(slot).alias("lo"), F.max(slot).alias("hi"))
    w = W.orderBy(order)  # three rows
    ranges = ranges.withColumn("overlaps_previous", F.coalesce(F.lag("hi").over(w) >= F.col("lo"), F.lit(False)))
    shared = df.groupBy(key).agg((F.min("split") != F.max("split")).alias("m")).agg(count_if(F.col("m")).alias("ids_in_two_splits"))
    return beside(ranges, shared)


def check_disjoint(df: DataFrame, key: str = "tx_id", slot: str = "slot") -> None:
    bad = split_problems(df, key, slot).where(F.col("overlaps_previous") | (F.col("ids_in_two_splits") > 0)).limit(1).collect()
    if bad:
        raise AssertionError(f"splits are not disjoint: {bad[0]}")


def chain_hours() -> Column:
    """Hours between first and last block time; NaN with fewer than two times."""
    t = F.col("block_time")
    return F.when(F.count(t) < 2, F.lit(float("nan"))).otherwise((F.max(t) - F.min(t)) / F.lit(3600.0))


def split_table(df: DataFrame) -> DataFrame:
    rel, pos = F.col("relevant") == 1, F.col("target") == 1
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), count_if(rel).alias("relevant"), F.count("target").alias("labelled"),
        count_if(pos).alias("positives"), count_if(pos & rel).alias("relevant_positives"), chain_hours().alias("hours"))


def id_windows(masters: DataFrame, b: dict) -> DataFrame:
    """Each split's slot window with its id window, and whether the next one starts after it ends."""
    m = assign_split(masters, b)
    per = m.groupBy("split").agg(F.min("slot").alias("slot_lo"), F.max("slot").alias("slot_hi"),
                                 F.min("tx_id").alias("id_lo"), F.max("tx_id").alias("id_hi"), F.count(F.lit(1)).alias("n"))
    w = W.orderBy("slot_lo")  # three rows
    return per.withColumn("ids_overlap", F.coalesce(F.lag("id_hi").over(w) >= F.col("id_lo"), F.lit(False)))


def slots_going_back(masters: DataFrame, part: str) -> DataFrame:
    """Per partition: number of ids whose slot is below the slot of the id before."""
    back = ordstat.with_previous(masters, [part], "tx_id", ["slot"])
    return back.groupBy(part).agg(count_if(F.col("slot") < F.col("prev_slot")).alias("backward_steps"), F.count(F.lit(1)).alias("n"))
