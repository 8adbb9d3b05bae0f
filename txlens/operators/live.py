"""A run in operation beside what the offline evaluation expects of it: per hour and as a whole, with 95% intervals.

Intervals come from a bootstrap that needs no second look at the rows: every row has, for every replicate, a Poisson weight of
mean one, drawn by a hash of its id and the number of the replicate. All replicates of all hours are added up in one
aggregation, which is partial in the tasks; what meets is a row per hour, group and replicate. The same rows give the same
interval wherever they are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txlens.functions import bits
from txlens.functions.numbers import ratio

# Fixed values
BOOTSTRAP_SEED = 0x51AB1E5EED
#: Up to this many replicates have weights of their own.
MOST_REPLICATES = 1023
#: Of a million draws, how many are at most k; for k from 0.
POISSON_PPM = (367_879, 735_759, 919_699, 981_012, 996_340, 999_406, 999_917, 999_990, 999_999)

SHARES = {"realised_share": ("realised", "decisions"), "positive_share": ("positives", "decisions"), "targeted_share": ("value_targeted", "value_available")}
TOTALS = ("decisions", "value_targeted", "value_available")


def poisson_weight(ident: Column, replicate: Column) -> Column:
    """Weight of a row in a replicate: 0, 1, 2, ... with mean one; in replicate 0 every row counts once."""
    u = bits.mix_mod(BOOTSTRAP_SEED, ident.cast("bigint") * (MOST_REPLICATES + 1) + replicate, 1_000_000)
    drawn = sum(((u >= t).cast("int") for t in POISSON_PPM[1:]), (u >= POISSON_PPM[0]).cast("int"))
    return F.when(replicate == 0, 1).otherwise(drawn)


def live_metrics(rows: DataFrame, hours: float, replicates: int) -> DataFrame:
    """(hour, metric, replicate, value); hour is null for the run as a whole, whose totals are per hour of `hours`.

    `rows`: (tx_id, hour, sent, realised, positive, route_hit, profit, group), one per transaction of the window. Value
    is available in every positive, and targeted where a sent one has its route among those chosen. `mix:<group>` is the share
    of the sent in a group.
    """
    if not 0 <= replicates <= MOST_REPLICATES:
        raise ValueError(f"at most {MOST_REPLICATES} replicates")
    true = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    sent, pos = true("sent"), true("positive")
    profit = F.coalesce(F.col("profit"), F.lit(0)).cast("bigint")
    number = F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("replicate")
    x = rows.where(sent | pos).select("tx_id", "hour", F.when(sent, F.coalesce(F.col("group").cast("string"), F.lit(""))).alias("group"), sent.cast("int").alias("decisions"),
                                      (sent & true("realised")).cast("int").alias("realised"), (sent & pos).cast("int").alias("positives"),
                                      F.when(sent & pos & true("route_hit"), profit).otherwise(0).alias("value_targeted"), F.when(pos, profit).otherwise(0).alias("value_available"), number)
    sums = ["decisions", "realised", "positives", "value_targeted", "value_available"]
    x = x.withColumn("w", poisson_weight(F.col("tx_id"), F.col("replicate"))).where("w > 0")
    per_hour = x.groupBy("hour", "group", "replicate").agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in sums])
    both = per_hour.withColumn("hour", F.explode(F.array("hour", F.lit(None).cast(rows.schema["hour"].dataType))))
    by_group = both.groupBy("hour", "group", "replicate").agg(*[F.sum(c).alias(c) for c in sums])
    by_hour = by_group.groupBy("hour", "replicate").agg(*[F.sum(c).alias(c) for c in sums])
    # a replicate in which no row of an hour counts still says nothing was sent
    seen = by_group.where("replicate = 0")
    grid = seen.select("hour").distinct().select("hour", number)
    known = lambda df, keys: [F.col(f"g.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    zero = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(0)).alias(c)
    whole = grid.alias("g").join(by_hour.alias("s"), known(by_hour, ["hour", "replicate"]), "left").select("g.hour", "g.replicate", *[zero(c) for c in sums])
    per = F.when(F.col("hour").isNull(), F.lit(float(hours))).otherwise(F.lit(1.0))
    values = {**{c: F.col(c) / per for c in TOTALS}, **{k: ratio(a, b) for k, (a, b) in SHARES.items()}}
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()]))
    long = whole.select("hour", "replicate", cells.alias("c")).select("hour", "c.metric", "replicate", "c.value")
    mixed = seen.where("decisions > 0").select("hour", "group", number)
    part = mixed.alias("g").join(by_group.alias("s"), known(by_group, ["hour", "group", "replicate"]), "left").select("g.hour", "g.group", "g.replicate", zero("decisions"))
    part = part.alias("p").join(whole.alias("t"), F.col("p.hour").eqNullSafe(F.col("t.hour")) & (F.col("p.replicate") == F.col("t.replicate")))
    share = F.when(F.col("t.decisions") > 0, F.col("p.decisions") / F.col("t.decisions"))
    mix = part.select("p.hour", F.concat(F.lit("mix:"), F.col("p.group")).alias("metric"), "p.replicate", share.alias("value"))
    return long.unionByName(mix)


def live_report(rows: DataFrame, expected: DataFrame, hours: float, replicates: int = 200) -> DataFrame:
    """hour, metric, live, lo, hi, expected, inside: `expected` is (metric, expected); a metric it lacks has null there."""
    m = live_metrics(rows, hours, replicates)
    drawn = F.when(F.col("replicate") > 0, F.col("value"))
    g = m.groupBy("hour", "metric").agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("live"), F.percentile(drawn, 0.025).alias("lo"), F.percentile(drawn, 0.975).alias("hi"))
    return g.join(expected.select("metric", "expected"), "metric", "left").select("hour", "metric", "live", "lo", "hi", "expected", F.col("expected").between(F.col("lo"), F.col("hi")).alias("inside"))


def largest_misses(tx: DataFrame, threshold: float, sends: int, most: int = 50, routes_per_send: int = 3) -> DataFrame:
    """The most valuable positives that were not decided with the right route, each with the first cause that applies.

    `tx`: (tx_id, positive, profit, has_candidate, encoded, score, hit_rank). A null score or rank is a miss.
    """
    hit = (F.col("score") >= threshold) & (F.col("hit_rank") < routes_per_send * sends)
    cause = (F.when(~F.coalesce("has_candidate", F.lit(False)), "no_candidate").when(~F.coalesce("encoded", F.lit(False)), "not_encoded")
             .when(F.coalesce(F.col("score") < threshold, F.lit(True)), "below_threshold").otherwise("route_miss"))
    missed = tx.where(F.col("positive") & ~F.coalesce(hit, F.lit(False)))
    return missed.select("tx_id", F.col("profit").alias("best_profit"), cause.alias("cause")).orderBy(F.desc("best_profit"), "tx_id").limit(most)


def outcome_report(decisions: DataFrame, outcomes: DataFrame, later: DataFrame) -> DataFrame:
    """Decided (tx_id, pool) rows: how many landed, still had an edge, were taken by someone later, or in the same slot.

    `outcomes`: (tx_id, landed, edge_exists); `later`: (tx_id, pool, later_tx, same_slot), as from `later_arbs`.
    """
    j = decisions.select("tx_id", "pool").join(outcomes, "tx_id", "left").join(later.select("tx_id", "pool", "later_tx", "same_slot"), ["tx_id", "pool"], "left")
    flag = lambda c: F.coalesce(F.sum(F.col(c).cast("boolean").cast("bigint")), F.lit(0)).alias
    return j.agg(F.count(F.lit(1)).alias("n"), flag("landed")("landed"), flag("edge_exists")("edge_exists"), F.count("later_tx").alias("later_arb"), flag("same_slot")("same_slot_arb"))
