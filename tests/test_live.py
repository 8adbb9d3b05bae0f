import numpy as np
import pytest
from pyspark.sql import functions as F

from txlens.operators import live as LV

SCHEMA = "tx_id long, hour int, sent boolean, realised boolean, positive boolean, route_hit boolean, profit long, group string"


def run_rows(n):
    rng = np.random.default_rng(4)
    return [(i, int(rng.integers(0, 4)), bool(rng.random() < 0.5), bool(rng.random() < 0.4), bool(rng.random() < 0.3), bool(rng.random() < 0.8), int(rng.integers(1, 1000)), str(rng.choice(["P", "N"])))
            for i in range(n)]


def test_weights_are_poisson_of_mean_one(spark):
    w = spark.range(20_000).select(F.col("id"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("r")).withColumn("w", LV.poisson_weight(F.col("id"), F.col("r")))
    m = w.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v"), F.avg((F.col("w") == 0).cast("int")).alias("none")).first()
    assert m.m == pytest.approx(1, abs=0.01) and m.v == pytest.approx(1, abs=0.02) and m.none == pytest.approx(np.exp(-1), abs=0.005)
    # replicates and rows are not drawn together
    p = w.groupBy("id").pivot("r", [1, 2]).agg(F.first("w")).select(F.corr("1", "2")).first()[0]
    assert abs(p) < 0.03


def test_report(spark):
    rows = run_rows(2000)
    df = spark.createDataFrame(rows, SCHEMA)
    expected = spark.createDataFrame([("decisions", 250.0), ("positive_share", 0.9)], "metric string, expected double")
    got = {(r.hour, r.metric): r for r in LV.live_report(df, expected, 4.0).collect()}
    sent = [r for r in rows if r[2]]
    assert got[None, "decisions"].live == len(sent) / 4 and got[2, "decisions"].live == sum(r[1] == 2 for r in sent)
    assert got[None, "realised_share"].live == pytest.approx(np.mean([r[3] for r in sent]))
    assert got[None, "value_available"].live == sum(r[6] for r in rows if r[4]) / 4
    assert got[None, "targeted_share"].live == pytest.approx(sum(r[6] for r in sent if r[4] and r[5]) / sum(r[6] for r in rows if r[4]))
    assert got[1, "mix:P"].live == pytest.approx(np.mean([r[7] == "P" for r in sent if r[1] == 1]))
    share = got[None, "positive_share"]
    # the width is that of a share of so many rows
    width = 2 * 1.96 * np.sqrt(share.live * (1 - share.live) / len(sent))
    assert share.lo < share.live < share.hi and share.hi - share.lo == pytest.approx(width, rel=0.25)
    assert got[None, "decisions"].inside and not share.inside and got[None, "realised_share"].expected is None


def test_rows_in_other_partitions_give_the_same_interval(spark):
    df = spark.createDataFrame(run_rows(300), SCHEMA)
    none = spark.createDataFrame([], "metric string, expected double")
    key = lambda rows: sorted(map(str, rows))
    assert key(LV.live_report(df.repartition(7), none, 1.0, 50).collect()) == key(LV.live_report(df.coalesce(1), none, 1.0, 50).collect())


def test_odd_rows(spark):
    none = spark.createDataFrame([], "metric string, expected double")
    df = spark.createDataFrame([(1, 0, None, None, None, None, None, None), (2, 0, True, None, None, None, None, None), (3, 1, False, True, True, True, None, "P")], SCHEMA)
    got = {(r.hour, r.metric): r.live for r in LV.live_report(df, none, 2.0, 5).collect()}
    assert got[0, "decisions"] == 1 and got[1, "decisions"] == 0 and got[None, "decisions"] == 0.5 and got[0, "mix:"] == 1
    assert got[1, "realised_share"] is None and got[1, "value_available"] == 0
    assert LV.live_report(df.limit(0), none, 2.0, 5).collect() == []


def test_largest_misses_and_outcomes(spark):
    tx = spark.createDataFrame([(1, True, 9, True, True, 5.0, 0), (2, True, 8, True, True, 5.0, 7), (3, True, 7, False, True, 5.0, None), (4, True, 6, True, False, 5.0, 0), (5, True, 5, True, True, 1.0, 0),
                                (6, False, 99, True, True, 0.0, 0), (7, True, 5, None, None, None, None)], "tx_id long, positive boolean, profit long, has_candidate boolean, encoded boolean, score double, hit_rank int")
    found = [(r.tx_id, r.cause) for r in LV.largest_misses(tx, 2.0, 2).collect()]
    assert found == [(2, "route_miss"), (3, "no_candidate"), (5, "below_threshold"), (7, "no_candidate")]
    assert [x[0] for x in found[:2]] == [r.tx_id for r in LV.largest_misses(tx, 2.0, 2, most=2).collect()]
    dec = spark.createDataFrame([(1, 10), (2, 10), (3, 11)], "tx_id long, pool long")
    out = spark.createDataFrame([(1, 1, True), (2, 0, None)], "tx_id long, landed int, edge_exists boolean")
    later = spark.createDataFrame([(1, 10, 50, True), (2, 10, 51, False)], "tx_id long, pool long, later_tx long, same_slot boolean")
    assert tuple(LV.outcome_report(dec, out, later).first()) == (3, 1, 1, 2, 1)
