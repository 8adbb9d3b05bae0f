"""Streams over tables of several files, one file per micro-batch."""

import pytest
from pyspark.sql import functions as F

from txlens.operators import landing
from txlens.streaming import operators, run

SF = "/root/testdata/sf0.001"
LAG, HALF = 2, 60


@pytest.fixture(scope="module")
def attempts(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("tx_id"), F.col("o_custkey").alias("payer"), F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("bigint").alias("slot"),
                    F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("landed")).cache()


def written(df, folder, order):
    """Six files of a folder, later ones with later times of change."""
    import os
    import time
    parts = df.repartitionByRange(6, order).withColumn("p", F.spark_partition_id()).cache()
    target = f"{folder}/attempts.parquet"
    now = time.time()
    for i, p in enumerate(sorted(r.p for r in parts.select("p").distinct().collect())):
        parts.where(F.col("p") == p).drop("p").coalesce(1).write.mode("append").parquet(target)
        for name in os.listdir(target):
            if name.startswith("part-") and os.stat(f"{target}/{name}").st_mtime > now - 1000:
                os.utime(f"{target}/{name}", (now - 10_000 + i * 60,) * 2)
    return folder


def drained(spark, folder, **kw):
    return run.drain(operators.reputation(run.read_table(spark, folder, "attempts", 1), LAG, HALF, **kw), "rep").collect()


def test_reputation_in_order_equals_the_table(spark, attempts, tmp_path):
    found = drained(spark, written(attempts, str(tmp_path), "slot"))
    expected = {(r.payer, r.slot): (r.rep_landed, r.rep_failed, r.rep_seen) for r in landing.reputation_by_slot(attempts, lag=LAG, half_life=HALF).collect()}
    assert len(found) == attempts.count() and not any(r.late for r in found)
    assert all((r.rep_landed, r.rep_failed, r.rep_seen) == expected[r.payer, r.slot] for r in found)


def test_reputation_keeps_every_row_out_of_order(spark, attempts, tmp_path):
    folder = written(attempts, str(tmp_path), F.xxhash64("tx_id"))
    rows = drained(spark, folder, late_slots=100)
    assert sorted(r.tx_id for r in rows) == sorted(r.tx_id for r in attempts.select("tx_id").collect())
    assert any(r.late for r in rows) and all((r.rep_landed is None) == r.late == (r.rep_seen is None) for r in rows)
    assert not any(r.late for r in drained(spark, folder, late_slots=100_000))


def test_first_wins_over_files(spark, attempts, tmp_path):
    stream = run.read_table(spark, written(attempts, str(tmp_path), "tx_id"), "attempts", 1)
    timed = stream.withColumn("ts", F.timestamp_seconds(F.col("slot") + 1))
    assert run.drain(operators.first_wins(timed, ["payer"], "100000 seconds").drop("ts"), "wins").count() == attempts.select("payer").distinct().count()


def test_a_missing_table_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        run.read_table(spark, str(tmp_path), "nothing")


def test_reputation_over_thousands_of_half_lives(spark):
    rows = [(i, 1, s, ok) for i, (s, ok) in enumerate([(0, 1), (5, 0), (3000, 1), (3001, 1), (30_000, 0), (30_010, 1), (31_000, 1)])]
    df = spark.createDataFrame(rows, "tx_id long, payer long, slot long, landed int")
    got = {r.slot: (r.rep_landed, r.rep_failed, r.rep_seen) for r in landing.reputation_by_slot(df, lag=0, half_life=2).collect()}
    for _, _, slot, _ in rows:
        seen = [(s, ok) for _, _, s, ok in rows if s <= slot - 1]
        weigh = lambda s: 2.0 ** ((s // 2) - (slot // 2)) if (slot // 2) - (s // 2) < 1080 else 0.0
        assert got[slot] == (sum(weigh(s) for s, ok in seen if ok), sum(weigh(s) for s, ok in seen if not ok), int(bool(seen)))


def test_reputation_of_a_null_payer(spark):
    df = spark.createDataFrame([(1, None, 1, 1), (2, None, 9, 0)], "tx_id long, payer long, slot long, landed int")
    got = {r.tx_id: r.rep_seen for r in landing.with_reputation(df, lag=0, half_life=100).collect()}
    assert got == {1: 0, 2: 1}
