"""Settled reputation over shuffled files, split payers and expiring state."""

import os
import time

import pytest
from pyspark.sql import functions as F

from txlens.operators import landing
from txlens.streaming import reputation as R
from txlens.streaming import run

LAG, HALF = 2, 60
COLUMNS = ["payer", "slot", "rep_landed", "rep_failed", "rep_seen"]


@pytest.fixture(scope="module")
def attempts(spark):
    """Payer 0 holds a third of all rows; slots rise to about 2000."""
    k = F.col("id")
    payer = F.when(k % 3 == 0, 0).otherwise(1 + F.pmod(F.xxhash64(k), F.lit(40)))
    return spark.range(3000).select(k.alias("tx_id"), payer.cast("long").alias("payer"), F.floor(k * 2 / 3 + F.pmod(F.xxhash64(k, F.lit(1)), F.lit(30))).alias("slot"),
                                    (F.pmod(F.xxhash64(k, F.lit(2)), F.lit(5)) < 3).cast("int").alias("landed")).cache()


def folder_of(df, folder, files, order):
    now = time.time()
    rows = df.repartitionByRange(files, order).withColumn("p", F.spark_partition_id()).cache()
    target = f"{folder}/attempts.parquet"
    for i in range(files):
        rows.where(F.col("p") == i).drop("p").coalesce(1).write.mode("append").parquet(target)
        for name in os.listdir(target):
            if name.startswith("part-") and os.stat(f"{target}/{name}").st_mtime > now - 1000:
                os.utime(f"{target}/{name}", (now - 10_000 + i * 60,) * 2)
    return folder


def keyed(rows):
    return {(r.payer, r.slot): (r.rep_landed, r.rep_failed, r.rep_seen) for r in rows}


def table(attempts):
    return keyed(landing.reputation_by_slot(attempts, lag=LAG, half_life=HALF).select(COLUMNS).collect())


@pytest.mark.parametrize("parts", [1, 4])
def test_shuffled_files_give_the_table(spark, attempts, tmp_path, parts):
    """Files hold stretches of 300 slots in which rows are shuffled, and neighbours overlap by 30 slots."""
    folder = folder_of(attempts, str(tmp_path), 5, F.col("tx_id"))
    hot = spark.createDataFrame([(0, parts)], "payer long, parts int")
    stream = run.read_table(spark, folder, "attempts", 1)
    checkpoint = str(tmp_path / "ckpt")
    partial = R.settled(stream, LAG, HALF, delay=60, hot=hot, least=0.0)
    got = R.drain(partial, checkpoint=checkpoint)
    found, expected = keyed(got.select(COLUMNS).collect()), table(attempts)
    last = attempts.agg(F.max("slot")).first()[0]
    assert found == {k: v for k, v in expected.items() if k[1] <= last - 60 + LAG}
    assert got.count() == len(found)
    if parts > 1:
        kept = run.state_rows(spark, checkpoint, "old").select("key.payer", "key.part").where("payer = 0")
        assert sorted(r.part for r in kept.collect()) == list(range(parts))
    # maps hold slots of the delay and the lag only
    for name in ("recent", "asked"):
        kept = run.state_rows(spark, checkpoint, name).select(F.col("user_map_key.slot").alias("slot"))
        assert kept.agg(F.min("slot")).first()[0] >= last - 60 - LAG - 1


def test_small_entries_expire(spark, tmp_path):
    """A payer seen once is forgotten; one that comes back starts anew; others stay exact."""
    rows = [(i, 100 + i, i, 1) for i in range(50)] + [(1000 + i, 7, 10 * i, i % 2) for i in range(600)] + [(5000, 100, 5990, 1)]
    df = spark.createDataFrame(rows, "tx_id long, payer long, slot long, landed int")
    folder = folder_of(df, str(tmp_path), 4, F.col("slot"))
    checkpoint = str(tmp_path / "ckpt")
    found = keyed(R.drain(R.settled(run.read_table(spark, folder, "attempts", 1), LAG, HALF, delay=0), checkpoint=checkpoint).select(COLUMNS).collect())
    expected = table(df)
    # a hundred halvings do not fit the bits of a double, so the last one may differ
    differing = {k: expected[k] for k in found if found[k] != pytest.approx(expected[k], rel=1e-12)}
    assert set(differing) == {(100, 5990)} and sum(differing[100, 5990][:2]) < R.LEAST and found[100, 5990] == (0.0, 0.0, 0)
    assert {r.payer for r in run.state_rows(spark, checkpoint, "old").select("key.payer").collect()} <= {7, 100}


def test_a_stream_goes_on_after_a_stop(spark, attempts, tmp_path):
    """The second run reads the files that came since, with the state of the first."""
    early, late = attempts.where("tx_id < 1500"), attempts.where("tx_id >= 1500")
    folder = folder_of(early, str(tmp_path), 2, F.col("tx_id"))
    kw = {"checkpoint": str(tmp_path / "ckpt"), "out": str(tmp_path / "out")}
    settled = lambda: R.settled(run.read_table(spark, folder, "attempts", 1), LAG, HALF, delay=60, least=0.0)
    R.drain(settled(), **kw)
    late.coalesce(1).write.mode("append").parquet(f"{folder}/attempts.parquet")
    found = keyed(R.drain(settled(), **kw).select(COLUMNS).collect())
    last = attempts.agg(F.max("slot")).first()[0]
    assert found == {k: v for k, v in table(attempts).items() if k[1] <= last - 60 + LAG}
