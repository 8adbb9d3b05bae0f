"""Learned keys and versioned decisions: repeated batches, expiry, and a version that changes between batches."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from txlens.operators import boosting as B
from txlens.streaming import decisions as D
from txlens.streaming import learned as LE
from txlens.streaming import run


def add_file(df, folder, name):
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}.parquet")


def timed(stream):
    return stream.withColumn("ts", F.timestamp_seconds("t"))


def test_learned_keys(spark, tmp_path):
    folder, kw = str(tmp_path / "in"), {"checkpoint": str(tmp_path / "ckpt"), "out": str(tmp_path / "out")}
    schema = "k long, seq long, t long"

    def go_on():
        log = LE.first_seen(timed(run.read_table(spark, folder, "rows", 1)), "k", "seq", "10 seconds", 100)
        return run.drain_by_batch(log, "keys", **kw)

    add_file(spark.createDataFrame([(1, 50, 100), (1, 40, 101), (2, 7, 100), (None, 1, 100)], schema), folder, "rows")
    log = go_on()
    assert {(r.k, r.first_seq, r.corrected) for r in log.collect()} == {(1, 40, False), (2, 7, False)}
    # a smaller number later, a larger one, a new key
    add_file(spark.createDataFrame([(1, 30, 105), (2, 9, 105), (3, 1, 106)], schema), folder, "rows")
    log = go_on()
    assert {(r.k, r.first_seq, r.corrected) for r in log.collect()} == {(1, 40, False), (2, 7, False), (1, 30, True), (3, 1, False)}
    assert {r.k: r.first_seq for r in LE.learned(log, "k").collect()} == {1: 30, 2: 7, 3: 1}
    # the last batch is taken back and runs again: same log
    last = max(r.batch for r in log.select("batch").distinct().collect())
    before = sorted(map(tuple, log.collect()))
    for kind in ("commits",):
        number = max(int(p.name) for p in (tmp_path / "ckpt" / kind).iterdir() if p.name.isdigit())
        (tmp_path / "ckpt" / kind / str(number)).unlink()
        (tmp_path / "ckpt" / kind / f".{number}.crc").unlink(missing_ok=True)
    assert sorted(map(tuple, go_on().collect())) == before and last >= 1
    # long after, the keys are forgotten and learned anew
    add_file(spark.createDataFrame([(9, 1, 10_000)], schema), folder, "rows")
    go_on()
    assert {r.k for r in run.state_rows(spark, kw["checkpoint"], "first").select("key.k").collect()} == {9}
    add_file(spark.createDataFrame([(1, 35, 10_001)], schema), folder, "rows")
    assert (1, 35, False) in {(r.k, r.first_seq, r.corrected) for r in go_on().collect()}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    rows = [(int(i), float(a), float(b), [int(p) for p in rng.choice(30, rng.integers(0, 4), replace=False)] if i % 17 else None) for i, (a, b) in enumerate(rng.normal(size=(900, 2)))]
    tx = spark.createDataFrame(rows, "tx_id long, a double, b double, pools array<long>").cache()
    fit = tx.withColumn("y", (F.col("a") > 0.3).cast("int")).withColumn("v", F.col("b") * 2 + 10).withColumn("split", F.when(F.col("tx_id") % 3 == 0, "val").otherwise("train"))
    s = B.Settings(rounds=50)
    arb = [B.fit(fit.where(w), ["a", "b"], "y", settings=s) for w in ("true", "tx_id % 2 = 0")]
    size = B.fit(fit, ["b"], "v", task="regressor", settings=s)
    routes = spark.createDataFrame([(p, f"r{p * j % 41}", 100 - j) for p in range(25) for j in range(1, 8)], "pool long, route string, support long")
    return tx, arb, size, routes


def test_a_version_changes_between_batches(spark, parts, tmp_path):
    tx, arb, size, routes = parts
    root, folder = str(tmp_path / "bundles"), str(tmp_path / "in")
    where = {"checkpoint": str(tmp_path / "ckpt"), "out": str(tmp_path / "out")}
    stream = lambda: run.read_table(spark, folder, "tx", 1)
    log = lambda: D.drain(stream(), root, ["a", "b"], size_features=["b"], **where)
    D.publish(spark, root, D.Policy(1, arb[0], size, routes, 2000.0, 2))
    add_file(tx.where("tx_id < 300"), folder, "tx")
    log()
    D.publish(spark, root, D.Policy(2, arb[1], size, routes.where("pool < 10"), 1000.0, 1))
    with pytest.raises(ValueError):
        D.publish(spark, root, D.Policy(2, arb[1], size, routes, 1.0, 1))
    add_file(tx.where("tx_id >= 300 AND tx_id < 600"), folder, "tx")
    got = log()
    by = {v: got.where(F.col("version") == v).drop("batch") for v in (1, 2)}
    for v, rows in ((1, tx.where("tx_id < 300")), (2, tx.where("tx_id >= 300 AND tx_id < 600"))):
        again = D.decide(rows, D.load(spark, root, v, ["a", "b"], ["b"]))
        assert again.count() > 20 and by[v].exceptAll(again).count() == 0 and again.exceptAll(by[v]).count() == 0
    assert {(r.threshold, r.sends) for r in by[2].select("threshold", "sends").distinct().collect()} == {(1000.0, 1)}
    sent = by[2].where("sent").collect()
    assert sent and all(0 < len(r.routes) <= 3 and r.n_candidates >= len(r.routes) and r.ev >= 1000 for r in sent)
    # a batch that runs again after a newer version is out keeps the version it noted
    D.publish(spark, root, D.Policy(3, arb[0], size, routes, 0.0, 1))
    before = sorted(map(str, got.collect()))
    number = max(int(p.name) for p in (tmp_path / "ckpt" / "commits").iterdir() if p.name.isdigit())
    (tmp_path / "ckpt" / "commits" / str(number)).unlink()
    (tmp_path / "ckpt" / "commits" / f".{number}.crc").unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "out" / f"batch={number}")
    assert sorted(map(str, log().collect())) == before


def test_models_of_another_order_are_refused(spark, parts, tmp_path):
    tx, arb, size, routes = parts
    D.publish(spark, str(tmp_path), D.Policy(1, arb[0], size, routes, 1.0, 1))
    with pytest.raises(ValueError):
        D.load(spark, str(tmp_path), 1, ["b", "a"], ["b"])
    assert D.versions(spark, str(tmp_path / "none")) == {}
