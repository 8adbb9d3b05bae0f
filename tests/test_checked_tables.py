import glob
import os

import pytest
from pyspark.sql import functions as F

from txlens.operators import audit as A
from txlens.operators import pools as PO
from txlens.sources import kept as KP
from txlens.sources import tables as TB


def table(spark, n=500, step=1):
    return spark.range(0, n * step, step).select(F.col("id").alias("tx_id"), (F.col("id") % 7).alias("v"))


def shuffles_and_scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange"), plan.count("FileScan")


def test_manifest_says_what_was_written(spark, tmp_path):
    m = TB.write_checked(table(spark), f"{tmp_path}/t", "tx_id", {"from": "x"})
    assert (m["rows"], m["repeated"], m["low"], m["high"], m["without_id"], m["inputs"]) == (500, 0, 0, 499, 0, {"from": "x"})
    df, known = TB.checked(spark, f"{tmp_path}/t", whole=True)
    assert known == m and df.count() == 500
    twice = TB.write_checked(table(spark).unionByName(table(spark, 3)), f"{tmp_path}/u", "tx_id")
    assert twice["repeated"] == 3
    empty = TB.write_checked(table(spark).limit(0), f"{tmp_path}/e", "tx_id")
    assert empty["rows"] == 0 and TB.checked(spark, f"{tmp_path}/e", whole=True)[0].count() == 0
    assert TB.checked(spark, f"{tmp_path}/t")[1]["digest"] != twice["digest"]


def test_a_damaged_part_is_refused(spark, tmp_path):
    for name in ("gone", "cut", "new", "changed"):
        TB.write_checked(table(spark).repartition(3), f"{tmp_path}/{name}")
    part = lambda name: sorted(glob.glob(f"{tmp_path}/{name}/part-*.parquet"))[0]
    os.remove(part("gone"))
    with open(part("cut"), "r+b") as f:
        f.truncate(20)
    table(spark, 5).coalesce(1).write.mode("append").parquet(f"{tmp_path}/new")
    for name in ("gone", "cut", "new"):
        with pytest.raises(ValueError, match="files"):
            TB.checked(spark, f"{tmp_path}/{name}")
    # another table of the same layout under the old manifest
    TB.write_checked(table(spark).withColumn("v", F.col("v") + 1), f"{tmp_path}/other")
    df, known = TB.checked(spark, f"{tmp_path}/changed")
    now = TB._files(spark, f"{tmp_path}/other")
    import json
    spark.createDataFrame([(json.dumps({**known, "files": now}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{tmp_path}/_manifests/other")
    with pytest.raises(ValueError, match="rows"):
        TB.checked(spark, f"{tmp_path}/other", whole=True)


def test_prepared_tables_by_manifest(spark, tmp_path):
    root = f"{tmp_path}/p"
    TB.write_checked(table(spark), f"{root}/tx_labels", "tx_id")
    TB.write_checked(table(spark).withColumnRenamed("v", "w"), f"{root}/tx_features", "tx_id")
    df = TB.scan_prepared(spark, root)
    assert df.count() == 500 and df.columns == ["tx_id", "v", "w"]
    # the join alone: two scans, and no more exchanges than the join asks for
    assert shuffles_and_scans(df)[1] == 2 and shuffles_and_scans(df)[0] <= 2
    TB.write_checked(table(spark, 500, 2).withColumnRenamed("v", "w"), f"{root}/tx_features", "tx_id")
    with pytest.raises(ValueError, match="same ids"):
        TB.scan_prepared(spark, root)
    TB.write_checked(table(spark).unionByName(table(spark)), f"{root}/tx_labels", "tx_id")
    TB.write_checked(table(spark).unionByName(table(spark)), f"{root}/tx_features", "tx_id")
    with pytest.raises(ValueError, match="same ids"):
        TB.scan_prepared(spark, root)


def test_weeks_by_manifest(spark, tmp_path):
    root = f"{tmp_path}/w"
    for n in (0, 3):
        TB.write_checked(table(spark), f"{root}/partition_index={n}", "tx_id")
    df = TB.scan_week(spark, root)
    assert df.select("tx_id").distinct().count() == 1000 and shuffles_and_scans(df) == (0, 1)
    TB.write_checked(table(spark).withColumn("tx_id", F.col("tx_id") + (1 << 40)), f"{root}/partition_index=3", "tx_id")
    with pytest.raises(ValueError, match="range"):
        TB.scan_week(spark, root)


def test_catalogs(spark, tmp_path):
    rows = [("p1", "A", "F", "T", "B", 0, "r1,r2", "x,y,x", "s", 1, 9), ("p2", "A", "F", "T", "B", 1, "", None, "s,s,t", 1, 9)]
    names = "pack_id string, program_id string, family_id string, layer string, base string, rank int, route_ids string, pools string, sequences string, train_min_slot long, train_max_slot long"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/a/library")
    got = {r.pack_id: (r.routes, r.n_pools, r.n_sequences) for r in TB.scan_catalog(spark, f"{tmp_path}/a").collect()}
    assert got == {"p1": (["r1", "r2"], 2, 1), "p2": ([], 0, 2)}
    spark.createDataFrame([(*rows[0][:9], 1, 9), (*rows[1][:9], 2, 9)], names).write.parquet(f"{tmp_path}/b/library")
    with pytest.raises(ValueError, match="windows"):
        TB.scan_catalog(spark, f"{tmp_path}/b")


def test_kept_steps_are_made_once_per_content(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return table(spark, 10)

    table(spark).write.parquet(f"{tmp_path}/in")
    step = lambda **p: KP.kept(spark, f"step-{tmp_path.name}", p, KP.files(spark, [f"{tmp_path}/in"]), build, (table,))
    assert step(a=1).count() == 10 and step(a=1).count() == 10 and len(made) == 1
    step(a=2)
    assert len(made) == 2
    table(spark, 3).write.mode("append").parquet(f"{tmp_path}/in")
    step(a=1)
    assert len(made) == 3


def test_memorisation(spark):
    train = spark.createDataFrame([(1, "x", 1), (1, "x", 0), (2, "y", 0)], "a int, b string, y int")
    test = spark.createDataFrame([(1, "x", 1, 0.9), (2, "y", 1, 0.8), (3, "z", 1, 0.7), (4, None, 0, 0.1), (2, "y", 0, 0.5), (4, None, 0, 0.9)], "a int, b string, y int, p double")
    m = A.memorisation(train, test, ["a", "b"], "y", "p").first()
    assert (m.seen_share, m.seen_share_positives, m.positives_like_train_positives, m.unseen_rows) == (0.5, 2 / 3, 1 / 3, 3)
    assert m.unseen_base_rate == pytest.approx(1 / 3) and m.unseen_pr_auc == pytest.approx(0.5)


def test_known_universe(spark):
    pools = spark.createDataFrame([(1,), (2,), (None,)], "pool long")
    routes = spark.createDataFrame([(2, "r"), (3, "r")], "pool long, route string")
    assert sorted(r.pool for r in PO.known_universe(pools, routes).collect()) == [1, 2, 3]
