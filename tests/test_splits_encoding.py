import pytest
from pyspark.sql import functions as F

from txlens import schema
from txlens.operators import audit as A
from txlens.operators import encode as E
from txlens.operators import splits as SP


@pytest.fixture(scope="module")
def slots(spark):
    return spark.range(300).select(F.col("id").alias("tx_id"), (1000 + F.floor(F.col("id") / 3)).alias("slot"))


def test_boundaries_counts_and_overlap(slots):
    b = SP.slot_boundaries(slots)
    assert (b["train"], b["val"], b["test"]) == ((1000, 1069), (1070, 1084), (1085, 1099))
    s = SP.assign_split(slots, b)
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 210, "val": 45, "test": 45}
    SP.check_disjoint(s)
    with pytest.raises(AssertionError):
        SP.check_disjoint(s.withColumn("split", F.when(F.col("slot") == 1099, "train").otherwise(F.col("split"))))
    with pytest.raises(AssertionError):
        SP.check_disjoint(s.unionByName(s.where("tx_id = 0").withColumn("split", F.lit("test")).withColumn("slot", F.lit(1090).cast("bigint"))))
    with pytest.raises(ValueError):
        SP.slot_boundaries(slots.limit(3))


def test_vocabulary(spark, tmp_path):
    big = -(2 ** 63) + 3  # the bit pattern of 2^63 + 3
    rows = [(big,)] * 200 + [(17,)] * 120 + [(99,)] * 2 + [(2 ** 40 + 3,)] * 78
    df = spark.createDataFrame([(h, float(i)) for i, (h,) in enumerate(rows)], "h bigint, x double")
    v = E.fit_vocab(df, ["h"])
    codes = {r.value: r.code for r in v.collect()}
    assert codes == {big: 0, 17: 1, 2 ** 40 + 3: 2}
    assert {r.value: r.code for r in E.fit_vocab(df.orderBy(F.desc("x")), ["h"]).collect()} == codes
    E.save_vocab(v, str(tmp_path / "v"))
    again = E.load_vocab(spark, str(tmp_path / "v"))
    unseen = E.encode(spark.createDataFrame([(99, 1.0), (17, 2.0)], "h bigint, x double"), {"h": "hash", "x": "numeric"}, again)
    got = {r.x: r.h for r in unseen.collect()}
    assert got[1.0] != got[1.0] and got[2.0] == 1.0


def test_only_declared_features_pass(spark):
    df = schema.with_roles(spark.createDataFrame([(1, 2, 3, 4)], "tx_id int, label int, a int, b int"), {"tx_id": "id", "label": "label", "a": "feature"}, {"a": "hash"})
    assert schema.feature_columns(df) == ["a"] and schema.kinds(df) == {"a": "hash"}
    for bad in ("tx_id", "label", "b"):
        with pytest.raises(ValueError):
            schema.check_features(df, ["a", bad])


def test_shuffle_keeps_rows_and_counts(spark):
    df = spark.range(500).select(F.col("id").alias("tx_id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    s = A.shuffle_labels(df, "y", "tx_id", 5)
    rows = s.collect()
    assert len({r.tx_id for r in rows}) == 500 and sum(r.y for r in rows) == 50
    assert sum(r.y for r in rows if r.tx_id % 10 == 0) < 50
