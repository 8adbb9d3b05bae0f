"""Leg patterns of long routes: counted right, and not carried along with every pack; the catalog is never broadcast."""

from pyspark.sql import functions as F

from txlens.operators import structure as ST
from txlens.plans import label_queries as LQ
from txlens.plans import standin as S


def test_patterns_do_not_travel_with_packs(spark):
    """Routes r0 and r2 have one pattern, r1 another; r3 has the same families in another order."""
    legs = spark.createDataFrame([(r, i, "AB"[(i + r % 2) % 2] if r < 3 else "AB"[i // 500], f"P{i % 4}") for r in range(4) for i in range(1000)], "n int, leg_no int, family string, program string")
    legs = legs.withColumn("route", F.concat(F.lit("r"), "n")).drop("n")
    packs = spark.range(300).select(F.concat(F.lit("K"), "id").alias("pack_id"), F.explode(F.sequence(F.lit(0), F.least(F.col("id") % 4, F.lit(3)).cast("int"))).alias("n"))
    out = ST.pack_features(packs.select("pack_id", F.concat(F.lit("r"), "n").alias("route")), legs, ["A"], ["P1"])
    got = {int(r.pack_id[1:]): r for r in out.collect()}
    assert len(got) == 300
    for k, r in got.items():
        n = k % 4 + 1
        assert (r.route_count, r.hops_sum, r.distinct_patterns) == (n, 1000 * n, (1, 2, 2, 3)[n - 1])
        assert (r.legs_A, r.legs_other, r.legs_p_P1, r.legs_p_other) == (500 * n, 500 * n, 250 * n, 750 * n)
    # what meets the packs is a name no longer than a route's
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "min(route" in plan[plan.index("Join"):]


def test_catalog_is_never_broadcast(spark, tmp_path):
    """Files of suppliers are small, their packs and routes are not."""
    d = str(tmp_path)
    spark.range(40).select(F.col("id").alias("s_suppkey")).write.parquet(f"{d}/supplier.parquet")
    spark.range(40).select(F.col("id").alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), F.lit("ECONOMY").alias("p_type"), (F.col("id") % 5).cast("int").alias("p_size")).write.parquet(f"{d}/part.parquet")
    k = F.col("id")
    spark.range(400).select(
        (k % 90).alias("l_orderkey"), (k % 40).alias("l_partkey"), (k * 7 % 40).alias("l_suppkey"), (k % 7 + 1).cast("int").alias("l_linenumber"), F.lit(1.0).alias("l_quantity"),
        F.lit(100.0).alias("l_extendedprice"), F.lit(0.05).alias("l_discount"), (k % 9 / 100).alias("l_tax"), F.when(k % 2 == 0, "R").otherwise("N").alias("l_returnflag"),
        F.when(k % 3 == 0, "F").otherwise("O").alias("l_linestatus")).write.parquet(f"{d}/lineitem.parquet")
    packs = S.packs(spark, d)
    for df, rows in ((packs.select("pack_id").join(S.pack_routes(packs).groupBy("pack_id").agg(F.collect_set("route").alias("r")), "pack_id", "left"), 320), (LQ.covered(spark, d), None)):
        # nodes below a broadcast are further in than it is
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        inset = [len(x) - len(x.lstrip(" :+-")) for x in lines]
        for i in (i for i, x in enumerate(lines) if "BroadcastExchange" in x):
            end = next((k for k in range(i + 1, len(lines)) if inset[k] <= inset[i]), len(lines))
            assert not any("s_suppkey" in x for x in lines[i:end])
        assert any("SortMergeJoin" in x for x in lines) and (rows is None or df.count() == rows)
