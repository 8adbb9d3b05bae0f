"""Order statistics against brute force, on both the plain and the bucketed path."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txlens.functions import bits, ordstat


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    # One value holds a third of all rows.
    data = [("a" if rng.random() < 0.6 else "b", 7.0 if rng.random() < 0.33 else round(rng.random() * 50, 1)) for _ in range(3000)]
    return data, spark.createDataFrame(data, "g string, v double")


@pytest.mark.parametrize("desc", [False, True])
def test_running_sums(rows, desc):
    data, df = rows
    got = {(r.g, r.v): (r.n, r.cum_n, r.tot_n) for r in ordstat.counts(df, "v", ["g"], desc).collect()}
    for g in ("a", "b"):
        vs = [v for k, v in data if k == g]
        for v in set(vs):
            cum = sum(1 for x in vs if (x >= v if desc else x <= v))
            assert got[(g, v)] == (vs.count(v), cum, len(vs))


def test_quantiles_and_index_percentiles(rows):
    data, df = rows
    vs = sorted(v for _, v in data)
    ps = [0.0, 0.1, 0.37, 0.5, 0.99, 1.0]
    assert np.allclose(ordstat.quantile_list(df, "v", ps), np.quantile(vs, ps))
    n = len(vs)
    low = ordstat.index_percentiles(df, "v", {"p": 0.9}).first()
    half = ordstat.index_percentiles(df, "v", {"p": 0.9}, rule="half").first()
    assert low.p == vs[int(0.9 * (n - 1))] and half.p == vs[int(0.9 * (n - 1) + 0.5)] and low.n == n


def test_numbering_and_average_rank(rows):
    data, df = rows
    keyed = df.withColumn("id", F.monotonically_increasing_id()).withColumn("w", F.col("v") + F.col("id") / 1e6)
    got = [(r.w, r.k) for r in ordstat.number_rows(keyed, "w", ["id"], "k").collect()]
    assert [k for _, k in sorted(got)] == list(range(len(data)))
    ranks = {r.v: r.r for r in ordstat.average_ranks(df, "v", "r").collect()}
    vs = sorted(v for _, v in data)
    for v in random.Random(1).sample(sorted(set(vs)), 20):
        places = [i + 1 for i, x in enumerate(vs) if x == v]
        assert ranks[v] == sum(places) / len(places)


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(float(x),) for x in range(6)], "v double")
    got = [r.b for r in df.select("v", ordstat.bucket_of(F.col("v"), [1.0, 3.0]).alias("b")).orderBy("v").collect()]
    assert got == [0, 0, 1, 1, 2, 2]


def test_mix_equals_wrapping_arithmetic(spark):
    ids = [0, 1, 7, 2**31, 2**32 + 5, 2**40 + 3, 2**62 + 11, 2**63 - 1]
    mask = (1 << 64) - 1
    df = spark.createDataFrame([(i,) for i in ids], "i bigint")
    got = {r.i: r.m for r in df.select("i", bits.mix_mod(bits.SAMPLE_SEED, F.col("i"), 1_000_000).alias("m")).collect()}
    for i in ids:
        x = ((bits.SAMPLE_SEED + i) * bits.MIX_CONST) & mask
        assert got[i] == (x ^ (x >> 30)) % 1_000_000


def test_unsigned_order(spark):
    vals = [5, -1, 2**63 - 1, -(2**63), 0]
    df = spark.createDataFrame([(v,) for v in vals], "v bigint")
    got = [r.v for r in df.orderBy(*bits.unsigned_order(F.col("v"))).collect()]
    assert got == sorted(vals, key=lambda v: v % (1 << 64))


def test_numbering_with_many_ties(spark):
    df = spark.range(900).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 5 ELSE id % 40 END AS v")
    got = {r.id: r.k for r in ordstat.number_rows(df, "v", ["id"], "k", desc=True).collect()}
    rows = sorted(((-(5 if i % 3 == 0 else i % 40), i) for i in range(900)))
    assert got == {i: k for k, (_, i) in enumerate(rows)}


def test_previous_row_across_chunks(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, rng.randrange(9)) for i in rng.sample(range(1000), 300)]
    got = {(r.g, r.o): r.prev_v for r in ordstat.with_previous(spark.createDataFrame(rows, "g string, o bigint, v int"), ["g"], "o", ["v"]).collect()}
    for g in "ab":
        mine = sorted((o, v) for h, o, v in rows if h == g)
        assert [got[(g, o)] for o, _ in mine] == [None] + [v for _, v in mine[:-1]]


def test_numbering_with_nulls_repeats_and_text(spark):
    rows = [(None, "b"), (2.0, None), (2.0, "a"), (2.0, "a"), (None, None), (1.0, "z"), (float("nan"), "a")]
    df = spark.createDataFrame(rows, "v double, t string")
    got = sorted((r.k, r.v, r.t) for r in ordstat.number_rows(df, "v", ["t"], "k").collect())
    assert [k for k, _, _ in got] == list(range(7))
    assert [(v, t) for _, v, t in got[:6]] == [(None, None), (None, "b"), (1.0, "z"), (2.0, None), (2.0, "a"), (2.0, "a")]
    assert got[6][2] == "a" and got[6][1] != got[6][1]
    texts = ordstat.counts(df, "t").orderBy("cum_n").collect()
    assert [(r.t, r.n, r.cum_n, r.tot_n) for r in texts] == [("a", 3, 3, 5), ("b", 1, 4, 5), ("z", 1, 5, 5)]


def test_previous_row_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 1, 10), (None, 7, 20), (1, 3, 30)], "g int, o int, v int")
    got = sorted((r.g or 0, r.o, r.prev_v) for r in ordstat.with_previous(df, ["g"], "o", ["v"]).collect())
    assert got == [(0, 1, None), (0, 7, 10), (1, 3, None)]


def test_scans_over_dense_and_empty_ranges(spark):
    """All rows lie in one narrow stretch of the order; a third of them in one group that spans many ranges, values are rare."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else rng.choice(["a", "b", None]), 10**12 + i, i if rng.random() < 0.01 else None) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o bigint, v bigint").repartition(5)
    grouped = ordstat.carry_forward(df, "o", "v", "c", ["g"])
    flat = ordstat.carry_forward(df, "o", "v", "c")
    prev = ordstat.with_previous(df, ["g"], "o", ["v", "o"])
    for found, groups in ((grouped, True), (flat, False)):
        got, last = {r.o: r.c for r in found.collect()}, {}
        for g, o, v in sorted(rows, key=lambda r: r[1]):
            key = g if groups else 0
            last[key] = v if v is not None else last.get(key)
            assert got[o] == last[key]
        assert len(got) == 3000 and found.columns == ["g", "o", "v", "c"]
    got, before = {r.o: (r.prev_v, r.prev_o) for r in prev.collect()}, {}
    for g, o, v in sorted(rows, key=lambda r: r[1]):
        assert got[o] == before.get(g, (None, None))
        before[g] = (v, o)
    spread = ordstat.ranged(df, ["g", "o"], "t").groupBy("_b").count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 3 * 3000 / 8
    assert ordstat.carry_forward(df.limit(0), "o", "v", "c").collect() == []
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan
