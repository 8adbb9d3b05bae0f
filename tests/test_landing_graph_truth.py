"""Reputation, cycles, races and journals against brute force and hand-built cases."""

import itertools
import json
import math
import random

import numpy as np
from pyspark.sql import functions as F

from txlens.functions.numbers import wilson_bounds
from txlens.operators import funnel as FU
from txlens.operators import graph as G
from txlens.operators import landing as LA
from txlens.operators import truth as T
from txlens.sources import journal as J
from txlens.sources import tables as TB


def test_reputation_equals_the_documented_rule(spark):
    rng = random.Random(11)
    rows = [(i, "hot" if rng.random() < 0.4 else f"p{rng.randrange(12)}", rng.randrange(0, 400), int(rng.random() < 0.5)) for i in range(1500)]
    df = spark.createDataFrame(rows, "tx_id int, payer string, slot bigint, landed int")
    got = {r.tx_id: r for r in LA.with_reputation(df, half_life=30).collect()}
    assert len(got) == len(rows)
    for i, p, s, _ in rows:
        seen = [(t, k) for _, q, t, k in rows if q == p and t <= s - 3]
        weight = lambda t: 2.0 ** (t // 30 - s // 30)
        landed, failed = sum(weight(t) for t, k in seen if k), sum(weight(t) for t, k in seen if not k)
        r = got[i]
        assert math.isclose(r.rep_landed, landed, abs_tol=1e-12) and math.isclose(r.rep_failed, failed, abs_tol=1e-12)
        assert r.rep_seen == int(bool(seen)) and (math.isnan(r.rep_fail_rate) if landed + failed == 0 else True)


def _pools(rng, n, tokens):
    names = ["BASE"] + [f"T{i}" for i in range(tokens)]
    return [(i, rng.choice("AB"), *rng.choices(names, k=2)) for i in range(n)]


def test_cycle_counts(spark):
    pools = _pools(random.Random(5), 40, 6)
    df = spark.createDataFrame(pools, "pool bigint, kind string, mx string, my string")
    edges = [(i, k, x, y) for i, k, x, y in pools if x != y]
    walk = [(i, k, a, b) for i, k, x, y in edges for a, b in ((x, y), (y, x))]
    two, three = {}, {}
    for a, b in itertools.permutations(walk, 2):
        if a[2] == "BASE" and a[3] == b[2] and b[3] == "BASE" and a[0] != b[0]:
            two[(a[1], b[1])] = two.get((a[1], b[1]), 0) + 1
    for a in (w for w in walk if w[2] == "BASE"):
        for b in (w for w in walk if w[2] == a[3] and w[3] not in ("BASE", a[3])):
            for c in (w for w in walk if w[2] == b[3] and w[3] == "BASE"):
                key = (a[1], b[1], c[1])
                three[key] = three.get(key, 0) + 1
    assert {(r.k1, r.k2): r.routes for r in G.cycles2(df, "BASE").collect()} == two
    assert {(r.k1, r.k2, r.k3): r.routes for r in G.cycles3(df, "BASE").collect()} == three


def test_base_cycle_follows_long_paths(spark):
    chain = [(0, "A", "BASE", "T0")] + [(i, "A", f"T{i - 1}", f"T{i}") for i in range(1, 9)] + [(9, "A", "T8", "BASE"), (10, "A", "T4", "T20"), (11, "A", "BASE", "T0")]
    pools = spark.createDataFrame(chain, "pool bigint, kind string, mx string, my string")
    rows = [(1, p) for p in range(10)] + [(2, p) for p in range(9)] + [(3, p) for p in (0, 11)] + [(4, p) for p in (0, 1, 2, 4, 9)]
    got = {r.tx_id for r in G.base_cycle(spark.createDataFrame(rows, "tx_id bigint, pool bigint"), pools, "BASE").collect()}
    assert got == {1, 3}


def test_race_pair(spark):
    p = spark.createDataFrame([(1, 1, 1000, 50, 1), (2, 2, 184000, 50, 1), (3, 3, 900, 50, 2)], "source_id int, seq bigint, rx_ns bigint, slot bigint, index int")
    p = p.withColumn("fec_set", F.lit(0)).withColumn("type", F.lit("d")).withColumn("bytes", F.lit(10)).withColumn("malformed", F.lit(False))
    key = ["slot", "index", "fec_set", "type"]
    (r,) = T.race_matrix(p, key).collect()
    assert (r["first"], r.late, r.n, r.min_value, r.p50, r.max_value) == (1, 2, 1, 183000, 183000, 183000)
    assert {r.source_id: (r.first_n, r.late_n) for r in T.feed_counters(p, key).collect()} == {1: (1, 0), 2: (0, 1), 3: (1, 0)}


def test_prefix_gap(spark):
    rows = [(1, i) for i in (0, 1, 2, 5, 2)] + [(2, i) for i in (1, 2)]
    got = {r.slot: (r.n, r.has_zero, r.first_hole) for r in T.prefix_gap(spark.createDataFrame(rows, "slot bigint, index bigint")).collect()}
    assert got == {1: (4, True, 3), 2: (2, False, 0)}


def test_send_buckets(spark):
    hurdle = spark.range(1).select(FU.fee_hurdle().alias("h")).first().h
    assert hurdle == 525_000
    base = dict(framed=True, exact=True, ready_file=True, plane_pool=1, ambiguous=False, plane_ready=True, direction=1, cooling=False, cap_ok=True, cap_gross=525_001)
    cases = {"would_fire": {}, "below_hurdle": {"cap_gross": 525_000}, "ix_only": {"exact": False}, "ambiguous_pool": {"ambiguous": True}, "plane_miss": {"plane_pool": None},
             "bad_direction": {"direction": 3}, "not_framed": {"framed": False}, "cooldown": {"cooling": True}}
    ddl = "name string, framed boolean, exact boolean, ready_file boolean, plane_pool int, ambiguous boolean, plane_ready boolean, direction int, cooling boolean, cap_ok boolean, cap_gross int"
    df = spark.createDataFrame([(n, *{**base, **c}.values()) for n, c in cases.items()], ddl)
    for r in df.select("name", FU.send_bucket(F.lit(True), hurdle).alias("b")).collect():
        assert r.b == r.name
    shapes = spark.createDataFrame([(255, 3, None), (0, 2, None), (5, 2, "a-b"), (1, 2, "a-b"), (0, 2, "x")], "f int, h int, s string")
    assert [r.ok for r in shapes.select(FU.shape_ok(F.col("f"), F.col("h"), F.col("s"), ["a-b"]).alias("ok")).collect()] == [False, True, True, True, False]


def test_journal_tolerates_bad_lines(spark, tmp_path):
    lines = [json.dumps({"kind": "gate", "ts": 100, "gross": 5}), json.dumps({"kind": "gate", "ts": 99e9 + 1e12, "gross": 6}), '{"kind":"gate", broken', json.dumps({"kind": "opp"}),
             json.dumps({"kind": "gate", "gross": 7})]
    (tmp_path / "j.jsonl").write_text("\n".join(lines))
    assert sorted(r.gross for r in J.scan_journal(spark, str(tmp_path), "gate").where("gross IS NOT NULL").collect())[:1] == [5]
    assert [r.gross for r in J.scan_journal(spark, str(tmp_path), "gate", window_s=50, now=140).where("gross IS NOT NULL").collect() if r.gross != 6] == [5]


def test_truth_last_row_wins(spark, tmp_path):
    a = "AB" * 32
    rows = [{"sig_hex": a, "slot": 1}, {"sig_hex": "short", "slot": 2}, {"sig_hex": a.lower(), "slot": 3}]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    (r,) = J.scan_truth(spark, str(tmp_path / "t.jsonl")).collect()
    assert (r.sig_hex, r.slot) == (a.lower(), 3)


def test_guards_refuse_bad_tables(spark, tmp_path):
    import pytest
    p = str(tmp_path / "prep")
    spark.range(5).selectExpr("id AS tx_id", "1 AS label").write.parquet(f"{p}/tx_labels")
    spark.range(4).selectExpr("id AS tx_id", "2 AS x").write.parquet(f"{p}/tx_features")
    with pytest.raises(ValueError):
        TB.scan_prepared(spark, p)
    w = str(tmp_path / "week")
    spark.createDataFrame([(1, 0), (1, 0)], "tx_id bigint, partition_index int").write.partitionBy("partition_index").parquet(w)
    with pytest.raises(ValueError):
        TB.scan_week(spark, w)


def test_wilson_limits(spark):
    lo, hi = wilson_bounds("k", "n")
    r = spark.createDataFrame([(8, 10), (0, 0)], "k int, n int").select("n", lo.alias("lo"), hi.alias("hi")).collect()
    # The bounds solve (share - p)^2 = z^2 p (1 - p) / n.
    z2, n, share = 1.96 ** 2, 10, 0.8
    low, high = sorted(np.roots([1 + z2 / n, -2 * share - z2 / n, share * share]))
    assert abs(r[0].lo - low) < 1e-9 and abs(r[0].hi - high) < 1e-9 and r[1].lo is None
