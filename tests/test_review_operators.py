"""Operators over journals, unions and chosen pools on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from txlens.operators import funnel as FU
from txlens.operators import metrics as M
from txlens.operators import models as MD
from txlens.operators import pools as PO
from txlens.operators import sets as SE
from txlens.operators import structure as ST
from txlens.operators import truth as T


def test_gates(spark):
    rows = [(1, 1, 0, 0), (0, 2, None, 0), (0, 0, 3, 0), (None, None, None, 0)]
    df = spark.createDataFrame(rows, "relevant int, market_writable long, venue_program long, x int")
    got = [tuple(r) for r in df.select(*[ST.gate(n).alias(n) for n in ST.GATES]).collect()]
    assert got == [(True, True, True), (False, True, True), (False, False, True), (False, False, False)]
    with pytest.raises(ValueError):
        ST.gate("other")


def test_extras(spark):
    keys = spark.createDataFrame([(1, "p2", True, False), (1, "p1", False, True), (1, "p1", True, True), (1, "zz", True, True), (2, "base", True, False), (3, "p1", None, None)],
                                 "tx_id long, account string, is_static boolean, writable boolean")
    ixs = spark.createDataFrame([(1, "swap", 5), (1, "swap", 9), (1, "router", 4), (2, "other", 99), (9, "swap", 1)], "tx_id long, kind string, amount long")
    pools = spark.createDataFrame([("p1",), ("p2",), ("p2",)], "pool string")
    got = {r.tx_id: tuple(r)[1:] for r in ST.extras(keys, ixs, pools, "base").collect()}
    assert got == {1: (["p1", "p2"], ["p1"], ["p1", "p2"], 2, 9, 1, 4, False), 2: ([], [], [], 0, 0, 0, 0, True), 3: (["p1"], [], [], 0, 0, 0, 0, False)}


def test_contract(spark):
    schema = "pool_idx long, would_send_new int, synced_all int, n_sync int, n_hop int, updating int, state_gen long, s007_ready int, cap_gross long, exec_fam int"
    good = (7, 1, 1, 2, 2, 0, 4, 1, 1000, 1)
    rows = [good, (8, *good[1:]), (9, 1, 1, 1, 2, 0, 4, 1, 1000, 0), (10, 1, None, None, 2, None, None, None, None, None), (11, 0, *good[2:])]
    df = spark.createDataFrame(rows, schema)
    bad, ready = spark.createDataFrame([(8,), (8,)], "pool_idx long"), spark.createDataFrame([(9,)], "pool_idx long")
    names = ["hops_synced", "not_updating", "no_mismatch", "generation_ok", "quote_ok", "ready", "open"]
    got = {r.pool_idx: [r[n] for n in names] for r in FU.contract(df, bad, 999, ready).collect()}
    assert got == {7: [True] * 7, 8: [True, True, False, True, True, True, False], 9: [False, True, True, True, True, True, False], 10: [False, True, True, False, False, False, False]}
    assert {r.pool_idx: r.quote_ok for r in FU.contract(df, bad).collect()}[7] is False


def test_addressable(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,), (None,)], "pool long")
    cls = spark.createDataFrame([(1, "compatible", True), (2, "compatible", False), (3, "stable", True)], "pool long, cls string, compiled boolean")
    r = FU.addressable(rows, cls).first()
    assert (r.all_n, r.addressable, r.known_addressable, r.incompatible, r.unclassified, r.coverage_pct, r.share_pct) == (6, 3, 2, 1, 2, pytest.approx(200 / 3), 50.0)
    assert FU.addressable(rows.limit(0), cls).first().coverage_pct is None


def test_kills(spark):
    e = [(1, 5, "LUT", "EXACT", "DIRTY"), (1, 3, "APPLY", "EXACT", "DIRTY"), (1, 4, "GAP", "DIRTY", "DIRTY"), (1, 9, "GAP", "DIRTY", "DIRTY"), (2, 1, "GAP", "EXACT", "EXACT"), (2, 2, "LUT", "EXACT", "DIRTY"),
         (3, 1, "LUT", None, "DIRTY")]
    df = spark.createDataFrame(e, "pool long, seq long, rc string, before string, after string")
    assert {r.rc: r.pools for r in FU.first_kill(df).collect()} == {"APPLY": 1, "LUT": 1}
    got = {r.pool: tuple(r)[1:] for r in FU.kill_gap(df, "APPLY", "GAP").collect()}
    assert got == {1: (4, 3, 4, 2), 2: (2, None, 1, 0), 3: (1, None, None, 0)}


def test_reference_hour_and_causes(spark):
    mev = spark.createDataFrame([(0, 10, True), (0, 5, None), (1, 7, False)], "hour int, value long, simple boolean")
    live = spark.createDataFrame([(0, "exact"), (0, "unknown"), (0, None), (0, "x")], "hour int, cls string")
    got = {r.hour: tuple(r)[1:] for r in T.reference_hour(mev, live).collect()}
    assert got == {0: (2, 15, 1, 10, 1, 1, 2), 1: (1, 7, 0, 0, None, None, None)}
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "cause string")
    got = {r.cause: tuple(r)[1:] for r in T.ab_causes(one(["a", "a", "b"]), one(["a", "c", None]), ["a"]).collect()}
    assert got == {"a": (2, 1, 1, True), "b": (1, 0, 1, False), "c": (0, 1, -1, False), None: (0, 1, -1, False)}


def test_unions(spark):
    part = lambda *xs: spark.createDataFrame([(x, f"k{x}") for x in xs], "pool long, kind string")
    got = {r.pool: (r.prio, r.deferred) for r in SE.universe_union(part(1, 2), part(2, 3, 3), part(4, 1, None), cap=3).collect()}
    assert got == {1: (0, False), 2: (0, False), 3: (1, False), 4: (2, True)}
    assert not any(r.deferred for r in SE.universe_union(part(1), part(2), part(3)).collect())
    cases = [spark.createDataFrame(rows, "sig string, a int, b int") for rows in ([("x", 1, 1), ("y", None, 1)], [("x", 2, 2), ("y", 5, 6)], [("z", 7, None), (None, 1, 1), ("y", 0, 0)])]
    assert {r.sig: (r.a, r.b, r.source) for r in SE.case_union(cases, ["a", "b"]).collect()} == {"x": (1, 1, 0), "y": (5, 6, 1)}


def test_choices(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 5), (4, 1)], "pool long, n long")
    bonus = F.when(F.col("pool") == 4, 50).otherwise(0)
    assert [(r.pool, r.score) for r in SE.keep_scored(df, "n", bonus, 3).collect()] == [(4, 51), (1, 5), (3, 5)]
    cands = spark.createDataFrame([(t, f"r{i}", s) for t in (1, 2) for i, s in enumerate([3, 9, 9, 1, 2, 5, 4])], "tx_id long, route string, support long")
    assert {(r.tx_id, r.pack): r.routes for r in PO.packs_of_three(cands, 2).collect()} == {(t, p): x for t in (1, 2) for p, x in ((0, "r1,r2,r5"), (1, "r6,r0,r4"))}
    limited = PO.rank_candidates(cands, 3)
    assert "WindowGroupLimit" in limited._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.tx_id, r.r, r.route) for r in limited.collect())[:3] == [(1, 0, "r1"), (1, 1, "r2"), (1, 2, "r5")]


def test_expected_values(spark):
    df = spark.createDataFrame([(0.5, 0.0, 0.25, True, 0), (0.5, 0.0, 0.25, False, 0), (0.5, 0.0, 0.25, True, 3), (None, 0.0, 0.25, True, 0), (0.5, 0.0, 0.25, None, 0)],
                               "p double, size double, landed double, has_candidate boolean, encode_status int")
    low = float("-inf")
    assert [r[0] for r in df.select(MD.ev_score("p", "size")).collect()] == [0.5, low, low, low, low]
    assert df.select(MD.ev_score("p", "size", "landed")).first()[0] == 0.125


def test_acceptance_rules():
    assert MD.accept_ranker(0.5, 0.4) and not MD.accept_ranker(0.4, 0.4) and not MD.accept_ranker(None, None)
    assert MD.accept_compact(100, 90) and not MD.accept_compact(100, 89.9)
    assert MD.accept_compact_gate(1.0, 0.97) and not MD.accept_compact_gate(1.0, 0.96)


def test_landing_summary_in_one_pass(spark):
    rows = [(1, 0.9, "a"), (0, 0.9, "a"), (1, 0.4, "a"), (0, 0.1, "a"), (0, 0.1, "b"), (1, 0.7, "b"), (None, 0.2, "b"), (1, 0.5, "c")]
    df = spark.createDataFrame(rows, "y int, p double, g string")
    got = {r.g: r for r in M.landing_summary(df, "y", "p", ["g"]).collect()}
    for g in ("a", "b"):
        x = df.where((F.col("g") == g) & F.col("y").isNotNull())
        fail = M.classifier_summary(x.select((1 - F.col("y")).alias("f"), (-F.col("p")).alias("q")), "f", "q").first()
        land = M.classifier_summary(x, "y", "p").first()
        assert (got[g].n, got[g].landed_rate, got[g].roc_auc) == (land.n, land.base_rate, pytest.approx(land.roc_auc))
        assert got[g].fail_pr_auc == pytest.approx(fail.pr_auc) and got[g].fail_base_rate == pytest.approx(fail.base_rate)
    assert got["a"].brier == pytest.approx((0.01 + 0.81 + 0.36 + 0.01) / 4)
    assert got["c"].roc_auc is None and got["c"].fail_pr_auc is None and got["c"].brier == 0.25


def test_landing_static(spark):
    tx = spark.createDataFrame([(1, 1, 2, 1, 900, 0, 200000, 5000, 3, 7), (2, None, None, None, None, None, None, None, None, None)],
                               "tx_id long, version int, n_tables int, n_signers int, raw_len int, durable_nonce int, unit_limit long, unit_price long, entry_index int, tx_index int")
    keys = spark.createDataFrame([(1, "a", True, True), (1, "p", False, True), (1, "b", True, False)], "tx_id long, account string, is_static boolean, writable boolean")
    ixs = spark.createDataFrame([(1, 2, "X", 9, 4, False, True, True, False, False), (1, 1, "C", 5, 0, True, False, False, False, False), (1, 3, "Y", 1, 8, False, False, False, True, False)],
                                "tx_id long, pos int, prog string, data_len long, amount long, is_budget boolean, is_transfer boolean, is_tip boolean, is_swap boolean, is_router boolean")
    pools = spark.createDataFrame([("p",), ("q",)], "pool string")
    got = {r.tx_id: r.asDict() for r in ST.landing_static(tx, keys, ixs, pools, "b", spark.createDataFrame([(1,), (1,)], "tx_id long")).collect()}
    one = got[1]
    code = lambda s: spark.range(1).select(ST.name_code(F.lit(s))).first()[0]
    assert {k: one[k] for k in ("n_keys", "n_static_keys", "uses_tables", "n_pools", "n_pools_static", "n_pools_writable", "base_in_keys", "attempted_cycle")} == {
        "n_keys": 3, "n_static_keys": 2, "uses_tables": 1, "n_pools": 1, "n_pools_static": 0, "n_pools_writable": 1, "base_in_keys": 1, "attempted_cycle": 1}
    assert (one["priority_fee"], one["tip"], one["has_tip"], one["n_transfers"], one["n_swaps"], one["max_swap"], one["n_router"], one["payer_only_signer"]) == (1000, 4, 1, 1, 1, 8, 0, 1)
    assert [one[c] for c in ST.LANDING_HASHES] == [code("C"), code("X"), code("Y"), code("Y"), code("X|Y")]
    assert set(got[2].values()) == {0, 2} and set(one) == {"tx_id", *ST.LANDING_NUMBERS, *ST.LANDING_HASHES}


def test_pack_structure(spark):
    packs = spark.createDataFrame([("a", "P", "prefix8:00ff:len28:accounts19", "INNER"), ("b", "Q", "other", "none")], "pack_id string, program string, family string, layer string")
    legs = spark.createDataFrame([("r", 1, "X", "P1"), ("r", 2, "Y", "P9"), ("s", 1, "X", "P1"), ("s", 2, "Y", "P9"), ("s", 3, "X", "P1")], "route string, leg_no int, family string, program string")
    got = {r.pack_id: r.asDict() for r in ST.pack_structure(packs, spark.createDataFrame([("a", "r"), ("a", "s")], "pack_id string, route string"), legs, ["X"], ["P1"]).collect()}
    a, b = got["a"], got["b"]
    assert (a["layer_code"], a["family_prefix_bytes"], a["family_data_len"], a["family_account_count"]) == (1, 8, 28, 19) and (b["layer_code"], b["family_data_len"]) == (3, 0)
    assert (a["route_count"], a["hops_min"], a["hops_max"], a["hops_sum"], a["routes_2hop"], a["routes_3hop"], a["distinct_patterns"], a["legs_X"], a["legs_other"]) == (2, 2, 3, 5, 1, 1, 2, 3, 2)
    assert b["route_count"] == 0 and a["program_hash"] != b["program_hash"]
