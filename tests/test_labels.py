"""Hand-built trigger rows with known labels, eligibility, coverage and pairs."""

import pytest

from txlens.operators import labels as L

TRIG = [
    (1, "A", "F1", "TOP_LEVEL", "SOL", "POSITIVE", "", 1000, "q"), (1, "B", "F2", "INNER", "SOL", "POSITIVE", "", 1000, "q"),
    (2, "A", "F1", "TOP_LEVEL", "SOL", "CERTIFIED_NEGATIVE", "", None, ""),
    (3, "A", "F1", "TOP_LEVEL", "SOL", "CERTIFIED_NEGATIVE", "", None, ""), (3, "B", "F2", "INNER", "SOL", "UNKNOWN", "UNRESOLVED", None, ""),
    (4, "A", "F1", "TOP_LEVEL", "", "UNKNOWN", "NO_LABEL", None, ""),
    (5, "B", "F2", "INNER", "SOL", "POSITIVE", "", 1000, "q"), (5, "A", "F1", "TOP_LEVEL", "SOL", "POSITIVE", "", 1000, "q")]
PACKS = [("P1", "A", "F1", "TOP_LEVEL", "SOL", 0), ("P2", "B", "F2", "INNER", "SOL", 0), ("P3", "A", "F1", "TOP_LEVEL", "SOL", 1)]


@pytest.fixture(scope="module")
def tables(spark):
    trig = spark.createDataFrame(TRIG, "tx_id bigint, program string, family string, layer string, base string, status string, reason string, profit bigint, quality string")
    packs = spark.createDataFrame(PACKS, "pack_id string, program string, family string, layer string, base string, rank bigint")
    routes = spark.createDataFrame([("P1", "r1"), ("P2", "r2"), ("P3", "r3")], "pack_id string, route string")
    pos = spark.createDataFrame([(1, "r1,r9"), (1, "r1,r9"), (5, "r2"), (5, "r2,")], "tx_id bigint, routes string")
    return trig, packs, routes, L.packed_routes(pos), pos


def test_labels_are_three_valued(tables):
    trig, _, _, routes, _ = tables
    got = {r.tx_id: r for r in L.tx_labels(trig, routes).collect()}
    assert {k: (r.label, r.target) for k, r in got.items()} == {
        1: ("POSITIVE", 1), 2: ("CERTIFIED_NEGATIVE", 0), 3: ("UNKNOWN", None), 4: ("UNKNOWN", None), 5: ("POSITIVE", 1)}
    assert got[1].profitable_routes == "r1,r9" and got[1].n_routes == 2 and got[1].best_profit == 1000
    assert got[3].unknown_reasons == "UNRESOLVED" and got[4].n_top_level == 1


def test_coverage_and_pairs(spark, tables):
    trig, packs, pack_routes, routes, pos = tables
    e = L.eligible_packs(trig, packs)
    assert {(r.tx_id, r.pack_id) for r in e.collect()} == {(t, p) for t in (1, 3, 5) for p in ("P1", "P2", "P3")} | {(t, p) for t in (2, 4) for p in ("P1", "P3")}
    c = L.covering(e, pack_routes, routes)
    assert {(r.tx_id, r.pack_id, r.live) for r in c.collect()} == {(1, "P1", True), (5, "P2", False)}
    hits = L.eligible_hits(trig, packs, pack_routes, routes)
    assert sorted(map(str, hits.drop("hit").collect())) == sorted(map(str, e.collect()))
    assert sorted(map(str, hits.where("hit").drop("hit").collect())) == sorted(map(str, c.select("tx_id", "pack_id", "pack_rank", "live").collect()))
    cov = {r.tx_id: r for r in L.cover_rank(e, c).collect()}
    assert cov[1].min_cover_rank_live == 0 and cov[5].min_cover_rank == 0 and cov[5].min_cover_rank_live is None
    lab = L.tx_labels(trig)
    rel = lab.selectExpr("tx_id", "1 AS relevant")
    rows = {(r.tx_id, r.pack_id): r.pack_target for r in L.expand_pairs(lab, rel, e, c, 1, 1_000_000).collect()}
    assert rows == {(1, "P1"): 1, (1, "P2"): 0, (2, "P1"): 0, (3, "P1"): None, (4, "P1"): None, (5, "P1"): 0, (5, "P2"): 1}
    direct = lambda depth: sorted(map(str, L.pairs_of(lab, rel, trig, packs, pack_routes, routes, depth, 1_000_000).collect()))
    for depth in (0, 1, 2):
        assert direct(depth) == sorted(map(str, L.expand_pairs(lab, rel, e, c, depth, 1_000_000).collect()))
    trig_slot = trig.selectExpr("*", "tx_id AS slot")
    assert tuple(L.label_problems(trig_slot, lab, pos).first()) == (0, 0, 4, 4, 0)


def test_key_dictionary_is_dense_and_stable(tables):
    ids = [(r.key_id, r.program, r.base) for r in L.key_dictionary(tables[0]).orderBy("key_id").collect()]
    assert ids == [(0, "A", "SOL"), (1, "B", "SOL"), (2, "A", "")]
