"""Policy accounting on the five-transaction frame."""

import math

import pytest
from pyspark.sql import functions as F

from txlens.operators import labels as L
from txlens.operators import policy as P


@pytest.fixture(scope="module")
def frames(spark):
    tx = spark.createDataFrame([(1, 1, "POSITIVE", 1, 0, 0.9, 0, 1, 1), (2, 1, "POSITIVE", 1, 0, 0.8, 0, None, 0), (3, 0, "CERTIFIED_NEGATIVE", 1, 0, 0.7, 0, None, 0),
                                (4, None, "UNKNOWN", 1, 0, 0.95, 1, None, 0), (5, None, "UNKNOWN", 0, 0, 0.99, 0, None, 0)],
                               "tx_id bigint, target int, label string, relevant int, encode_status int, arb_score double, pair_sample int, min_cover_rank_live int, n_seen_in_train int")
    pairs = spark.createDataFrame([(1, "A", 0, True, "POSITIVE", 0, 0.0, 0.2), (1, "B", 1, True, "POSITIVE", 1, -1.0, 0.9), (2, "A", 0, True, "POSITIVE", 0, 0.0, 0.5),
                                   (3, "A", 0, True, "CERTIFIED_NEGATIVE", 0, 0.0, 0.1), (4, "A", 0, True, "UNKNOWN", None, 0.0, 0.4)],
                                  "tx_id bigint, pack_id string, pack_rank int, eligible_live boolean, label string, pack_target int, static double, learned double")
    return tx.withColumn("weight", L.sample_weight(250_000)), pairs


def test_availability(frames):
    assert [(r.k, r.available) for r in P.availability(frames[0], [1, 2]).orderBy("k").collect()] == [(1, 0), (2, 1)]


def test_conditional_topk(frames):
    s, l = P.conditional_topk(frames[1], "static", 2).first(), P.conditional_topk(frames[1], "learned", 2).first()
    assert (s.top1, l.top1, s.top2) == (0.0, 1.0, 1.0)
    assert P.conditional_topk(frames[1], "static", 1).first().coverable == 0


def test_two_stage_and_joint(frames):
    tx, pairs = frames
    x = P.per_tx(tx, P.ranked(pairs, "learned", 2), 1, 2, "learned")
    e = P.evaluate(x, "two_stage", 0.75, 1.0).first()
    assert (e.sends_weighted, e.succeeded, e.miss_no_covering_pack) == (6.0, 1, 1)
    e = P.evaluate(P.per_tx(tx, P.ranked(pairs, "static", 2), 1, 2, "static"), "two_stage", 0.75, 1.0).first()
    assert (e.miss_ranking, e.succeeded) == (1, 0)
    e = P.evaluate(x, "joint", 0.5, 1.0).first()
    assert (e.sends_weighted, e.succeeded) == (1.0, 1)
    broken = x.withColumn("encode_status", F.when(F.col("tx_id") == 2, 1).otherwise(F.col("encode_status")))
    e = P.evaluate(broken, "two_stage", 0.75, 1.0).first()
    assert (e.miss_encoder_unsupported, e.miss_relevance_gate) == (1, 0)


def test_budget_threshold_never_splits_ties(spark):
    df = spark.createDataFrame([(s, 1.0) for s in (0.9, 0.8, 0.8, 0.1, float("-inf"))], "s double, w double")
    got = {r.budget: r.threshold for r in P.budget_threshold(df, "s", "w", [1, 2, 3, 0.5]).collect()}
    assert got == {1.0: 0.9, 2.0: 0.9, 3.0: 0.8, 0.5: math.inf}
