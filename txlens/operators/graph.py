"""Closed routes over the pool graph and per-transaction cycle tests, from counts and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens.functions.numbers import beside, count_if
from txlens.session import materialise


def _edges(pools: DataFrame) -> DataFrame:
    """Pools of two different tokens as (pool, kind, x, y)."""
    return pools.where(F.col("mx") != F.col("my")).select("pool", "kind", F.col("mx").alias("x"), F.col("my").alias("y"))


def _base_counts(edges: DataFrame, base: str) -> DataFrame:
    """Edges between the base and each token, counted per kind."""
    touch = edges.where((F.col("x") == base) | (F.col("y") == base))
    tok = F.when(F.col("x") == base, F.col("y")).otherwise(F.col("x"))
    return touch.groupBy(tok.alias("t"), "kind").agg(F.count(F.lit(1)).alias("n"))


def cycles2(pools: DataFrame, base: str) -> DataFrame:
    """Closed base-token-base routes over two different pools, counted per ordered pair of kinds.

    n1 edges of one kind and n2 of another give n1*n2 ordered routes, n*(n-1) within a kind: counts per (token, kind)
    are joined, the routes themselves are never listed.
    """
    c = _base_counts(_edges(pools), base)
    a = c.select("t", F.col("kind").alias("k1"), F.col("n").alias("n1"))
    b = c.select("t", F.col("kind").alias("k2"), F.col("n").alias("n2"))
    j = a.join(b, "t")
    routes = F.when(F.col("k1") == F.col("k2"), F.col("n1") * (F.col("n1") - 1)).otherwise(F.col("n1") * F.col("n2"))
    return j.groupBy("k1", "k2").agg(F.sum(routes).alias("routes")).where(F.col("routes") > 0)


def cycles3(pools: DataFrame, base: str) -> DataFrame:
    """Closed base-t1-t2-base routes (tokens, hence pools, all different), counted per ordered triple of kinds."""
    e = _edges(pools)
    c = _base_counts(e, base)
    mid = e.where((F.col("x") != base) & (F.col("y") != base))
    m = mid.groupBy("x", "y", "kind").agg(F.count(F.lit(1)).alias("nm"))
    both = m.select(F.col("x").alias("t1"), F.col("y").alias("t2"), F.col("kind").alias("k2"), "nm").unionByName(
        m.select(F.col("y").alias("t1"), F.col("x").alias("t2"), F.col("kind").alias("k2"), "nm"))
    a = c.select(F.col("t").alias("t1"), F.col("kind").alias("k1"), F.col("n").alias("n1"))
    b = c.select(F.col("t").alias("t2"), F.col("kind").alias("k3"), F.col("n").alias("n3"))
    j = both.join(a, "t1").groupBy("t2", "k1", "k2").agg(F.sum(F.col("nm") * F.col("n1")).alias("w")).join(b, "t2")
    return j.groupBy("k1", "k2", "k3").agg(F.sum(F.col("w") * F.col("n3")).alias("routes"))


def closure_by_sequence(pools: DataFrame, base: str, sequences: DataFrame) -> DataFrame:
    """Closed two- and three-hop routes per kind sequence of a given list; sequences without any show 0."""
    two = cycles2(pools, base).select(F.concat_ws("-", "k1", "k2").alias("seq"), "routes")
    three = cycles3(pools, base).select(F.concat_ws("-", "k1", "k2", "k3").alias("seq"), "routes")
    return sequences.join(two.unionByName(three), "seq", "left").select("seq", F.coalesce("routes", F.lit(0)).alias("routes"))


def cycle_delta(pools: DataFrame, extra: DataFrame, base: str) -> DataFrame:
    """Two- and three-hop routes before and after adding pools, the gain, and the support score of the gain."""
    def totals(df, name):
        two = cycles2(df, base).agg(F.coalesce(F.sum("routes"), F.lit(0)).alias(f"{name}_2hop"))
        three = cycles3(df, base).agg(F.coalesce(F.sum("routes"), F.lit(0)).alias(f"{name}_3hop"))
        return beside(two, three)

    j = beside(totals(pools, "before"), totals(pools.unionByName(extra), "after"))
    d2, d3 = F.col("after_2hop") - F.col("before_2hop"), F.col("after_3hop") - F.col("before_3hop")
    return j.select("*", d2.alias("gain_2hop"), d3.alias("gain_3hop"), F.when(d3 > 0, 1.5).when(d2 > 0, 1.0).otherwise(0.0).alias("support"))


def base_cycle(tx_pools: DataFrame, pools: DataFrame, base: str) -> DataFrame:
    """Transactions whose named pools contain a cycle through the base token.

    Without the base node, a component of the transaction's token graph that has two base edges closes such a cycle.
    Two base edges at one token are found by a count. The rest is a smallest-label walk over (transaction, token) nodes,
    only for transactions with at least two base edges. In each round a node takes the smallest label around it and then
    the label of its label, so rounds grow with the logarithm of a path; every round is written to the shared folder.
    """
    e = tx_pools.join(_edges(pools), "pool").select("tx_id", "x", "y")
    on_base = (F.col("x") == base) | (F.col("y") == base)
    starts = e.where(on_base).groupBy("tx_id", F.when(F.col("x") == base, F.col("y")).otherwise(F.col("x")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    starts = materialise(starts, "cycle-starts")
    direct = starts.where(F.col("n") >= 2).select("tx_id").distinct()
    open_tx = starts.groupBy("tx_id").agg(F.sum("n").alias("n")).where(F.col("n") >= 2).select("tx_id").join(direct, "tx_id", "left_anti")
    mid = e.where(~on_base).join(open_tx, "tx_id", "left_semi")
    links = materialise(mid.select("tx_id", F.col("x").alias("a"), F.col("y").alias("b")).unionByName(
        mid.select("tx_id", F.col("y").alias("a"), F.col("x").alias("b"))).distinct(), "cycle-links")
    labels = materialise(starts.join(open_tx, "tx_id", "left_semi").select("tx_id", "t").unionByName(
        links.select("tx_id", F.col("a").alias("t"))).distinct().withColumn("label", F.col("t")), "cycle-labels")
    moved = True
    while moved:
        near = links.join(labels, (links["tx_id"] == labels["tx_id"]) & (links["a"] == labels["t"])).select(
            links["tx_id"], F.col("b").alias("t"), "label")
        best = near.groupBy("tx_id", "t").agg(F.min("label").alias("m"))
        step = materialise(labels.join(best, ["tx_id", "t"], "left").select("tx_id", "t", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label")), "cycle-labels")
        jump = step.select("tx_id", F.col("t").alias("label"), F.col("label").alias("_next"))
        nxt = materialise(step.join(jump, ["tx_id", "label"], "left").select("tx_id", "t", "old", F.least("label", F.coalesce("_next", "label")).alias("label")), "cycle-labels")
        moved = not nxt.where(F.col("label") < F.col("old")).isEmpty()
        labels = nxt.drop("old")
    joined = starts.join(labels, ["tx_id", "t"]).groupBy("tx_id", "label").agg(F.sum("n").alias("n")).where(F.col("n") >= 2).select("tx_id").distinct()
    return direct.unionByName(joined).distinct()


def partner_counts(pools: DataFrame) -> DataFrame:
    """Per pool: how many pools of another protocol trade the same token, and the smallest of them.

    Counts and smallest ids per (token, protocol) are enough; pairs are never listed.
    """
    per = pools.groupBy("token", "proto").agg(F.count(F.lit(1)).alias("n"), F.min("pool").alias("m"))
    other = per.select("token", F.col("proto").alias("_p"), "n", "m")
    kinds = pools.select("token", "proto").distinct().join(other, "token").where(F.col("proto") != F.col("_p")).groupBy("token", "proto").agg(
        F.sum("n").alias("partners"), F.min("m").alias("first_partner"))
    return pools.join(kinds, ["token", "proto"], "left").select("pool", F.coalesce("partners", F.lit(0)).alias("partners"), "first_partner")


def pool_class(pools: DataFrame, stable: list[str], base: str, partner_proto: str) -> DataFrame:
    """Reason per pool: quote side is not the base, stable token, no partner pool, or compatible."""
    have = pools.where(F.col("proto") == partner_proto).select("token").distinct().withColumn("_h", F.lit(1))
    j = pools.where(F.col("proto") != partner_proto).join(have, "token", "left")
    reason = (F.when(F.col("quote") != base, "quote_not_base").when(F.col("token").isin(*stable) | (F.col("token") == base), "stable_or_base")
              .when(F.col("_h").isNull(), "no_partner").otherwise("compatible"))
    return j.select("pool", reason.alias("reason"))


def routes_by_pool(legs: DataFrame) -> DataFrame:
    """Inverted index as a table: the routes of every pool with the leg it takes, and the number of routes per pool."""
    n = legs.groupBy("pool").agg(F.count(F.lit(1)).alias("n_routes"))
    return legs.join(n, "pool").select("pool", "route", "leg_no", "n_routes")


def ambiguous_keys(routes: DataFrame) -> DataFrame:
    """Pool keys that occur in two different pairs."""
    pair = F.struct("left", "right")
    keys = routes.select(pair.alias("p"), F.explode(F.array("left", "right")).alias("key")).where(F.col("key").isNotNull() & (F.col("key") != ""))
    return keys.groupBy("key").agg((F.min("p") != F.max("p")).alias("two")).where("two").select("key")


def kinds_seen(pools: DataFrame) -> DataFrame:
    return pools.groupBy("kind").agg(F.count(F.lit(1)).alias("pools"), count_if(F.col("mx") == F.col("my")).alias("self_pools"))
