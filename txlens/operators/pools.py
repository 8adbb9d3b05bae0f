"""Pool priors, route support, capped pool-to-route lists, candidates and their hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from txlens.functions.numbers import beside, count_if, each, ratio, sum_if
from txlens.operators.sets import best_per_key

# Fixed values
RATE_PRIOR = 0.1
RATE_WEIGHT = 10.0
ROUTE_CAP = 192
ROUTES_PER_PACK = 3


def _pool_sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """touch, pos, sum and count of log profit per pool; `rows` has one row per (tx, pool)."""
    pos = F.col("target3") == 1
    logs = F.when(pos & (F.col("best_profit") > 0), F.log("best_profit"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("touch"), count_if(pos).alias("pos"),
                                 F.sum(logs).alias("log_sum"), F.count(logs).alias("log_n"))


def _finish(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.select(*keys, "touch", "pos", ratio("log_sum", "log_n").alias("logprofit"),
                       ((F.col("pos") + RATE_PRIOR) / (F.col("touch") + RATE_WEIGHT)).alias("pos_rate"))


def pool_priors(rows: DataFrame) -> DataFrame:
    """Per pool: touches, positives, mean log profit of positives, smoothed positive rate."""
    return _finish(_pool_sums(rows, ["pool"]), ["pool"])


def route_support(tx_routes: DataFrame) -> DataFrame:
    """Distinct positive transactions per profitable route."""
    return tx_routes.select("tx_id", "route").distinct().groupBy("route").agg(F.count(F.lit(1)).alias("support"))


def pool_route_rows(support: DataFrame, routes: DataFrame) -> DataFrame:
    """(pool, route, support): `routes` is (route_id, pool), one row per market of a route."""
    return routes.withColumnRenamed("route_id", "route").join(support, "route").select("pool", "route", "support")


def unpack_markets(routes: DataFrame) -> DataFrame:
    """Routes with a packed market list to (route_id, pool)."""
    return routes.select("route_id", F.explode(F.split("market_ids", ",")).alias("pool"))


def pool_route_count(rows: DataFrame) -> DataFrame:
    """Routes per pool, before any cap."""
    return rows.groupBy("pool").agg(F.count(F.lit(1)).alias("n_routes"))


def pool_routes(rows: DataFrame, cap: int = ROUTE_CAP) -> DataFrame:
    """0-based rank within the pool by support, then route; ranks below the cap stay.

    The rank filter on the window is pushed to a partial group limit before the shuffle.
    """
    w = W.partitionBy("pool").orderBy(F.desc("support"), "route")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).withColumn(
        "rank", F.col("_r") - 1).drop("_r")


def attach_priors(tx: DataFrame, tx_pools: DataFrame, priors: DataFrame, counts: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Per transaction the maxima and sums of its pools' priors; 0 when it has none.

    `on` adds key columns (such as the fold) to the lookup of priors and counts.
    """
    keys = ["pool", *(on or [])]
    e = tx_pools.join(priors, keys, "left").join(counts, keys, "left")
    agg = e.groupBy("tx_id").agg(
        F.max("touch").alias("prior_touch_max"), F.max("pos_rate").alias("prior_pos_rate_max"), F.sum("pos").alias("prior_pos_sum"),
        F.max("logprofit").alias("prior_logprofit_max"), F.max("n_routes").alias("prior_routes_max"),
        F.sum("n_routes").alias("n_candidate_routes"))
    names = [c for c in agg.columns if c != "tx_id"]
    out = tx.join(agg, "tx_id", "left")
    return out.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in names else F.col(c) for c in out.columns])


def oof_priors(rows: DataFrame, tx_routes: DataFrame, routes: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Priors and route counts of each fold from the other folds.

    `rows`: (tx_id, pool, fold, target3, best_profit); `tx_routes`: (tx_id, route, fold). Sums per (pool, fold) are made
    once; the sums of the other folds come from adding them up again per target fold, without a pass per fold and
    without subtraction.
    """
    target = each(range(k), "target", "int")
    sums = _pool_sums(rows, ["pool", "fold"])
    other = sums.select("*", target).where(F.col("fold") != F.col("target")).groupBy("pool", "target").agg(
        *[F.sum(c).alias(c) for c in ("touch", "pos", "log_sum", "log_n")])
    priors = _finish(other.withColumnRenamed("target", "fold"), ["pool", "fold"])
    sup = tx_routes.select("tx_id", "route", "fold").distinct().groupBy("route", "fold").agg(F.count(F.lit(1)).alias("support"))
    alive = sup.select("*", target).where(F.col("fold") != F.col("target")).select("route", F.col("target").alias("fold")).distinct()
    n = routes.withColumnRenamed("route_id", "route").join(alive, "route").groupBy("pool", "fold").agg(F.count(F.lit(1)).alias("n_routes"))
    return priors, n


def pool_stats(priors: DataFrame, counts: DataFrame) -> DataFrame:
    """Priors and route counts of every pool either side knows."""
    out = priors.join(counts, "pool", "full_outer")
    return out.select("pool", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("touch", "pos")], "pos_rate", "logprofit",
                      F.coalesce("n_routes", F.lit(0)).alias("n_routes"))


def candidates(tx_pools: DataFrame, pool_routes_df: DataFrame) -> DataFrame:
    """(tx, route, support): routes of all pools the transaction names, best support of each."""
    return tx_pools.join(pool_routes_df.select("pool", "route", "support"), "pool").groupBy("tx_id", "route").agg(
        F.max("support").alias("support"))


def rank_candidates(cands: DataFrame, most: int | None = None) -> DataFrame:
    """0-based rank in the transaction by support, then route; with `most` only the first ranks, limited before the shuffle."""
    if most is not None:
        return best_per_key(cands, ["tx_id"], [F.desc("support"), "route"], most, "r")
    w = W.partitionBy("tx_id").orderBy(F.desc("support"), "route")
    return cands.withColumn("r", F.row_number().over(w) - 1)


def hit_rank(ranked: DataFrame, tx_routes: DataFrame) -> DataFrame:
    """First candidate rank that is a profitable route of the transaction."""
    return ranked.join(tx_routes.select("tx_id", "route").distinct(), ["tx_id", "route"]).groupBy("tx_id").agg(F.min("r").alias("hit_rank"))


def has_candidate(tx_pools: DataFrame, counts: DataFrame) -> DataFrame:
    return tx_pools.join(counts, "pool", "left_semi").select("tx_id").distinct()


def packs_of_three(cands: DataFrame, sends: int) -> DataFrame:
    """The top 3*L candidate routes (tx_id, route, support) grouped in L packs of three consecutive ranks."""
    top = rank_candidates(cands, ROUTES_PER_PACK * sends).withColumn("pack", F.floor(F.col("r") / ROUTES_PER_PACK))
    rows = top.groupBy("tx_id", "pack").agg(F.array_sort(F.collect_list(F.struct("r", "route"))).alias("rs"))
    return rows.select("tx_id", "pack", F.array_join(F.transform("rs", lambda x: x["route"]), ",").alias("routes"))


def route_availability(pos: DataFrame, ks) -> DataFrame:
    """Share of positives, and of their value, whose hit rank is below k; `pos` has hit_rank and best_profit."""
    g = pos.agg(F.count(F.lit(1)).alias("positives"), F.sum("best_profit").alias("value"),
                *[count_if(F.col("hit_rank") < k).alias(f"c{k}") for k in ks],
                *[sum_if(F.col("hit_rank") < k, "best_profit").alias(f"v{k}") for k in ks])
    packed = F.array(*[F.struct(F.lit(int(k)).alias("k"), F.col(f"c{k}").alias("covered"), F.col(f"v{k}").alias("v")) for k in ks])
    return g.withColumn("s", F.explode(packed)).select("s.k", "positives", "s.covered", ratio("s.covered", "positives").alias("share"),
                                                       ratio("s.v", "value").alias("value_share"))


def unseen_pools(pos_pools: DataFrame, known: DataFrame, positives: DataFrame) -> DataFrame:
    """Positives that touch no known pool, with their share and value share."""
    touched = pos_pools.join(known.select("pool").distinct(), "pool", "left_semi").select("tx_id").distinct().withColumn("k", F.lit(1))
    x = positives.join(touched, "tx_id", "left")
    new = F.col("k").isNull()
    g = x.agg(F.count(F.lit(1)).alias("positives"), count_if(new).alias("unseen"), sum_if(new, "best_profit").alias("_v"),
              F.sum("best_profit").alias("_t"))
    return g.select("positives", "unseen", ratio("unseen", "positives").alias("share"), ratio("_v", "_t").alias("value_share"))


def known_universe(train_pools: DataFrame, train_routes: DataFrame) -> DataFrame:
    """(pool): pools that train transactions touch, and pools that a route with support in train names."""
    return train_pools.select("pool").unionByName(train_routes.select("pool")).where(F.col("pool").isNotNull()).distinct()


def restrict_lists(tx_pools: DataFrame, universe: DataFrame) -> DataFrame:
    """(tx, pool) rows whose pool is in the universe."""
    return tx_pools.join(universe.select("pool").distinct(), "pool", "left_semi")


def tables_of_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """List columns to one long table (tx_id, list, pool)."""
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).alias("v")) for c in columns]))
    return df.select("tx_id", long.alias("s")).select("tx_id", "s.list", F.explode("s.v").alias("pool"))


def attach_side(tx: DataFrame, side: DataFrame, extras: DataFrame, flag: str) -> DataFrame:
    """Left joins of label and extra columns; `_missing_extras` marks a transaction without extras."""
    marked = extras.withColumn("_has", F.lit(True))
    return tx.join(side, "tx_id", "left").join(marked, "tx_id", "left").withColumn(flag, F.col("_has").isNull()).drop("_has")


def with_extras(df: DataFrame) -> DataFrame:
    """List lengths with null as 0, log1p of amounts, flag to number."""
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    return df.select(
        "*", F.when(F.col("pools_all").isNull(), 0).otherwise(size("pools_all")).alias("n_pools_all"),
        F.when(F.col("pools_writable").isNull(), 0).otherwise(size("pools_writable")).alias("n_pools_writable"),
        F.log1p(F.col("max_swap").cast("double")).alias("log_swap"), F.col("base_in_keys").cast("int").alias("base_flag"))


def ranker_frame(tx: DataFrame, pairs: DataFrame, pack_features: DataFrame) -> DataFrame:
    """Pairs with transaction and pack features; rows of either side that find no partner are counted by `frame_gaps`."""
    return pairs.join(tx, "tx_id").join(pack_features, "pack_id")


def frame_gaps(tx: DataFrame, pairs: DataFrame, pack_features: DataFrame) -> DataFrame:
    a = pairs.join(tx.select("tx_id"), "tx_id", "left_anti").agg(F.count(F.lit(1)).alias("without_tx"))
    b = pairs.join(pack_features.select("pack_id"), "pack_id", "left_anti").agg(F.count(F.lit(1)).alias("without_pack"))
    return beside(a, b)
