"""Pools, routes, priors, candidates, the budgeted lookup policy and its audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from txlens.functions import bits
from txlens.functions.numbers import BASE_FEE, LAMPORTS_PER_COIN, beside, count_if, ratio, rounded, rounded_all, sum_if
from txlens.operators import labels as L
from txlens.operators import metrics as M
from txlens.operators import models as MD
from txlens.operators import policy as P
from txlens.operators import pools as PO
from txlens.operators import splits as SP
from txlens.operators import structure as ST
from txlens.plans import label_queries as LQ
from txlens.plans import metric_queries as MQ
from txlens.plans import standin as S
from txlens.plans.registry import query
from txlens.plans.standin import auc_sql, r6, with_ctes
from txlens.session import materialise

CAP = PO.ROUTE_CAP
KS = (1, 2, 3, 6, 9, 24)

S.CTE["tx_pools"] = "SELECT DISTINCT tx_id, pool FROM trig"
S.CTE["pool_rows"] = """
  SELECT p.tx_id, p.pool, s.split, s.slot, s.target3, s.best_profit FROM tx_pools p JOIN scored s ON s.tx_id = p.tx_id"""
S.CTE["train_support"] = """
  SELECT route, count(DISTINCT r.tx_id) AS support FROM pos_routes r JOIN scored s ON s.tx_id = r.tx_id WHERE s.split = 'train' GROUP BY route"""
S.CTE["pr_all"] = "SELECT pool, i.route, support FROM pool_route_ids i JOIN train_support t ON t.route = i.route"
S.CTE["pr_count"] = "SELECT pool, count(*) AS n_routes FROM pr_all GROUP BY pool"
S.CTE["pr_top"] = f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY support DESC, route) - 1 AS rank FROM pr_all) WHERE rank < {CAP}"""
S.CTE["priors"] = """
  SELECT pool, count(*) AS touch, count(*) FILTER (target3 = 1) AS pos,
         avg(ln(CASE WHEN target3 = 1 AND best_profit > 0 THEN best_profit END)) AS logprofit,
         (count(*) FILTER (target3 = 1) + 0.1::DOUBLE) / (count(*) + 10) AS pos_rate
  FROM pool_rows WHERE split = 'train' GROUP BY pool"""
S.CTE["cand"] = """
  SELECT tx_id, route, support, row_number() OVER (PARTITION BY tx_id ORDER BY support DESC, route) - 1 AS r FROM
    (SELECT p.tx_id, t.route, max(t.support) AS support FROM tx_pools p JOIN pr_top t ON t.pool = p.pool GROUP BY ALL)"""
S.CTE["hits"] = "SELECT c.tx_id, min(r) AS hit_rank FROM cand c JOIN pos_routes p ON p.tx_id = c.tx_id AND p.route = c.route GROUP BY c.tx_id"
S.CTE["lookup"] = """
  SELECT s.*, h.hit_rank, c.tx_id IS NOT NULL AS has_candidate,
         CASE WHEN c.tx_id IS NOT NULL AND encode_status = 0 THEN ev ELSE '-inf'::DOUBLE END AS s
  FROM scored s LEFT JOIN hits h ON h.tx_id = s.tx_id
  LEFT JOIN (SELECT DISTINCT tx_id FROM tx_pools JOIN pr_count USING (pool)) c ON c.tx_id = s.tx_id WHERE s.split <> 'train'"""


def tx_pools(spark, d):
    return S.trig(spark, d).select("tx_id", "pool").distinct()


def routes_long(spark, d):
    return S.pool_route_ids(spark, d).withColumnRenamed("route", "route_id")


def pool_rows(spark, d):
    s = MQ.scored(spark, d).select("tx_id", "split", "slot", "target3", "best_profit")
    return tx_pools(spark, d).join(s, "tx_id")


def train_rows(spark, d):
    return pool_rows(spark, d).where(F.col("split") == "train")


def train_pool_routes(spark, d):
    train = MQ.split_tx(spark, d).where(F.col("split") == "train").select("tx_id")
    sup = PO.route_support(LQ.tx_routes(spark, d).join(train, "tx_id", "left_semi"))
    return PO.pool_route_rows(sup, routes_long(spark, d))


@query("pool_priors", with_ctes(f"SELECT pool, touch, pos, {r6('logprofit')} AS logprofit, {r6('pos_rate')} AS pos_rate FROM priors"))
def q_pool_priors(spark, d):
    return rounded_all(PO.pool_priors(train_rows(spark, d)), ["logprofit", "pos_rate"])


@query("route_support", with_ctes("SELECT route, count(*) AS support FROM pos_routes GROUP BY route"))
def q_route_support(spark, d):
    return PO.route_support(LQ.tx_routes(spark, d))


@query("pool_routes_join", with_ctes("SELECT * FROM pr_all"))
def q_pool_routes_join(spark, d):
    return train_pool_routes(spark, d)


@query("pool_route_count", with_ctes("SELECT * FROM pr_count"))
def q_pool_route_count(spark, d):
    return PO.pool_route_count(train_pool_routes(spark, d))


@query("rank_pool_routes", with_ctes("SELECT * FROM pr_top"))
def q_rank_pool_routes(spark, d):
    return PO.pool_routes(train_pool_routes(spark, d), CAP)


@query("first_n_per_key", with_ctes("""
  SELECT supp, pool, n FROM (SELECT *, row_number() OVER (PARTITION BY supp ORDER BY n DESC, pool) AS rn FROM
    (SELECT supp, pool, count(*) AS n FROM trig GROUP BY ALL)) WHERE rn <= 5"""))
def q_first_n_per_key(spark, d):
    g = S.trig(spark, d).groupBy("supp", "pool").agg(F.count(F.lit(1)).alias("n"))
    w = M.W.partitionBy("supp").orderBy(F.desc("n"), "pool")
    return g.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 5).drop("_r")


PRIOR_SQL = f"""
  SELECT t.tx_id, coalesce(max(touch), 0) AS prior_touch_max, {r6('coalesce(max(pos_rate), 0)')} AS prior_pos_rate_max,
         coalesce(sum(pos), 0) AS prior_pos_sum, {r6('coalesce(max(logprofit), 0)')} AS prior_logprofit_max,
         coalesce(max(n_routes), 0) AS prior_routes_max, coalesce(sum(n_routes), 0) AS n_candidate_routes"""
PRIOR_ROUND = ["prior_pos_rate_max", "prior_logprofit_max"]


@query("attach_priors", with_ctes(f"""{PRIOR_SQL}
  FROM (SELECT tx_id FROM split_tx WHERE split <> 'train') t LEFT JOIN tx_pools e ON e.tx_id = t.tx_id
  LEFT JOIN priors p ON p.pool = e.pool LEFT JOIN pr_count c ON c.pool = e.pool GROUP BY t.tx_id"""))
def q_attach_priors(spark, d):
    t = MQ.split_tx(spark, d).where(F.col("split") != "train").select("tx_id")
    return rounded_all(PO.attach_priors(t, tx_pools(spark, d), PO.pool_priors(train_rows(spark, d)),
                                        PO.pool_route_count(train_pool_routes(spark, d))), PRIOR_ROUND)


@query("oof_priors", with_ctes(f"""
  WITH tf AS (SELECT unnest(range(5))::INT AS target),
  fr AS (SELECT p.*, f.fold FROM pool_rows p JOIN folds f ON f.tx_id = p.tx_id),
  op AS (SELECT pool, target AS fold, count(*) AS touch, count(*) FILTER (target3 = 1) AS pos,
           avg(ln(CASE WHEN target3 = 1 AND best_profit > 0 THEN best_profit END)) AS logprofit,
           (count(*) FILTER (target3 = 1) + 0.1::DOUBLE) / (count(*) + 10) AS pos_rate FROM fr, tf WHERE fold <> target GROUP BY pool, target),
  al AS (SELECT DISTINCT route, target AS fold FROM pos_routes r JOIN folds f ON f.tx_id = r.tx_id, tf WHERE fold <> target),
  oc AS (SELECT pool, fold, count(*) AS n_routes FROM pool_route_ids i JOIN al USING (route) GROUP BY pool, fold)
  {PRIOR_SQL}, t.fold FROM folds t LEFT JOIN tx_pools e ON e.tx_id = t.tx_id
  LEFT JOIN op p ON p.pool = e.pool AND p.fold = t.fold LEFT JOIN oc c ON c.pool = e.pool AND c.fold = t.fold GROUP BY t.tx_id, t.fold"""))
def q_oof_priors(spark, d):
    f = MQ.folded_train(spark, d).select("tx_id", "fold")
    pools = tx_pools(spark, d).join(f, "tx_id")
    rows = train_rows(spark, d).join(f, "tx_id")
    routes = LQ.tx_routes(spark, d).join(f, "tx_id")
    priors, n = PO.oof_priors(rows, routes, routes_long(spark, d), 5)
    return rounded_all(PO.attach_priors(f, pools, priors, n, ["fold"]), PRIOR_ROUND)


@query("pool_stats", with_ctes(f"""
  SELECT coalesce(p.pool, c.pool) AS pool, coalesce(touch, 0) AS touch, coalesce(pos, 0) AS pos, {r6('pos_rate')} AS pos_rate,
         {r6('logprofit')} AS logprofit, coalesce(n_routes, 0) AS n_routes FROM priors p FULL JOIN pr_count c ON c.pool = p.pool"""))
def q_pool_stats(spark, d):
    return rounded_all(PO.pool_stats(PO.pool_priors(train_rows(spark, d)), PO.pool_route_count(train_pool_routes(spark, d))),
                       ["pos_rate", "logprofit"])


def ranked_candidates(spark, d):
    return PO.rank_candidates(PO.candidates(tx_pools(spark, d), PO.pool_routes(train_pool_routes(spark, d), CAP)))


@query("candidate_routes", with_ctes("SELECT tx_id, route, support FROM cand"))
def q_candidate_routes(spark, d):
    return PO.candidates(tx_pools(spark, d), PO.pool_routes(train_pool_routes(spark, d), CAP))


@query("rank_candidates", with_ctes("SELECT tx_id, route, r FROM cand"))
def q_rank_candidates(spark, d):
    return ranked_candidates(spark, d).select("tx_id", "route", "r")


@query("route_hit", with_ctes("SELECT * FROM hits"))
def q_route_hit(spark, d):
    # only a transaction with profitable routes can be hit
    routes = LQ.tx_routes(spark, d)
    pools = tx_pools(spark, d).join(routes.select("tx_id").distinct(), "tx_id", "left_semi")
    return PO.hit_rank(PO.rank_candidates(PO.candidates(pools, PO.pool_routes(train_pool_routes(spark, d), CAP))), routes)


@query("has_candidate", with_ctes("SELECT DISTINCT tx_id FROM tx_pools JOIN pr_count USING (pool)"))
def q_has_candidate(spark, d):
    return PO.has_candidate(tx_pools(spark, d), PO.pool_route_count(train_pool_routes(spark, d)))


@query("top_packs", with_ctes("""
  SELECT tx_id, r // 3 AS pack, string_agg(route, ',' ORDER BY r) AS routes FROM cand WHERE r < 6 GROUP BY tx_id, r // 3"""))
def q_top_packs(spark, d):
    return PO.packs_of_three(q_candidate_routes(spark, d), 2)


@query("route_availability", with_ctes(f"""
  WITH p AS (SELECT s.best_profit, h.hit_rank FROM scored s LEFT JOIN hits h ON h.tx_id = s.tx_id WHERE s.split <> 'train' AND s.target3 = 1)
  SELECT k, count(*) AS positives, count(*) FILTER (hit_rank < k) AS covered, {r6('count(*) FILTER (hit_rank < k) / count(*)')} AS share,
         {r6('coalesce(sum(best_profit) FILTER (hit_rank < k), 0) / sum(best_profit)')} AS value_share
  FROM p, (SELECT unnest([1, 2, 3, 6, 9, 24]) AS k) GROUP BY k"""))
def q_route_availability(spark, d):
    pos = MQ.scored(spark, d).where((F.col("split") != "train") & (F.col("target3") == 1)).select("tx_id", "best_profit")
    return rounded_all(PO.route_availability(pos.join(q_route_hit(spark, d), "tx_id", "left"), KS), ["share", "value_share"])


@query("route_ceiling", with_ctes(f"""
  SELECT split, count(*) AS positives, {r6('avg((n_seen_in_train > 0)::INT)')} AS seen_share,
         {r6('avg((n_covering_live > 0)::INT) FILTER (n_seen_in_train > 0)')} AS covered_given_seen
  FROM (SELECT split, n_seen_in_train, coalesce(n_covering_live, 0) AS n_covering_live FROM scored_cov WHERE target = 1) GROUP BY split"""))
def q_route_ceiling(spark, d):
    seen = F.col("n_seen_in_train") > 0
    cov = (F.coalesce(F.col("n_covering_live"), F.lit(0)) > 0).cast("int")
    return MQ.scored_cov(spark, d).where(F.col("target") == 1).groupBy("split").agg(
        F.count(F.lit(1)).alias("positives"), rounded(F.avg(seen.cast("int"))).alias("seen_share"),
        rounded(F.avg(F.when(seen, cov))).alias("covered_given_seen"))


@query("sweep_crosscheck", with_ctes("""
  WITH own AS (SELECT k, count(*) FILTER (min_cover_rank_live < k) AS own FROM scored_cov, (SELECT unnest([1, 2]) AS k) WHERE target = 1 GROUP BY k)
  , best AS (SELECT tx_id, min(pack_rank) AS r FROM spairs WHERE eligible_live AND pack_target = 1 GROUP BY tx_id)
  SELECT k, own, sweep, own = sweep AS equal FROM own JOIN (SELECT k, count(*) FILTER (r < k) AS sweep FROM best, (SELECT unnest([1, 2]) AS k) GROUP BY k) s USING (k)"""))
def q_sweep_crosscheck(spark, d):
    """Coverage per depth from catalog ranks beside coverage counted from the pairs table."""
    tx, pairs = MQ.both(spark, d)
    own = P.availability(tx, [1, 2]).select("k", F.col("available").alias("own"))
    hit = pairs.where(F.col("eligible_live") & (F.col("pack_target") == 1))
    best = hit.groupBy("tx_id").agg(F.min("pack_rank").alias("r"))
    sweep = best.agg(*[count_if(F.col("r") < k).alias(f"c{k}") for k in (1, 2)]).select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("sweep")) for k in (1, 2)])).alias("s")).select("s.*")
    return own.join(sweep, "k").withColumn("equal", F.col("own") == F.col("sweep"))


def lookup(spark, d):
    """Val and test transactions with the hit rank of their candidates, over route tables built once."""
    routes = materialise(LQ.tx_routes(spark, d).distinct(), "routes")
    sc = MQ.scored(spark, d)
    pools = materialise(tx_pools(spark, d).join(sc.where(F.col("split") != "train").select("tx_id"), "tx_id", "left_semi"), "tx-pools")
    # candidates of those only that have profitable routes: no other transaction can be hit
    wanted = pools.join(routes.select("tx_id").distinct(), "tx_id", "left_semi")
    train = MQ.split_tx(spark, d).where(F.col("split") == "train").select("tx_id")
    rows = materialise(PO.pool_route_rows(PO.route_support(routes.join(train, "tx_id", "left_semi")), routes_long(spark, d)), "pool-routes")
    hits = PO.hit_rank(PO.rank_candidates(PO.candidates(wanted, PO.pool_routes(rows, CAP))), routes)
    cand = PO.has_candidate(pools, rows).withColumn("_c", F.lit(True))
    x = sc.where(F.col("split") != "train").join(hits, "tx_id", "left").join(cand, "tx_id", "left").withColumn(
        "has_candidate", F.coalesce("_c", F.lit(False))).drop("_c")
    return x.withColumn("s", M.score_of(F.col("has_candidate") & (F.col("encode_status") == 0), F.col("ev")))


@query("ev_score", with_ctes(f"""
  SELECT tx_id, {r6('arb_score * exp(size_pred / 4e0)')} AS ev_size, {r6('(landed * 0.5e0 + 0.25e0) * arb_score * exp(size_pred / 4e0)')} AS ev_landing,
         CASE WHEN has_candidate AND encode_status = 0 THEN {r6('arb_score * exp(size_pred / 4e0)')} ELSE '-inf'::DOUBLE END AS s FROM lookup"""))
def q_ev_score(spark, d):
    x = lookup(spark, d).withColumns({"size": F.col("size_pred") / 4.0, "p_land": F.col("landed") * 0.5 + 0.25})
    return x.select("tx_id", rounded(MD.ev_size("arb_score", "size")).alias("ev_size"), rounded(MD.ev_landing("arb_score", "size", "p_land")).alias("ev_landing"),
                    rounded(MD.ev_score("arb_score", "size")).alias("s"))


BUDGETS = (0.01, 0.05, 0.2)

S.CTE["lookup_hours"] = """
  SELECT max(h) FILTER (split = 'val') AS val, max(h) FILTER (split = 'test') AS test FROM (SELECT split, (max(block_time) - min(block_time)) / 3600e0 AS h FROM lookup GROUP BY split)"""
S.CTE["bgrid"] = f"""
  WITH b AS (SELECT unnest({list(BUDGETS)}::DOUBLE[]) AS budget_per_hour), ls AS (SELECT unnest([1, 2, 3]) AS sends),
  vr AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS rn FROM lookup WHERE split = 'val'),
  th AS (SELECT budget_per_hour, CASE WHEN s IS NULL OR isinf(s) THEN 'inf'::DOUBLE ELSE s END AS threshold FROM b, lookup_hours h LEFT JOIN vr ON rn = trunc(budget_per_hour * h.val))
  SELECT budget_per_hour, sends, {r6('threshold')} AS threshold,
    {", ".join(f"""{r6(f"count(*) FILTER (split = '{sp}') / any_value(h.{sp})")} AS {sp}_decisions_per_hour, count(*) FILTER (split = '{sp}' AND ok) AS {sp}_captured,
      {r6(f"coalesce(sum(best_profit) FILTER (split = '{sp}' AND ok), 0) / 1e9 / any_value(h.{sp})", 9)} AS {sp}_coins_per_hour,
      {r6(f"coalesce(sum(best_profit) FILTER (split = '{sp}' AND ok), 0) / 1e9 / any_value(h.{sp}) - count(*) FILTER (split = '{sp}') * sends * 5000 / 1e9 / any_value(h.{sp})", 9)} AS {sp}_net_per_hour"""
      for sp in ("val", "test"))}
  FROM (SELECT th.*, ls.sends, l.split, l.best_profit, coalesce(l.target3 = 1 AND l.hit_rank < 3 * ls.sends, false) AS ok
        FROM th CROSS JOIN ls LEFT JOIN lookup l ON l.s >= th.threshold), lookup_hours h GROUP BY budget_per_hour, sends, threshold"""


def split_hours(x):
    """Chain hours of val and test: two numbers."""
    found = {r["split"]: r["h"] for r in x.groupBy("split").agg(SP.chain_hours().alias("h")).collect()}
    return {sp: found.get(sp, float("nan")) for sp in ("val", "test")}


def budget_grid_of(x, hours, budgets=BUDGETS):
    """Budgets x L for the lookup policy: n-th score thresholds from val, sums per score, one join with the thresholds.

    `x`: val and test rows (split, s, target3, hit_rank, best_profit); `hours` are the chain hours of the splits.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for k in (1, 2, 3):
        ok = (F.col("target3") == 1) & (F.col("hit_rank") < PO.ROUTES_PER_PACK * k)
        aggs += [count_if(ok).alias(f"c{k}"), sum_if(ok, "best_profit").alias(f"v{k}")]
    sums = materialise(x.where(F.col("s") > float("-inf")).groupBy("split", "s").agg(*aggs), "score-sums")
    asked = [int(b * hours["val"]) if hours["val"] == hours["val"] else 0 for b in budgets]
    thr = P.nth_threshold(sums.where(F.col("split") == "val"), "s", sorted(set(asked)), rows="n")
    limits = thr.agg(*[F.coalesce(F.max(F.when(F.col("n_th") == n, F.col("threshold"))), F.lit(float("inf"))).alias(f"t{i}") for i, n in enumerate(asked)])
    parts = [F.max(f"t{i}").alias(f"t{i}") for i in range(len(budgets))]
    for i in range(len(budgets)):
        for sp in ("val", "test"):
            here = (F.col("split") == sp) & (F.col("s") >= F.col(f"t{i}"))
            parts.append(sum_if(here, "n").alias(f"{sp}_n_{i}"))
            for k in (1, 2, 3):
                parts += [sum_if(here, f"c{k}").alias(f"{sp}_c{k}_{i}"), sum_if(here, f"v{k}").alias(f"{sp}_v{k}_{i}")]
    g = beside(sums, limits).agg(*parts)
    cells = F.explode(F.array(*[
        F.struct(F.lit(float(b)).alias("budget_per_hour"), F.lit(k).alias("sends"), F.col(f"t{i}").alias("threshold"),
                 *[F.col(f"{sp}_{m}_{i}").alias(f"{sp}_{n}") for sp in ("val", "test") for m, n in (("n", "n"), (f"c{k}", "c"), (f"v{k}", "v"))])
        for i, b in enumerate(budgets) for k in (1, 2, 3)]))
    out = ["budget_per_hour", "sends", rounded("threshold").alias("threshold")]
    for sp in ("val", "test"):
        h = F.lit(hours[sp])
        coins = F.col(f"{sp}_v") / float(LAMPORTS_PER_COIN) / h
        out += [rounded(F.col(f"{sp}_n") / h).alias(f"{sp}_decisions_per_hour"), F.col(f"{sp}_c").alias(f"{sp}_captured"),
                rounded(coins, 9).alias(f"{sp}_coins_per_hour"),
                rounded(coins - F.col(f"{sp}_n") * F.col("sends") * BASE_FEE / float(LAMPORTS_PER_COIN) / h, 9).alias(f"{sp}_net_per_hour")]
    return g.select(cells.alias("c")).select("c.*").select(*out)


def budget_grid(spark, d):
    x = lookup(spark, d)
    return budget_grid_of(x, split_hours(MQ.scored(spark, d).where(F.col("split") != "train")))


@query("budget_grid", with_ctes("SELECT * FROM bgrid"))
def q_budget_grid(spark, d):
    return budget_grid(spark, d)


@query("threshold_table", with_ctes("""
  SELECT budget_per_hour, threshold, sends, 3 * sends AS routes_per_decision FROM bgrid
  QUALIFY row_number() OVER (PARTITION BY budget_per_hour ORDER BY val_coins_per_hour DESC, sends) = 1"""))
def q_threshold_table(spark, d):
    w = M.W.partitionBy("budget_per_hour").orderBy(F.desc("val_coins_per_hour"), "sends")
    return budget_grid(spark, d).withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(
        "budget_per_hour", "threshold", "sends", (PO.ROUTES_PER_PACK * F.col("sends")).alias("routes_per_decision"))


@query("send_mix", with_ctes(f"""
  SELECT "group", count(*) AS n, {r6('count(*) / sum(count(*)) OVER ()')} AS share FROM lookup WHERE split = 'test' AND s >= 20::DOUBLE GROUP BY "group" """))
def q_send_mix(spark, d):
    g = lookup(spark, d).where((F.col("split") == "test") & (F.col("s") >= 20.0)).groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    return beside(g, g.agg(F.sum("n").alias("_t"))).select("group", "n", rounded(ratio("n", "_t")).alias("share"))


@query("unknown_groups", with_ctes(f"""
  SELECT split, "group", count(*) AS txs, {r6('avg(relevant)')} AS relevant_share, {r6('quantile_cont(arb_score, 0.5)')} AS median_score,
         {r6('avg((arb_score >= 0.5::DOUBLE)::INT)')} AS share_05, {r6('avg((arb_score >= 0.9::DOUBLE)::INT)')} AS share_09
  FROM scored WHERE split <> 'train' GROUP BY split, "group" """))
def q_unknown_groups(spark, d):
    x = MQ.scored(spark, d).where(F.col("split") != "train").select("split", "group", "relevant", "arb_score")
    s = F.col("arb_score")
    g = x.groupBy("split", "group").agg(
        F.count(F.lit(1)).alias("txs"), F.avg("relevant").alias("relevant_share"), F.avg((s >= 0.5).cast("int")).alias("share_05"),
        F.avg((s >= 0.9).cast("int")).alias("share_09"))
    from txlens.functions.ordstat import linear_quantiles
    med = linear_quantiles(x, "arb_score", [0.5], ["split", "group"]).select("split", "group", F.col("value").alias("median_score"))
    return rounded_all(g.join(med, ["split", "group"]), ["relevant_share", "median_score", "share_05", "share_09"])


@query("hidden_estimate", with_ctes(f"""
  WITH t AS (SELECT * FROM scored WHERE split = 'test' AND relevant = 1),
  e AS (SELECT DISTINCT unnest(quantile_cont(arb_score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM t WHERE target IS NOT NULL),
  b AS (SELECT t.*, (SELECT count(*) FROM e WHERE edge < t.arb_score) AS bin FROM t),
  lab AS (SELECT bin, avg(target) AS pr, avg(best_profit) FILTER (target = 1) AS mp FROM b WHERE target IS NOT NULL GROUP BY bin),
  un AS (SELECT bin, unknown_reasons, count(*) AS u FROM b WHERE label = 'UNKNOWN' GROUP BY ALL)
  SELECT unknown_reasons, sum(u) AS unknown, {r6('sum(u * pr)')} AS est_hidden, {r6('sum(u * pr * mp / 1e9)', 9)} AS est_hidden_value
  FROM un LEFT JOIN lab USING (bin) GROUP BY unknown_reasons"""))
def q_hidden_estimate(spark, d):
    from txlens.functions.ordstat import quantile_list
    t = MQ.scored(spark, d).where((F.col("split") == "test") & (F.col("relevant") == 1))
    edges = quantile_list(t.where(F.col("target").isNotNull()), "arb_score", [i / 10 for i in range(1, 10)])
    b = t.withColumn("bin", SP.cut_bin("arb_score", edges))
    lab = b.where(F.col("target").isNotNull()).groupBy("bin").agg(F.avg("target").alias("pr"), F.avg(F.when(F.col("target") == 1, F.col("best_profit"))).alias("mp"))
    un = b.where(F.col("label") == "UNKNOWN").groupBy("bin", "unknown_reasons").agg(F.count(F.lit(1)).alias("u"))
    hid = F.col("u") * F.col("pr")
    return un.join(lab, "bin", "left").groupBy("unknown_reasons").agg(
        F.sum("u").alias("unknown"), rounded(F.sum(hid)).alias("est_hidden"),
        rounded(F.sum(hid * F.col("mp") / float(LAMPORTS_PER_COIN)), 9).alias("est_hidden_value"))


@query("time_chunks", with_ctes(f"""
  WITH x AS (SELECT * FROM lookup WHERE split = 'test'),
  q AS (SELECT quantile_cont(slot, 0.25) AS q1, quantile_cont(slot, 0.5) AS q2, quantile_cont(slot, 0.75) AS q3 FROM x),
  c AS (SELECT x.*, (slot >= q1)::INT + (slot >= q2)::INT + (slot >= q3)::INT AS chunk FROM x, q)
  SELECT a.chunk, {r6('a.pr_auc')} AS pr_auc, v.positives, {r6('v.value_share')} AS value_share FROM ({auc_sql('c', 'target3', 'arb_score', 'chunk')}) a JOIN
    (SELECT chunk, count(*) FILTER (target3 = 1) AS positives,
            coalesce(sum(best_profit) FILTER (target3 = 1 AND s >= 10::DOUBLE AND hit_rank < 9), 0) / sum(best_profit) FILTER (target3 = 1) AS value_share
     FROM c GROUP BY chunk) v ON v.chunk = a.chunk"""))
def q_time_chunks(spark, d):
    """Chunks are left-closed with a closed last one, so an edge belongs to the chunk that starts there."""
    from txlens.functions.ordstat import quantile_list
    x = materialise(lookup(spark, d).where(F.col("split") == "test"), "test-rows")
    q = quantile_list(x, "slot", [0.25, 0.5, 0.75])
    c = x.withColumn("chunk", sum(((F.col("slot") >= e).cast("int") for e in q), F.lit(0)))
    auc = M.classifier_summary(c, "target3", "arb_score", ["chunk"]).select("chunk", "pr_auc")
    pos = F.col("target3") == 1
    v = c.groupBy("chunk").agg(count_if(pos).alias("positives"),
                               ratio(sum_if(pos & (F.col("s") >= 10.0) & (F.col("hit_rank") < 9), "best_profit"), sum_if(pos, "best_profit")).alias("value_share"))
    return rounded_all(auc.join(v, "chunk"), ["pr_auc", "value_share"])


@query("unseen_pools", with_ctes(f"""
  WITH known AS (SELECT DISTINCT pool FROM pool_rows WHERE split = 'train' AND pool % 3 > 0),
  p AS (SELECT s.tx_id, s.best_profit, s.tx_id NOT IN (SELECT tx_id FROM tx_pools WHERE pool IN (SELECT pool FROM known)) AS new
        FROM scored s WHERE split = 'test' AND target3 = 1)
  SELECT count(*) AS positives, count(*) FILTER (new) AS unseen, {r6('count(*) FILTER (new) / count(*)')} AS share,
         {r6('coalesce(sum(best_profit) FILTER (new), 0) / sum(best_profit)')} AS value_share FROM p"""))
def q_unseen_pools(spark, d):
    known = train_rows(spark, d).where(F.col("pool") % 3 > 0)
    pos = MQ.scored(spark, d).where((F.col("split") == "test") & (F.col("target3") == 1)).select("tx_id", "best_profit")
    return rounded_all(PO.unseen_pools(tx_pools(spark, d).join(pos, "tx_id", "left_semi"), known, pos), ["share", "value_share"])


#: Pools of training time: those of train rows (one in five is taken as new, so that there are any) and those that train routes name.
UNIVERSE_SQL = """u AS (SELECT DISTINCT pool FROM pool_rows WHERE split = 'train' AND pool % 5 <> 0 UNION SELECT DISTINCT pool FROM pr_all WHERE pool % 15 = 0)"""


def known_universe(spark, d):
    return PO.known_universe(train_rows(spark, d).where(F.col("pool") % 5 != 0), train_pool_routes(spark, d).where(F.col("pool") % 15 == 0))


@query("restrict_universe", with_ctes(f"""
  WITH {UNIVERSE_SQL}
  SELECT s.tx_id, count(u.pool) AS n_pools FROM (SELECT tx_id FROM split_tx WHERE split <> 'train') s LEFT JOIN tx_pools p ON p.tx_id = s.tx_id
  LEFT JOIN u ON u.pool = p.pool GROUP BY s.tx_id"""))
def q_restrict_universe(spark, d):
    n = PO.restrict_lists(tx_pools(spark, d), known_universe(spark, d)).groupBy("tx_id").agg(F.count(F.lit(1)).alias("n"))
    t = MQ.split_tx(spark, d).where(F.col("split") != "train").select("tx_id")
    return t.join(n, "tx_id", "left").select("tx_id", F.coalesce("n", F.lit(0)).alias("n_pools"))


@query("universe_freeze", with_ctes(f"""
  WITH {UNIVERSE_SQL},
  n AS (SELECT tx_id, count(*) AS n, count(*) FILTER (pool IN (SELECT pool FROM u)) AS nf FROM tx_pools GROUP BY tx_id),
  x AS (SELECT s.target3, arb_score * n AS before, arb_score * nf AS after FROM scored s JOIN n ON n.tx_id = s.tx_id WHERE s.split = 'test')
  SELECT 'before' AS universe, n, positives, {r6('pr_auc')} AS pr_auc FROM ({auc_sql('x', 'target3', 'before')})
  UNION ALL SELECT 'frozen', n, positives, {r6('pr_auc')} FROM ({auc_sql('x', 'target3', 'after')})"""))
def q_universe_freeze(spark, d):
    """Skill with pool counts over all pools beside pool counts over pools known in train."""
    u = known_universe(spark, d).withColumn("k", F.lit(1))
    n = tx_pools(spark, d).join(u, "pool", "left").groupBy("tx_id").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("nf"))
    x = MQ.scored(spark, d).where(F.col("split") == "test").select("tx_id", "target3", "arb_score").join(n, "tx_id")
    long = x.select("target3", F.explode(F.array(
        F.struct(F.lit("before").alias("universe"), (F.col("arb_score") * F.col("n")).alias("p")),
        F.struct(F.lit("frozen").alias("universe"), (F.col("arb_score") * F.col("nf")).alias("p")))).alias("s")).select("target3", "s.*")
    return rounded_all(M.classifier_summary(long, "target3", "p", ["universe"]).select("universe", "n", "positives", "pr_auc"), ["pr_auc"])


@query("gate_variants", with_ctes("""
  WITH g AS (SELECT tx_id, count(*) FILTER (writable) AS mw, count(*) FILTER (supp % 4 = 0) AS vp FROM trig GROUP BY tx_id)
  SELECT g.tx_id, relevant = 1 AS relevant, mw > 0 AS writes, mw > 0 OR vp > 0 AS writes_or_program FROM g JOIN tx USING (tx_id)"""))
def q_gate_variants(spark, d):
    return gates(spark, d).select("tx_id", *[ST.gate(n).alias(n) for n in ST.GATES])


def gates(spark, d):
    g = S.trig(spark, d).groupBy("tx_id").agg(count_if(F.col("writable")).alias("market_writable"),
                                              count_if(F.col("supp") % 4 == 0).alias("venue_program"))
    return g.join(S.tx(spark, d).select("tx_id", "relevant"), "tx_id")


@query("gate_pass", with_ctes(f"""
  WITH g AS (SELECT tx_id, count(*) FILTER (writable) AS mw, count(*) FILTER (supp % 4 = 0) AS vp FROM trig GROUP BY tx_id)
  SELECT "group", count(*) AS txs, {r6('avg(relevant)')} AS pass_relevant, {r6('avg((mw > 0)::INT)')} AS pass_writes,
         {r6('avg((mw > 0 OR vp > 0)::INT)')} AS pass_writes_or_program FROM scored s JOIN g ON g.tx_id = s.tx_id WHERE split = 'test' GROUP BY "group" """))
def q_gate_pass(spark, d):
    x = MQ.scored(spark, d).where(F.col("split") == "test").select("tx_id", "group").join(gates(spark, d), "tx_id")
    return x.groupBy("group").agg(F.count(F.lit(1)).alias("txs"),
                                  *[rounded(F.avg(ST.gate(n).cast("int"))).alias(f"pass_{n}") for n in ST.GATES])


S.CTE["extras"] = """
  SELECT tx_id, list_sort(list(DISTINCT pool::VARCHAR)) AS pools_all, list_sort(list(DISTINCT pool::VARCHAR) FILTER (writable)) AS pools_writable,
         list_sort(list(DISTINCT pool::VARCHAR) FILTER (layer = 'TOP_LEVEL')) AS pools_static, count(*) FILTER (supp % 2 = 0) AS n_swaps,
         coalesce(max(amount) FILTER (supp % 2 = 0), 0) AS max_swap, count(*) FILTER (supp % 5 = 0) AS n_router,
         coalesce(max(amount) FILTER (supp % 5 = 0), 0) AS max_router, count(*) FILTER (pool % 97 = 0) > 0 AS base_in_keys FROM trig GROUP BY tx_id"""


def extras(spark, d):
    """Pools are the accounts a row names; a row of every 97th pool also names the base account."""
    t = S.trig(spark, d)
    keys = t.select("tx_id", F.col("pool").cast("string").alias("account"), (F.col("layer") == "TOP_LEVEL").alias("is_static"), "writable")
    keys = keys.unionByName(t.where(F.col("pool") % 97 == 0).select("tx_id", F.lit("BASE").alias("account"), F.lit(True).alias("is_static"), F.lit(False).alias("writable")))
    ixs = [t.where(F.col("supp") % n == 0).select("tx_id", F.lit(kind).alias("kind"), "amount") for kind, n in (("swap", 2), ("router", 5))]
    pools = S.table(spark, d, "part").select(F.col("p_partkey").alias("pool"))
    return ST.extras(keys, ixs[0].unionByName(ixs[1]), pools, "BASE")


@query("extras", with_ctes("""
  SELECT tx_id, array_to_string(pools_all, ',') AS pools_all, coalesce(array_to_string(pools_writable, ','), '') AS pools_writable,
         coalesce(array_to_string(pools_static, ','), '') AS pools_static, n_swaps, max_swap, n_router, max_router, base_in_keys FROM extras"""))
def q_extras(spark, d):
    e = extras(spark, d)
    return e.select(*[F.array_join(c, ",").alias(c) if c.startswith("pools") else F.col(c) for c in e.columns])


@query("log_extras", with_ctes(f"""
  SELECT t.tx_id, coalesce(len(pools_all), 0) AS n_pools_all, coalesce(len(pools_writable), 0) AS n_pools_writable,
         {r6('ln(1 + max_swap)')} AS log_swap, base_in_keys::INT AS base_flag FROM tx t LEFT JOIN extras e ON e.tx_id = t.tx_id"""))
def q_log_extras(spark, d):
    x = S.tx(spark, d).select("tx_id").join(extras(spark, d), "tx_id", "left")
    return PO.with_extras(x).select("tx_id", "n_pools_all", "n_pools_writable", rounded("log_swap").alias("log_swap"), "base_flag")


@query("tx_side_extras", with_ctes("""
  SELECT t.tx_id, l.label, e.n_swaps, e.tx_id IS NULL AS missing_extras FROM tx t LEFT JOIN labels l ON l.tx_id = t.tx_id
  LEFT JOIN extras e ON e.tx_id = t.tx_id"""))
def q_tx_side_extras(spark, d):
    side = L.tx_labels(S.trig(spark, d)).select("tx_id", "label")
    return PO.attach_side(S.tx(spark, d).select("tx_id"), side, extras(spark, d).select("tx_id", "n_swaps"), "missing_extras")


@query("ranker_frame", with_ctes("""
  SELECT p.tx_id, p.pack_id, p.pack_target, t.amount, k.gain, k.family FROM pairs p JOIN tx t ON t.tx_id = p.tx_id JOIN packs k ON k.pack_id = p.pack_id"""))
def q_ranker_frame(spark, d):
    return PO.ranker_frame(S.tx(spark, d).select("tx_id", "amount"), LQ.pairs(spark, d).select("tx_id", "pack_id", "pack_target"),
                           S.packs(spark, d).select("pack_id", "gain", "family"))


@query("ranker_frame_gaps", with_ctes("""
  SELECT (SELECT count(*) FROM pairs WHERE tx_id NOT IN (SELECT tx_id FROM tx)) AS without_tx,
         (SELECT count(*) FROM pairs WHERE pack_id NOT IN (SELECT pack_id FROM packs)) AS without_pack"""))
def q_ranker_frame_gaps(spark, d):
    return PO.frame_gaps(S.tx(spark, d), LQ.pairs(spark, d), S.packs(spark, d))


@query("instruction_amounts", with_ctes("""
  WITH i AS (SELECT event_id, substr(sha256('global:' || event_type), 1, 16) AS disc, lower(printf('%016x', event_id * 1000003 + user_id)) AS h FROM events),
  l AS (SELECT *, substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS little FROM i)
  SELECT disc, count(*) AS n, sum(('0x' || h)::UBIGINT)::DOUBLE AS amount, min(little) AS first_bytes FROM l GROUP BY disc"""))
def q_instruction_amounts(spark, d):
    """Instruction data (discriminator, then an amount) read back by byte offset, summed per discriminator."""
    e = S.table(spark, d, "events")
    digits = F.lower(F.lpad(F.hex((F.col("event_id") * 1000003 + F.col("user_id")).cast("bigint")), 16, "0"))
    little = F.concat(*[F.substring(digits, i, 2) for i in range(15, 0, -2)])
    data = F.concat(bits.discriminator(F.col("event_type")), F.unhex(little))
    ix = e.select(F.lower(F.hex(F.substring(data, 1, 8))).alias("disc"), bits.u64_at(data, 8).alias("amount"), little.alias("little"))
    return ix.groupBy("disc").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("amount"), F.min("little").alias("first_bytes"))
