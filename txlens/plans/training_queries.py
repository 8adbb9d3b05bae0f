"""Audits that fit or score again: embargo before validation, and the pool universe of training time."""

from __future__ import annotations

from pyspark.sql import functions as F

from txlens.functions.numbers import beside, rounded
from txlens.operators import metrics as M
from txlens.operators import models as MD
from txlens.operators import pools as PO
from txlens.operators import splits as SP
from txlens.plans import label_queries as LQ
from txlens.plans import metric_queries as MQ
from txlens.plans import model_queries as MO
from txlens.plans import pool_queries as PQ
from txlens.plans import standin as S
from txlens.plans.registry import query
from txlens.plans.standin import with_ctes
from txlens.sources import kept as KP

EMBARGO = 0.15


def priors_of(spark, d, split):
    """Pool priors under this assignment (tx_id, slot, split): train rows from the other folds, the rest from all of train."""
    train = split.where(F.col("split") == "train").select("tx_id", "slot")
    folds = SP.with_folds(train, SP.fold_edges(train)).select("tx_id", "fold")
    known = MQ.scored(spark, d).select("tx_id", "target3", "best_profit")
    pools, routes = PQ.tx_pools(spark, d), LQ.tx_routes(spark, d)
    rows = pools.join(known, "tx_id").join(folds, "tx_id")
    by_fold, n_by_fold = PO.oof_priors(rows, routes.join(folds, "tx_id"), PQ.routes_long(spark, d), 5)
    own = PO.attach_priors(folds, pools.join(folds, "tx_id"), by_fold, n_by_fold, ["fold"]).drop("fold")
    alive = PO.pool_route_rows(PO.route_support(routes.join(folds, "tx_id", "left_semi")), PQ.routes_long(spark, d))
    rest = split.where(F.col("split") != "train").select("tx_id")
    return own.unionByName(PO.attach_priors(rest, pools, PO.pool_priors(rows), PO.pool_route_count(alive)))


def embargoed(spark, d):
    t = MQ.split_tx(spark, d).select("tx_id", "slot", "split")
    return SP.embargo(t, SP.embargo_cut(t.where(F.col("split") == "train"), EMBARGO))


S.CTE["embargo_end"] = f"""
  SELECT max(slot) AS c FROM (SELECT slot, row_number() OVER (ORDER BY slot) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT slot FROM split_tx WHERE split = 'train'))
  WHERE rn = trunc(n * (1 - {EMBARGO}::DOUBLE))"""


@query("embargo_refit", with_ctes(f"""
  SELECT split, count(*) AS n, sum(target3)::BIGINT AS positives, {S.r6('avg(target3)')} AS base_rate, max(slot) AS last_slot, true AS above_base, true AS orders_well
  FROM scored, embargo_end WHERE target3 IS NOT NULL AND (split <> 'train' OR slot <= c) GROUP BY split"""))
def q_embargo_refit(spark, d):
    """Everything fitted again on train without its last share of slots: folds, priors, vocabularies, model."""
    keep = embargoed(spark, d)

    def build():
        frame = MO.feature_frame(spark, d, priors_of(spark, d, keep))
        return MO.encoded(frame.join(keep.select("tx_id"), "tx_id", "left_semi"))

    x = KP.kept(spark, "matrix-embargo", {"features": MO.FEATURES, "share": EMBARGO}, MO.inputs(spark, d), build, (*MO.CODE, priors_of))
    m = MO.arb_model(spark, d, x, name="arb-embargo", share=EMBARGO)
    scored = MD.score(m, x.where(F.col("target3").isNotNull()), "p")
    g = M.classifier_summary(scored, "target3", "p", ["split"]).join(scored.groupBy("split").agg(F.max("slot").alias("last_slot")), "split")
    return g.select("split", "n", "positives", rounded("base_rate").alias("base_rate"), "last_slot", (F.col("pr_auc") >= F.col("base_rate") + MO.MARGIN).alias("above_base"),
                    (F.col("roc_auc") >= MO.LEAST_ROC).alias("orders_well"))


@query("universe_rescore", with_ctes(f"""
  WITH {PQ.UNIVERSE_SQL}, n AS (SELECT p.tx_id, count(*) AS n, count(u.pool) AS nf FROM tx_pools p LEFT JOIN u ON u.pool = p.pool GROUP BY p.tx_id)
  SELECT split, (SELECT count(*) FROM u) AS pools_in_universe, count(*) AS n, sum(target3)::BIGINT AS positives, count(*) FILTER (n.n <> n.nf) AS rows_changed, true AS near_baseline
  FROM scored s JOIN n ON n.tx_id = s.tx_id WHERE split <> 'train' AND target3 IS NOT NULL GROUP BY split"""))
def q_universe_rescore(spark, d):
    """The fitted model on val and test whose pool counts know only the pools of training time, beside its skill on all pools."""
    u = PQ.known_universe(spark, d)
    count = PO.restrict_lists(PQ.tx_pools(spark, d), u).groupBy("tx_id").agg(F.count(F.lit(1)).cast("double").alias("nf"))
    x = MO.matrix(spark, d)
    m = MO.arb_model(spark, d, x)
    rows = x.where((F.col("split") != "train") & F.col("target3").isNotNull())
    frozen = rows.join(count, "tx_id", "left").withColumn("nf", F.coalesce("nf", F.lit(0.0)))
    before = M.classifier_summary(MD.score(m, rows, "p"), "target3", "p", ["split"]).select("split", F.col("pr_auc").alias("b"))
    after = M.classifier_summary(MD.score(m, frozen.drop("n_pools").withColumnRenamed("nf", "n_pools"), "p"), "target3", "p", ["split"])
    changed = frozen.groupBy("split").agg(F.sum((F.col("nf") != F.col("n_pools")).cast("bigint")).alias("rows_changed"))
    g = beside(after.join(before, "split").join(changed, "split"), u.agg(F.count(F.lit(1)).alias("pools_in_universe")))
    return g.select("split", "pools_in_universe", "n", "positives", "rows_changed", (F.abs(F.col("pr_auc") - F.col("b")) < MO.MARGIN).alias("near_baseline"))


def fitted_lookup(spark, d):
    """Val and test transactions with the value that the fitted models expect of them, and the hit rank of their candidates."""
    x = MO.matrix(spark, d)
    vt = x.where(F.col("split") != "train")
    scored = MD.score(MO.size_model(spark, d, x), MD.score(MO.arb_model(spark, d, x), vt, "p"), "size").select("tx_id", "p", "size")
    rows = PQ.lookup(spark, d).drop("s", "ev", "p2", "size_pred").join(scored, "tx_id")
    return rows.withColumn("s", MD.ev_score("p", "size"))


@query("budget_grid_fitted", with_ctes(f"""
  WITH n AS (SELECT budget_per_hour, trunc(budget_per_hour * h.val)::BIGINT AS asked FROM (SELECT unnest({list(PQ.BUDGETS)}::DOUBLE[]) AS budget_per_hour), lookup_hours h)
  SELECT budget_per_hour, asked, sends, true AS asked_reached, true AS sends_capture_more, true AS budget_captures_more FROM n, (SELECT unnest([1, 2, 3]) AS sends)"""))
def q_budget_grid_fitted(spark, d):
    """The grid from p x exp(size): thresholds of val at chain-hour budgets. Every threshold lets at least the rows asked for
    through, and neither more sends nor a larger budget captures less."""
    x = fitted_lookup(spark, d)
    hours = PQ.split_hours(MQ.scored(spark, d).where(F.col("split") != "train"))
    g = PQ.budget_grid_of(x, hours)
    rows = {(r.budget_per_hour, r.sends): r for r in g.collect()}  # budgets x sends
    out = []
    for i, b in enumerate(PQ.BUDGETS):
        asked = int(b * hours["val"])
        for k in (1, 2, 3):
            r = rows[b, k]
            less = [rows[b, k - 1]] if k > 1 else []
            smaller = [rows[PQ.BUDGETS[i - 1], k]] if i else []
            reached = round(r.val_decisions_per_hour * hours["val"]) >= asked or r.threshold == float("inf")
            more = lambda others, r=r: all(r[f"{sp}_captured"] >= o[f"{sp}_captured"] or r.threshold == float("inf") for o in others for sp in ("val", "test"))
            out.append((b, asked, k, reached, more(less), more(smaller)))
    return spark.createDataFrame(out, "budget_per_hour double, asked bigint, sends int, asked_reached boolean, sends_capture_more boolean, budget_captures_more boolean")
