"""Classifier, calibration, ranking and value metrics. Nothing here sorts a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from txlens.functions import ordstat
from txlens.functions.numbers import count_if, each, ratio, sum_if, wilson_bounds
from txlens.operators.splits import cut_bin
from txlens.session import materialise

# Fixed values
TOP_FRACTIONS = (0.5, 0.2, 0.1, 0.05, 0.02, 0.01)


def classifier_summary(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """n, positives, base rate, average precision and ROC-AUC (null unless both classes occur)."""
    c = ordstat.cumulate(df.where(F.col(y).isNotNull()), p, {"n": F.count(F.lit(1)), "pos": F.sum(F.col(y).cast("bigint"))},
                         by, desc=True)
    step = F.col("pos") / F.col("tot_pos") * (F.col("cum_pos") / F.col("cum_n"))
    rank = F.col("tot_n") - F.col("cum_n") + (F.col("n") + 1) / 2.0
    aggs = [F.sum("n").alias("n"), F.sum("pos").alias("positives"), F.sum(F.when(F.col("tot_pos") > 0, step)).alias("_ap"),
            F.sum(F.col("pos") * rank).alias("_s")]
    g = c.groupBy(*by).agg(*aggs) if by else c.agg(*aggs)
    n1 = F.col("positives").cast("double")
    n0 = F.col("n") - n1
    both = (n1 > 0) & (n0 > 0)
    return g.select(*by, "n", "positives", ratio("positives", "n").alias("base_rate"), F.when(both, F.col("_ap")).alias("pr_auc"),
                    F.when(both, (F.col("_s") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("roc_auc"))


def threshold_for_precision(df: DataFrame, y: str, p: str, target: float, min_positives: int = 1) -> DataFrame:
    """Lowest score with precision >= target and enough true positives; null when there is none."""
    c = ordstat.cumulate(df, p, {"n": F.count(F.lit(1)), "pos": F.sum(F.col(y).cast("bigint"))}, desc=True)
    ok = (F.col("cum_pos") / F.col("cum_n") >= target) & (F.col("cum_pos") >= min_positives)
    return c.agg(F.min(F.when(ok, F.col(p))).alias("threshold"))


def confusion(df: DataFrame, y: str, p: str, t) -> DataFrame:
    sel, pos = F.col(p) >= t, F.col(y) == 1
    neg = F.col(y) == 0
    g = df.agg(count_if(sel & pos).alias("tp"), count_if(sel & neg).alias("fp"), count_if(~sel & pos).alias("fn"),
               count_if(~sel & neg).alias("tn"))
    return g.select("*", ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
                    ratio("tp", F.col("tp") + F.col("fn")).alias("recall"), (F.col("tp") + F.col("fp")).alias("selected"))


def calibration_quantile(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Quantile bins of the prediction (equal edges merged): size, mean prediction, observed rate."""
    edges = ordstat.quantile_list(df, p, [i / bins for i in range(1, bins)])
    return df.groupBy(cut_bin(p, edges, "bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("observed"))


def calibration_fixed(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Equal-width left-closed bins over [0, 1)."""
    b = F.floor(F.col(p) * bins).cast("int")
    inside = df.where((F.col(p) >= 0) & (F.col(p) < 1))
    return inside.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("landed"))


def selectivity(df: DataFrame, y: str, p: str, key: str, fractions=TOP_FRACTIONS) -> DataFrame:
    """Precision and recall of the top fraction by score; rows with equal scores are taken in key order.

    Only the tie group at each cut is looked at by key, so the rest of the table is touched by score sums alone.
    """
    c = ordstat.cumulate(df, p, {"n": F.count(F.lit(1)), "pos": F.sum(F.col(y).cast("bigint"))}, desc=True)
    want = F.greatest(F.lit(1), F.rint(F.col("tot_n") * F.col("top_frac")).cast("bigint"))
    at = (c.select("*", each(fractions, "top_frac")).withColumn("sent", want)
          .where((F.col("cum_n") >= F.col("sent")) & (F.col("cum_n") - F.col("n") < F.col("sent")))
          .select("top_frac", "sent", F.col(p).alias("min_score"), (F.col("cum_pos") - F.col("pos")).alias("_above"),
                  (F.col("sent") - (F.col("cum_n") - F.col("n"))).alias("_take"), "tot_pos"))
    ties = df.select(key, y, F.col(p).alias("min_score")).join(F.broadcast(at.select("top_frac", "min_score", "_take")), "min_score")
    inside = ordstat.cumulate(ties, key, {"n": F.count(F.lit(1)), "pos": F.sum(F.col(y).cast("bigint")), "take": F.max("_take")},
                              ["top_frac"])
    part = inside.groupBy("top_frac").agg(F.sum(F.when(F.col("cum_n") <= F.col("take"), F.col("pos"))).alias("_part"))
    out = at.join(part, "top_frac")
    tp = F.col("_above") + F.coalesce("_part", F.lit(0))
    return out.select("top_frac", "sent", "min_score", tp.alias("tp"), ratio(tp, "sent").alias("precision"),
                      ratio(tp, F.greatest(F.lit(1), F.col("tot_pos"))).alias("recall"))


def rank_within(df: DataFrame, score: str, key: str = "tx_id", ties: Sequence[str] = ("pack_id",), name: str = "rank") -> DataFrame:
    """1 = best score of the transaction; equal scores in the order of `ties`."""
    w = W.partitionBy(key).orderBy(F.desc(score), *[F.col(t) for t in ties])
    return df.withColumn(name, F.row_number().over(w))


def topk_coverage(df: DataFrame, score: str, ks=(1, 2, 3)) -> DataFrame:
    """Over transactions that some eligible pack covers: is one of the top k a covering pack?"""
    r = rank_within(df, score)
    hit = F.col("pack_target") == 1
    per = r.groupBy("tx_id").agg(F.max("pack_target").alias("cov"), F.min(F.when(hit, F.col("rank"))).alias("first_hit"),
                                 F.count(F.lit(1)).alias("n"))
    ok = F.col("cov") == 1
    return per.agg(F.count(F.lit(1)).alias("transactions"), count_if(ok).alias("coverable"),
                   *[F.avg(F.when(ok, (F.col("first_hit") <= k).cast("int"))).alias(f"top{k}") for k in ks],
                   F.avg(F.when(ok, 1.0 / F.col("first_hit"))).alias("mrr"), F.avg(F.when(ok, F.col("n"))).alias("mean_eligible"))


def size_quality(df: DataFrame, actual: str, predicted: str, train_mean: float) -> DataFrame:
    """Rank correlation, log error against the train-mean baseline, share of the top 1% found in the predicted top 5%."""
    df = materialise(df.select(actual, predicted), "sizes")  # everything below reads this
    a_cut = ordstat.quantile_list(df, actual, [0.99])[0]
    p_cut = ordstat.quantile_list(df, predicted, [0.95])[0]
    # a row without one of the two values has no rank there and stays out of the correlation only
    ranked = df.join(ordstat.average_ranks(df, actual, "_ra"), actual, "left").join(ordstat.average_ranks(df, predicted, "_rp"), predicted, "left")
    err = F.col(predicted) - F.col(actual)
    base = F.lit(train_mean) - F.col(actual)
    top = F.col(actual) >= a_cut
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_rp", "_ra").alias("spearman"), F.sqrt(F.avg(err * err)).alias("rmse"),
                      F.sqrt(F.avg(base * base)).alias("baseline_rmse"),
                      F.avg(F.when(top, (F.col(predicted) >= p_cut).cast("int"))).alias("top1_in_top5"))


def landing_summary(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """n, landed rate, ROC-AUC of landing, average precision of failure, Brier score: all from one pass over the scores.

    Failure is ranked by falling scores, so its running counts are what the counts of landing leave of the totals.
    """
    land = F.col(y).cast("bigint")
    sq = (F.col(y) - F.col(p)) * (F.col(y) - F.col(p))
    c = ordstat.cumulate(df.where(F.col(y).isNotNull()), p, {"n": F.count(F.lit(1)), "pos": F.sum(land), "sq": F.sum(sq)}, by, desc=True)
    rank = F.col("tot_n") - F.col("cum_n") + (F.col("n") + 1) / 2.0
    fail, tot_fail = F.col("n") - F.col("pos"), F.col("tot_n") - F.col("tot_pos")
    below_n = F.col("tot_n") - F.col("cum_n") + F.col("n")
    below_fail = below_n - (F.col("tot_pos") - F.col("cum_pos") + F.col("pos"))
    step = F.when(tot_fail > 0, fail / tot_fail * (below_fail / below_n))
    aggs = [F.sum("n").alias("n"), F.sum("pos").alias("_pos"), F.sum(F.col("pos") * rank).alias("_s"), F.sum(step).alias("_ap"), F.sum("sq").alias("_sq")]
    g = c.groupBy(*by).agg(*aggs) if by else c.agg(*aggs)
    n1 = F.col("_pos").cast("double")
    n0 = F.col("n") - n1
    both = (n1 > 0) & (n0 > 0)
    return g.select(*by, "n", ratio("_pos", "n").alias("landed_rate"), F.when(both, (F.col("_s") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("roc_auc"), ratio(n0, "n").alias("fail_base_rate"),
                    F.when(both, F.col("_ap")).alias("fail_pr_auc"), (F.col("_sq") / F.col("n")).alias("brier"))


def gate_tradeoff(df: DataFrame, y: str, p: str, cutoffs: Sequence[float]) -> DataFrame:
    """Per cut-off: share kept, landed rate of the kept, failures removed, landed lost."""
    # Distinct scores first, so the cut-offs multiply only those.
    per = df.groupBy(p).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))
    kept = F.col(p) >= F.col("cutoff")
    g = per.select("*", each(cutoffs, "cutoff")).groupBy("cutoff").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), sum_if(kept, "n").alias("kn"), sum_if(kept, "pos").alias("kp"))
    fails = F.col("n") - F.col("pos")
    kept_fails = F.col("kn") - F.col("kp")
    return g.select("cutoff", ratio("kn", "n").alias("kept"), ratio("kp", "kn").alias("landed_rate_kept"),
                    ((fails - kept_fails) / F.greatest(F.lit(1), fails)).alias("failures_removed"),
                    ((F.col("pos") - F.col("kp")) / F.greatest(F.lit(1), F.col("pos"))).alias("landed_lost"))


def feature_auc(df: DataFrame, y: str, features: Sequence[str]) -> DataFrame:
    """AUC of every single feature, folded to at least 0.5 with its direction; constant features are left out."""
    long = df.select(y, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(-1e300)), F.lit(-1e300)).alias("value"))
        for f in features])).alias("s")).select(y, "s.feature", "s.value")
    spread = classifier_summary(long, y, "value", ["feature"])
    varied = long.groupBy("feature").agg((F.min("value") < F.max("value")).alias("v")).where("v").drop("v")
    a = F.col("roc_auc")
    return (spread.join(varied, "feature").where(a.isNotNull())
            .select("feature", F.greatest(a, 1 - a).alias("auc"), F.when(a >= 0.5, "+").otherwise("-").alias("direction")))


def with_interval(df: DataFrame, k: str, n: str, prefix: str) -> DataFrame:
    lo, hi = wilson_bounds(k, n)
    return df.withColumn(f"{prefix}_lo", lo).withColumn(f"{prefix}_hi", hi)


def score_of(flag: Column, score: Column) -> Column:
    """Score where the flag holds, minus infinity elsewhere."""
    return F.when(flag, score).otherwise(F.lit(float("-inf")))
