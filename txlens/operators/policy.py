"""Decision policies: availability, top-L hits, thresholds under a send budget, outcome of every positive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from txlens.functions import ordstat
from txlens.functions.numbers import BASE_FEE, LAMPORTS_PER_COIN, count_if, each, ratio, sum_if, wilson_bounds
from txlens.session import materialise

NEG_INF = float("-inf")
POS_INF = float("inf")


def availability(tx: DataFrame, ks: Sequence[int], rank: str = "min_cover_rank_live") -> DataFrame:
    """Share of positives with a covering pack of rank < k, for each k, in one pass."""
    pos = F.col("target") == 1
    one = tx.agg(count_if(pos).alias("positives"), *[count_if(pos & (F.col(rank) < k)).alias(f"a{k}") for k in ks])
    rows = one.select("positives", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"a{k}").alias("available"))
                                                        for k in ks])).alias("s")).select("s.k", "positives", "s.available")
    lo, hi = wilson_bounds("available", "positives")
    return rows.select("*", ratio("available", "positives").alias("availability"), lo.alias("lo"), hi.alias("hi"))


def ranked(pairs: DataFrame, score: str, depth: int) -> DataFrame:
    """Live pairs under a depth with `sel` = 1 for the best; ties by catalog rank, then pack."""
    w = W.partitionBy("tx_id").orderBy(F.desc(score), "pack_rank", "pack_id")
    return pairs.where(F.col("eligible_live") & (F.col("pack_rank") < depth)).withColumn("sel", F.row_number().over(w))


def conditional_topk(pairs: DataFrame, score: str, depth: int, sends: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Top-L success over positives that a live pack at this depth covers."""
    r = ranked(pairs.where(F.col("label") == "POSITIVE"), score, depth)
    per = r.groupBy("tx_id").agg(F.min(F.when(F.col("pack_target") == 1, F.col("sel"))).alias("first_hit"),
                                 F.count(F.lit(1)).alias("n"))
    hit = F.col("first_hit")
    g = per.where(hit.isNotNull()).agg(
        F.count(F.lit(1)).alias("coverable"), F.avg("n").alias("mean_eligible"), F.avg(1.0 / hit).alias("mrr"),
        *[count_if(hit <= k).alias(f"hits{k}") for k in sends])
    cols = []
    for k in sends:
        lo, hi = wilson_bounds(f"hits{k}", "coverable")
        cols += [ratio(f"hits{k}", "coverable").alias(f"top{k}"), lo.alias(f"top{k}_lo"), hi.alias(f"top{k}_hi")]
    return g.select("coverable", "mean_eligible", "mrr", *cols)


def per_tx(tx: DataFrame, ranked_pairs: DataFrame, sends: int, depth: int, joint: str | None) -> DataFrame:
    """Each transaction with its top-L hit, number of pairs, best joint score and coverable flag."""
    r = ranked_pairs
    if joint:
        r = r.join(tx.select("tx_id", "arb_score"), "tx_id")
    by = r.groupBy("tx_id").agg(
        F.max(F.when(F.col("sel") <= sends, F.coalesce("pack_target", F.lit(0))).otherwise(0)).alias("_hit"),
        F.count(F.lit(1)).alias("_n"),
        (F.max(F.col(joint) * F.col("arb_score")) if joint else F.lit(None).cast("double")).alias("joint"))
    return tx.join(by, "tx_id", "left").select(
        tx["*"], F.coalesce("_hit", F.lit(0)).alias("hit"), F.coalesce("_n", F.lit(0)).alias("n_pairs"), "joint",
        F.coalesce(F.col("min_cover_rank_live") < depth, F.lit(False)).alias("coverable"))


def decision_score(rule: str) -> Column:
    """What the threshold applies to; minus infinity when the rule can never send."""
    if rule not in ("two_stage", "joint"):
        raise ValueError(rule)
    s = F.col("arb_score" if rule == "two_stage" else "joint")
    return F.coalesce(F.when((F.col("relevant") == 1) & (F.col("n_pairs") > 0), s), F.lit(NEG_INF))


def budget_threshold(df: DataFrame, score: str, weight: str, budgets: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Lowest score whose cumulative weight stays within each budget; ties are never split; infinity when none fits."""
    ok = df.where((F.col(score) > NEG_INF) & (F.col(score) < POS_INF) & ~F.isnan(score) & (F.col(weight) > 0))
    c = ordstat.cumulate(ok, score, {"w": F.sum(weight)}, by, desc=True)
    found = c.select("*", each(budgets, "budget")).groupBy(*by, "budget").agg(
        F.min(F.when(F.col("cum_w") <= F.col("budget"), F.col(score))).alias("threshold"))
    keys = (df.select(*by).distinct() if by else df.sparkSession.range(1)).select(*by, each(budgets, "budget"))
    return keys.join(found, [*by, "budget"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(POS_INF)))


def nth_threshold(df: DataFrame, score: str, ns: Sequence[int], by: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """The n-th highest score; infinity when n is out of range or the score is not finite.

    `rows` names a column that says how many rows a line stands for, when `df` is already summed by score.
    """
    c = ordstat.cumulate(df, score, {"n": F.sum(rows) if rows else F.count(F.lit(1))}, by, desc=True)
    found = c.select("*", each(ns, "n_th", "bigint")).groupBy(*by, "n_th").agg(
        F.max(F.when((F.col("cum_n") >= F.col("n_th")) & (F.col("n_th") > 0), F.col(score))).alias("_t"))
    t = F.col("_t")
    return found.select(*by, "n_th", F.when(t.isNotNull() & (t > NEG_INF) & (t < POS_INF), t).otherwise(F.lit(POS_INF)).alias("threshold"))


def _stages(rule: str, threshold) -> tuple[Column, Column, Column]:
    encoded = F.col("encode_status") == 0
    gate = encoded & (F.col("relevant") == 1)
    s = F.coalesce(F.col("arb_score" if rule == "two_stage" else "joint"), F.lit(NEG_INF))
    return encoded, gate, s >= threshold


def outcome(rule: str, threshold) -> Column:
    """The one outcome of a positive: encoder, gate, threshold, coverage, ranking, success, in this order."""
    encoded, gate, passed = _stages(rule, threshold)
    return (F.when(~encoded, "encoder_unsupported").when(~gate, "relevance_gate").when(~passed, "threshold")
            .when(~F.col("coverable"), "no_covering_pack").when(F.col("hit") == 0, "ranking").otherwise("success"))


def evaluate(d: DataFrame, rule: str, threshold: float, hours: float) -> DataFrame:
    """Send volume, precision, recall and the outcome of every positive; `d` is per_tx with `weight`."""
    x = d.withColumn("_s", decision_score(rule)).withColumn("_o", F.when(F.col("target") == 1, outcome(rule, threshold)))
    sent, pos = F.col("_s") >= threshold, F.col("target") == 1
    lab = sent & F.col("target").isNotNull()
    kinds = ["encoder_unsupported", "relevance_gate", "threshold", "no_covering_pack", "ranking", "success"]
    g = x.agg(
        sum_if(sent, "weight").cast("double").alias("sends_weighted"), count_if(lab).alias("sends_labelled"),
        F.avg(F.when(lab, F.col("target"))).alias("precision_arb"),
        F.avg(F.when(lab, F.col("hit") * F.col("target"))).alias("precision_capture"),
        count_if(pos).alias("positives"), count_if(pos & sent).alias("sent_positives"),
        count_if(pos & F.col("coverable")).alias("covered_positives"),
        *[count_if(F.col("_o") == k).alias("succeeded" if k == "success" else f"miss_{k}") for k in kinds])
    lo, hi = wilson_bounds("succeeded", "positives")
    reached = F.col("succeeded") + F.col("miss_ranking")
    return g.select(
        "sends_weighted", "sends_labelled", "precision_arb", "precision_capture", "positives", "succeeded",
        *[f"miss_{k}" for k in kinds if k != "success"],
        ratio("sends_weighted", F.lit(hours)).alias("sends_per_hour"),
        (1 - ratio("sends_labelled", "sends_weighted")).alias("unknown_share"),
        ratio("sent_positives", "positives").alias("positive_recall"),
        ratio("covered_positives", "positives").alias("availability"),
        ratio("succeeded", reached).alias("hit_given_reached"),
        ratio("succeeded", "positives").alias("end_to_end_recall"), lo.alias("recall_lo"), hi.alias("recall_hi"))


def conditional_success(d: DataFrame, rule: str, threshold: float) -> DataFrame:
    """Success rate of positives in seven overlapping subsets; each row is expanded to the subsets it is in."""
    encoded = F.col("encode_status") == 0
    rel = F.col("relevant") == 1
    seen = F.col("n_seen_in_train") > 0
    subsets = [("all", F.lit(True)), ("covering pack exists", F.col("coverable")), ("route seen in train", seen),
               ("route not seen in train", ~seen), ("gate passes", encoded & rel), ("gate fails", encoded & ~rel),
               ("cannot be parsed", ~encoded)]
    x = d.where(F.col("target") == 1).withColumn("ok", (outcome(rule, threshold) == "success").cast("int"))
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in subsets]), lambda v: v.isNotNull())
    g = x.select("ok", F.explode(names).alias("subset")).groupBy("subset").agg(
        F.count(F.lit(1)).alias("positives"), F.sum("ok").alias("succeeded"))
    lo, hi = wilson_bounds("succeeded", "positives")
    return g.select("*", ratio("succeeded", "positives").alias("rate"), lo.alias("lo"), hi.alias("hi"))


def funnel(tx: DataFrame, pairs: DataFrame, score: str, threshold: float, k: int) -> DataFrame:
    """Positives by outcome with pack availability first: no pack, gate, classifier, ranker, success."""
    w = W.partitionBy("tx_id").orderBy(F.desc(score), "pack_id")
    top = pairs.where(F.col("eligible_live")).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    hit = top.groupBy("tx_id").agg(F.max("pack_target").alias("_hit"))
    x = tx.join(hit, "tx_id", "left").withColumn("hit", F.coalesce("_hit", F.lit(0)))
    has = F.coalesce(F.col("n_covering_live") > 0, F.lit(False))
    gate, good = F.col("relevant") == 1, F.col("arb_score") >= threshold
    o = (F.when(~has, "no_candidate_pack").when(~gate, "relevance_gate").when(~good, "classifier")
         .when(F.col("hit") == 0, "ranker").otherwise("success"))
    pos = F.col("target") == 1
    sent = gate & good & (F.coalesce(F.col("n_eligible_live"), F.lit(0)) > 0)
    lab = sent & F.col("target").isNotNull()
    kinds = ["no_candidate_pack", "relevance_gate", "classifier", "ranker"]
    g = x.withColumn("_o", F.when(pos, o)).agg(
        count_if(pos).alias("positives"), *[count_if(F.col("_o") == n).alias(f"miss_{n}") for n in kinds],
        count_if(F.col("_o") == "success").alias("succeeded"), count_if(sent).alias("sends_all"),
        count_if(lab).alias("sends_labelled"), F.avg(F.when(lab, F.col("target"))).alias("send_precision"),
        F.avg(F.when(lab, F.col("hit"))).alias("send_precision_pack"))
    with_pack = F.col("positives") - F.col("miss_no_candidate_pack")
    reached = F.col("succeeded") + F.col("miss_ranker")
    lo, hi = wilson_bounds("succeeded", "positives")
    return g.select("*", ratio(with_pack, "positives").alias("pack_availability"), ratio(reached, with_pack).alias("recall_given_pack"),
                    ratio("succeeded", reached).alias("topk_given_sent"), ratio("succeeded", "positives").alias("end_to_end_recall"),
                    lo.alias("recall_lo"), hi.alias("recall_hi"))


def captured(d: DataFrame, threshold: float, score: str = "ev") -> DataFrame:
    """Number and value of positives whose send succeeds at a threshold."""
    ok = ((F.col("target") == 1) & (F.col("encode_status") == 0) & (F.col("relevant") == 1) & (F.col(score) >= threshold)
          & F.col("coverable") & (F.col("hit") == 1))
    return d.agg(count_if(ok).alias("captured"), sum_if(ok, "best_profit").alias("value"))


def policy_grid(tx: DataFrame, pairs: DataFrame, rank_score: str, policies: Sequence[tuple[str, str, str]],
                depths: Sequence[int], sends: Sequence[int], budgets: Sequence[float], hours: dict) -> DataFrame:
    """Policy x depth x L x budget: thresholds fitted on val, volume and value on val and test.

    `policies` are (name, rule, score column). Pairs are ranked once per depth; every policy, L and budget is then read
    from sums per (policy, depth, split, score), so the grid never multiplies transactions by budgets or L.
    """
    spark = tx.sparkSession
    live = pairs.where(F.col("eligible_live")).select("tx_id", "pack_id", "pack_rank", "pack_target", rank_score)
    # a transaction's pairs in their order, once; a depth is the part of them that the catalog ranks below it
    pair = F.struct(F.coalesce(-F.col(rank_score), F.lit(POS_INF)).alias("s"), "pack_rank", "pack_id", (F.coalesce(F.col("pack_target"), F.lit(0)) == 1).alias("hit"))
    listed = live.where(F.col("pack_rank") < max(depths)).groupBy("tx_id").agg(F.sort_array(F.collect_list(pair)).alias("_pairs"))
    deep = listed.withColumn("depth", F.explode(F.array(*[F.lit(int(x)) for x in depths])))
    deep = deep.withColumn("_pairs", F.filter("_pairs", lambda p: p["pack_rank"] < F.col("depth"))).where(F.size("_pairs") > 0)
    first = F.array_position(F.transform("_pairs", lambda p: p["hit"]), True).cast("int")
    by = deep.select("tx_id", "depth", F.size("_pairs").alias("n_pairs"), F.when(F.col("_pairs")[0]["s"] < POS_INF, -F.col("_pairs")[0]["s"]).alias("best_rank"), F.when(first > 0, first).alias("first_hit"))
    x = (tx.where(F.col("split").isin("val", "test")).join(by, "tx_id")
         .withColumn("coverable", F.coalesce(F.col("min_cover_rank_live") < F.col("depth"), F.lit(False))))
    options = F.array(*[F.struct(F.lit(n).alias("policy"), (F.col(s) * F.col("best_rank") if r == "joint" else F.col(s)).alias("s"))
                        for n, r, s in policies])
    x = x.where(F.col("relevant") == 1).withColumn("_p", F.explode(options)).select("*", "_p.policy", "_p.s").drop("_p")
    good = (F.col("target") == 1) & (F.col("encode_status") == 0) & F.col("coverable")
    aggs = [F.sum("weight").alias("w"), F.count("target").alias("lab")]
    for k in sends:
        win = good & (F.col("first_hit") <= k)
        aggs += [count_if(win).alias(f"c{k}"), sum_if(win, "best_profit").alias(f"v{k}")]
    sums = materialise(x.groupBy("policy", "depth", "split", "s").agg(*aggs), "policy-sums")  # everything below reads this
    val = sums.where((F.col("split") == "val") & (F.col("w") > 0))
    limits = [b * hours["val"] for b in budgets]
    thr = budget_threshold(val, "s", "w", limits, ["policy", "depth"])
    per_hour = F.broadcast(spark.createDataFrame(list(zip(limits, [float(b) for b in budgets])), "budget double, budget_per_hour double"))
    thr = thr.join(per_hour, "budget").drop("budget")
    sent = sums.join(F.broadcast(thr), ["policy", "depth"])  # policies x depths x budgets rows
    keep = F.col("s") >= F.col("threshold")
    aggs = []
    for sp in ("val", "test"):
        here = keep & (F.col("split") == sp)
        aggs += [sum_if(here, "w").cast("double").alias(f"{sp}_w"), sum_if(here, "lab").alias(f"{sp}_lab")]
        for k in sends:
            aggs += [sum_if(here, f"c{k}").alias(f"{sp}_c{k}"), sum_if(here, f"v{k}").alias(f"{sp}_v{k}")]
    g = sent.groupBy("policy", "depth", "budget_per_hour", "threshold").agg(*aggs)
    packed = F.array(*[F.struct(F.lit(int(k)).alias("sends"), *[F.col(f"{sp}_{m}{k}").alias(f"{sp}_{n}")
                                                               for sp in ("val", "test") for m, n in (("c", "captured"), ("v", "value"))])
                       for k in sends])
    g = g.withColumn("_s", F.explode(packed)).select("*", "_s.*").drop("_s")
    out = ["policy", "depth", "sends", "budget_per_hour", "threshold"]
    for sp in ("val", "test"):
        h = float(hours[sp])
        coins = F.col(f"{sp}_value") / float(LAMPORTS_PER_COIN) / h
        rate = F.col(f"{sp}_w") / h
        out += [f"{sp}_captured", rate.alias(f"{sp}_sends_per_hour"), coins.alias(f"{sp}_coins_per_hour"),
                (coins - rate * (BASE_FEE / LAMPORTS_PER_COIN)).alias(f"{sp}_net_per_hour"),
                (1 - F.col(f"{sp}_lab") / F.greatest(F.lit(1.0), F.col(f"{sp}_w"))).alias(f"{sp}_unknown_share")]
    return g.select(*out)


def operating_points(grid: DataFrame, value: str = "val_coins_per_hour") -> DataFrame:
    """Best row of each policy and budget on validation; ties go to fewer sends, then smaller depth."""
    w = W.partitionBy("policy", "budget_per_hour").orderBy(F.desc(value), "sends", "depth")
    return grid.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
