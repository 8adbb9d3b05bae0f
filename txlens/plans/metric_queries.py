"""Splits, classifier metrics, ranking metrics and decision policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from txlens.functions import bits, ordstat
from txlens.functions.numbers import rounded, rounded_all, wilson_bounds
from txlens.operators import labels as L
from txlens.operators import metrics as M
from txlens.operators import policy as P
from txlens.operators import splits as SP
from txlens.plans import label_queries as LQ
from txlens.plans import standin as S
from txlens.plans.registry import query
from txlens.plans.standin import SAMPLE_PPM, auc_sql, r6, with_ctes


def bounds(spark, d):
    return SP.slot_boundaries(S.tx(spark, d).select("slot"))


def split_tx(spark, d):
    return SP.assign_split(S.tx(spark, d), bounds(spark, d))


def with_scores(df):
    base = (F.pmod(F.col("tx_id") * 7919, F.lit(211)) + F.when(F.col("n_pos") > 0, 40).otherwise(0) + F.col("n_occurrences")) / 300.0
    return (df.withColumn("arb_score", base).withColumn("p2", F.col("amount") % 1000003 / 1000003.0)
            .withColumn("size_pred", (F.col("amount") % 7919 + F.col("n_occurrences")) / 1000.0)
            .withColumn("ev", F.col("arb_score") * F.col("amount") / 1000000.0)
            .withColumn("pair_sample", ((F.col("label") == "UNKNOWN") & bits.sampled(F.col("tx_id"), SAMPLE_PPM)).cast("int"))
            .withColumn("weight", L.sample_weight(SAMPLE_PPM)))


def scored(spark, d):
    return SP.assign_split(with_scores(LQ.grouped(spark, d)), bounds(spark, d))


def scored_cov(spark, d, st=None):
    st = st or LQ.Stages(spark, d)
    b = bounds(spark, d)
    s = SP.assign_split(with_scores(st.grouped()), b)
    cov = L.cover_rank(st.eligible, st.cover)
    train = SP.assign_split(S.tx(spark, d), b).where(F.col("split") == "train").select("tx_id")
    seen = st.routes.join(st.routes.join(train, "tx_id", "left_semi").select("route").distinct(), "route", "left_semi").groupBy("tx_id").agg(
        F.count(F.lit(1)).alias("n_seen_in_train"))
    return s.join(cov, "tx_id", "left").join(seen, "tx_id", "left").withColumn(
        "n_seen_in_train", F.coalesce("n_seen_in_train", F.lit(0)))


def scored_pairs(spark, d, st=None):
    st = st or LQ.Stages(spark, d)
    gain = S.packs(spark, d).select("pack_id", "gain")
    return st.pairs().join(gain, "pack_id").withColumn("static", -F.col("pack_rank").cast("double")).withColumn(
        "learned", F.pmod(F.col("tx_id") * 31 + F.col("gain") * 17, F.lit(101)) / 101.0)


def both(spark, d):
    """Scored transactions and scored pairs over the same stages."""
    st = LQ.Stages(spark, d)
    return scored_cov(spark, d, st), scored_pairs(spark, d, st)


# ---------------------------------------------------------------- splits

@query("slot_boundaries", with_ctes("""
  SELECT 'train' AS split, first_slot AS lo, train_hi AS hi FROM bounds
  UNION ALL SELECT 'val', (SELECT min(slot) FROM tx WHERE slot > train_hi), val_hi FROM bounds
  UNION ALL SELECT 'test', (SELECT min(slot) FROM tx WHERE slot > val_hi), last_slot FROM bounds"""))
def q_slot_boundaries(spark, d):
    return SP.bounds_frame(spark, bounds(spark, d))


@query("assign_split", with_ctes("SELECT split, count(*) AS n, sum(tx_id) AS id_sum FROM split_tx GROUP BY split"))
def q_assign_split(spark, d):
    return split_tx(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("tx_id").alias("id_sum"))


@query("landing_split", with_ctes("""
  WITH cuts AS (SELECT max(slot) FILTER (rn = trunc(n * 0.7::DOUBLE) + 1) AS c1, max(slot) FILTER (rn = trunc(n * 0.85::DOUBLE) + 1) AS c2 FROM slot_list)
  SELECT CASE WHEN slot < c1 THEN 'train' WHEN slot < c2 THEN 'val' ELSE 'test' END AS split, count(*) AS n, min(slot) AS lo, max(slot) AS hi
  FROM tx, cuts GROUP BY 1"""))
def q_landing_split(spark, d):
    t = S.tx(spark, d)
    return SP.landing_split(t, SP.landing_cuts(t)).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"))


S.CTE["fold_edges"] = """
  SELECT quantile_cont(slot, 0.2) AS e1, quantile_cont(slot, 0.4) AS e2, quantile_cont(slot, 0.6) AS e3, quantile_cont(slot, 0.8) AS e4
  FROM split_tx WHERE split = 'train'"""
S.CTE["folds"] = """
  SELECT t.*, (slot > e1)::INT + (slot > e2)::INT + (slot > e3)::INT + (slot > e4)::INT AS fold
  FROM split_tx t, fold_edges WHERE split = 'train'"""


def folded_train(spark, d):
    train = split_tx(spark, d).where(F.col("split") == "train")
    return SP.with_folds(train, SP.fold_edges(train))


@query("slot_folds", with_ctes("SELECT fold, count(*) AS n, min(slot) AS lo, max(slot) AS hi FROM folds GROUP BY fold"))
def q_slot_folds(spark, d):
    return folded_train(spark, d).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("lo"), F.max("slot").alias("hi"))


@query("split_disjoint", with_ctes("""
  SELECT split, min(slot) AS lo, max(slot) AS hi,
         coalesce(lag(max(slot)) OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) >= min(slot), false) AS overlaps_previous,
         (SELECT count(*) FROM (SELECT tx_id FROM split_tx GROUP BY tx_id HAVING count(DISTINCT split) > 1)) AS ids_in_two_splits
  FROM split_tx GROUP BY split"""))
def q_split_disjoint(spark, d):
    return SP.split_problems(split_tx(spark, d))


@query("split_table", with_ctes(f"""
  SELECT split, count(*) AS rows, count(*) FILTER (relevant = 1) AS relevant, count(target) AS labelled,
         count(*) FILTER (target = 1) AS positives, count(*) FILTER (target = 1 AND relevant = 1) AS relevant_positives,
         {r6('(max(block_time) - min(block_time)) / 3600e0')} AS hours FROM scored GROUP BY split"""))
def q_split_table(spark, d):
    return rounded_all(SP.split_table(scored(spark, d)), ["hours"])


@query("chain_hours", with_ctes(f"""
  SELECT slot % 400 AS slot_group, CASE WHEN count(block_time) < 2 THEN 'nan'::DOUBLE ELSE {r6('(max(block_time) - min(block_time)) / 3600e0')} END AS hours
  FROM tx GROUP BY 1"""))
def q_chain_hours(spark, d):
    return S.tx(spark, d).groupBy((F.col("slot") % 400).alias("slot_group")).agg(rounded(SP.chain_hours()).alias("hours"))


@query("slot_range", with_ctes("SELECT tx_id, slot FROM tx WHERE slot BETWEEN 300 AND 420"))
def q_slot_range(spark, d):
    return S.tx(spark, d).where(F.col("slot").between(300, 420)).select("tx_id", "slot")


@query("embargo", with_ctes("""
  WITH ts AS (SELECT slot, row_number() OVER (ORDER BY slot) AS rn, count(*) OVER () AS n
              FROM (SELECT DISTINCT slot FROM split_tx WHERE split = 'train')),
       cut AS (SELECT max(slot) AS c FROM ts WHERE rn = trunc(n * (1 - 0.15::DOUBLE)))
  SELECT split, count(*) AS n, max(slot) AS hi FROM split_tx, cut WHERE split <> 'train' OR slot <= c GROUP BY split"""))
def q_embargo(spark, d):
    t = split_tx(spark, d)
    cut = SP.embargo_cut(t.where(F.col("split") == "train"), 0.15)
    return SP.embargo(t, cut).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("hi"))


@query("global_windows", with_ctes("""
  SELECT split, min(slot) AS slot_lo, max(slot) AS slot_hi, min(id) AS id_lo, max(id) AS id_hi, count(*) AS n,
         coalesce(lag(max(id)) OVER (ORDER BY min(slot)) >= min(id), false) AS ids_overlap
  FROM (SELECT split, slot, slot * 1099511627776 + tx_id AS id FROM split_tx) GROUP BY split"""))
def q_global_windows(spark, d):
    b = bounds(spark, d)
    ids = S.tx(spark, d).select((F.shiftleft(F.col("slot"), 40) + F.col("tx_id")).alias("tx_id"), "slot")
    return SP.id_windows(ids, b)


@query("partition_order", with_ctes("""
  SELECT part, count(*) FILTER (slot < prev) AS backward_steps, count(*) AS n FROM
    (SELECT tx_id % 64 AS part, slot, lag(slot) OVER (PARTITION BY tx_id % 64 ORDER BY tx_id) AS prev FROM tx) GROUP BY part"""))
def q_partition_order(spark, d):
    return SP.slots_going_back(S.tx(spark, d).select("tx_id", "slot", (F.col("tx_id") % 64).alias("part")), "part")


# ---------------------------------------------------------------- classifier metrics

AUC_COLS = f"n, positives, {r6('base_rate')} AS base_rate, {r6('pr_auc')} AS pr_auc, {r6('roc_auc')} AS roc_auc"


@query("classifier_summary", with_ctes(f"SELECT split, {AUC_COLS} FROM ({auc_sql('scored', 'target', 'arb_score', 'split')})"))
def q_classifier_summary(spark, d):
    return rounded_all(M.classifier_summary(scored(spark, d), "target", "arb_score", ["split"]), ["base_rate", "pr_auc", "roc_auc"])


@query("classifier_summary_unique", with_ctes(f"SELECT {AUC_COLS} FROM ({auc_sql('scored', 'target3', 'p2')})"))
def q_classifier_summary_unique(spark, d):
    return rounded_all(M.classifier_summary(scored(spark, d), "target3", "p2"), ["base_rate", "pr_auc", "roc_auc"])


@query("precision_threshold", with_ctes(f"""
  SELECT {r6('min(s)')} AS threshold FROM (SELECT s, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn FROM
    (SELECT arb_score AS s, count(*) AS n, sum(target) AS pos FROM scored WHERE target IS NOT NULL GROUP BY arb_score))
  WHERE cp / cn >= 0.9::DOUBLE AND cp >= 20"""))
def q_precision_threshold(spark, d):
    return rounded_all(M.threshold_for_precision(scored(spark, d).where(F.col("target").isNotNull()), "target", "arb_score", 0.9, 20), ["threshold"])


@query("confusion_at", with_ctes(f"""
  SELECT tp, fp, fn, tn, {r6('tp / (tp + fp)')} AS precision, {r6('tp / (tp + fn)')} AS recall, tp + fp AS selected FROM
    (SELECT count(*) FILTER (s AND target = 1) AS tp, count(*) FILTER (s AND target = 0) AS fp,
            count(*) FILTER (NOT s AND target = 1) AS fn, count(*) FILTER (NOT s AND target = 0) AS tn
     FROM (SELECT arb_score >= 0.5::DOUBLE AS s, target FROM scored))"""))
def q_confusion(spark, d):
    return rounded_all(M.confusion(scored(spark, d), "target", "arb_score", 0.5), ["precision", "recall"])


@query("calibration_quantile", with_ctes(f"""
  WITH lab AS (SELECT target, p2 FROM scored WHERE target IS NOT NULL),
       e AS (SELECT DISTINCT unnest(quantile_cont(p2, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM lab),
       b AS (SELECT target, p2, (SELECT count(*) FROM e WHERE edge < p2) AS bin FROM lab)
  SELECT bin, count(*) AS n, {r6('avg(p2)')} AS mean_pred, {r6('avg(target)')} AS observed FROM b GROUP BY bin"""))
def q_calibration_quantile(spark, d):
    lab = scored(spark, d).where(F.col("target").isNotNull())
    return rounded_all(M.calibration_quantile(lab, "target", "p2"), ["mean_pred", "observed"])


@query("calibration_fixed", with_ctes(f"""
  SELECT floor(p2 * 10)::INT AS bin, count(*) AS n, {r6('avg(landed)')} AS landed FROM scored GROUP BY 1"""))
def q_calibration_fixed(spark, d):
    return rounded_all(M.calibration_fixed(scored(spark, d), "landed", "p2"), ["landed"])


@query("selectivity", with_ctes(f"""
  WITH o AS (SELECT target, arb_score, row_number() OVER (ORDER BY arb_score DESC, tx_id) AS rn, count(*) OVER () AS n, sum(target) OVER () AS pos
             FROM scored WHERE target IS NOT NULL),
       f AS (SELECT unnest([0.5::DOUBLE, 0.2, 0.1, 0.05, 0.02, 0.01]) AS top_frac)
  SELECT top_frac, max(greatest(1, round_even(n * top_frac, 0)))::BIGINT AS sent, {r6('min(arb_score)')} AS min_score, sum(target) AS tp,
         {r6('sum(target) / max(greatest(1, round_even(n * top_frac, 0)))')} AS precision, {r6('sum(target) / max(greatest(1, pos))')} AS recall
  FROM o, f WHERE rn <= greatest(1, round_even(n * top_frac, 0)) GROUP BY top_frac"""))
def q_selectivity(spark, d):
    lab = scored(spark, d).where(F.col("target").isNotNull())
    return rounded_all(M.selectivity(lab, "target", "arb_score", "tx_id"), ["min_score", "precision", "recall"])


def wilson_sql(k: str, n: str) -> tuple[str, str]:
    z2 = "3.8416e0"
    c = f"(({k}) / ({n})::DOUBLE + {z2} / (2 * ({n}))) / (1 + {z2} / ({n}))"
    h = f"1.96e0 * sqrt(({k}) / ({n})::DOUBLE * (1 - ({k}) / ({n})::DOUBLE) / ({n}) + {z2} / (4e0 * ({n}) * ({n}))) / (1 + {z2} / ({n}))"
    return (f"CASE WHEN ({n}) > 0 THEN {r6(c + ' - ' + h)} END", f"CASE WHEN ({n}) > 0 THEN {r6(c + ' + ' + h)} END")


WLO, WHI = wilson_sql("k", "n")


@query("wilson", with_ctes(f"""
  SELECT slot_group, k, n, {WLO} AS lo, {WHI} AS hi FROM
    (SELECT slot % 97 AS slot_group, count(*) FILTER (target = 1) AS k, count(target) AS n FROM scored GROUP BY 1)"""))
def q_wilson(spark, d):
    g = scored(spark, d).groupBy((F.col("slot") % 97).alias("slot_group")).agg(
        F.count_if(F.coalesce(F.col("target") == 1, F.lit(False))).alias("k"), F.count("target").alias("n"))
    lo, hi = wilson_bounds("k", "n")
    return g.select("*", rounded(lo).alias("lo"), rounded(hi).alias("hi"))


@query("budget_threshold", with_ctes(f"""
  WITH c AS (SELECT s, sum(w) OVER (ORDER BY s DESC) AS cw FROM (SELECT arb_score AS s, sum(weight) AS w FROM scored WHERE weight > 0 AND relevant = 1 GROUP BY 1)),
       b AS (SELECT unnest([0.5::DOUBLE, 100, 1000, 2500, 100000]) AS budget)
  SELECT budget, {r6("coalesce(min(s), 'inf'::DOUBLE)")} AS threshold FROM b LEFT JOIN c ON cw <= budget GROUP BY budget"""))
def q_budget_threshold(spark, d):
    s = scored(spark, d).withColumn("s", M.score_of(F.col("relevant") == 1, F.col("arb_score")))
    return rounded_all(P.budget_threshold(s, "s", "weight", [0.5, 100, 1000, 2500, 100000]), ["threshold"])


@query("nth_threshold", with_ctes(f"""
  WITH o AS (SELECT CASE WHEN relevant = 1 THEN arb_score ELSE '-inf'::DOUBLE END AS s FROM scored WHERE split = 'val'),
       r AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS rn FROM o), b AS (SELECT unnest([0, 1, 50, 700, 2000, 10000000]) AS n_th)
  SELECT n_th::BIGINT AS n_th, {r6("CASE WHEN s IS NULL OR isinf(s) THEN 'inf'::DOUBLE ELSE s END")} AS threshold
  FROM b LEFT JOIN r ON rn = n_th"""))
def q_nth_threshold(spark, d):
    s = scored(spark, d).where(F.col("split") == "val").withColumn("s", M.score_of(F.col("relevant") == 1, F.col("arb_score")))
    return rounded_all(P.nth_threshold(s, "s", [0, 1, 50, 700, 2000, 10000000]), ["threshold"])


@query("average_rank", with_ctes("""
  SELECT n_occurrences AS value, avg(rn) AS rank FROM (SELECT n_occurrences, row_number() OVER (ORDER BY n_occurrences) AS rn FROM labels) GROUP BY 1"""))
def q_average_rank(spark, d):
    return ordstat.average_ranks(L.tx_labels(S.trig(spark, d)).withColumnRenamed("n_occurrences", "value"), "value", "rank")


@query("size_quality", with_ctes(f"""
  WITH p AS (SELECT tx_id, split, ln(best_profit) AS a, size_pred AS q FROM scored WHERE target = 1 AND best_profit > 0),
       t AS (SELECT * FROM p WHERE split = 'test'),
       ra AS (SELECT a, avg(rn) AS r FROM (SELECT a, row_number() OVER (ORDER BY a) AS rn FROM t) GROUP BY a),
       rq AS (SELECT q, avg(rn) AS r FROM (SELECT q, row_number() OVER (ORDER BY q) AS rn FROM t) GROUP BY q)
  SELECT count(*) AS n, {r6('corr(ra.r, rq.r)')} AS spearman, {r6('sqrt(avg((t.q - t.a) * (t.q - t.a)))')} AS rmse,
         {r6('sqrt(avg((m.m - t.a) * (m.m - t.a)))')} AS baseline_rmse,
         {r6('avg(CASE WHEN t.a >= c.ac THEN (t.q >= c.qc)::INT END)')} AS top1_in_top5
  FROM t JOIN ra ON ra.a = t.a JOIN rq ON rq.q = t.q, (SELECT avg(a) AS m FROM p WHERE split = 'train') m,
       (SELECT quantile_cont(a, 0.99) AS ac, quantile_cont(q, 0.95) AS qc FROM t) c"""))
def q_size_quality(spark, d):
    p = scored(spark, d).where((F.col("target") == 1) & (F.col("best_profit") > 0)).withColumn("a", F.log("best_profit"))
    mean = p.where(F.col("split") == "train").agg(F.avg("a")).first()[0]
    return rounded_all(M.size_quality(p.where(F.col("split") == "test"), "a", "size_pred", mean),
                       ["spearman", "rmse", "baseline_rmse", "top1_in_top5"])


@query("encoder_coverage", with_ctes(f"""
  SELECT label, count(*) AS n, count(*) FILTER (encode_status <> 0) AS failed, {r6('avg((encode_status <> 0)::INT)')} AS share FROM grouped GROUP BY label"""))
def q_encoder_coverage(spark, d):
    bad = F.col("encode_status") != 0
    return LQ.grouped(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("failed"),
                                                     rounded(F.avg(bad.cast("int"))).alias("share"))


# ---------------------------------------------------------------- ranking and policy

@query("rank_packs", with_ctes("SELECT tx_id, pack_id, row_number() OVER (PARTITION BY tx_id ORDER BY learned DESC, pack_id) AS rank FROM spairs"))
def q_rank_packs(spark, d):
    return M.rank_within(scored_pairs(spark, d), "learned").select("tx_id", "pack_id", "rank")


@query("rank_live_packs", with_ctes("""
  SELECT tx_id, pack_id, row_number() OVER (PARTITION BY tx_id ORDER BY static DESC, pack_rank, pack_id) AS sel
  FROM spairs WHERE eligible_live AND pack_rank < 2"""))
def q_rank_live_packs(spark, d):
    return P.ranked(scored_pairs(spark, d), "static", 2).select("tx_id", "pack_id", "sel")


@query("topk_coverage", with_ctes(f"""
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY learned DESC, pack_id) AS rk FROM spairs),
       per AS (SELECT tx_id, max(pack_target) AS cov, min(rk) FILTER (pack_target = 1) AS fh, count(*) AS n FROM r GROUP BY tx_id)
  SELECT count(*) AS transactions, count(*) FILTER (cov = 1) AS coverable, {r6('avg((fh <= 1)::INT) FILTER (cov = 1)')} AS top1,
         {r6('avg((fh <= 2)::INT) FILTER (cov = 1)')} AS top2, {r6('avg((fh <= 3)::INT) FILTER (cov = 1)')} AS top3,
         {r6('avg(1e0 / fh) FILTER (cov = 1)')} AS mrr, {r6('avg(n) FILTER (cov = 1)')} AS mean_eligible FROM per"""))
def q_topk_coverage(spark, d):
    return rounded_all(M.topk_coverage(scored_pairs(spark, d), "learned"), ["top1", "top2", "top3", "mrr", "mean_eligible"])


HITS = ", ".join(f"{r6(f'count(*) FILTER (fh <= {k}) / count(*)')} AS top{k}, {wilson_sql(f'count(*) FILTER (fh <= {k})', 'count(*)')[0]} AS top{k}_lo, "
                 f"{wilson_sql(f'count(*) FILTER (fh <= {k})', 'count(*)')[1]} AS top{k}_hi" for k in (1, 2, 3))


@query("conditional_topk", with_ctes(f"""
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY learned DESC, pack_rank, pack_id) AS rk FROM spairs
             WHERE eligible_live AND pack_rank < 2 AND label = 'POSITIVE'),
       per AS (SELECT tx_id, min(rk) FILTER (pack_target = 1) AS fh, count(*) AS n FROM r GROUP BY tx_id)
  SELECT count(*) AS coverable, {r6('avg(n)')} AS mean_eligible, {r6('avg(1e0 / fh)')} AS mrr, {HITS} FROM per WHERE fh IS NOT NULL"""))
def q_conditional_topk(spark, d):
    out = P.conditional_topk(scored_pairs(spark, d), "learned", 2)
    return rounded_all(out, [c for c in out.columns if c != "coverable"])


S.CTE["ptx"] = """
  SELECT t.*, coalesce(b.hit, 0) AS hit, coalesce(b.n_pairs, 0) AS n_pairs, b.joint, coalesce(t.min_cover_rank_live < 2, false) AS coverable
  FROM scored_cov t LEFT JOIN (
    SELECT r.tx_id, max(CASE WHEN rk <= 1 THEN coalesce(pack_target, 0) ELSE 0 END) AS hit, count(*) AS n_pairs, max(learned * q.arb_score) AS joint
    FROM (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY learned DESC, pack_rank, pack_id) AS rk FROM spairs
          WHERE eligible_live AND pack_rank < 2) r JOIN scored q ON q.tx_id = r.tx_id GROUP BY r.tx_id) b ON b.tx_id = t.tx_id"""


def policy_tx(spark, d):
    tx, pairs = both(spark, d)
    return P.per_tx(tx, P.ranked(pairs, "learned", 2), 1, 2, "learned")


@query("per_tx_hit", with_ctes(f"SELECT tx_id, hit, n_pairs, {r6('joint')} AS joint, coverable FROM ptx"))
def q_per_tx(spark, d):
    return policy_tx(spark, d).select("tx_id", "hit", "n_pairs", rounded("joint").alias("joint"), "coverable")


@query("decision_score", with_ctes(f"""
  SELECT tx_id, CASE WHEN relevant = 1 AND n_pairs > 0 THEN {r6('arb_score')} ELSE '-inf'::DOUBLE END AS two_stage,
         CASE WHEN relevant = 1 AND n_pairs > 0 THEN {r6('joint')} ELSE '-inf'::DOUBLE END AS joint FROM ptx"""))
def q_decision_score(spark, d):
    return policy_tx(spark, d).select("tx_id", rounded(P.decision_score("two_stage")).alias("two_stage"),
                                      rounded(P.decision_score("joint")).alias("joint"))


KS = (1, 2, 3)


@query("availability_k", with_ctes(f"""
  SELECT k, n AS positives, a AS available, {r6('a / n')} AS availability, {wilson_sql('a', 'n')[0]} AS lo, {wilson_sql('a', 'n')[1]} AS hi FROM
    (SELECT k, count(*) AS n, count(*) FILTER (min_cover_rank_live < k) AS a FROM scored_cov, (SELECT unnest([1, 2, 3]) AS k) WHERE target = 1 GROUP BY k)"""))
def q_availability(spark, d):
    return rounded_all(P.availability(scored_cov(spark, d), KS), ["availability", "lo", "hi"])


OUTCOME_SQL = """CASE WHEN encode_status <> 0 THEN 'encoder_unsupported' WHEN relevant <> 1 THEN 'relevance_gate'
  WHEN NOT (arb_score >= 0.5::DOUBLE) THEN 'threshold' WHEN NOT coverable THEN 'no_covering_pack' WHEN hit = 0 THEN 'ranking' ELSE 'success' END"""


@query("policy_eval", with_ctes(f"""
  WITH x AS (SELECT *, (relevant = 1 AND n_pairs > 0 AND arb_score >= 0.5::DOUBLE) AS sent, CASE WHEN target = 1 THEN {OUTCOME_SQL} END AS o
             FROM ptx WHERE split = 'test'),
       g AS (SELECT sum(weight) FILTER (sent)::DOUBLE AS sends_weighted, count(*) FILTER (sent AND target IS NOT NULL) AS sends_labelled,
              avg(target) FILTER (sent AND target IS NOT NULL) AS pa, avg(hit * target) FILTER (sent AND target IS NOT NULL) AS pc,
              count(*) FILTER (target = 1) AS n, count(*) FILTER (target = 1 AND sent) AS sp, count(*) FILTER (target = 1 AND coverable) AS cp,
              count(*) FILTER (o = 'success') AS k, count(*) FILTER (o = 'encoder_unsupported') AS miss_encoder_unsupported,
              count(*) FILTER (o = 'relevance_gate') AS miss_relevance_gate, count(*) FILTER (o = 'threshold') AS miss_threshold,
              count(*) FILTER (o = 'no_covering_pack') AS miss_no_covering_pack, count(*) FILTER (o = 'ranking') AS miss_ranking FROM x)
  SELECT sends_weighted, sends_labelled, {r6('pa')} AS precision_arb, {r6('pc')} AS precision_capture, n AS positives, k AS succeeded,
         miss_encoder_unsupported, miss_relevance_gate, miss_threshold, miss_no_covering_pack, miss_ranking,
         {r6('sends_weighted / 24e0')} AS sends_per_hour, {r6('1 - sends_labelled / sends_weighted')} AS unknown_share,
         {r6('sp / n')} AS positive_recall, {r6('cp / n')} AS availability, {r6('k / (k + miss_ranking)')} AS hit_given_reached,
         {r6('k / n')} AS end_to_end_recall, {WLO} AS recall_lo, {WHI} AS recall_hi FROM g"""))
def q_policy_eval(spark, d):
    out = P.evaluate(policy_tx(spark, d).where(F.col("split") == "test"), "two_stage", 0.5, 24.0)
    return rounded_all(out, ["precision_arb", "precision_capture", "sends_per_hour", "unknown_share", "positive_recall", "availability",
                             "hit_given_reached", "end_to_end_recall", "recall_lo", "recall_hi"])


@query("conditional_success", with_ctes(f"""
  WITH x AS (SELECT *, ({OUTCOME_SQL} = 'success')::INT AS ok FROM ptx WHERE target = 1),
       u AS (SELECT * FROM (SELECT ok, unnest([ 'all', CASE WHEN coverable THEN 'covering pack exists' END,
               CASE WHEN n_seen_in_train > 0 THEN 'route seen in train' ELSE 'route not seen in train' END,
               CASE WHEN encode_status <> 0 THEN 'cannot be parsed' WHEN relevant = 1 THEN 'gate passes' ELSE 'gate fails' END]) AS subset FROM x) WHERE subset IS NOT NULL)
  SELECT subset, n AS positives, k AS succeeded, {r6('k / n')} AS rate, {WLO} AS lo, {WHI} AS hi FROM
    (SELECT subset, count(*) AS n, sum(ok) AS k FROM u GROUP BY subset)"""))
def q_conditional_success(spark, d):
    return rounded_all(P.conditional_success(policy_tx(spark, d), "two_stage", 0.5), ["rate", "lo", "hi"])


@query("funnel", with_ctes(f"""
  WITH h AS (SELECT tx_id, max(pack_target) AS hit FROM (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY learned DESC, pack_id) AS rk
             FROM spairs WHERE eligible_live) WHERE rk <= 1 GROUP BY tx_id),
       x AS (SELECT t.*, coalesce(h.hit, 0) AS hit FROM scored_cov t LEFT JOIN h USING (tx_id)),
       y AS (SELECT *, CASE WHEN target = 1 THEN CASE WHEN NOT coalesce(n_covering_live > 0, false) THEN 'np' WHEN relevant <> 1 THEN 'rg'
               WHEN arb_score < 0.5::DOUBLE THEN 'cl' WHEN hit = 0 THEN 'rk' ELSE 'ok' END END AS o,
               relevant = 1 AND arb_score >= 0.5::DOUBLE AND coalesce(n_eligible_live, 0) > 0 AS sent FROM x),
       g AS (SELECT count(*) FILTER (target = 1) AS n, count(*) FILTER (o = 'np') AS np, count(*) FILTER (o = 'rg') AS rg,
               count(*) FILTER (o = 'cl') AS cl, count(*) FILTER (o = 'rk') AS rk, count(*) FILTER (o = 'ok') AS k,
               count(*) FILTER (sent) AS sends_all, count(*) FILTER (sent AND target IS NOT NULL) AS sends_labelled,
               avg(target) FILTER (sent AND target IS NOT NULL) AS sp, avg(hit) FILTER (sent AND target IS NOT NULL) AS spp FROM y)
  SELECT n AS positives, np AS miss_no_candidate_pack, rg AS miss_relevance_gate, cl AS miss_classifier, rk AS miss_ranker, k AS succeeded,
         sends_all, sends_labelled, {r6('sp')} AS send_precision, {r6('spp')} AS send_precision_pack, {r6('(n - np) / n')} AS pack_availability,
         {r6('(k + rk) / (n - np)')} AS recall_given_pack, {r6('k / (k + rk)')} AS topk_given_sent, {r6('k / n')} AS end_to_end_recall,
         {WLO} AS recall_lo, {WHI} AS recall_hi FROM g"""))
def q_funnel(spark, d):
    out = P.funnel(*both(spark, d), "learned", 0.5, 1)
    return rounded_all(out, ["send_precision", "send_precision_pack", "pack_availability", "recall_given_pack", "topk_given_sent",
                             "end_to_end_recall", "recall_lo", "recall_hi"])


@query("captured_value", with_ctes("""
  SELECT count(*) AS captured, coalesce(sum(best_profit), 0)::BIGINT AS value FROM ptx
  WHERE target = 1 AND encode_status = 0 AND relevant = 1 AND ev >= 10::DOUBLE AND coverable AND hit = 1"""))
def q_captured(spark, d):
    return P.captured(policy_tx(spark, d), 10.0)


GRID = dict(policies=[("count_joint", "joint", "arb_score"), ("ev_two_stage", "two_stage", "ev"), ("ev_joint", "joint", "ev")],
            depths=[1, 2], sends=[1, 2], budgets=[5.0, 20.0, 100.0], hours={"val": 10.0, "test": 12.0})

S.CTE["grid"] = f"""
  WITH dp AS (SELECT unnest([1, 2]) AS depth), ls AS (SELECT unnest([1, 2]) AS sends), bu AS (SELECT unnest([5e0, 20e0, 100e0]) AS budget_per_hour),
  po AS (SELECT unnest(['count_joint', 'ev_two_stage', 'ev_joint']) AS policy),
  rk AS (SELECT p.*, dp.depth, row_number() OVER (PARTITION BY tx_id, dp.depth ORDER BY learned DESC, pack_rank, pack_id) AS sel
         FROM spairs p, dp WHERE eligible_live AND pack_rank < dp.depth),
  by_tx AS (SELECT tx_id, depth, max(learned) AS best, min(sel) FILTER (pack_target = 1) AS fh FROM rk GROUP BY ALL),
  x AS (SELECT t.*, b.depth, b.fh, po.policy, coalesce(t.min_cover_rank_live < b.depth, false) AS cov,
               CASE po.policy WHEN 'count_joint' THEN arb_score * best WHEN 'ev_two_stage' THEN ev ELSE ev * best END AS s
        FROM scored_cov t JOIN by_tx b ON b.tx_id = t.tx_id, po WHERE relevant = 1),
  cw AS (SELECT policy, depth, s, sum(w) OVER (PARTITION BY policy, depth ORDER BY s DESC) AS cw FROM
         (SELECT policy, depth, s, sum(weight) AS w FROM x WHERE split = 'val' AND weight > 0 GROUP BY ALL)),
  th AS (SELECT po.policy, dp.depth, bu.budget_per_hour, coalesce(min(s), 'inf'::DOUBLE) AS threshold
         FROM po CROSS JOIN dp CROSS JOIN bu LEFT JOIN cw ON cw.policy = po.policy AND cw.depth = dp.depth AND cw.cw <= bu.budget_per_hour * 10 GROUP BY ALL)
  SELECT th.policy, th.depth, ls.sends, th.budget_per_hour, {r6('th.threshold')} AS threshold,
    {", ".join(f'''count(*) FILTER (split = '{sp}' AND ok) AS {sp}_captured, {r6(f"coalesce(sum(weight) FILTER (split = '{sp}'), 0) / {h}")} AS {sp}_sends_per_hour,
      {r6(f"coalesce(sum(best_profit) FILTER (split = '{sp}' AND ok), 0) / 1e9 / {h}", 9)} AS {sp}_coins_per_hour,
      {r6(f"coalesce(sum(best_profit) FILTER (split = '{sp}' AND ok), 0) / 1e9 / {h} - coalesce(sum(weight) FILTER (split = '{sp}'), 0) / {h} * 5000 / 1e9", 9)} AS {sp}_net_per_hour,
      {r6(f"1 - count(target) FILTER (split = '{sp}') / greatest(1e0, coalesce(sum(weight) FILTER (split = '{sp}'), 0))")} AS {sp}_unknown_share'''
      for sp, h in (("val", "10e0"), ("test", "12e0")))}
  FROM th CROSS JOIN ls LEFT JOIN (SELECT x.*, l2.sends AS l, target = 1 AND encode_status = 0 AND cov AND coalesce(fh <= l2.sends, false) AS ok
       FROM x, (SELECT unnest([1, 2]) AS sends) l2 WHERE x.split IN ('val', 'test')) y
    ON y.policy = th.policy AND y.depth = th.depth AND y.s >= th.threshold AND y.l = ls.sends
  GROUP BY ALL"""


def grid(spark, d):
    g = P.policy_grid(*both(spark, d), "learned", **GRID)
    six = ["threshold", "val_sends_per_hour", "test_sends_per_hour", "val_unknown_share", "test_unknown_share"]
    nine = [f"{s}_{m}_per_hour" for s in ("val", "test") for m in ("coins", "net")]
    return rounded_all(rounded_all(g, six), nine, 9)


@query("policy_grid", with_ctes("SELECT * FROM grid"))
def q_policy_grid(spark, d):
    return grid(spark, d)


@query("operating_point", with_ctes("""
  SELECT * FROM grid QUALIFY row_number() OVER (PARTITION BY policy, budget_per_hour ORDER BY val_coins_per_hour DESC, sends, depth) = 1"""))
def q_operating_point(spark, d):
    return P.operating_points(grid(spark, d))
