"""Model matrix, training, scoring and their audits; prepared tables written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from txlens import schema as SC
from txlens.functions.numbers import beside, count_if, rounded, rounded_all, sum_if
from txlens.operators import audit as A
from txlens.operators import encode as E
from txlens.operators import labels as L
from txlens.operators import metrics as M
from txlens.operators import models as MD
from txlens.operators import policy as P
from txlens.operators import pools as PO
from txlens.operators import splits as SP
from txlens.plans import label_queries as LQ
from txlens.plans import landing_queries as LA
from txlens.plans import metric_queries as MQ
from txlens.plans import pool_queries as PQ
from txlens.plans import standin as S
from txlens.plans.registry import query
from txlens.plans.standin import with_ctes
from txlens.session import materialise, new_dir
from txlens.sources import kept as KP
from txlens.sources import tables as TB

BASIC = {"amount": "numeric", "n_occurrences": "numeric", "n_top_level": "numeric", "n_pools": "numeric", "swap_max": "numeric", "relevant": "categorical",
         "prio_code": "categorical", "payer_hash": "hash", "supp_hash": "hash"}
PRIORS = ["prior_touch_max", "prior_pos_rate_max", "prior_pos_sum", "prior_logprofit_max", "prior_routes_max", "n_candidate_routes"]
FEATURES = {**BASIC, **dict.fromkeys(PRIORS, "numeric")}
ROLES = {"tx_id": "id", "label": "label", "target": "label", "target3": "label", "best_profit": "label", "slot": "meta", "split": "meta", "encode_status": "gate",
         **{f: "feature" for f in FEATURES}}


def priors(spark, d):
    """Pool priors of every transaction: of train rows from the other folds, of all others from the whole of train."""
    return PQ.q_oof_priors(spark, d).drop("fold").unionByName(PQ.q_attach_priors(spark, d))


def feature_frame(spark, d, prior=None):
    """Labelled transactions with their inputs; hash inputs use high bits so that some are negative as signed numbers."""
    t = S.trig(spark, d).groupBy("tx_id").agg(F.countDistinct("pool").alias("n_pools"), F.max("amount").alias("swap_max"), F.min("supp").alias("ms"))
    x = MQ.scored(spark, d).join(t, "tx_id").join(priors(spark, d) if prior is None else prior, "tx_id", "left")
    wrap = lambda c: F.when(F.col(c) % 2 == 0, F.col(c) * 1000003).otherwise(-F.col(c) * 1000003 - 1)
    out = x.withColumn("payer_hash", wrap("payer")).withColumn("supp_hash", wrap("ms")).withColumn("prio_code", F.substring("prio", 1, 1).cast("int"))
    keep = out.select("tx_id", "slot", "split", "label", "group", "target", "target3", "best_profit", "encode_status", *FEATURES)
    return SC.with_roles(keep, ROLES, FEATURES)


VOC_SQL = """v AS (SELECT 'payer_hash' AS feature, CASE WHEN payer % 2 = 0 THEN payer * 1000003 ELSE -payer * 1000003 - 1 END AS value FROM split_tx WHERE split = 'train' AND tx_id IN (SELECT tx_id FROM trig)
  UNION ALL SELECT 'supp_hash', CASE WHEN ms % 2 = 0 THEN ms * 1000003 ELSE -ms * 1000003 - 1 END FROM (SELECT tx_id, min(supp) AS ms FROM trig GROUP BY tx_id) JOIN split_tx USING (tx_id) WHERE split = 'train'),
  c AS (SELECT feature, value, count(*) AS n FROM v GROUP BY ALL HAVING count(*) >= 5),
  voc AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, CASE WHEN value < 0 THEN value::HUGEINT + 18446744073709551616 ELSE value END) - 1 AS code FROM c QUALIFY code < 255)"""


def hashed(spark, d):
    ms = S.trig(spark, d).groupBy("tx_id").agg(F.min("supp").alias("ms"))
    wrap = lambda c: F.when(F.col(c) % 2 == 0, F.col(c) * 1000003).otherwise(-F.col(c) * 1000003 - 1)
    return MQ.split_tx(spark, d).join(ms, "tx_id").select("tx_id", "split", "amount", "relevant", wrap("payer").alias("payer_hash"), wrap("ms").alias("supp_hash"))


@query("vocabulary", with_ctes(f"WITH {VOC_SQL} SELECT feature, value, n, code FROM voc"))
def q_vocabulary(spark, d):
    return E.fit_vocab(hashed(spark, d).where(F.col("split") == "train"), ["payer_hash", "supp_hash"])


ENC = {"amount": "numeric", "relevant": "categorical", "payer_hash": "hash", "supp_hash": "hash"}


@query("encode_matrix", with_ctes(f"""
  WITH {VOC_SQL}, x AS (SELECT t.tx_id, amount, relevant, CASE WHEN payer % 2 = 0 THEN payer * 1000003 ELSE -payer * 1000003 - 1 END AS ph,
    CASE WHEN ms % 2 = 0 THEN ms * 1000003 ELSE -ms * 1000003 - 1 END AS sh FROM split_tx t JOIN (SELECT tx_id, min(supp) AS ms FROM trig GROUP BY tx_id) m ON m.tx_id = t.tx_id)
  SELECT tx_id, amount::DOUBLE AS amount, relevant::DOUBLE AS relevant, coalesce(a.code::DOUBLE, 'nan'::DOUBLE) AS payer_hash, coalesce(b.code::DOUBLE, 'nan'::DOUBLE) AS supp_hash
  FROM x LEFT JOIN voc a ON a.feature = 'payer_hash' AND a.value = ph LEFT JOIN voc b ON b.feature = 'supp_hash' AND b.value = sh"""))
def q_encode(spark, d):
    h = hashed(spark, d)
    return E.encode(h, ENC, q_vocabulary(spark, d)).select("tx_id", *ENC)


@query("save_load_vocab", with_ctes(f"WITH {VOC_SQL} SELECT feature, count(*) AS codes, sum(n)::BIGINT AS rows FROM voc GROUP BY feature"))
def q_save_vocab(spark, d):
    path = new_dir(spark, "vocab")
    E.save_vocab(q_vocabulary(spark, d), path)
    return E.load_vocab(spark, path).groupBy("feature").agg(F.count(F.lit(1)).alias("codes"), F.sum("n").alias("rows"))


@query("feature_allowlist", with_ctes("""
  SELECT 'amount' AS feature, 'numeric' AS kind, count(amount) AS filled FROM tx UNION ALL SELECT 'relevant', 'categorical', count(relevant) FROM tx UNION ALL SELECT 'payer', 'hash', count(payer) FROM tx"""))
def q_allowlist(spark, d):
    """Only columns declared as features come out, with their kind; asking for an id or a label is refused."""
    t = SC.with_roles(S.tx(spark, d), {"tx_id": "id", "slot": "meta", "landed": "label", "encode_status": "gate", "amount": "feature", "relevant": "feature", "payer": "feature"},
                      {"relevant": "categorical", "payer": "hash"})
    cols, kinds = SC.feature_columns(t), SC.kinds(t)
    SC.check_features(t, cols)
    one = t.agg(*[F.count(c).alias(c) for c in cols])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(kinds[c]).alias("kind"), F.col(c).alias("filled")) for c in cols])).alias("s")).select("s.*")


def inputs(spark, d):
    """The files that every model of the stand-in data is made from."""
    return KP.files(spark, [f"{d}/{t}.parquet" for t in ("orders", "lineitem", "part", "supplier")])


CODE = (feature_frame, priors, E.encode, E.fit_vocab, MQ.scored, PO.attach_priors, PO.oof_priors)


def encoded(frame):
    SC.check_features(frame, list(FEATURES))
    vocab = E.fit_vocab(frame.where(F.col("split") == "train"), [c for c, k in FEATURES.items() if k == "hash"])
    return E.encode(frame, FEATURES, vocab)


def matrix(spark, d):
    """Encoded, made once: every fit and evaluation of every query reads the same table."""
    return KP.kept(spark, "matrix", {"features": FEATURES}, inputs(spark, d), lambda: encoded(feature_frame(spark, d)), CODE)


def model_folder(spark, d, name, settings, **params):
    return KP.folder(spark, name, {**vars(settings), **params, "features": FEATURES}, inputs(spark, d), (*CODE, MD.B, arb_model, size_model))


def arb_model(spark, d, x, settings=MD.Settings(), name="arb", **params):
    lab = L.subsample(x.where(F.col("target3").isNotNull() & (F.col("encode_status") == 0)))
    return MD.fit_classifier(lab, list(FEATURES), "target3", "w", FEATURES, settings, model_folder(spark, d, name, settings, **params))


def positives_of(x):
    return x.where((F.col("target3") == 1) & (F.col("best_profit") > 0)).withColumn("logp", F.log("best_profit"))


def size_model(spark, d, x, settings=MD.Settings(), name="size", **params):
    return MD.fit_regressor(positives_of(x), list(FEATURES), "logp", FEATURES, settings, model_folder(spark, d, name, settings, **params))


def stopped(m, settings=MD.Settings()):
    """Whether the fit ended by its own rule, within its bound."""
    return len(m.trees) == settings.rounds or 0 < m.n_trees <= len(m.trees) - settings.patience


#: What the fitted models must beat on val and test: average precision above the base rate, ROC-AUC, and the log error of the train mean.
MARGIN, LEAST_ROC, MOST_ERROR = 0.05, 0.7, 0.9

LABELLED = "SELECT split, count(*) AS n, sum(target3)::BIGINT AS positives, {rate} AS base_rate FROM scored WHERE target3 IS NOT NULL{where} GROUP BY split"


def labelled_sql(where=""):
    return LABELLED.format(rate=S.r6("avg(target3)"), where=where)


@query("fit_classifier", with_ctes(f"SELECT *, true AS above_base, true AS orders_well, true AS stopped FROM ({labelled_sql()})"))
def q_fit_classifier(spark, d):
    """Rows and base rate per split, and whether the model beats them by MARGIN and LEAST_ROC."""
    x = matrix(spark, d)
    m = arb_model(spark, d, x)
    s = M.classifier_summary(MD.score(m, x.where(F.col("target3").isNotNull()), "p"), "target3", "p", ["split"])
    return s.select("split", "n", "positives", rounded("base_rate").alias("base_rate"), (F.col("pr_auc") >= F.col("base_rate") + MARGIN).alias("above_base"),
                    (F.col("roc_auc") >= LEAST_ROC).alias("orders_well"), F.lit(stopped(m)).alias("stopped"))


@query("score", with_ctes("SELECT split, count(*) AS n, count(*) AS ids, 0 AS outside, true AS varied FROM scored WHERE split <> 'train' GROUP BY split"))
def q_score(spark, d):
    """Scores of val and test: one per row, all of them probabilities."""
    x = matrix(spark, d).where(F.col("split") != "train")
    s = MD.score(arb_model(spark, d, matrix(spark, d)), x, "p").select("tx_id", "split", "p")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tx_id").alias("ids"), count_if(~F.coalesce(F.col("p").between(0, 1), F.lit(False))).alias("outside"),
                                  (F.countDistinct("p") > 50).alias("varied"))


@query("fit_size", with_ctes(f"""
  SELECT split, count(*) AS n, {S.r6("sqrt(avg((ln(best_profit) - m) * (ln(best_profit) - m)))")} AS baseline_rmse, true AS beats_baseline, true AS stopped
  FROM scored, (SELECT avg(ln(best_profit)) AS m FROM scored WHERE split = 'train' AND target3 = 1 AND best_profit > 0)
  WHERE split <> 'train' AND target3 = 1 AND best_profit > 0 GROUP BY split"""))
def q_fit_size(spark, d):
    x = matrix(spark, d)
    m = size_model(spark, d, x)
    pos = positives_of(x)
    mean = pos.where(F.col("split") == "train").agg(F.avg("logp")).first()[0]
    err = lambda c: F.sqrt(F.avg((c - F.col("logp")) * (c - F.col("logp"))))
    g = MD.score(m, pos.where(F.col("split") != "train"), "pred").groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), err(F.lit(mean)).alias("b"), err(F.col("pred")).alias("e"), F.corr("pred", "logp").alias("r"))
    return g.select("split", "n", rounded("b").alias("baseline_rmse"), ((F.col("e") < F.col("b")) & (F.col("r") > 0.2)).alias("beats_baseline"), F.lit(stopped(m)).alias("stopped"))


RANKER = ["gain", "pack_rank", "amount", "n_occurrences"]


@query("fit_ranker", with_ctes(f"""
  WITH r AS (SELECT s.split, p.tx_id, p.pack_target, row_number() OVER (PARTITION BY p.tx_id ORDER BY p.pack_rank, p.pack_id) AS sel
             FROM pairs p JOIN split_tx s ON s.tx_id = p.tx_id WHERE p.eligible_live AND p.label = 'POSITIVE' AND p.pack_rank < 2 AND s.split <> 'train'),
  h AS (SELECT split, tx_id, min(sel) FILTER (pack_target = 1) AS hit FROM r GROUP BY ALL HAVING count(*) FILTER (pack_target = 1) > 0)
  SELECT split, count(*) AS coverable, {S.r6("avg((hit <= 1)::INT)")} AS static_top1, {S.r6("avg(1e0 / hit)")} AS static_mrr, CASE WHEN split = 'val' THEN true END AS served_not_worse,
    true AS stopped FROM h GROUP BY split"""))
def q_fit_ranker(spark, d):
    """Classifier on live pairs of train positives, beside the catalog order it must beat on val to be kept."""
    pairs = LQ.pairs(spark, d)
    t = MQ.scored(spark, d).select("tx_id", "split", "amount", "n_occurrences")
    frame = PO.ranker_frame(t, pairs.where((F.col("label") == "POSITIVE") & F.col("eligible_live")), S.packs(spark, d).select("pack_id", "gain"))
    x = KP.kept(spark, "ranker", {"inputs": RANKER}, inputs(spark, d), lambda: frame, (PO.ranker_frame, LQ.pairs))
    m = MD.fit_classifier(x, RANKER, "pack_target", folder=model_folder(spark, d, "ranker-model", MD.Settings()))
    s = MD.score(m, x, "learned").withColumn("static", -F.col("pack_rank").cast("double"))
    parts = {(sp, sc): P.conditional_topk(s.where(F.col("split") == sp), sc, 2) for sp in ("val", "test") for sc in ("static", "learned")}
    top = {k: parts[k].first() for k in (("val", "static"), ("val", "learned"))}
    kept = MD.accept_ranker(top["val", "learned"].top1, top["val", "static"].top1)
    served = top["val", "learned" if kept else "static"].top1 or 0
    worse = {"val": F.lit(served >= (top["val", "static"].top1 or 0)), "test": F.lit(None).cast("boolean")}
    rows = [parts[sp, "static"].select(F.lit(sp).alias("split"), "coverable", rounded("top1").alias("static_top1"), rounded("mrr").alias("static_mrr"), worse[sp].alias("served_not_worse"),
                                       F.lit(stopped(m)).alias("stopped")) for sp in ("val", "test")]
    return rows[0].unionByName(rows[1])


LAND_REP = ["rep_landed", "rep_failed", "rep_total", "rep_fail_rate", "rep_seen"]
LAND_STATIC = ["amount", "prio_code", *LA.STATIC_INPUTS]
LAND_KINDS = {"prio_code": "categorical", **dict.fromkeys(LA.ST.LANDING_HASHES, "hash")}


def land_frame(spark, d):
    """Every input of the landing model beside its label: structure, instructions, tips and the payer's past."""
    def build():
        x = LA.land(spark, d).withColumn("prio_code", F.substring("prio", 1, 1).cast("int")).drop("relevant")
        x = SP.landing_split(x.join(LA.q_landing_static(spark, d), "tx_id", "left"), SP.landing_cuts(S.tx(spark, d)))
        vocab = E.fit_vocab(x.where(F.col("split") == "train"), LA.ST.LANDING_HASHES)
        return E.encode(x, {c: LAND_KINDS.get(c, "numeric") for c in LAND_STATIC + LAND_REP}, vocab)

    return KP.kept(spark, "landing", {"inputs": LAND_STATIC + LAND_REP}, inputs(spark, d), build, (LA.land, LA.q_landing_static))


def land_fit(spark, d, x, cols, settings=MD.Settings(), name="landing-model"):
    m = MD.fit_classifier(x, cols, "landed", None, LAND_KINDS, settings, KP.folder(spark, name, {**vars(settings), "cols": cols}, inputs(spark, d), (LA.q_landing_static, MD.B)))
    return m, MD.score(m, x.where(F.col("split") == "test"), "p")


S.CTE["land_cuts"] = """
  SELECT max(slot) FILTER (rn = trunc(n * 0.7::DOUBLE) + 1) AS c1, max(slot) FILTER (rn = trunc(n * 0.85::DOUBLE) + 1) AS c2 FROM slot_list"""
LAND_TEST = f"SELECT count(*) AS n, {S.r6('avg(landed)')} AS landed_rate, {S.r6('1 - avg(landed)')} AS fail_base_rate FROM tx, land_cuts WHERE slot >= c2"


def land_facts(s):
    """Rows and rates of a landing summary, and whether its Brier score is that of a model that knows the rate at least."""
    known = F.col("landed_rate") * (1 - F.col("landed_rate"))
    return rounded_all(s, ["landed_rate", "fail_base_rate"]).select("n", "landed_rate", "fail_base_rate", (F.col("brier") <= known + 0.01).alias("calibrated"))


@query("fit_landing", with_ctes(f"SELECT *, true AS calibrated, {len(LAND_STATIC + LAND_REP)} AS inputs, true AS stopped FROM ({LAND_TEST})"))
def q_fit_landing(spark, d):
    m, s = land_fit(spark, d, land_frame(spark, d), LAND_STATIC + LAND_REP)
    return land_facts(M.landing_summary(s, "landed", "p")).withColumn("inputs", F.lit(len(m.features))).withColumn("stopped", F.lit(stopped(m)))


@query("ablation", with_ctes(f"""
  SELECT * FROM ({LAND_TEST}), (SELECT unnest(['reputation_only', 'no_reputation', 'all']) AS inputs, unnest([{len(LAND_REP)}, {len(LAND_STATIC)}, {len(LAND_STATIC + LAND_REP)}]) AS offered,
    true AS uses_no_other, true AS calibrated)"""))
def q_ablation(spark, d):
    x = land_frame(spark, d)
    parts = []
    for name, cols in (("reputation_only", LAND_REP), ("no_reputation", LAND_STATIC), ("all", LAND_STATIC + LAND_REP)):
        m, s = land_fit(spark, d, x, cols)
        facts = land_facts(M.landing_summary(s, "landed", "p"))
        parts.append(facts.withColumns({"inputs": F.lit(name), "offered": F.lit(len(cols)), "uses_no_other": F.lit({f for f, _ in MD.B.importance(m)} <= set(cols))}))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("importance_top", with_ctes(f"""
  SELECT unnest({list(FEATURES)}) AS feature, true AS in_range, true AS sums_to_one, 'n_occurrences' AS strongest, true AS known_inputs FROM (SELECT count(*) FROM scored)"""))
def q_importance(spark, d):
    """Share of gains per input: all of them, none negative; the label counts occurrences, so they must come first."""
    i = MD.importance(arb_model(spark, d, matrix(spark, d)), spark)
    top = i.first().feature
    total = i.agg(F.sum("gain").alias("t"))
    return beside(i, total).select("feature", F.col("gain").between(0, 1).alias("in_range"), (F.abs(F.col("t") - 1) < 1e-9).alias("sums_to_one"), F.lit(top).alias("strongest"),
                                   F.col("feature").isin(list(FEATURES)).alias("known_inputs"))


@query("persist_model", with_ctes("SELECT count(*) AS rows, 0 AS differing, true AS order_refused FROM scored"))
def q_persist(spark, d):
    """Scores before saving and after loading, the rows where they differ, and that another order of inputs is refused."""
    x = matrix(spark, d)
    m = arb_model(spark, d, x)
    path = new_dir(spark, "model")
    MD.save_model(m, spark, path)
    again = MD.load_model(spark, path, list(FEATURES))
    a = MD.score(m, x, "a").select("tx_id", "a")
    b = MD.score(again, x, "b").select("tx_id", "b")
    try:
        MD.load_model(spark, path, list(FEATURES)[::-1])
        refused = False
    except ValueError:
        refused = True
    return a.join(b, "tx_id").agg(F.count(F.lit(1)).alias("rows"), count_if(F.col("a") != F.col("b")).alias("differing"), F.lit(refused).alias("order_refused"))


COMPACT = MD.Settings(rounds=100, depth=3)
SENDS = 300


@query("compact_model", with_ctes(f"""
  SELECT unnest(['full', 'compact']) AS model, unnest([{MD.Settings().rounds}, {COMPACT.rounds}]) AS most_trees, unnest([{MD.Settings().depth}, {COMPACT.depth}]) AS depth,
    least({SENDS}, count(*)) AS sends, true AS enough_sends, true AS within_bound FROM scored WHERE split = 'test' AND target3 IS NOT NULL"""))
def q_compact(spark, d):
    """Full and small model at the same number of sends; `compared` says what the small one keeps."""
    rows = []
    for name, settings in (("full", MD.Settings()), ("compact", COMPACT)):
        m, n, sent, _ = at_sends(spark, d, name, settings)
        rows.append((name, settings.rounds, m.depth, n, sent >= n, len(m.trees) <= settings.rounds and all(len(t.feature) == 2 ** (m.depth + 1) - 1 for t in m.trees)))
    return spark.createDataFrame(rows, "model string, most_trees int, depth int, sends bigint, enough_sends boolean, within_bound boolean")


def at_sends(spark, d, name, settings):
    """(model, sends asked, sends made, value captured) on test."""
    x = matrix(spark, d)
    m = arb_model(spark, d, x, settings, name="arb" if name == "full" else f"arb-{name}")
    s = MD.score(m, x.where((F.col("split") == "test") & F.col("target3").isNotNull()), "p").select("p", "target3", "best_profit")
    n = min(SENDS, s.count())
    limit = P.nth_threshold(s, "p", [n]).first().threshold
    sent = s.where(F.col("p") >= limit).agg(F.count(F.lit(1)).alias("n"), sum_if(F.col("target3") == 1, "best_profit").alias("v")).first()
    return m, n, sent.n, sent.v or 0


def compared(spark, d):
    """Whether the small classifier keeps the value of the full one, and the small landing model the failures removed."""
    value = {name: at_sends(spark, d, name, settings)[3] for name, settings in (("full", MD.Settings()), ("compact", COMPACT))}
    lf, removed = land_frame(spark, d), {}
    for name, settings in (("full", MD.Settings()), ("compact", COMPACT)):
        _, s = land_fit(spark, d, lf, LAND_STATIC + LAND_REP, settings)
        removed[name] = M.gate_tradeoff(s, "landed", "p", [0.5]).first().failures_removed
    return MD.accept_compact(value["full"], value["compact"]), MD.accept_compact_gate(removed["full"], removed["compact"])


@query("relabel_shuffle", with_ctes("""
  SELECT split, count(*) AS rows, sum(target3) AS positives FROM scored WHERE target3 IS NOT NULL GROUP BY split"""))
def q_relabel(spark, d):
    """Permuted targets keep the rows and the number of positives of every split."""
    x = MQ.scored(spark, d).where(F.col("target3").isNotNull()).select("tx_id", "split", "target3")
    parts = [A.shuffle_labels(x.where(F.col("split") == sp), "target3", "tx_id", 7) for sp in SP.SPLITS]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("target3").alias("positives"))


@query("shuffled_control", with_ctes(f"SELECT *, true AS near_base, true AS no_order FROM ({labelled_sql(' AND split = \'test\'')})"))
def q_shuffled(spark, d):
    """Skill of a model fitted on permuted labels: average precision at the base rate, no order."""
    x = matrix(spark, d).where(F.col("target3").isNotNull())
    known = x.where(F.col("encode_status") == 0)

    def build():
        parts = [A.shuffle_labels(known.where(F.col("split") == sp), "target3", "tx_id", 7) for sp in ("train", "val")]
        return parts[0].unionByName(parts[1])

    fit = KP.kept(spark, "shuffled", {"features": FEATURES}, inputs(spark, d), build, (*CODE, A.shuffle_labels))
    m = MD.fit_classifier(fit, list(FEATURES), "target3", kinds=FEATURES, folder=model_folder(spark, d, "shuffled-model", MD.Settings()))
    s = M.classifier_summary(MD.score(m, x.where(F.col("split") == "test"), "p"), "target3", "p", ["split"])
    return s.select("split", "n", "positives", rounded("base_rate").alias("base_rate"), (F.abs(F.col("pr_auc") - F.col("base_rate")) < MARGIN).alias("near_base"),
                    (F.abs(F.col("roc_auc") - 0.5) < 0.15).alias("no_order"))


# ---------------------------------------------------------------- prepared tables

def prepared(spark, d):
    root = new_dir(spark, "prepared")
    lab = LQ.labelled(spark, d).select("tx_id", "slot", "label", "target", "unknown_reasons", "best_profit")
    TB.write_checked(lab, f"{root}/tx_labels", "tx_id")
    feats = S.tx(spark, d).join(lab.select("tx_id"), "tx_id", "left_semi").select("tx_id", "slot", "block_time", "encode_status", "relevant", "amount")
    TB.write_checked(feats, f"{root}/tx_features", "tx_id")
    return root

@query("scan_prepared", with_ctes("SELECT tx_id, slot, label, target, unknown_reasons, best_profit, block_time, encode_status, relevant, amount FROM labels JOIN tx USING (tx_id)"))
def q_scan_prepared(spark, d):
    return TB.scan_prepared(spark, prepared(spark, d))


@query("scan_week", with_ctes("SELECT (tx_id % 4) * 1099511627776 + tx_id AS tx_id, slot, label, target, tx_id % 4 AS partition_index FROM labels JOIN tx USING (tx_id)"))
def q_scan_week(spark, d):
    root = new_dir(spark, "week")
    rows = materialise(LQ.labelled(spark, d).select("tx_id", "slot", "label", "target", "unknown_reasons"), "week-rows")
    for n in range(4):
        TB.write_checked(rows.where(F.col("tx_id") % 4 == n), f"{root}/partition_index={n}", "tx_id")
    return TB.scan_week(spark, root)


@query("week_summary", with_ctes("""
  SELECT tx_id % 4 AS partition_index, count(*) AS rows, count(*) FILTER (label = 'POSITIVE') AS positives, count(target) AS labelled, min(slot) AS slot_min, max(slot) AS slot_max
  FROM labels JOIN tx USING (tx_id) GROUP BY 1"""))
def q_week_summary(spark, d):
    w = q_scan_week(spark, d)
    return w.groupBy("partition_index").agg(F.count(F.lit(1)).alias("rows"), count_if(F.col("label") == "POSITIVE").alias("positives"), F.count("target").alias("labelled"),
                                            F.min("slot").alias("slot_min"), F.max("slot").alias("slot_max"))


@query("scan_pairs_range", with_ctes("SELECT p.tx_id, p.pack_id, t.slot FROM pairs p JOIN tx t ON t.tx_id = p.tx_id WHERE t.slot BETWEEN 250 AND 600"))
def q_scan_pairs(spark, d):
    path = new_dir(spark, "pairs")
    p = LQ.pairs(spark, d).join(S.tx(spark, d).select("tx_id", "slot"), "tx_id")
    TB.write_parts(p, path, 100, ["tx_id", "pack_id"])
    return TB.scan_pairs(spark, path, (250, 600), 100).select("tx_id", "pack_id", "slot")


@query("scan_slot_parts", with_ctes("""
  WITH s AS (SELECT slot, min(block_time) FILTER (tx_id % 5 = 0) AS t FROM tx GROUP BY slot), c AS (SELECT slot, last_value(t IGNORE NULLS) OVER (ORDER BY slot) AS slot_time FROM s)
  SELECT tx_id, slot, slot_time FROM tx JOIN c USING (slot) WHERE slot BETWEEN 300 AND 900"""))
def q_slot_parts(spark, d):
    path = new_dir(spark, "slots")
    t = S.tx(spark, d).select("tx_id", "slot", F.when(F.col("tx_id") % 5 == 0, F.col("block_time")).alias("block_time"))
    TB.write_parts(t, path, 100, ["tx_id"])
    return TB.scan_slot_parts(spark, path, 300, 900, 100).select("tx_id", "slot", "slot_time")


@query("write_parts", with_ctes("SELECT slot // 200 AS part, count(*) AS rows, 0 AS lost FROM tx GROUP BY 1"))
def q_write_parts(spark, d):
    """Manifest rows per part, and rows of the source that the written table lacks."""
    path = new_dir(spark, "parts")
    t = S.tx(spark, d)
    m = TB.write_parts(t, path, 200, ["tx_id"])
    back = spark.read.parquet(path).drop("part").select(t.columns)
    lost = t.exceptAll(back).withColumn("part", F.floor(F.col("slot") / 200)).groupBy("part").agg(F.count(F.lit(1)).alias("l"))
    return m.join(lost, "part", "left").select("part", "rows", F.coalesce("l", F.lit(0)).alias("lost"))


@query("publish_manifest", with_ctes("SELECT count(*) AS rows, count(DISTINCT slot // 200) AS parts, true AS same_inputs, true AS refuses_others FROM tx"))
def q_manifest(spark, d):
    path = new_dir(spark, "manifest")
    t = S.tx(spark, d)
    n = t.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.floor(F.col("slot") / 200)).alias("p"), *TB.digest(t)[1:]).first()
    inputs, config = {"digest": str(n.digest)}, {"slots_per_part": 200}
    TB.write_manifest(spark, path, inputs, config, {"rows": n.n, "parts": n.p})
    TB.write_manifest(spark, path, inputs, config, {"rows": n.n, "parts": n.p})
    got = TB.read_manifest(spark, path)
    try:
        TB.write_manifest(spark, path, {"digest": "other"}, config, {})
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(got["counts"]["rows"], got["counts"]["parts"], got["inputs"] == inputs, refused)], "rows bigint, parts bigint, same_inputs boolean, refuses_others boolean")


@query("scan_catalog", with_ctes("""
  WITH r AS (SELECT pack_id, string_agg(route, ',' ORDER BY route) AS routes, count(DISTINCT substr(route, 7, 1)) AS n_sequences FROM pack_routes GROUP BY pack_id)
  SELECT 'library' AS fmt, p.pack_id, program, family, layer, base, rank, 0 AS train_lo, 9000 AS train_hi, routes, 3 AS n_pools, n_sequences FROM packs p JOIN r ON r.pack_id = p.pack_id
  UNION ALL SELECT 'legacy', pack_id, program, family, layer, base, rank, 0, 9000, NULL, NULL, NULL FROM packs"""))
def q_scan_catalog(spark, d):
    """Both formats of a catalog written and read; which one is there is found out."""
    path = new_dir(spark, "catalog")
    packs = S.packs(spark, d)
    window = {"train_lo": F.lit(0), "train_hi": F.lit(9000)}
    packs.withColumns(window).withColumnsRenamed({"pack_id": "pack", "rank": "order", "train_lo": "train_min", "train_hi": "train_max"}).write.parquet(f"{path}/old")
    routes = S.pack_routes(packs).groupBy("pack_id").agg(F.array_join(F.sort_array(F.collect_list("route")), ",").alias("route_ids"),
                                                         F.array_join(F.collect_list(F.substring("route", 7, 1)), ",").alias("sequences"))
    library = packs.join(routes, "pack_id").withColumns({**window, "pools": F.concat_ws(",", "supp", "supp", F.col("supp") + 1, F.col("supp") + 2)})
    library.withColumnsRenamed({"program": "program_id", "family": "family_id", "train_lo": "train_min_slot", "train_hi": "train_max_slot"}).write.parquet(f"{path}/new/library")
    found = [TB.scan_catalog(spark, f"{path}/{at}").withColumn("fmt", F.lit(fmt)) for fmt, at in (("library", "new"), ("legacy", "old"))]
    return found[0].unionByName(found[1]).withColumn("routes", F.array_join("routes", ","))


@query("export_bundle_tables", with_ctes("""
  SELECT 'pool_stats' AS name, (SELECT count(*) FROM priors p FULL JOIN pr_count c ON c.pool = p.pool) AS rows, (SELECT sum(touch) FROM priors)::BIGINT AS content
  UNION ALL SELECT 'pool_routes', (SELECT count(*) FROM pr_top), (SELECT sum(support) FROM pr_top)::BIGINT
  UNION ALL SELECT 'routes', (SELECT count(*) FROM pool_route_ids WHERE route IN (SELECT route FROM pr_top)), (SELECT sum(pool) FROM pool_route_ids WHERE route IN (SELECT route FROM pr_top))::BIGINT
  UNION ALL SELECT 'thresholds', 3, (SELECT sum(sends) FROM (SELECT sends FROM bgrid QUALIFY row_number() OVER (PARTITION BY budget_per_hour ORDER BY val_coins_per_hour DESC, sends) = 1))::BIGINT
  UNION ALL SELECT 'eval', (SELECT count(*) FROM bgrid), (SELECT sum(val_captured) FROM bgrid)::BIGINT"""))
def q_export_bundle(spark, d):
    """A bundle written, checked whole and read back: rows and a sum of each table."""
    path = new_dir(spark, "bundle")
    grid = materialise(PQ.budget_grid(spark, d), "grid")
    w = M.W.partitionBy("budget_per_hour").orderBy(F.desc("val_coins_per_hour"), "sends")
    best = grid.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select("budget_per_hour", "threshold", "sends")
    TB.export_bundle(path, PQ.q_pool_stats(spark, d), PQ.q_rank_pool_routes(spark, d), PQ.routes_long(spark, d), best, grid)
    tables = TB.scan_bundle(spark, path, whole=True)
    content = {"pool_stats": "touch", "pool_routes": "support", "routes": "pool", "thresholds": "sends", "eval": "val_captured"}
    parts = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows"), F.sum(content[n]).cast("bigint").alias("content")) for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("export_landing_tables", with_ctes("""
  SELECT 'pools' AS name, (SELECT count(DISTINCT pool) FROM trig) AS rows UNION ALL SELECT 'parity_sample', (SELECT least(50000, count(*)) FROM tx) UNION ALL SELECT 'parity_window', (SELECT count(*) FROM tx WHERE slot BETWEEN 100 AND 200)"""))
def q_export_landing(spark, d):
    path = new_dir(spark, "landing-tables")
    TB.export_landing(path, S.trig(spark, d).select("pool").distinct(), S.tx(spark, d), "tx_id", (100, 200))
    parts = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) for n in ("pools", "parity_sample", "parity_window")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("scan_raw_jsonl", with_ctes("SELECT slot, tx_id AS tx_index, 'S' || tx_id AS signature, octet_length(encode('tx' || tx_id)) AS bytes FROM tx"))
def q_raw_jsonl(spark, d):
    from txlens.sources import journal as J
    path = new_dir(spark, "raw")
    S.tx(spark, d).select("slot", F.col("tx_id").alias("tx_index"), F.concat(F.lit("S"), "tx_id").alias("signature"), F.hex(F.concat(F.lit("tx"), "tx_id")).alias("raw_hex")).write.json(path)
    return J.scan_raw_jsonl(spark, path).select("slot", "tx_index", "signature", F.octet_length("raw").alias("bytes"))


@query("scan_attempts", with_ctes("SELECT fmt, phase, count(*) AS n, sum(send_ns)::BIGINT AS send_ns FROM (SELECT CASE WHEN tx_id % 4 = 0 THEN 'cold' ELSE 'warm' END AS phase, amount AS send_ns FROM tx), (SELECT unnest(['json', 'csv']) AS fmt) GROUP BY ALL"))
def q_scan_attempts(spark, d):
    from txlens.sources import journal as J
    path = new_dir(spark, "attempts")
    t = S.tx(spark, d).select(F.col("tx_id").alias("attempt"), F.when(F.col("tx_id") % 4 == 0, "cold").otherwise("warm").alias("phase"), F.col("amount").alias("send_ns"), (F.col("landed") == 1).alias("landed"))
    t.write.json(f"{path}/json")
    t.write.option("header", True).csv(f"{path}/csv")
    g = [J.scan_attempts(spark, f"{path}/{f}", f).groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.sum("send_ns").alias("send_ns")).withColumn("fmt", F.lit(f)) for f in ("json", "csv")]
    return g[0].unionByName(g[1])
