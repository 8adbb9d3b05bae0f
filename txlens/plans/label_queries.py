"""Labels, keys, eligibility, coverage, pairs and label-derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from txlens.functions import bits
from txlens.operators import labels as L
from txlens.plans import standin as S
from txlens.plans.registry import query
from txlens.plans.standin import SAMPLE_PPM, with_ctes
from txlens.session import materialise


def tx_routes(spark, d):
    return L.packed_routes(S.positives(spark, d))


class Stages:
    """The tables one report shares, each built once and written to the shared folder like the stages of a build."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d
        self.labels = materialise(L.tx_labels(S.trig(spark, d)), "labels")
        self.routes = materialise(tx_routes(spark, d).distinct(), "routes")
        packs = S.packs(spark, d)
        hits = materialise(L.eligible_hits(S.trig(spark, d), packs, S.pack_routes(packs), self.routes), "eligible")
        self.eligible, self.cover = hits.drop("hit"), hits.where("hit").drop("hit")

    def pairs(self, depth=2):
        return L.expand_pairs(self.labels, S.tx(self.spark, self.d), self.eligible, self.cover, depth, SAMPLE_PPM)

    def grouped(self):
        return L.with_target3(L.with_group(self.labels.join(S.tx(self.spark, self.d), "tx_id")))


def labelled(spark, d, routes=False):
    """Labels with the transaction's own columns."""
    lab = L.tx_labels(S.trig(spark, d), tx_routes(spark, d) if routes else None)
    return lab.join(S.tx(spark, d), "tx_id")


def eligible(spark, d):
    return L.eligible_packs(S.trig(spark, d), S.packs(spark, d))


def covered(spark, d):
    return L.covering(eligible(spark, d), S.pack_routes(S.packs(spark, d)), tx_routes(spark, d))


@query("tx_labels", with_ctes("""
  SELECT l.* EXCLUDE (target), l.target, coalesce(r.n_routes, 0) AS n_routes, coalesce(r.profitable_routes, '') AS profitable_routes
  FROM labels l LEFT JOIN (SELECT tx_id, count(*) AS n_routes, string_agg(route, ',' ORDER BY route) AS profitable_routes
                           FROM pos_routes GROUP BY tx_id) r ON r.tx_id = l.tx_id"""))
def q_tx_labels(spark, d):
    return L.tx_labels(S.trig(spark, d), tx_routes(spark, d))


@query("scan_positives", with_ctes("""
  SELECT route, count(*) AS occurrences FROM (SELECT tx_id, unnest(string_split(routes, ',')) AS route FROM positives)
  WHERE route <> '' GROUP BY route"""))
def q_scan_positives(spark, d):
    return tx_routes(spark, d).groupBy("route").agg(F.count(F.lit(1)).alias("occurrences"))


@query("label_integrity", with_ctes("""
  SELECT (SELECT count(*) FROM (SELECT tx_id FROM trig JOIN tx USING (tx_id) GROUP BY tx_id HAVING min(slot) <> max(slot))) AS mixed_identity,
         (SELECT count(*) FROM (SELECT tx_id, count(*) FILTER (status = 'POSITIVE') AS n FROM trig GROUP BY tx_id) a
          FULL JOIN (SELECT tx_id, count(*) AS m FROM positives GROUP BY tx_id) b ON a.tx_id = b.tx_id
          WHERE coalesce(n, 0) <> coalesce(m, 0)) AS count_mismatch,
         (SELECT count(*) FROM trig WHERE status = 'POSITIVE') AS positive_rows,
         (SELECT count(*) FROM positives) AS indexed_positives,
         (SELECT count(*) FROM labels WHERE label <> 'POSITIVE' AND tx_id IN (SELECT tx_id FROM pos_routes)) AS routes_without_positive"""))
def q_label_integrity(spark, d):
    trig = S.trig(spark, d)
    with_slot = trig.join(S.tx(spark, d).select("tx_id", "slot"), "tx_id")
    return L.label_problems(with_slot, L.tx_labels(trig), S.positives(spark, d))


TRAIN_TX = (0, 9000)


@query("label_summary", with_ctes(f"""
  SELECT count(*) AS transactions, sum(n_occurrences) AS trigger_rows, sum(n_pos) AS rows_positive, sum(n_neg) AS rows_negative,
         sum(n_occurrences - n_pos - n_neg) AS rows_unknown, count(*) FILTER (label = 'POSITIVE') AS tx_positive,
         count(*) FILTER (label = 'CERTIFIED_NEGATIVE') AS tx_negative, count(*) FILTER (label = 'UNKNOWN') AS tx_unknown,
         count(*) FILTER (label = 'POSITIVE' AND n_eligible_live > 0) AS positive_eligible_live,
         count(*) FILTER (label = 'POSITIVE' AND n_eligible > 0) AS positive_eligible,
         count(*) FILTER (label = 'POSITIVE' AND n_covering_live > 0) AS positive_covered_live,
         count(*) FILTER (label = 'POSITIVE' AND n_covering > 0) AS positive_covered,
         count(*) FILTER (label = 'POSITIVE' AND seen > 0) AS positive_seen_in_train,
         min(slot) AS slot_min, max(slot) AS slot_max
  FROM labels l JOIN tx USING (tx_id) LEFT JOIN cover_counts USING (tx_id)
  LEFT JOIN (SELECT tx_id, count(*) AS seen FROM pos_routes WHERE route IN
             (SELECT route FROM pos_routes WHERE tx_id BETWEEN {TRAIN_TX[0]} AND {TRAIN_TX[1]}) GROUP BY tx_id) s USING (tx_id)"""))
def q_label_summary(spark, d):
    cov = L.cover_rank(eligible(spark, d), covered(spark, d))
    routes = tx_routes(spark, d).distinct()
    seen = routes.join(L.train_routes(routes, *TRAIN_TX), "route", "left_semi").groupBy("tx_id").agg(
        F.count(F.lit(1)).alias("n_seen_in_train"))
    return L.label_summary(labelled(spark, d).join(cov, "tx_id", "left").join(seen, "tx_id", "left"))


@query("masters", with_ctes("SELECT DISTINCT tx_id, slot FROM trig JOIN tx USING (tx_id)"))
def q_masters(spark, d):
    return L.masters(S.trig(spark, d).join(S.tx(spark, d).select("tx_id", "slot"), "tx_id"))


DICTIONARY_SQL = """SELECT *, row_number() OVER (ORDER BY first_tx, program, family, layer, base) - 1 AS key_id FROM
  (SELECT program, family, layer, base, min(tx_id) AS first_tx FROM trig GROUP BY ALL)"""


@query("key_dictionary", with_ctes(DICTIONARY_SQL))
def q_key_dictionary(spark, d):
    return L.key_dictionary(S.trig(spark, d))


@query("trigger_keys", with_ctes(f"""
  WITH dict AS ({DICTIONARY_SQL})
  SELECT tx_id, count(*) AS n_keys, string_agg(key_id::VARCHAR, ',' ORDER BY key_id) AS keys
  FROM (SELECT DISTINCT tx_id, program, family, layer, base FROM trig) JOIN dict USING (program, family, layer, base)
  GROUP BY tx_id"""))
def q_trigger_keys(spark, d):
    trig = S.trig(spark, d)
    return L.trigger_keys(trig, L.key_dictionary(trig)).select(
        "tx_id", F.size("keys").alias("n_keys"), F.array_join("keys", ",").alias("keys"))


@query("eligible_packs", with_ctes("SELECT tx_id, pack_id, pack_rank, live FROM elig"))
def q_eligible_packs(spark, d):
    return eligible(spark, d)


@query("pack_coverage", with_ctes("SELECT tx_id, pack_id, pack_rank, live FROM cover"))
def q_pack_coverage(spark, d):
    return covered(spark, d)


@query("cover_rank", with_ctes("SELECT * FROM cover_counts"))
def q_cover_rank(spark, d):
    return L.cover_rank(eligible(spark, d), covered(spark, d))


S.CTE["pairs"] = """
  SELECT e.tx_id, e.pack_id, e.pack_rank, l.label, e.live AS eligible_live,
         CASE WHEN l.label <> 'UNKNOWN' THEN CASE WHEN c.pack_id IS NULL THEN 0 ELSE 1 END END AS pack_target
  FROM labels l JOIN tx t USING (tx_id) JOIN elig e ON e.tx_id = l.tx_id AND e.pack_rank < 2
  LEFT JOIN cover c ON c.tx_id = e.tx_id AND c.pack_id = e.pack_id
  WHERE l.label = 'POSITIVE' OR (e.live AND (l.label = 'CERTIFIED_NEGATIVE'
        OR (t.relevant = 1 AND l.tx_id IN (SELECT tx_id FROM sampled_tx))))"""


def pairs(spark, d, depth=2):
    t, packs = S.trig(spark, d), S.packs(spark, d)
    return L.pairs_of(L.tx_labels(t), S.tx(spark, d), t, packs, S.pack_routes(packs), tx_routes(spark, d), depth, SAMPLE_PPM)


@query("pairs_expand", with_ctes("SELECT * FROM pairs"))
def q_pairs(spark, d):
    return pairs(spark, d)


@query("pair_sample", with_ctes("""
  SELECT tx_id, CASE WHEN label = 'UNKNOWN' AND tx_id IN (SELECT tx_id FROM sampled_tx) THEN 1 ELSE 0 END AS pair_sample,
         CASE WHEN target IS NOT NULL THEN 1.0::DOUBLE WHEN tx_id IN (SELECT tx_id FROM sampled_tx) THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS weight
  FROM labels"""))
def q_pair_sample(spark, d):
    lab = L.tx_labels(S.trig(spark, d)).withColumn(
        "pair_sample", ((F.col("label") == "UNKNOWN") & bits.sampled(F.col("tx_id"), SAMPLE_PPM)).cast("int"))
    return lab.select("tx_id", "pair_sample", L.sample_weight(SAMPLE_PPM).alias("weight"))


S.CTE["grouped"] = """
  SELECT *, CASE WHEN "group" = 'POSITIVE' THEN 1 WHEN "group" IN ('CERTIFIED_NEGATIVE', 'NO_LABEL') THEN 0 END AS target3 FROM
    (SELECT l.*, t.* EXCLUDE (tx_id), CASE WHEN label = 'UNKNOWN' THEN unknown_reasons ELSE label END AS "group"
     FROM labels l JOIN tx t ON t.tx_id = l.tx_id)"""


def grouped(spark, d):
    return L.with_target3(L.with_group(labelled(spark, d)))


@query("label_group", with_ctes('SELECT "group", count(*) AS n, sum(target3) AS positives, count(target3) AS with_target FROM grouped GROUP BY "group"'))
def q_label_group(spark, d):
    return grouped(spark, d).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("target3").alias("positives"),
                                                  F.count("target3").alias("with_target"))


@query("target3", with_ctes('SELECT tx_id, "group", target3 FROM grouped'))
def q_target3(spark, d):
    return grouped(spark, d).select("tx_id", "group", "target3")


@query("subsample_weighted", with_ctes("""
  SELECT tx_id, CASE WHEN "group" = 'NO_LABEL' THEN 8.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM grouped
  WHERE "group" <> 'NO_LABEL' OR tx_id % 8 = 0"""))
def q_subsample(spark, d):
    return L.subsample(grouped(spark, d)).select("tx_id", "w")


@query("sample_weight", with_ctes("""
  SELECT label, sum(CASE WHEN target IS NOT NULL THEN 1 WHEN s.tx_id IS NOT NULL THEN 4 ELSE 0 END)::DOUBLE AS weight, count(*) AS n
  FROM labels l LEFT JOIN sampled_tx s ON s.tx_id = l.tx_id GROUP BY label"""))
def q_sample_weight(spark, d):
    return q_pair_sample(spark, d).join(L.tx_labels(S.trig(spark, d)).select("tx_id", "label"), "tx_id").groupBy("label").agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


@query("training_rows", with_ctes("""
  SELECT tx_id, target FROM labels JOIN tx USING (tx_id) WHERE target IS NOT NULL AND encode_status = 0"""))
def q_training_rows(spark, d):
    return L.training_rows(labelled(spark, d)).select("tx_id", "target")


@query("library_support", with_ctes(f"""
  WITH meta AS (SELECT p_brand || '/s' || (p_size % 5) AS route, p_partkey % 5 AS part, min(2 + p_partkey % 3) AS hops
                FROM part GROUP BY 1, 2)
  SELECT w.route, m.part, m.hops, m.route IS NULL AS missing, tr.route IS NOT NULL AS in_train
  FROM (SELECT DISTINCT route FROM pack_routes) w
  LEFT JOIN (SELECT * FROM meta QUALIFY row_number() OVER (PARTITION BY route ORDER BY part) = 1) m ON m.route = w.route
  LEFT JOIN (SELECT DISTINCT route FROM pos_routes WHERE tx_id BETWEEN {TRAIN_TX[0]} AND {TRAIN_TX[1]}) tr ON tr.route = w.route"""))
def q_library_support(spark, d):
    meta = S.table(spark, d, "part").select(
        F.concat(F.col("p_brand"), F.lit("/s"), F.col("p_size") % 5).alias("route"), (F.col("p_partkey") % 5).alias("part"),
        (2 + F.col("p_partkey") % 3).alias("hops")).groupBy("route", "part").agg(F.min("hops").alias("hops"))
    sup = L.library_support(meta, S.pack_routes(S.packs(spark, d)))
    seen = L.train_routes(tx_routes(spark, d), *TRAIN_TX).withColumn("in_train", F.lit(True))
    return sup.join(seen, "route", "left").withColumn("in_train", F.coalesce("in_train", F.lit(False)))
