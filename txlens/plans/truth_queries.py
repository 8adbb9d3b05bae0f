"""Feeds, truth joins, races, gaps, outcomes, latency, graph and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from txlens.functions import ordstat
from txlens.functions.numbers import beside, count_if, ratio, rounded, rounded_all
from txlens.operators import funnel as FU
from txlens.operators import graph as G
from txlens.operators import metrics as M
from txlens.operators import sets as SE
from txlens.operators import live as LV
from txlens.operators import truth as T
from txlens.plans import journal_queries as JQ
from txlens.plans import label_queries as LQ
from txlens.plans import landing_queries as LA
from txlens.plans import metric_queries as MQ
from txlens.plans import pool_queries as PQ
from txlens.plans import standin as S
from txlens.plans.registry import query
from txlens.plans.standin import r6, with_ctes
from txlens.session import materialise, new_dir
from txlens.sources import journal as J

# ---------------------------------------------------------------- packets and feeds

S.CTE["packets"] = """
  SELECT event_id % 3 AS source_id, event_id AS seq, epoch_us(ts) * 1000 AS rx_ns, secs // 86400 AS slot, user_id % 20 AS "index", k % 4 AS fec_set, event_type AS type,
         k * 10 AS bytes, k % 50 = 0 AS malformed, user_id || '-' || (secs // 86400) AS sig, k, user_id, event_type FROM gates"""


def packets(spark, d):
    e = S.table(spark, d, "events")
    k = F.from_json("props", "k bigint")["k"]
    base = e.select("event_id", "user_id", "event_type", k.alias("k"), S.epoch_seconds("ts").alias("secs"), (S.epoch_micros("ts") * 1000).alias("rx_ns"))
    day = F.floor(F.col("secs") / 86400)
    return base.select((F.col("event_id") % 3).alias("source_id"), F.col("event_id").alias("seq"), "rx_ns", day.alias("slot"), (F.col("user_id") % 20).alias("index"),
                       (F.col("k") % 4).alias("fec_set"), F.col("event_type").alias("type"), (F.col("k") * 10).alias("bytes"), (F.col("k") % 50 == 0).alias("malformed"),
                       F.concat_ws("-", "user_id", day).alias("sig"), "k", "user_id", "event_type")


KEY = ["slot", "index", "fec_set", "type"]
FIRST_SQL = """first AS (SELECT slot, "index", fec_set, type, arg_min(source_id, (rx_ns, source_id, seq)) AS fs, min(rx_ns) AS frx, arg_min(seq, (rx_ns, source_id, seq)) AS fseq
  FROM good GROUP BY ALL)"""
PCT = lambda p, c="v": f"max({c}) FILTER (i = floor({p}::DOUBLE * (n - 1)))"


@query("race_matrix", with_ctes(f"""
  WITH good AS (SELECT * FROM packets WHERE NOT malformed), {FIRST_SQL},
  late AS (SELECT f.fs AS first, p.source_id AS late, p.rx_ns - f.frx AS v FROM good p JOIN first f USING (slot, "index", fec_set, type) WHERE p.seq <> f.fseq),
  o AS (SELECT *, row_number() OVER (PARTITION BY first, late ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY first, late) AS n FROM late)
  SELECT first, late, max(n) AS n, min(v) AS min_value, max(v) AS max_value, {PCT(0.5)} AS p50, {PCT(0.95)} AS p95, {PCT(0.99)} AS p99 FROM o GROUP BY first, late"""))
def q_race_matrix(spark, d):
    return T.race_matrix(packets(spark, d).where(~F.col("malformed")), KEY)


@query("race_first_counts", with_ctes(f"""
  WITH good AS (SELECT * FROM packets WHERE NOT malformed), {FIRST_SQL}
  SELECT fs AS source_id, count(DISTINCT (f.slot, f."index", f.fec_set, f.type)) AS first_n, count(*) - count(DISTINCT (f.slot, f."index", f.fec_set, f.type)) AS copies_behind
  FROM first f JOIN good p USING (slot, "index", fec_set, type) GROUP BY fs"""))
def q_first_counts(spark, d):
    return T.first_counts(packets(spark, d).where(~F.col("malformed")), KEY)


@query("feed_counters", with_ctes(f"""
  WITH good AS (SELECT * FROM packets WHERE NOT malformed), {FIRST_SQL}, fc AS (SELECT fs, count(*) AS first_n FROM first GROUP BY fs)
  SELECT source_id, count(*) AS received, sum(bytes)::BIGINT AS bytes, count(*) FILTER (malformed) AS malformed, coalesce(any_value(first_n), 0) AS first_n,
         count(*) FILTER (NOT malformed) - coalesce(any_value(first_n), 0) AS late_n FROM packets LEFT JOIN fc ON fs = source_id GROUP BY source_id"""))
def q_feed_counters(spark, d):
    return T.feed_counters(packets(spark, d), KEY)


@query("scan_packet_log", with_ctes("""SELECT fmt, source_id, slot, type, count(*) AS n, min(rx_ns) AS first_ns, max(rx_ns) AS last_ns FROM packets, (SELECT unnest(['json', 'parquet']) AS fmt) GROUP BY ALL"""))
def q_packet_log(spark, d):
    """Packet headers written in both formats of the log and read back."""
    path = new_dir(spark, "packets")
    p = packets(spark, d)
    rows = p.select(*[F.col(c) for c, _ in J._fields(J.PACKET_SCHEMA) if c in p.columns])
    rows.write.json(f"{path}/json")
    rows.write.parquet(f"{path}/parquet")
    missing = [F.lit(None).cast(t).alias(c) for c, t in J._fields(J.PACKET_SCHEMA) if c not in p.columns]
    spark.read.parquet(f"{path}/parquet").select("*", *missing).write.parquet(f"{path}/whole")
    back = [J.scan_packets(spark, f"{path}/{at}", fmt).withColumn("fmt", F.lit(fmt)) for fmt, at in (("json", "json"), ("parquet", "whole"))]
    return back[0].unionByName(back[1]).groupBy("fmt", "source_id", "slot", "type").agg(F.count(F.lit(1)).alias("n"), F.min("rx_ns").alias("first_ns"), F.max("rx_ns").alias("last_ns"))


RACE_CTE = """a AS (SELECT sig, min(rx_ns) AS a_ns, arg_min(event_type, rx_ns) AS event_type FROM packets WHERE source_id = 0 GROUP BY sig),
  b AS (SELECT sig, min(rx_ns) AS b_ns FROM packets WHERE source_id = 1 GROUP BY sig),
  r AS (SELECT coalesce(a.sig, b.sig) AS sig, a_ns, b_ns, event_type, b_ns - a_ns AS lead_ns,
    CASE WHEN b_ns IS NULL THEN 'a_only' WHEN a_ns IS NULL THEN 'b_only' WHEN b_ns > a_ns THEN 'a' WHEN b_ns < a_ns THEN 'b' ELSE 'tie' END AS first FROM a FULL JOIN b ON a.sig = b.sig)"""


def race(spark, d):
    p = packets(spark, d)
    return T.feed_race(p.where(F.col("source_id") == 0), p.where(F.col("source_id") == 1), ["event_type"])


@query("feed_race", with_ctes(f"WITH {RACE_CTE} SELECT sig, a_ns, b_ns, lead_ns, first FROM r"))
def q_feed_race(spark, d):
    return race(spark, d).select("sig", "a_ns", "b_ns", "lead_ns", "first")


@query("feed_race_summary", with_ctes(f"""
  WITH {RACE_CTE}, l AS (SELECT slice, lead_ns AS v FROM (SELECT lead_ns, unnest(['all', CASE WHEN event_type = 'click' THEN 'click' END, CASE WHEN lead_ns % 2 = 0 THEN 'even' END]) AS slice FROM r WHERE lead_ns IS NOT NULL)
         WHERE slice IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY slice) AS n FROM l)
  SELECT slice, max(n) AS n, min(v) AS min_value, max(v) AS max_value, {", ".join(f"{PCT(p)} AS {n}" for n, p in T.LEAD_PERCENTILES.items())},
         count(*) FILTER (v > 0) AS a_first, count(*) FILTER (v < 0) AS b_first, count(*) FILTER (v = 0) AS ties FROM o GROUP BY slice"""))
def q_race_summary(spark, d):
    return T.race_summary(race(spark, d), {"all": F.lit(True), "click": F.col("event_type") == "click", "even": F.col("lead_ns") % 2 == 0})


@query("lead_bucket", with_ctes(f"""
  WITH {RACE_CTE} SELECT first, CASE WHEN x > 20000000 THEN '>20ms' WHEN x > 10000000 THEN '10-20ms' WHEN x > 5000000 THEN '5-10ms' WHEN x > 2000000 THEN '2-5ms' WHEN x > 1000000 THEN '1-2ms'
    WHEN x > 500000 THEN '0.5-1ms' ELSE '0-0.5ms' END AS bucket, count(*) AS n FROM (SELECT first, abs(lead_ns) AS x FROM r WHERE lead_ns IS NOT NULL) GROUP BY ALL"""))
def q_lead_bucket(spark, d):
    r = race(spark, d).where(F.col("lead_ns").isNotNull())
    return r.groupBy("first", T.lead_bucket(F.abs("lead_ns")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("slot_coverage", with_ctes("""
  WITH a AS (SELECT DISTINCT slot, sig FROM packets WHERE source_id = 0), b AS (SELECT DISTINCT slot, sig FROM packets WHERE source_id = 1)
  SELECT coalesce(a.slot, b.slot) AS slot, count(a.sig) AS n_a, count(b.sig) AS n_b, count(*) FILTER (a.sig IS NOT NULL AND b.sig IS NOT NULL) AS n_both,
         count(*) FILTER (b.sig IS NULL) AS a_only, count(*) FILTER (a.sig IS NULL) AS b_only FROM a FULL JOIN b ON a.slot = b.slot AND a.sig = b.sig GROUP BY 1"""))
def q_slot_coverage(spark, d):
    p = packets(spark, d)
    return T.slot_coverage(p.where(F.col("source_id") == 0).select("slot", "sig").distinct(), p.where(F.col("source_id") == 1).select("slot", "sig").distinct())


RECON_CTE = """recon AS (SELECT 'S' || tx_id AS sig, CASE WHEN tx_id % 100 = 1 THEN slot + 1 WHEN tx_id % 100 = 2 THEN NULL ELSE slot END AS slot,
    CASE WHEN tx_id % 90 = 3 THEN 1 ELSE 0 END AS idx, CASE WHEN tx_id % 80 = 4 THEN NULL ELSE 0 END AS version FROM tx WHERE tx_id % 10 <> 0),
  truth AS (SELECT 'S' || tx_id AS sig, slot, 0 AS idx, CASE WHEN tx_id % 70 = 5 THEN 1 ELSE 0 END AS version FROM tx WHERE tx_id % 13 <> 0)"""


def recon_truth(spark, d):
    t = S.tx(spark, d).select("tx_id", "slot", F.concat(F.lit("S"), "tx_id").alias("sig"))
    k = F.col("tx_id")
    recon = t.where(k % 10 != 0).select("sig", F.when(k % 100 == 1, F.col("slot") + 1).when(k % 100 == 2, None).otherwise(F.col("slot")).alias("slot"),
                                        F.when(k % 90 == 3, 1).otherwise(0).alias("idx"), F.when(k % 80 != 4, 0).alias("version"))
    truth = t.where(k % 13 != 0).select("sig", "slot", F.lit(0).alias("idx"), F.when(k % 70 == 5, 1).otherwise(0).alias("version"))
    return recon, truth


def compare_sql(src: str) -> str:
    return f"""SELECT count(t.sig) AS truth, count(r.sig) AS recon, count(*) FILTER (b) AS compared, count(*) FILTER (b AND NOT coalesce(r.slot <> t.slot, false)) AS slot_match,
      count(*) FILTER (b AND r.slot <> t.slot) AS slot_mismatch, count(*) FILTER (b AND r.idx <> t.idx) AS index_mismatch, count(*) FILTER (b AND r.version <> t.version) AS version_mismatch,
      count(*) FILTER (r.sig IS NULL) AS truth_only FROM (SELECT r, t, r.sig IS NOT NULL AND t.sig IS NOT NULL AS b FROM {src} r FULL JOIN truth t ON t.sig = r.sig)"""


@query("feed_compare", with_ctes(f"WITH {RECON_CTE} {compare_sql('recon')}"))
def q_feed_compare(spark, d):
    return T.feed_compare(*recon_truth(spark, d))


@query("feed_compare_first_slots", with_ctes(f"""
  WITH {RECON_CTE}, lim AS (SELECT max(slot) AS m FROM (SELECT DISTINCT slot FROM recon WHERE slot IS NOT NULL ORDER BY slot LIMIT 200)),
  recon2 AS (SELECT recon.* FROM recon, lim WHERE slot <= m) {compare_sql('recon2')}"""))
def q_feed_compare_slots(spark, d):
    recon, truth = recon_truth(spark, d)
    return T.feed_compare(recon.where(F.col("slot").isNotNull()), truth, 200)


@query("scan_truth", with_ctes("""
  SELECT lower(sig) AS sig_hex, arg_max(slot, (tx_id % 2, tx_id)) AS slot FROM (SELECT tx_id, slot, CASE WHEN tx_id % 17 = 0 THEN 'short' ELSE sha256((payer)::VARCHAR) END AS sig FROM tx)
  WHERE length(sig) >= 64 GROUP BY 1"""))
def q_scan_truth(spark, d):
    """Two files of lines in order of the transactions; the last row of a key in the second file wins, else in the first."""
    path = new_dir(spark, "truth")
    t = S.tx(spark, d).select("tx_id", "slot", F.when(F.col("tx_id") % 17 == 0, "short").otherwise(F.upper(F.sha2(F.col("payer").cast("string"), 256))).alias("sig_hex"))
    for part in (0, 1):
        rows = t.where(F.col("tx_id") % 2 == part).repartitionByRange(4, "tx_id").sortWithinPartitions("tx_id")
        rows.select(F.to_json(F.struct("sig_hex", "slot")).alias("value")).write.text(f"{path}/file={part}")
    return J.scan_truth(spark, path).select("sig_hex", "slot")


S.CTE["data_rows"] = 'SELECT DISTINCT l_orderkey AS slot, (l_linenumber - 1)::BIGINT AS "index" FROM lineitem'
S.CTE["prefix"] = """
  SELECT slot, count(*) AS n, min("index") = 0 AS has_zero, count(*) FILTER (rn = "index") AS first_hole FROM
    (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY "index") - 1 AS rn FROM data_rows) GROUP BY slot"""


def data_rows(spark, d):
    return S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("slot"), (F.col("l_linenumber") - 1).cast("bigint").alias("index"))


@query("prefix_gap", with_ctes("SELECT * FROM prefix"))
def q_prefix(spark, d):
    return T.prefix_gap(data_rows(spark, d))


@query("gap_attribution", with_ctes("""
  WITH fixed AS (SELECT slot, count(*) FILTER (rn = "index") AS h FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY "index") - 1 AS rn FROM
      (SELECT * FROM data_rows UNION SELECT DISTINCT slot, 0 FROM data_rows UNION SELECT DISTINCT slot, 1 FROM data_rows)) GROUP BY slot),
  miss AS (SELECT o_orderkey AS slot, o_custkey % 7 AS "index" FROM orders)
  SELECT cause, count(*) AS n FROM (SELECT CASE WHEN "index" < p.first_hole THEN 'in_prefix' WHEN "index" < r.h THEN 'in_repaired_prefix' ELSE 'absent' END AS cause
    FROM miss m LEFT JOIN prefix p ON p.slot = m.slot LEFT JOIN fixed r ON r.slot = m.slot) GROUP BY cause"""))
def q_gap_attribution(spark, d):
    rows = data_rows(spark, d)
    fixed = rows.select("slot").distinct().select("slot", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("index"))
    miss = S.table(spark, d, "orders").select(F.col("o_orderkey").alias("slot"), (F.col("o_custkey") % 7).alias("index"))
    return T.gap_attribution(miss, T.prefix_gap(rows), T.prefix_gap(rows.unionByName(fixed))).groupBy("cause").agg(F.count(F.lit(1)).alias("n"))


FLAGS = {"slot_seen": "tx_id % 29 <> 0", "raw": "tx_id % 23 <> 0", "recon": "tx_id % 5 <> 0", "verified": "tx_id % 7 <> 0", "conflict": "tx_id % 31 = 0", "have0": "tx_id % 37 <> 0",
         "below_mark": "tx_id % 41 <> 0", "idx_match": "tx_id % 43 <> 0", "unresolved": "tx_id % 11 = 0"}


def probes(spark, d):
    return S.tx(spark, d).select("tx_id", (F.col("payer") % 3).alias("slot_n"), *[F.expr(e).alias(n) for n, e in FLAGS.items()])


PROBE_SQL = "p AS (SELECT tx_id, payer % 3 AS slot_n, " + ", ".join(f"{e} AS {n}" for n, e in FLAGS.items()) + " FROM tx)"


@query("loss_class", with_ctes(f"""
  WITH {PROBE_SQL} SELECT CASE WHEN NOT slot_seen THEN 'slot_absent' WHEN NOT raw THEN 'bytes_absent' WHEN NOT recon THEN 'not_rebuilt' WHEN NOT verified THEN 'bad_signature' ELSE 'ok' END AS loss,
  count(*) AS n FROM p GROUP BY 1"""))
def q_loss_class(spark, d):
    return probes(spark, d).groupBy(T.loss_class().alias("loss")).agg(F.count(F.lit(1)).alias("n"))


@query("loss_stage", with_ctes(f"""
  WITH {PROBE_SQL} SELECT CASE WHEN NOT slot_seen OR NOT raw THEN 'feed_missing' WHEN conflict THEN 'wrong_branch' WHEN NOT have0 OR NOT below_mark THEN 'prefix_gap'
    WHEN recon AND verified THEN CASE WHEN NOT idx_match THEN 'tx_parse' WHEN unresolved THEN 'classifier' ELSE 'ok' END WHEN recon THEN 'tx_parse'
    WHEN slot_n = 0 THEN 'entry_parse' ELSE 'tx_parse' END AS stage, count(*) AS n FROM p GROUP BY 1"""))
def q_loss_stage(spark, d):
    return probes(spark, d).groupBy(T.loss_stage().alias("stage")).agg(F.count(F.lit(1)).alias("n"))


@query("wire_class", with_ctes("""
  WITH f AS (SELECT tx_id, bool_or(supp % 17 = 0) AS a, bool_or(supp % 19 = 0) AS b, bool_or(supp % 5 = 0) AS r, bool_or(pool % 7 = 0) AS w, bool_or(base = '') AS u FROM trig GROUP BY tx_id)
  SELECT tx_id, CASE WHEN a THEN 'direct_a' WHEN b THEN 'direct_b' WHEN r THEN 'router' WHEN w THEN 'watched' WHEN u THEN 'unresolved' ELSE 'other' END AS class FROM f"""))
def q_wire_class(spark, d):
    s = F.col("supp")
    f = S.trig(spark, d).groupBy("tx_id").agg(F.bool_or(s % 17 == 0).alias("direct_a"), F.bool_or(s % 19 == 0).alias("direct_b"), F.bool_or(s % 5 == 0).alias("router"),
                                              F.bool_or(F.col("pool") % 7 == 0).alias("watched"), F.bool_or(F.col("base") == "").alias("unresolved"))
    return f.select("tx_id", T.wire_class().alias("class"))


# ---------------------------------------------------------------- outcomes and truth

@query("outcome_class", with_ctes("""
  SELECT t.tx_id, CASE WHEN o.o_orderkey IS NULL THEN 'disappeared' WHEN o.o_orderstatus = 'F' THEN 'landed-success' ELSE 'landed-failed' END AS outcome
  FROM tx t LEFT JOIN orders o ON o.o_orderkey = t.tx_id AND o.o_orderkey % 6 <> 0"""))
def q_outcome_class(spark, d):
    return outcomes(spark, d)


S.CTE["outcomes"] = """SELECT o_orderkey AS tx_id, CASE WHEN o_orderkey % 6 = 0 THEN 'disappeared' WHEN o_orderstatus = 'F' THEN 'landed-success' ELSE 'landed-failed' END AS outcome FROM orders"""


def outcomes(spark, d):
    st = S.table(spark, d, "orders").where(F.col("o_orderkey") % 6 != 0).select(
        F.col("o_orderkey").alias("tx_id"), F.lit(1).alias("status_slot"), F.when(F.col("o_orderstatus") != "F", "err").alias("err"))
    return S.tx(spark, d).select("tx_id").join(st, "tx_id", "left").select("tx_id", T.outcome_class().alias("outcome"))


HZ = [f"t{i}" for i in range(1, 8)]
HZ_SQL = f"""hz AS (SELECT tx_id, h.horizon, CASE (tx_id * h.i) % 5 WHEN 0 THEN 'incomplete' WHEN 1 THEN 'invalid' ELSE 'framed' END AS class,
    CASE WHEN (tx_id * h.i) % 5 <> 0 THEN amount % 5000 + h.i END AS us FROM tx, (SELECT unnest(range(1, 8)) AS i, 't' || unnest(range(1, 8)) AS horizon) h)"""


def frames(spark, d):
    cols = []
    for i, h in enumerate(HZ, 1):
        m = F.col("tx_id") * i % 5
        cols += [F.when(m == 0, None).when(m == 1, "invalid").otherwise("framed").alias(f"{h}_class"), F.when(m != 0, F.col("amount") % 5000 + i).alias(f"{h}_us")]
    return S.tx(spark, d).select("tx_id", *cols)


@query("truth_outcomes", with_ctes(f"WITH {HZ_SQL} SELECT hz.tx_id, horizon, class, us, outcome FROM hz JOIN outcomes o ON o.tx_id = hz.tx_id"))
def q_truth_outcomes(spark, d):
    return T.horizons_long(frames(spark, d), HZ).join(outcomes(spark, d), "tx_id").select("tx_id", "horizon", "class", "us", "outcome")


@query("horizon_confusion", with_ctes(f"""
  WITH {HZ_SQL}, g AS (SELECT horizon, class, count(*) AS n, count(*) FILTER (outcome = 'landed-success') AS landed, count(*) FILTER (outcome = 'landed-failed') AS failed,
    count(*) FILTER (outcome = 'disappeared') AS gone FROM hz JOIN outcomes o ON o.tx_id = hz.tx_id GROUP BY ALL),
  t AS (SELECT horizon, coalesce(sum(landed) FILTER (class = 'framed'), 0) AS tp, coalesce(sum(gone + failed) FILTER (class = 'framed'), 0) AS fp, sum(landed) AS al FROM g GROUP BY horizon)
  SELECT g.*, {r6('100 * (landed + failed) / n')} AS commit_pct, {r6('100 * tp / nullif(tp + fp, 0)')} AS precision_if_framed, {r6('100 * tp / al')} AS recall_of_landed FROM g JOIN t USING (horizon)"""))
def q_horizon_confusion(spark, d):
    return rounded_all(T.horizon_confusion(q_truth_outcomes(spark, d)), ["commit_pct", "precision_if_framed", "recall_of_landed"])


@query("horizon_latency", with_ctes(f"""
  WITH {HZ_SQL}, o AS (SELECT horizon, us AS v, row_number() OVER (PARTITION BY horizon ORDER BY us) - 1 AS i, count(*) OVER (PARTITION BY horizon) AS n FROM hz WHERE class = 'framed')
  SELECT horizon, max(n) AS n, min(v) AS min_value, max(v) AS max_value, {PCT(0.5)} AS p50, {PCT(0.9)} AS p90 FROM o GROUP BY horizon"""))
def q_horizon_latency(spark, d):
    f = T.horizons_long(frames(spark, d), HZ).where(F.col("class") == "framed")
    return ordstat.index_percentiles(f, "us", {"p50": 0.5, "p90": 0.9}, ["horizon"])


ENTRY_SQL = "CASE amount % 4 WHEN 0 THEN 'FRAGMENT_ONLY' WHEN 1 THEN 'FALSE_TRIGGER' WHEN 2 THEN 'ENTRY_VALID' ELSE 'NO_CAP' END"


@query("entry_truth", with_ctes(f"""
  WITH x AS (SELECT {ENTRY_SQL} AS class, outcome, amount % 100003 AS v FROM tx JOIN outcomes USING (tx_id)),
  g AS (SELECT class, count(*) AS n, count(*) FILTER (outcome = 'landed-success') AS landed_success, count(*) FILTER (outcome = 'landed-failed') AS landed_failed,
          count(*) FILTER (outcome = 'disappeared') AS disappeared FROM x GROUP BY class),
  o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM x WHERE class = 'ENTRY_VALID'),
  p AS (SELECT {PCT(0.5)} AS p50, {PCT(0.9)} AS p90, {PCT(0.99)} AS p99 FROM o)
  SELECT g.*, {r6('100 * (landed_success + landed_failed) / n')} AS commit_pct, {r6('100 * landed_success / (landed_success + landed_failed)')} AS success_given_commit_pct, p50, p90, p99 FROM g, p"""))
def q_entry_truth(spark, d):
    a = F.col("amount") % 4
    cls = F.when(a == 0, "FRAGMENT_ONLY").when(a == 1, "FALSE_TRIGGER").when(a == 2, "ENTRY_VALID").otherwise("NO_CAP")
    x = S.tx(spark, d).select("tx_id", cls.alias("class"), (F.col("amount") % 100003).alias("dt")).join(outcomes(spark, d), "tx_id")
    o = F.col("outcome")
    g = x.groupBy("class").agg(F.count(F.lit(1)).alias("n"), count_if(o == "landed-success").alias("landed_success"), count_if(o == "landed-failed").alias("landed_failed"),
                               count_if(o == "disappeared").alias("disappeared"))
    c = F.col("landed_success") + F.col("landed_failed")
    p = ordstat.index_percentiles(x.where(F.col("class") == "ENTRY_VALID"), "dt", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).select("p50", "p90", "p99")
    return beside(g.select("*", rounded(100.0 * ratio(c, "n")).alias("commit_pct"), rounded(100.0 * ratio("landed_success", c)).alias("success_given_commit_pct")), p)


SPANS = {"resolve": ("pos", 900), "score": ("qty", 77), "sign": ("supp", 1300)}


@query("latency_spans", with_ctes(f"""
  WITH l AS ({' UNION ALL '.join(f"SELECT '{n}' AS span, layer AS feed, amount % {m} + {c} AS v FROM trig" for n, (c, m) in SPANS.items())}),
  o AS (SELECT *, row_number() OVER (PARTITION BY span, feed ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY span, feed) AS n FROM l)
  SELECT span, feed, max(n) AS n, min(v) AS min_value, max(v) AS max_value, {PCT(0.5)} AS p50, {PCT(0.9)} AS p90, {PCT(0.99)} AS p99, {PCT(0.999)} AS p999 FROM o GROUP BY span, feed"""))
def q_latency_spans(spark, d):
    t = S.trig(spark, d).withColumnRenamed("layer", "feed")
    long = T.spans_long(t, {n: F.col("amount") % m + F.col(c) for n, (c, m) in SPANS.items()}, ["feed"])
    return T.latency_spans(long, ["span", "feed"])


ATT_SQL = """att AS (SELECT tx_id, CASE WHEN tx_id % 4 = 0 THEN 'cold' ELSE 'warm' END AS phase, CASE WHEN tx_id % 9 = 0 THEN 'send_fail' ELSE '' END AS err,
    CASE WHEN tx_id % 3 = 0 THEN 'new' ELSE 'reused' END AS conn, amount % 12000000 AS send_ns, landed = 1 AS landed, CASE WHEN landed = 1 THEN 5000 END AS fee FROM tx)"""


def attempts(spark, d):
    k = F.col("tx_id")
    return S.tx(spark, d).select("tx_id", F.when(k % 4 == 0, "cold").otherwise("warm").alias("phase"), F.when(k % 9 == 0, "send_fail").otherwise("").alias("err"),
                                 F.when(k % 3 == 0, "new").otherwise("reused").alias("conn"), (F.col("amount") % 12000000).alias("send_ns"), (F.col("landed") == 1).alias("landed"),
                                 F.when(F.col("landed") == 1, 5000).alias("fee_lamports"))


HALF = lambda p: f"max(v) FILTER (i = floor({p}::DOUBLE * (n - 1) + 0.5))"


@query("attempt_summary", with_ctes(f"""
  WITH {ATT_SQL}, ok AS (SELECT * FROM att WHERE err <> 'send_fail' AND send_ns > 0),
  o AS (SELECT phase, send_ns AS v, row_number() OVER (PARTITION BY phase ORDER BY send_ns) - 1 AS i, count(*) OVER (PARTITION BY phase) AS n FROM ok),
  p AS (SELECT phase, max(n) AS ok_send, {HALF(0.5)} AS p50, {HALF(0.9)} AS p90, {HALF(0.99)} AS p99, min(v) AS send_min, max(v) AS send_max FROM o GROUP BY phase)
  SELECT a.phase, count(*) AS attempts, count(*) FILTER (err = 'send_fail') AS send_fail, count(*) FILTER (conn = 'reused') AS reused,
    count(*) FILTER (err <> 'send_fail' AND send_ns > 0 AND landed) AS landed, coalesce(sum(fee), 0)::BIGINT AS fees,
    {", ".join(f"count(*) FILTER (err <> 'send_fail' AND send_ns > 0 AND send_ns <= {us * 1000}) AS le_{us}us" for us in T.SEND_BUDGETS_US)},
    any_value(ok_send) AS ok_send, any_value(p50) AS p50, any_value(p90) AS p90, any_value(p99) AS p99, any_value(send_min) AS send_min, any_value(send_max) AS send_max
  FROM att a LEFT JOIN p ON p.phase = a.phase GROUP BY a.phase"""))
def q_attempts(spark, d):
    return T.attempt_summary(attempts(spark, d))


# ---------------------------------------------------------------- accounts and tables

S.CTE["luts"] = 'SELECT p_partkey % 50 AS "table", p_partkey // 50 AS idx, p_partkey AS account FROM part'
S.CTE["resolved"] = """
  SELECT tx_id, NOT bool_or(account IS NULL) AS resolved, CASE WHEN NOT bool_or(account IS NULL) THEN string_agg(account::VARCHAR, ',' ORDER BY section, pos, idx, account) END AS accounts,
         CASE WHEN NOT bool_or(account IS NULL) THEN count(*) END AS n_accounts FROM (
    SELECT tx_id, 0 AS section, pos, 0 AS idx, supp AS account FROM trig WHERE layer = 'TOP_LEVEL'
    UNION ALL SELECT tx_id, CASE WHEN writable THEN 1 ELSE 2 END, pos, t.idx, l.account FROM
      (SELECT tx_id, pos, writable, pool % 50 AS tb, pool // 50 + CASE WHEN supp % 20 = 0 THEN 1000000000 ELSE 0 END AS idx FROM trig WHERE layer <> 'TOP_LEVEL') t
      LEFT JOIN luts l ON l."table" = t.tb AND l.idx = t.idx) GROUP BY tx_id"""


@query("table_resolve", with_ctes("SELECT * FROM resolved"))
def q_table_resolve(spark, d):
    t = S.trig(spark, d)
    static = t.where(F.col("layer") == "TOP_LEVEL").select("tx_id", "pos", F.col("supp").alias("account"))
    lk = t.where(F.col("layer") != "TOP_LEVEL").select("tx_id", "pos", (F.floor(F.col("pool") / 50) + F.when(F.col("supp") % 20 == 0, 1000000000).otherwise(0)).alias("idx"),
                                                       (F.col("pool") % 50).alias("table"), "writable")
    tables = S.table(spark, d, "part").select((F.col("p_partkey") % 50).alias("table"), F.floor(F.col("p_partkey") / 50).alias("idx"), F.col("p_partkey").alias("account"))
    return T.resolve_keys(static, lk, tables).select("tx_id", "resolved", F.array_join(F.col("accounts").cast("array<string>"), ",").alias("accounts"), "n_accounts")


@query("table_learn", with_ctes("""
  SELECT supp AS "table", min(tx_id) AS first_seq FROM trig WHERE supp % 20 = 0 AND supp % 3 <> 0 AND supp % 7 <> 1 GROUP BY supp ORDER BY first_seq, supp LIMIT 16"""))
def q_table_learn(spark, d):
    m = S.trig(spark, d).where(F.col("supp") % 20 == 0).select(F.col("supp").alias("table"), F.col("tx_id").alias("seq"))
    s = S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("table"))
    return T.tables_to_fetch(m, s.where(F.col("table") % 3 == 0), s.where(F.col("table") % 7 == 1))


@query("watch_hits", with_ctes("""
  WITH u AS (SELECT p_partkey AS pool, p_partkey + 1 AS vault_x, p_partkey * 2 AS vault_y FROM part WHERE p_size % 3 = 0),
  i AS (SELECT pool AS owner, pool AS account, 'pool' AS role FROM u UNION ALL SELECT pool, vault_x, 'vault_x' FROM u UNION ALL SELECT pool, vault_y, 'vault_y' FROM u)
  SELECT tx_id, count(*) AS hits, count(*) FILTER (role = 'pool') AS pool_hits, min(owner) AS first_pool FROM tx_keys k JOIN i ON i.account = k.account GROUP BY tx_id"""))
def q_watch_hits(spark, d):
    p = F.col("p_partkey")
    u = S.table(spark, d, "part").where(F.col("p_size") % 3 == 0).select(p.alias("pool"), (p + 1).alias("vault_x"), (p * 2).alias("vault_y"))
    return T.watch_hits(LA.tx_keys(spark, d).select("tx_id", "account"), u)


MEMBER_SQL = "f AS (SELECT pool, count(*) AS n, pool IN (SELECT p_partkey FROM part WHERE p_size % 3 = 0) AS hit FROM trig GROUP BY pool)"


def member(spark, d):
    u = S.table(spark, d, "part").where(F.col("p_size") % 3 == 0).select(F.col("p_partkey").alias("pool"))
    return T.membership(S.trig(spark, d).select("pool"), u, 20)


@query("membership", with_ctes(f"WITH {MEMBER_SQL} SELECT hit, pool, n FROM (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY n DESC, pool) AS rn FROM f) WHERE rn <= 20"))
def q_membership(spark, d):
    return member(spark, d)[1]


@query("membership_totals", with_ctes(f"WITH {MEMBER_SQL} SELECT sum(n) AS rows, sum(n) FILTER (hit) AS hits, count(*) AS pools, count(*) FILTER (hit) AS pools_hit FROM f"))
def q_membership_totals(spark, d):
    return member(spark, d)[0]


@query("slot_overlap", with_ctes("""
  WITH feed AS (SELECT tx_id, slot FROM tx WHERE payer % 10 = 3 AND slot BETWEEN 500 AND 1500), span AS (SELECT min(slot) AS lo, max(slot) AS hi FROM feed)
  SELECT count(*) AS in_range, count(*) FILTER (l.tx_id IN (SELECT tx_id FROM trig WHERE pool IN (SELECT pool FROM trig WHERE tx_id IN (SELECT tx_id FROM feed) AND supp % 9 = 0))) AS with_account
  FROM labels l JOIN tx t ON t.tx_id = l.tx_id, span WHERE t.slot BETWEEN lo AND hi"""))
def q_slot_overlap(spark, d):
    feed = S.tx(spark, d).where((F.col("payer") % 10 == 3) & F.col("slot").between(500, 1500)).select("tx_id", "slot")
    acc = S.trig(spark, d).select("tx_id", F.col("pool").alias("account"), "supp")
    fa = acc.where(F.col("supp") % 9 == 0).join(feed, "tx_id", "left_semi")
    return T.slot_overlap(LQ.labelled(spark, d).select("tx_id", "slot"), feed, acc.select("tx_id", "account"), fa)


@query("later_arbs", with_ctes("""
  WITH r AS (SELECT p.tx_id, p.pool, t.slot, t.landed = 1 AS ok, t.relevant = 1 AS both, row_number() OVER (PARTITION BY pool ORDER BY slot, p.tx_id) AS place FROM tx_pools p JOIN tx t ON t.tx_id = p.tx_id),
  dec AS (SELECT DISTINCT tx_id, pool FROM trig WHERE status = 'POSITIVE'),
  j AS (SELECT a.tx_id, a.pool, b.tx_id AS lt, b.slot = a.slot AS ss, b.place FROM dec JOIN r a ON a.tx_id = dec.tx_id AND a.pool = dec.pool
        JOIN r b ON b.pool = a.pool AND b.place > a.place AND b.slot <= a.slot + 200 AND b.ok AND b.both)
  SELECT dec.tx_id, dec.pool, min_by(lt, place) AS later_tx, min_by(ss, place) AS same_slot
  FROM dec LEFT JOIN j ON j.tx_id = dec.tx_id AND j.pool = dec.pool GROUP BY ALL"""))
def q_later_arbs(spark, d):
    return later(spark, d)


def later(spark, d):
    t = S.tx(spark, d).select("tx_id", "slot", (F.col("landed") == 1).alias("ok"), (F.col("relevant") == 1).alias("both"))
    rows = PQ.tx_pools(spark, d).join(t, "tx_id")
    dec = S.trig(spark, d).where(F.col("status") == "POSITIVE").select("tx_id", "pool").distinct()
    return T.later_arbs(dec, rows, 200)


@query("outcome_report", with_ctes("""
  WITH r AS (SELECT p.tx_id, p.pool, t.slot, t.landed = 1 AND t.relevant = 1 AS hit, row_number() OVER (PARTITION BY pool ORDER BY slot, p.tx_id) AS place FROM tx_pools p JOIN tx t ON t.tx_id = p.tx_id),
  dec AS (SELECT DISTINCT tx_id, pool FROM trig WHERE status = 'POSITIVE'),
  j AS (SELECT a.tx_id, a.pool, min_by(b.slot = a.slot, b.place) FILTER (b.hit) AS ss FROM dec JOIN r a ON a.tx_id = dec.tx_id AND a.pool = dec.pool
        JOIN r b ON b.pool = a.pool AND b.place > a.place AND b.slot <= a.slot + 200 GROUP BY ALL)
  SELECT count(*) AS n, count(*) FILTER (t.landed = 1) AS landed, count(*) FILTER (t.amount % 3 = 0) AS edge_exists, count(j.ss) AS later_arb, count(*) FILTER (j.ss) AS same_slot_arb
  FROM dec JOIN tx t ON t.tx_id = dec.tx_id LEFT JOIN j ON j.tx_id = dec.tx_id AND j.pool = dec.pool"""))
def q_outcome_report(spark, d):
    t = S.tx(spark, d).select("tx_id", "landed", (F.col("amount") % 3 == 0).alias("edge_exists"))
    found = later(spark, d)
    return LV.outcome_report(found, t, found)


WALK_SQL = """w AS (SELECT tx_id AS seq, 'S' || payer AS sig, tx_id % 5 = 0 AS lut_miss, amount % 1000 AS lp, amount % 1000 + slot % 7 AS lq FROM tx WHERE tx_id % 3 = 0),
  c AS (SELECT 'S' || payer AS sig, payer % 2 = 0 AS touched, payer % 5 <> 0 AS ok, max(amount) % 1000 AS cp, max(amount) % 1000 + max(slot) % 7 AS cq FROM tx GROUP BY payer)"""


@query("walk_join", with_ctes(f"""
  WITH {WALK_SQL}, j AS (SELECT w.*, coalesce(touched, false) AS t, cp, cq, coalesce(touched, false) AND coalesce(ok, false) AS g FROM w LEFT JOIN c USING (sig))
  SELECT count(*) FILTER (t) AS touched_rows, count(*) FILTER (t AND lut_miss) AS hidden_touches, count(*) FILTER (g AND lp <> cp) AS pre_diverging,
    count(*) FILTER (g AND lp = cp AND lq - lp <> cq - cp) AS apply_diverging, min(seq) FILTER (g AND lp <> cp) AS first_pre_seq, min_by(sig, seq) FILTER (g AND lp <> cp) AS first_pre_sig,
    min(seq) FILTER (g AND lp = cp AND lq - lp <> cq - cp) AS first_apply_seq, min_by(sig, seq) FILTER (g AND lp = cp AND lq - lp <> cq - cp) AS first_apply_sig FROM j"""))
def q_walk_join(spark, d):
    t = S.tx(spark, d)
    a = F.col("amount") % 1000
    walk = t.where(F.col("tx_id") % 3 == 0).select(F.col("tx_id").alias("seq"), F.concat(F.lit("S"), "payer").alias("sig"), (F.col("tx_id") % 5 == 0).alias("lut_miss"),
                                                   a.alias("local_pre"), (a + F.col("slot") % 7).alias("local_post"))
    m = t.groupBy("payer").agg(F.max("amount").alias("ma"), F.max("slot").alias("ms"))
    chain = m.select(F.concat(F.lit("S"), "payer").alias("sig"), (F.col("payer") % 2 == 0).alias("touched"), (F.col("payer") % 5 != 0).alias("ok"),
                     (F.col("ma") % 1000).alias("chain_pre"), (F.col("ma") % 1000 + F.col("ms") % 7).alias("chain_post"))
    return T.walk_join(walk, chain)


@query("first_divergence", with_ctes("""
  SELECT payer, min(tx_id) AS first_tx, min_by(amount % 13, tx_id) AS local_value, min_by(amount % 17, tx_id) AS chain_value FROM tx WHERE amount % 13 <> amount % 17 GROUP BY payer"""))
def q_first_divergence(spark, d):
    x = S.tx(spark, d).select("payer", "tx_id", (F.col("amount") % 13).alias("l"), (F.col("amount") % 17).alias("c")).where(F.col("l") != F.col("c"))
    g = x.groupBy("payer").agg(F.min_by(F.struct("tx_id", "l", "c"), "tx_id").alias("f"))
    return g.select("payer", F.col("f.tx_id").alias("first_tx"), F.col("f.l").alias("local_value"), F.col("f.c").alias("chain_value"))


@query("ab_join", with_ctes("""
  WITH o AS (SELECT user_id || '-' || slot // 24 AS sig FROM gates WHERE event_id % 4 = 0), n AS (SELECT user_id || '-' || slot // 24 AS sig, event_type AS rc, event_id AS line FROM gates WHERE event_id % 4 <> 0),
  f AS (SELECT sig, min_by(rc, line) AS new_rc FROM n GROUP BY sig) SELECT new_rc, count(*) AS n FROM o LEFT JOIN f USING (sig) GROUP BY new_rc"""))
def q_ab_join(spark, d):
    g = JQ.gates(spark, d).select(F.concat_ws("-", "user_id", F.floor(F.col("slot") / 24)).alias("sig"), F.col("event_type").alias("rc"), F.col("event_id").alias("line"))
    return T.ab_join(g.where(F.col("line") % 4 == 0), g.where(F.col("line") % 4 != 0))


@query("paper_vs_chain", with_ctes("""
  SELECT kind, status, count(*) AS n FROM (SELECT CASE WHEN pos % 2 = 0 THEN 'bins' ELSE 'reserve' END AS kind, CASE WHEN supp % 23 = 0 THEN 'failed' WHEN supp % 19 = 0 THEN 'unseen'
    WHEN qty % 3 = 0 THEN 'exact' WHEN pos % 2 = 0 AND (qty % 3) * 10000 < greatest(amount, 1) THEN 'close' ELSE 'mismatch' END AS status FROM trig) GROUP BY ALL"""))
def q_paper_vs_chain(spark, d):
    t = S.trig(spark, d).select(F.when(F.col("pos") % 2 == 0, "bins").otherwise("reserve").alias("pool_kind"), (F.col("supp") % 23 == 0).alias("failed"),
                                (F.col("amount") + F.col("qty") % 3).alias("pred_x"), F.col("amount").alias("pred_y"),
                                F.when(F.col("supp") % 19 != 0, F.col("amount")).alias("post_x"), F.when(F.col("supp") % 19 != 0, F.col("amount")).alias("post_y"))
    return t.groupBy(F.col("pool_kind").alias("kind"), T.predict_check().alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("vault_equation", with_ctes("""
  WITH e AS (SELECT tx_id, amount % 5000 AS ain, amount % 700 AS aout, amount % 3 AS host, amount % 2 = 0 AS fwd FROM tx WHERE tx_id % 6 <> 0),
  x AS (SELECT t.tx_id, e.*, 100000 + t.slot AS x0, 200000 + t.slot AS y0, CASE WHEN t.amount % 2 = 0 THEN 100000 + t.slot + t.amount % 5000 - t.amount % 3 ELSE 100000 + t.slot - t.amount % 700 END + CASE WHEN t.tx_id % 17 = 0 THEN 1 ELSE 0 END AS x1,
         CASE WHEN t.amount % 2 = 0 THEN 200000 + t.slot - t.amount % 700 ELSE 200000 + t.slot + t.amount % 5000 - t.amount % 3 END AS y1, t.amount % 3 > 0 AS hm FROM tx t LEFT JOIN e ON e.tx_id = t.tx_id)
  SELECT tx_id, ain IS NOT NULL AS has_event, CASE WHEN fwd THEN x0 ELSE y0 END + ain - coalesce(host, 0) = CASE WHEN fwd THEN x1 ELSE y1 END AS in_exact,
    CASE WHEN fwd THEN x1 - x0 ELSE y1 - y0 END = ain AS in_delta_exact, CASE WHEN fwd THEN y0 ELSE x0 END - aout = CASE WHEN fwd THEN y1 ELSE x1 END AS out_exact, hm AS host_moved FROM x"""))
def q_vault(spark, d):
    t = S.tx(spark, d)
    a, s = F.col("amount"), F.col("slot")
    fwd = a % 2 == 0
    x1 = F.when(fwd, 100000 + s + a % 5000 - a % 3).otherwise(100000 + s - a % 700) + F.when(F.col("tx_id") % 17 == 0, 1).otherwise(0)
    y1 = F.when(fwd, 200000 + s - a % 700).otherwise(200000 + s + a % 5000 - a % 3)

    def bal(x, y, h):
        return t.select("tx_id", F.explode(F.array(F.struct(F.lit("vault_x").alias("role"), x.alias("amount")), F.struct(F.lit("vault_y").alias("role"), y.alias("amount")),
                                                   F.struct(F.lit("host_fee").alias("role"), h.alias("amount")))).alias("b")).select("tx_id", "b.*")

    ev = t.where(F.col("tx_id") % 6 != 0).select("tx_id", (a % 5000).alias("amount_in"), (a % 700).alias("amount_out"), (a % 3).alias("host_fee"), fwd.alias("x_to_y"))
    return T.vault_check(bal(100000 + s, 200000 + s, F.lit(0).cast("bigint")), bal(x1, y1, a % 3), ev).select(
        "tx_id", "has_event", F.when(F.col("has_event"), F.col("in_exact")).alias("in_exact"), F.when(F.col("has_event"), F.col("in_delta_exact")).alias("in_delta_exact"),
        F.when(F.col("has_event"), F.col("out_exact")).alias("out_exact"), "host_moved")


@query("truth_six_way", with_ctes("""
  SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN tx_id % 31 = 0 THEN 'TX_MISMATCH' WHEN NOT coalesce(resolved, true) THEN 'NO_LUT' WHEN relevant = 0 THEN 'NO_PRESTATE' WHEN amount % 4 = 0 THEN 'FALLBACK'
    WHEN amount % 4 = 1 THEN 'EXACT_MATCH' WHEN landed = 0 THEN 'EXACT_MISMATCH' ELSE 'EXACT_MATCH' END AS outcome FROM tx LEFT JOIN resolved USING (tx_id)) GROUP BY outcome"""))
def q_six_way(spark, d):
    r = q_table_resolve(spark, d).select("tx_id", "resolved")
    a = F.col("amount") % 4
    x = S.tx(spark, d).join(r, "tx_id", "left").select((F.col("tx_id") % 31 == 0).alias("tx_mismatch"), (~F.coalesce("resolved", F.lit(True))).alias("table_miss"),
                                                       (F.col("relevant") == 1).alias("prestate"), (a != 0).alias("published"), F.when(a != 1, F.col("landed") == 1).alias("post_equal"))
    return x.groupBy(T.six_way().alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("missing_from_walk", with_ctes("""
  WITH a AS (SELECT 'S' || tx_id AS sig, slot, landed = 1 AS ok FROM tx WHERE payer % 2 = 0), b AS (SELECT 'S' || tx_id AS sig, slot, landed = 1 AS ok FROM tx WHERE payer % 3 = 0),
  u AS (SELECT DISTINCT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE slot > 400 AND slot <= 900)
  SELECT sig, slot FROM u WHERE ok AND sig NOT IN (SELECT 'S' || tx_id FROM tx WHERE amount % 4 > 0)"""))
def q_missing_walk(spark, d):
    t = S.tx(spark, d).select(F.concat(F.lit("S"), "tx_id").alias("sig"), "slot", (F.col("landed") == 1).alias("ok"), "payer", "amount")
    c = ["sig", "slot", "ok"]
    return T.missing_from_walk(t.where(F.col("payer") % 2 == 0).select(c), t.where(F.col("payer") % 3 == 0).select(c), t.where(F.col("amount") % 4 > 0), 400, 900).select("sig", "slot")


@query("asof_time", with_ctes("""
  WITH s AS (SELECT slot, min(block_time) FILTER (tx_id % 9 = 0) AS bt FROM tx GROUP BY slot)
  SELECT slot, last_value(bt IGNORE NULLS) OVER (ORDER BY slot) AS time FROM s"""))
def q_asof(spark, d):
    s = S.tx(spark, d).groupBy("slot").agg(F.min(F.when(F.col("tx_id") % 9 == 0, F.col("block_time"))).alias("bt"))
    return ordstat.carry_forward(s, "slot", "bt", "time").select("slot", "time")


@query("carry_forward", with_ctes("""
  SELECT event_id, last_value(CASE WHEN k % 5 = 0 THEN gross END IGNORE NULLS) OVER (ORDER BY event_id) AS last_gross FROM gates"""))
def q_carry(spark, d):
    g = JQ.gates(spark, d).select("event_id", F.when(F.col("k") % 5 == 0, F.col("gross")).alias("v"))
    return ordstat.carry_forward(g, "event_id", "v", "last_gross").select("event_id", "last_gross")


# ---------------------------------------------------------------- decisions, parity, drift

DEC_SQL = "dec AS (SELECT tx_id, slot // 100 AS hour, s FROM lookup WHERE s >= 10::DOUBLE)"


def decisions(spark, d):
    return PQ.lookup(spark, d).where(F.col("s") >= 10.0).select("tx_id", F.floor(F.col("slot") / 100).alias("hour"), F.coalesce(F.col("hit_rank") < 9, F.lit(False)).alias("route_hit"))


WL, WH = MQ.wilson_sql("count(*) FILTER (l.target = 1)", "count(*)")


@query("decision_truth", with_ctes(f"""
  WITH {DEC_SQL} SELECT hour, count(*) AS decisions, count(*) FILTER (t.landed = 1) AS with_realised, count(*) FILTER (l.target = 1) AS positives,
    coalesce(sum(l.best_profit) FILTER (l.target = 1 AND l.hit_rank < 9), 0)::BIGINT AS value, {r6('count(*) FILTER (t.landed = 1) / count(*)')} AS realised_share,
    {r6('count(*) FILTER (l.target = 1) / count(*)')} AS positive_share, {WL} AS positive_lo, {WH} AS positive_hi
  FROM dec JOIN lookup l ON l.tx_id = dec.tx_id JOIN tx t ON t.tx_id = dec.tx_id GROUP BY hour"""))
def q_decision_truth(spark, d):
    real = S.tx(spark, d).where(F.col("landed") == 1).select("tx_id", F.lit(1).alias("realised"))
    lab = LQ.grouped(spark, d).select("tx_id", "target", "best_profit")
    return rounded_all(T.decision_truth(decisions(spark, d), real, lab), ["realised_share", "positive_share", "positive_lo", "positive_hi"])


LIVE_HOURS, REPLICATES = 24.0, 60

S.CTE["live_rows"] = """
  SELECT l.tx_id, l.split, l.slot // 100 AS hour, l.s >= 10::DOUBLE AS sent, t.landed = 1 AS realised, coalesce(l.target = 1, false) AS positive, coalesce(l.hit_rank < 9, false) AS route_hit,
         l.best_profit AS profit, l."group" FROM lookup l JOIN tx t ON t.tx_id = l.tx_id"""


def live_sql(split: str, replicates: int) -> str:
    """(hour, metric, r, v) of a split: the same weights from the same mixed ids."""
    u = f"(({LV.BOOTSTRAP_SEED}::UHUGEINT + (tx_id * {LV.MOST_REPLICATES + 1} + r)::UHUGEINT) * 11400714785074694791::UHUGEINT) % 18446744073709551616::UHUGEINT"
    w = " + ".join(f"(u >= {t})::INT" for t in LV.POISSON_PPM)
    return f"""
    SELECT hour, unnest(['decisions', 'value_targeted', 'value_available', 'realised_share', 'positive_share', 'targeted_share']) AS metric, r,
      unnest([n / p, vt / p, va / p, k / nullif(n, 0), pos / nullif(n, 0), vt / nullif(va, 0)]::DOUBLE[]) AS v
    FROM (SELECT h.hour, r, CASE WHEN h.hour IS NULL THEN {LIVE_HOURS} ELSE 1 END AS p, coalesce(sum(w) FILTER (sent), 0) AS n, coalesce(sum(w) FILTER (sent AND realised), 0) AS k,
            coalesce(sum(w) FILTER (sent AND positive), 0) AS pos, coalesce(sum(w * profit) FILTER (sent AND positive AND route_hit), 0) AS vt, coalesce(sum(w * profit) FILTER (positive), 0) AS va
          FROM (SELECT DISTINCT hour FROM live_rows WHERE split = '{split}' AND (sent OR positive) UNION ALL SELECT NULL) h, weighted_{split} x WHERE h.hour IS NULL OR x.hour = h.hour GROUP BY ALL)
    UNION ALL
    SELECT g.hour, 'mix:' || g."group", r, coalesce(sum(w) FILTER (sent AND x."group" = g."group"), 0) / nullif(sum(w) FILTER (sent), 0)
    FROM (SELECT DISTINCT unnest([hour, NULL]) AS hour, "group" FROM live_rows WHERE split = '{split}' AND sent) g, weighted_{split} x WHERE g.hour IS NULL OR x.hour = g.hour GROUP BY ALL""", f"""
    weighted_{split} AS (SELECT *, CASE WHEN r = 0 THEN 1 ELSE {w} END AS w FROM (
      SELECT *, (xor(m::UBIGINT, (m // 1073741824::UHUGEINT)::UBIGINT) % 1000000)::BIGINT AS u FROM (
        SELECT *, {u} AS m FROM live_rows, (SELECT unnest(range({replicates + 1})) AS r) WHERE split = '{split}' AND (sent OR positive))))"""


def live_rows(spark, d):
    """Val and test transactions as a run would log them: sent above the threshold, with what became of them."""
    real = S.tx(spark, d).select("tx_id", (F.col("landed") == 1).alias("realised"))
    x = PQ.lookup(spark, d).join(real, "tx_id")
    return x.select("tx_id", "split", F.floor(F.col("slot") / 100).alias("hour"), (F.col("s") >= 10.0).alias("sent"), "realised", F.coalesce(F.col("target") == 1, F.lit(False)).alias("positive"),
                    F.coalesce(F.col("hit_rank") < 9, F.lit(False)).alias("route_hit"), F.col("best_profit").alias("profit"), "group")


_LIVE, _WEIGHTED = live_sql("test", REPLICATES)
_OFF, _OFF_WEIGHTED = live_sql("val", 0)


@query("live_vs_offline", with_ctes(f"""
  WITH {_WEIGHTED}, {_OFF_WEIGHTED}, m AS ({_LIVE}), e AS ({_OFF}),
  g AS (SELECT hour, metric, max(v) FILTER (r = 0) AS live, quantile_cont(v, 0.025) FILTER (r > 0) AS lo, quantile_cont(v, 0.975) FILTER (r > 0) AS hi FROM m GROUP BY hour, metric)
  SELECT g.hour, g.metric, {r6('live')} AS live, {r6('lo')} AS lo, {r6('hi')} AS hi, {r6('e.v')} AS expected FROM g LEFT JOIN e ON e.metric = g.metric AND e.hour IS NULL"""))
def q_live_offline(spark, d):
    """Test as the run in operation, hour by hour and as a whole, beside what val leads to expect."""
    x = materialise(live_rows(spark, d), "live-rows")
    expected = LV.live_metrics(x.where(F.col("split") == "val"), LIVE_HOURS, 0).where("hour IS NULL").select("metric", F.col("value").alias("expected"))
    report = LV.live_report(x.where(F.col("split") == "test"), expected, LIVE_HOURS, REPLICATES).drop("inside")
    return rounded_all(report, ["live", "lo", "hi", "expected"])


@query("largest_misses", with_ctes(f"""
  SELECT tx_id, best_profit, CASE WHEN NOT has_candidate THEN 'no_candidate' WHEN encode_status <> 0 THEN 'not_encoded' WHEN s < 20::DOUBLE THEN 'below_threshold' ELSE 'route_miss' END AS cause
  FROM lookup WHERE target3 = 1 AND NOT coalesce(s >= 20::DOUBLE AND hit_rank < 3, false) ORDER BY best_profit DESC, tx_id LIMIT 50"""))
def q_misses(spark, d):
    x = PQ.lookup(spark, d).select("tx_id", (F.col("target3") == 1).alias("positive"), F.col("best_profit").alias("profit"), "has_candidate", (F.col("encode_status") == 0).alias("encoded"),
                                   F.col("s").alias("score"), "hit_rank")
    return LV.largest_misses(x, 20.0, 1)


@query("drift_deciles", with_ctes(f"""
  WITH l AS (SELECT 'amount' AS feature, split, amount::DOUBLE AS v FROM split_tx UNION ALL SELECT 'payer', split, payer FROM split_tx), q AS (SELECT unnest(range(1, 10)) / 10 AS q),
  p AS (SELECT feature, split, unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS q, unnest(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS x FROM l GROUP BY feature, split)
  SELECT a.feature, a.q, {r6('a.x', 3)} AS live, {r6('b.x', 3)} AS offline, abs(a.x - b.x) / greatest(abs(b.x), 1e-9) > 0.1::DOUBLE AS shifted
  FROM p a JOIN p b ON b.feature = a.feature AND b.q = a.q AND b.split = 'train' WHERE a.split = 'test'"""))
def q_drift(spark, d):
    t = MQ.split_tx(spark, d)
    return rounded_all(T.drift(t.where(F.col("split") == "test"), t.where(F.col("split") == "train"), ["amount", "payer"]), ["live", "offline"], 3)


@query("parity_check", with_ctes("""
  WITH a AS (SELECT tx_id, prio, amount, slot, block_time FROM tx), b AS (SELECT tx_id, amount + (CASE WHEN tx_id % 40 = 0 THEN 1 ELSE 0 END) AS amount, slot, CASE WHEN tx_id % 60 = 0 THEN NULL ELSE block_time END AS block_time FROM tx WHERE tx_id % 3 <> 1)
  SELECT prio, count(*) AS rows, 'amount' AS feature, count(*) FILTER (a.amount IS DISTINCT FROM b.amount) AS mismatches FROM a JOIN b USING (tx_id) GROUP BY prio
  UNION ALL SELECT prio, count(*), 'slot', count(*) FILTER (a.slot IS DISTINCT FROM b.slot) FROM a JOIN b USING (tx_id) GROUP BY prio
  UNION ALL SELECT prio, count(*), 'block_time', count(*) FILTER (a.block_time IS DISTINCT FROM b.block_time) FROM a JOIN b USING (tx_id) GROUP BY prio"""))
def q_parity(spark, d):
    t = S.tx(spark, d)
    k = F.col("tx_id")
    b = t.where(k % 3 != 1).select("tx_id", (F.col("amount") + F.when(k % 40 == 0, 1).otherwise(0)).alias("amount"), "slot", F.when(k % 60 != 0, F.col("block_time")).alias("block_time"))
    return T.parity(t, b, "tx_id", "prio", ["amount", "slot", "block_time"])


@query("reference_hour", with_ctes("""
  SELECT h.slot, h.all_n, h.all_value, h.two_n, h.two_value, e.exact_n, e.unknown_n, e.other_n FROM
    (SELECT slot, count(*) AS all_n, sum(gross)::BIGINT AS all_value, count(*) FILTER (exec_fam) AS two_n, coalesce(sum(gross) FILTER (exec_fam), 0)::BIGINT AS two_value FROM gates GROUP BY slot) h
    LEFT JOIN (SELECT slot, count(*) FILTER (k % 5 = 4) AS exact_n, count(*) FILTER (k % 5 = 3) AS unknown_n, count(*) FILTER (k % 5 < 3) AS other_n FROM gates WHERE known GROUP BY slot) e ON e.slot = h.slot"""))
def q_reference_hour(spark, d):
    g = JQ.gates(spark, d)
    k = F.col("k") % 5
    mev = g.select("slot", F.col("gross").alias("value"), F.col("exec_fam").alias("simple"))
    events = g.where("known").select("slot", F.when(k == 4, "exact").when(k == 3, "unknown").otherwise("other").alias("cls"))
    return T.reference_hour(mev, events, "slot")


# ---------------------------------------------------------------- windows over event logs

KILL_SQL = "ev AS (SELECT user_id AS pool, event_id AS seq, event_type AS rc, k % 3 = 0 AS killed, slot FROM gates)"


@query("first_kill", with_ctes(f"""
  WITH {KILL_SQL}, f AS (SELECT pool, min_by(rc, seq) AS rc, min(seq) AS seq FROM ev WHERE killed GROUP BY pool) SELECT rc, count(*) AS pools FROM f GROUP BY rc"""))
def q_first_kill(spark, d):
    return FU.first_kill(kill_events(spark, d))


def kill_events(spark, d):
    grade = F.when(F.col("k") % 3 == 0, "DIRTY").otherwise("EXACT")
    return JQ.gates(spark, d).select(F.col("user_id").alias("pool"), F.col("event_id").alias("seq"), F.col("event_type").alias("rc"), F.lit("EXACT").alias("before"), grade.alias("after"))


@query("first_kill_then_gap", with_ctes(f"""
  WITH {KILL_SQL}, f AS (SELECT pool, min(seq) FILTER (killed AND rc = 'click') AS kill_seq, min(seq) FILTER (rc = 'error') AS first_gap, count(*) AS events FROM ev GROUP BY pool)
  SELECT f.pool, events, kill_seq, first_gap, count(*) FILTER (rc = 'error' AND seq > kill_seq) AS gaps_after FROM f JOIN ev ON ev.pool = f.pool GROUP BY f.pool, events, kill_seq, first_gap"""))
def q_kill_gap(spark, d):
    return FU.kill_gap(kill_events(spark, d), "click", "error")


# ---------------------------------------------------------------- graph

S.CTE["gpools"] = """
  SELECT p_partkey AS pool, p_brand AS brand, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS kind, 'T' || (p_partkey % 40 + 1) AS mx,
         CASE WHEN p_partkey % 3 = 0 THEN 'BASE' ELSE 'T' || ((p_partkey * 7) % 40 + 1) END AS my FROM part"""
S.CTE["gedges"] = """SELECT pool, kind, mx AS x, my AS y FROM gpools WHERE mx <> my UNION ALL SELECT pool, kind, my, mx FROM gpools WHERE mx <> my"""
S.CTE["cyc2"] = """SELECT a.kind AS k1, b.kind AS k2, count(*) AS routes FROM gedges a JOIN gedges b ON b.x = a.y AND b.pool <> a.pool AND b.y = 'BASE' WHERE a.x = 'BASE' GROUP BY ALL"""
S.CTE["cyc3"] = """
  SELECT a.kind AS k1, b.kind AS k2, c.kind AS k3, count(*) AS routes FROM gedges a JOIN gedges b ON b.x = a.y AND b.pool <> a.pool AND b.y <> 'BASE' JOIN gedges c ON c.x = b.y AND c.y = 'BASE'
    AND c.pool <> a.pool AND c.pool <> b.pool WHERE a.x = 'BASE' AND b.y <> a.y GROUP BY ALL"""


def gpools(spark, d):
    p = F.col("p_partkey")
    return S.table(spark, d, "part").select(p.alias("pool"), F.col("p_brand").alias("brand"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("B").alias("kind"),
                                            F.concat(F.lit("T"), p % 40 + 1).alias("mx"), F.when(p % 3 == 0, "BASE").otherwise(F.concat(F.lit("T"), p * 7 % 40 + 1)).alias("my"))


@query("two_hop_cycles", with_ctes("SELECT * FROM cyc2"))
def q_cycles2(spark, d):
    return G.cycles2(gpools(spark, d), "BASE")


@query("three_hop_cycles", with_ctes("SELECT * FROM cyc3"))
def q_cycles3(spark, d):
    return G.cycles3(gpools(spark, d), "BASE")


@query("closure_by_sequence", with_ctes("""
  WITH s AS (SELECT DISTINCT a.kind || '-' || b.kind AS seq FROM gpools a, gpools b UNION SELECT DISTINCT a.kind || '-' || b.kind || '-C' FROM (SELECT DISTINCT kind FROM gpools) a, (SELECT DISTINCT kind FROM gpools) b
              UNION SELECT DISTINCT a.kind || '-' || b.kind || '-' || a.kind FROM (SELECT DISTINCT kind FROM gpools) a, (SELECT DISTINCT kind FROM gpools) b),
  c AS (SELECT k1 || '-' || k2 AS seq, routes FROM cyc2 UNION ALL SELECT k1 || '-' || k2 || '-' || k3, routes FROM cyc3)
  SELECT s.seq, coalesce(routes, 0) AS routes FROM s LEFT JOIN c ON c.seq = s.seq""".replace("FROM gpools a, gpools b UNION", "FROM (SELECT DISTINCT kind FROM gpools) a, (SELECT DISTINCT kind FROM gpools) b UNION")))
def q_closure(spark, d):
    p = gpools(spark, d)
    kinds = p.agg(F.collect_set("kind").alias("ks"))  # one row: the few protocol kinds
    pairs = kinds.select("ks", F.explode("ks").alias("a")).select("a", F.explode("ks").alias("b"))
    seqs = pairs.select(F.explode(F.array(F.concat_ws("-", "a", "b"), F.concat_ws("-", "a", "b", F.lit("C")), F.concat_ws("-", "a", "b", "a"))).alias("seq")).distinct()
    return G.closure_by_sequence(p, "BASE", seqs)


@query("cycle_delta", with_ctes("""
  WITH e0 AS (SELECT * FROM gedges WHERE pool % 10 <> 0),
  b2 AS (SELECT count(*) AS n FROM e0 a JOIN e0 b ON b.x = a.y AND b.pool <> a.pool AND b.y = 'BASE' WHERE a.x = 'BASE'),
  b3 AS (SELECT count(*) AS n FROM e0 a JOIN e0 b ON b.x = a.y AND b.y <> 'BASE' JOIN e0 c ON c.x = b.y AND c.y = 'BASE' WHERE a.x = 'BASE' AND b.y <> a.y),
  a2 AS (SELECT sum(routes) AS n FROM cyc2), a3 AS (SELECT sum(routes) AS n FROM cyc3)
  SELECT b2.n AS before_2hop, b3.n AS before_3hop, a2.n AS after_2hop, a3.n AS after_3hop, a2.n - b2.n AS gain_2hop, a3.n - b3.n AS gain_3hop,
         CASE WHEN a3.n > b3.n THEN 1.5::DOUBLE WHEN a2.n > b2.n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS support FROM b2, b3, a2, a3"""))
def q_cycle_delta(spark, d):
    p = gpools(spark, d)
    return G.cycle_delta(p.where(F.col("pool") % 10 != 0), p.where(F.col("pool") % 10 == 0), "BASE")


@query("base_cycle_flag", with_ctes("""
  WITH RECURSIVE e AS (SELECT p.tx_id, g.pool, g.x, g.y FROM tx_pools p JOIN gedges g ON g.pool = p.pool),
  st AS (SELECT tx_id, pool, y AS t FROM e WHERE x = 'BASE'),
  reach(tx_id, pool, t) AS (SELECT tx_id, pool, t FROM st UNION SELECT r.tx_id, r.pool, e.y FROM reach r JOIN e ON e.tx_id = r.tx_id AND e.x = r.t AND e.y <> 'BASE')
  SELECT DISTINCT r.tx_id FROM reach r JOIN st ON st.tx_id = r.tx_id AND st.t = r.t AND st.pool <> r.pool"""))
def q_base_cycle(spark, d):
    return G.base_cycle(PQ.tx_pools(spark, d), gpools(spark, d).select("pool", "kind", "mx", "my"), "BASE")


@query("partner_pools", with_ctes("""
  WITH p AS (SELECT pool, kind AS proto, mx AS token FROM gpools)
  SELECT a.pool, count(b.pool) AS partners, min(b.pool) AS first_partner FROM p a LEFT JOIN p b ON b.token = a.token AND b.proto <> a.proto GROUP BY a.pool"""))
def q_partners(spark, d):
    return G.partner_counts(gpools(spark, d).select("pool", F.col("kind").alias("proto"), F.col("mx").alias("token")))


@query("pool_class", with_ctes("""
  SELECT pool, CASE WHEN my <> 'BASE' THEN 'quote_not_base' WHEN mx IN ('T1', 'T2') THEN 'stable_or_base' WHEN mx NOT IN (SELECT mx FROM gpools WHERE kind = 'B' AND pool % 7 = 0) THEN 'no_partner' ELSE 'compatible' END AS reason
  FROM gpools WHERE NOT (kind = 'B' AND pool % 7 = 0)"""))
def q_pool_class(spark, d):
    p = gpools(spark, d).select("pool", F.when((F.col("kind") == "B") & (F.col("pool") % 7 == 0), "partner").otherwise("main").alias("proto"), F.col("mx").alias("token"), F.col("my").alias("quote"))
    return G.pool_class(p, ["T1", "T2"], "BASE", "partner")


@query("routes_by_pool", with_ctes("""
  SELECT p.pool, i.route, p.leg_no, count(*) OVER (PARTITION BY p.pool) AS n_routes FROM (SELECT pool, 1 AS leg_no FROM gpools) p JOIN pool_route_ids i ON i.pool = p.pool"""))
def q_routes_by_pool(spark, d):
    return G.routes_by_pool(S.pool_route_ids(spark, d).withColumn("leg_no", F.lit(1)))


@query("ambiguous_keys", with_ctes("""
  WITH r AS (SELECT DISTINCT pool AS l, supp AS r FROM trig), k AS (SELECT l AS key, l, r FROM r UNION ALL SELECT 1000000000 + r, l, r FROM r) SELECT key::VARCHAR AS key FROM k GROUP BY key HAVING count(DISTINCT (l, r)) > 1"""))
def q_ambiguous(spark, d):
    r = S.trig(spark, d).select(F.col("pool").cast("string").alias("left"), (F.col("supp") + 1000000000).cast("string").alias("right")).distinct()
    return G.ambiguous_keys(r)


# ---------------------------------------------------------------- sets, sorts, limits

@query("union_parts", with_ctes("SELECT part, count(*) AS n, count(extra) AS with_extra, sum(amount)::BIGINT AS amount FROM (SELECT tx_id % 3 AS part, amount, CASE WHEN tx_id % 3 = 1 THEN payer END AS extra FROM tx) GROUP BY part"))
def q_union_parts(spark, d):
    t = S.tx(spark, d)
    parts = [t.where(F.col("tx_id") % 3 == i).select(F.lit(i).alias("part"), "amount", *([F.col("payer").alias("extra")] if i == 1 else [])) for i in range(3)]
    u = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return u.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("with_extra"), F.sum("amount").alias("amount"))


@query("distinct_routes", with_ctes("SELECT route, min(pool) AS pool FROM pool_route_ids GROUP BY route"))
def q_distinct_routes(spark, d):
    return S.pool_route_ids(spark, d).groupBy("route").agg(F.min("pool").alias("pool"))


UNI_SQL = """u AS (SELECT pool, min(p) AS prio FROM (SELECT p_partkey AS pool, 0 AS p FROM part WHERE p_size < 10 UNION ALL SELECT p_partkey, 1 FROM part WHERE p_size < 20 AND p_partkey % 2 = 0
    UNION ALL SELECT p_partkey, 2 FROM part WHERE p_partkey % 5 = 0) GROUP BY pool)"""


@query("universe_union", with_ctes(f"WITH {UNI_SQL} SELECT pool, prio FROM u"))
def q_universe_union(spark, d):
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("pool"), "p_size")
    parts = [p.where(F.col("p_size") < 10), p.where((F.col("p_size") < 20) & (F.col("pool") % 2 == 0)), p.where(F.col("pool") % 5 == 0)]
    return SE.universe_union(*[x.select("pool") for x in parts]).select("pool", "prio")


@query("new_pools", with_ctes("SELECT p_partkey AS pool FROM part WHERE p_partkey % 5 = 0 AND NOT p_size < 10"))
def q_new_pools(spark, d):
    p = S.table(spark, d, "part").select(F.col("p_partkey").alias("pool"), "p_size")
    return p.where(F.col("pool") % 5 == 0).select("pool").join(p.where(F.col("p_size") < 10).select("pool"), "pool", "left_anti")


@query("same_inputs", with_ctes("SELECT 'tx' AS input, count(*) AS rows, 0 AS only_left, count(*) FILTER (tx_id % 77 = 0) AS only_right FROM tx"))
def q_same_inputs(spark, d):
    """Rows of one version missing in the other, both ways."""
    a = S.tx(spark, d).select("tx_id", "amount")
    b = a.select("tx_id", (F.col("amount") + 0).alias("amount")).unionByName(a.where(F.col("tx_id") % 77 == 0).select("tx_id", (F.col("amount") + 1).alias("amount")))
    n = a.agg(F.count(F.lit(1)).alias("rows"))
    l = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left"))
    r = b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_right"))
    return beside(beside(n, l), r).select(F.lit("tx").alias("input"), "rows", "only_left", "only_right")


@query("dedup_events", with_ctes("SELECT tx_id, status, layer, writable FROM trig GROUP BY ALL"))
def q_dedup(spark, d):
    c = ["tx_id", "status", "layer", "writable"]
    return S.trig(spark, d).select(c).dropDuplicates(c)


@query("case_union", with_ctes("""
  SELECT sig, min(p) AS source, min_by(amount, p) AS amount FROM (SELECT payer AS sig, 0 AS p, max(amount) AS amount FROM tx WHERE tx_id % 3 = 0 GROUP BY payer UNION ALL SELECT payer, 1, max(amount) FROM tx WHERE tx_id % 3 = 1 GROUP BY payer
    UNION ALL SELECT payer, 2, max(CASE WHEN tx_id % 50 <> 0 THEN amount END) FROM tx WHERE tx_id % 3 = 2 GROUP BY payer) WHERE amount IS NOT NULL GROUP BY sig"""))
def q_case_union(spark, d):
    t = S.tx(spark, d)
    k = F.col("tx_id")
    largest = [t.where(k % 3 == i).groupBy(F.col("payer").alias("sig")).agg(F.max(F.col("amount") if i < 2 else F.when(k % 50 != 0, F.col("amount"))).alias("amount")) for i in range(3)]
    return SE.case_union(largest, ["amount"]).select("sig", "source", "amount")


@query("keep_scored", with_ctes("SELECT pool, score FROM (SELECT pool, count(*) + CASE WHEN pool % 4 = 0 THEN 50 ELSE 0 END AS score FROM trig GROUP BY pool) ORDER BY score DESC, pool LIMIT 300"))
def q_keep_scored(spark, d):
    g = S.trig(spark, d).groupBy("pool").agg(F.count(F.lit(1)).alias("n"))
    return SE.keep_scored(g, "n", F.when(F.col("pool") % 4 == 0, 50).otherwise(0), 300).select("pool", "score")


@query("sorted_output", with_ctes("SELECT slot, tx_id, row_number() OVER (ORDER BY slot, tx_id) - 1 AS position FROM tx"))
def q_sorted(spark, d):
    """Total order by (slot, id) as an explicit position."""
    return ordstat.number_rows(S.tx(spark, d).select("slot", "tx_id"), "slot", ["tx_id"], "position")


@query("parts_spread", with_ctes("SELECT slot, rn - 1 AS part_no FROM slot_list WHERE (rn - 1) % 25 = 0"))
def q_spread(spark, d):
    """Every 25th part of the slot-ordered list of parts: a spread, where the stride is the feature."""
    p = ordstat.number_rows(S.tx(spark, d).select("slot").distinct(), "slot", [], "part_no")
    return p.where(F.col("part_no") % 25 == 0)


S.CTE["mem"] = """
  WITH f AS (SELECT split, target, relevant, n_occurrences, landed, prio, arb_score, round(arb_score * 300)::INT AS q FROM scored WHERE target IS NOT NULL AND encode_status = 0),
  tr AS (SELECT relevant, n_occurrences, landed, prio, q, max(target) AS p FROM f WHERE split = 'train' GROUP BY ALL)
  SELECT f.target, f.arb_score, tr.q IS NOT NULL AS seen, coalesce(tr.p = 1, false) AS seen_positive FROM (SELECT * FROM f WHERE split = 'test') f LEFT JOIN tr USING (relevant, n_occurrences, landed, prio, q)"""


@query("memorisation", with_ctes(f"""
  WITH fresh AS (SELECT * FROM mem WHERE NOT seen)
  SELECT {r6('avg(seen::INT)')} AS seen_share, {r6('avg(seen::INT) FILTER (target = 1)')} AS seen_share_positives, {r6('avg(seen_positive::INT) FILTER (target = 1)')} AS positives_like_train_positives,
    max(u.n) AS unseen_rows, {r6('max(u.base_rate)')} AS unseen_base_rate, {r6('max(u.pr_auc)')} AS unseen_pr_auc FROM mem, ({S.auc_sql('fresh', 'target', 'arb_score')}) u"""))
def q_memorisation(spark, d):
    from txlens.operators import audit as A
    f = MQ.scored(spark, d).where(F.col("target").isNotNull() & (F.col("encode_status") == 0)).withColumn("q", F.rint(F.col("arb_score") * 300).cast("int"))
    m = A.memorisation(f.where(F.col("split") == "train"), f.where(F.col("split") == "test"), ["relevant", "n_occurrences", "landed", "prio", "q"], "target", "arb_score")
    return rounded_all(m, ["seen_share", "seen_share_positives", "positives_like_train_positives", "unseen_base_rate", "unseen_pr_auc"])


@query("feature_auc", with_ctes("WITH x AS (SELECT target3, unnest(['amount', 'slot', 'p2', 'size_pred', 'n_occurrences', 'score']) AS feature, unnest([amount::DOUBLE, slot::DOUBLE, p2, size_pred, n_occurrences::DOUBLE, arb_score]) AS value FROM scored WHERE split = 'test' AND target3 IS NOT NULL) "
       + f"SELECT feature, {r6('greatest(roc_auc, 1 - roc_auc)')} AS auc, CASE WHEN roc_auc >= 0.5 THEN '+' ELSE '-' END AS direction FROM ({S.auc_sql('x', 'target3', 'value', 'feature')})"))
def q_feature_auc(spark, d):
    x = MQ.scored(spark, d).where((F.col("split") == "test") & F.col("target3").isNotNull()).withColumnRenamed("arb_score", "score")
    return rounded_all(M.feature_auc(x, "target3", ["amount", "slot", "p2", "size_pred", "n_occurrences", "score"]), ["auc"])
