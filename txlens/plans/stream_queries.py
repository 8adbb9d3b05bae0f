"""Streaming operators, drained over the tables with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from txlens.functions.numbers import beside, count_if, rounded_all
from txlens.functions.bits import SAMPLE_SEED  # noqa: F401
from txlens.plans import journal_queries as JQ
from txlens.plans import landing_queries as LA
from txlens.plans import model_queries as MO
from txlens.plans import pool_queries as PQ
from txlens.plans import standin as S
from txlens.plans.registry import query
from txlens.plans.standin import r6, with_ctes
from txlens.session import new_dir
from txlens.streaming import decisions as DE
from txlens.streaming import learned as LE
from txlens.streaming import operators as O
from txlens.streaming import reputation as RP
from txlens.streaming import run as R


def events(spark, d):
    """The event stream with a zone-bound event time made from whole microseconds."""
    e = R.read_table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.from_json("props", "k bigint")["k"].alias("k"), F.timestamp_micros(S.epoch_micros("ts")).alias("ts"))


def secs(c):
    return F.unix_micros(c)


MARK = "(SELECT max(epoch_us(ts)) FROM events) - {}"
MIN = 60_000_000


@query("stream_first_wins", with_ctes("SELECT DISTINCT user_id % 20 AS \"index\", secs // 86400 AS slot, k % 4 AS fec_set, event_type AS type FROM gates"))
def q_first_wins(spark, d):
    p = events(spark, d).select("ts", (F.col("user_id") % 20).alias("index"), F.floor(secs("ts") / 86400000000).alias("slot"), (F.col("k") % 4).alias("fec_set"), F.col("event_type").alias("type"))
    return R.drain(O.first_wins(p, ["index", "slot", "fec_set", "type"], "2 days").drop("ts"), "first-wins")


PAIR_SQL = """a AS (SELECT event_id // 2 AS sig, epoch_us(ts) AS a_ts FROM gates WHERE event_id % 2 = 0 AND event_id % 10 <> 4),
  b AS (SELECT event_id // 2 AS sig, epoch_us(ts) AS b_ts, k % 3 > 0 AS ok FROM gates WHERE event_id % 2 = 1 AND event_id % 10 <> 7)"""


def pair(spark, d):
    e = events(spark, d).withColumn("sig", F.floor(F.col("event_id") / 2))
    k = F.col("event_id")
    return e.where((k % 2 == 0) & (k % 10 != 4)).select("sig", "ts"), e.where((k % 2 == 1) & (k % 10 != 7)).select("sig", "ts", (F.col("k") % 3 > 0).alias("ok"))


@query("stream_feed_race", with_ctes(f"""
  WITH {PAIR_SQL}, wm AS (SELECT least((SELECT max(a_ts) FROM a), (SELECT max(b_ts) FROM b)) - {10 * MIN} AS w),
  m AS (SELECT a.sig, a_ts, b_ts FROM a JOIN b ON a.sig = b.sig AND abs(b_ts - a_ts) <= {5 * MIN})
  SELECT sig, a_ts, b_ts, b_ts - a_ts AS lead_us FROM m
  UNION ALL SELECT a.sig, a_ts, NULL, NULL FROM a, wm WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.sig = a.sig) AND a_ts + {5 * MIN} < w // 1000 * 1000
  UNION ALL SELECT b.sig, NULL, b_ts, NULL FROM b, wm WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.sig = b.sig) AND b_ts + {5 * MIN} < w // 1000 * 1000"""))
def q_stream_race(spark, d):
    a, b = pair(spark, d)
    j = R.drain(O.feed_race(a, b.drop("ok"), "5 minutes", "10 minutes"), "feed-race")
    return j.select("sig", secs("a_ts").alias("a_ts"), secs("b_ts").alias("b_ts"), (secs("b_ts") - secs("a_ts")).alias("lead_us"))


def follow_sql(wait: int) -> str:
    return f"""WITH {PAIR_SQL}, wm AS (SELECT least((SELECT max(a_ts) FROM a), (SELECT max(b_ts) FROM b)) - {10 * MIN} AS w),
      m AS (SELECT a.sig, a_ts, b_ts, ok FROM a JOIN b ON a.sig = b.sig AND b_ts BETWEEN a_ts AND a_ts + {wait})
      SELECT sig, CASE WHEN ok THEN 'landed-success' ELSE 'landed-failed' END AS outcome, b_ts - a_ts AS wait_us FROM m
      UNION ALL SELECT a.sig, 'disappeared', NULL FROM a, wm WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.sig = a.sig) AND a_ts + {wait} < w // 1000 * 1000"""


@query("stream_outcomes", with_ctes(follow_sql(200_000_000)))
def q_stream_outcomes(spark, d):
    """The 20-second wait at ten times the length, as the stand-in events are minutes apart."""
    a, b = pair(spark, d)
    j = R.drain(O.follow(a, b, "200 seconds", "10 minutes"), "outcomes")
    return j.select("sig", "outcome", (secs("s_ts") - secs("o_ts")).alias("wait_us"))


@query("stream_confirm", with_ctes(follow_sql(450_000_000)))
def q_stream_confirm(spark, d):
    a, b = pair(spark, d)
    j = R.drain(O.follow(a, b, "450 seconds", "10 minutes"), "confirm")
    return j.select("sig", "outcome", (secs("s_ts") - secs("o_ts")).alias("wait_us"))


def gate_stream(spark, d):
    e = events(spark, d)
    k, v, t, u = F.col("k"), F.col("value"), F.col("event_type"), F.col("user_id")
    return e.select("ts", (t != "error").alias("known"), (k >= 10).alias("routed"), (k >= 20).alias("searchable"), (v > 5).alias("gross_pos"), (v > 25).alias("cap_hurdle"),
                    (k % 2 == 0).alias("synced_all"), (u % 3 == 0).alias("mut_ok_all"), (k % 4 == 0).alias("age32_all"), t.isin("click", "purchase").alias("exec_fam"), (u % 5 == 0).alias("race_ready"))


@query("stream_funnel_30m", with_ctes(f"""
  WITH x AS (SELECT *, (secs // 600 - i) * 600 + 1800 AS e FROM gates, (SELECT unnest(range(3)) AS i))
  SELECT e AS window_end, {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in JQ.STAGE_SQL.items())} FROM x
  WHERE e * 1000000 <= {MARK.format(10 * MIN)} GROUP BY e"""))
def q_stream_funnel(spark, d):
    g = R.drain(O.funnel_window(gate_stream(spark, d), "30 minutes", "10 minutes", "10 minutes"), "funnel")
    return g.withColumn("window_end", F.unix_seconds("window_end"))


@query("stream_counters_1s", with_ctes(f"""
  SELECT secs AS window_start, event_type, count(*) AS n FROM gates WHERE (secs + 1) * 1000000 <= {MARK.format(10 * MIN)} GROUP BY ALL"""))
def q_counters(spark, d):
    c = R.drain(O.counters(events(spark, d), ["event_type"], "1 second", "10 minutes"), "counters")
    return c.withColumn("window_start", F.unix_seconds("window_start"))


@query("stream_rate_check", with_ctes(f"""
  SELECT secs // 3600 * 3600 AS window_start, count(*) AS n, abs(count(*) - 4) <= 1 AS within FROM gates WHERE cap_hurdle AND (secs // 3600 + 1) * 3600000000 <= {MARK.format(10 * MIN)} GROUP BY 1"""
       .replace("MARK", "")))
def q_rate(spark, d):
    g = gate_stream(spark, d).where("cap_hurdle")
    return R.drain(O.rate_check(g, "1 hour", 4.0, "10 minutes"), "rate").withColumn("window_start", F.unix_seconds("window_start"))


@query("stream_sessions", with_ctes(f"""
  WITH g AS (SELECT user_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER w > {240 * MIN} AS fresh FROM gates WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY t) AS n FROM g)
  SELECT user_id, min(t) AS session_start, max(t) + {240 * MIN} AS session_end, count(*) AS beats FROM s GROUP BY user_id, n HAVING max(t) + {240 * MIN} <= {MARK.format(10 * MIN)}"""))
def q_sessions(spark, d):
    s = R.drain(O.sessions(events(spark, d).select("ts", "user_id"), "user_id", "4 hours", "10 minutes"), "sessions")
    return s.select("user_id", secs("session_start").alias("session_start"), secs("session_end").alias("session_end"), "beats")


def static_scores(spark, d):
    """Static lookup by transaction: expected value and number of candidate pools."""
    n = S.trig(spark, d).groupBy("tx_id").agg(count_if(F.col("pool") % 3 == 0).alias("n_candidates"))
    k = F.col("tx_id")
    return S.tx(spark, d).select("tx_id", ((F.pmod(k * 7919, F.lit(211)) / 211.0) * (F.col("amount") / 1000000.0)).alias("ev")).join(n, "tx_id")


def tx_stream(spark, d, stream=True):
    o = R.read_table(spark, d, "orders") if stream else S.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("tx_id"), F.floor(F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")) / 100).alias("hour"))


DECIDE_SQL = """SELECT tx_id, hour, sent, sampled, threshold, sends FROM (
    SELECT t.tx_id, t.slot // 100 AS hour, coalesce((t.tx_id * 7919 % 211) / 211e0 * (amount / 1000000e0) >= 25::DOUBLE, false) AND coalesce(n > 0, false) AS sent,
           25::DOUBLE AS threshold, 3 AS sends, NOT (coalesce((t.tx_id * 7919 % 211) / 211e0 * (amount / 1000000e0) >= 25::DOUBLE, false) AND coalesce(n > 0, false))
           AND xor(m.x::UBIGINT, (m.x // 1073741824::UHUGEINT)::UBIGINT) % 1000 = 0 AS sampled
    FROM tx t JOIN mixed m ON m.tx_id = t.tx_id LEFT JOIN (SELECT tx_id, count(*) FILTER (pool % 3 = 0) AS n FROM trig GROUP BY tx_id) c ON c.tx_id = t.tx_id) WHERE sent OR sampled"""
DECIDE_COLS = ["tx_id", "hour", "sent", "sampled", "threshold", "sends"]


@query("stream_decisions", with_ctes(DECIDE_SQL))
def q_decisions(spark, d):
    s = O.decide(tx_stream(spark, d), static_scores(spark, d), 25.0, 3).select(DECIDE_COLS)
    return R.drain(s, "decisions", ["hour"]).select(DECIDE_COLS)


@query("sink_decision_log", with_ctes(f"SELECT hour, count(*) AS records, count(*) FILTER (sent) AS sent, count(*) FILTER (sampled) AS sampled FROM ({DECIDE_SQL}) GROUP BY hour"))
def q_decision_log(spark, d):
    """The log as written, one folder per hour, read back and counted."""
    return q_decisions(spark, d).groupBy("hour").agg(F.count(F.lit(1)).alias("records"), count_if(F.col("sent")).alias("sent"), count_if(F.col("sampled")).alias("sampled"))


@query("replay_equals_live", with_ctes(f"SELECT count(*) AS live_rows, 0 AS only_live, 0 AS only_replay FROM ({DECIDE_SQL})"))
def q_replay(spark, d):
    """One function on the stream and on the table; rows that only one of them has."""
    live = q_decisions(spark, d)
    again = O.decide(tx_stream(spark, d, False), static_scores(spark, d), 25.0, 3).select(DECIDE_COLS)
    n = live.agg(F.count(F.lit(1)).alias("live_rows"))
    return beside(beside(n, live.exceptAll(again).agg(F.count(F.lit(1)).alias("only_live"))), again.exceptAll(live).agg(F.count(F.lit(1)).alias("only_replay")))


@query("stream_miss_learn", with_ctes("""
  SELECT user_id AS "table", min(event_id) AS first_seq FROM gates WHERE event_type = 'error' AND user_id % 4 <> 0 GROUP BY user_id"""))
def q_miss_learn(spark, d):
    """Missing tables not known at the start, with the first miss of each over all batches."""
    known = S.table(spark, d, "events").select(F.col("user_id").alias("table")).where(F.col("table") % 4 == 0).distinct()
    miss = events(spark, d).where(F.col("event_type") == "error").select(F.col("user_id").cast("long").alias("table"), F.col("event_id").cast("long").alias("seq"), "ts").join(known, "table", "left_anti")
    return LE.learned(R.drain_by_batch(LE.first_seen(miss, "table", "seq", "2 days", 86_400), "misses"), "table")


@query("stream_reputation", with_ctes(f"""
  SELECT tx_id, {r6('rep_landed', 9)} AS rep_landed, {r6('rep_failed', 9)} AS rep_failed, rep_seen FROM land"""))
def q_stream_reputation(spark, d):
    o = R.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("tx_id"), F.col("o_custkey").alias("payer"),
                                                F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("bigint").alias("slot"),
                                                F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("landed"))
    r = R.drain(O.reputation(o, 2, LA.HALF), "reputation")
    return rounded_all(r.select("tx_id", "rep_landed", "rep_failed", "rep_seen"), ["rep_landed", "rep_failed"], 9)


SETTLE = 30


@query("stream_reputation_settled", with_ctes(f"""
  SELECT payer, slot, {r6('rep_landed', 9)} AS rep_landed, {r6('rep_failed', 9)} AS rep_failed, rep_seen FROM rep
  WHERE slot - 2 <= (SELECT max(slot) FROM tx) - {SETTLE}"""))
def q_stream_reputation_settled(spark, d):
    """Reputation per payer and slot, answered when the watermark has passed; the busiest payers are split over parts."""
    o = R.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("tx_id"), F.col("o_custkey").alias("payer"),
                                                F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("bigint").alias("slot"),
                                                F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("landed"))
    n = S.tx(spark, d).groupBy("payer").agg(F.count(F.lit(1)).alias("n"))
    # payers with more than a thousandth of all rows: fewer than a thousand
    hot = beside(n, n.agg(F.sum("n").alias("all"))).where(F.col("n") * 1000 > F.col("all")).select("payer", F.lit(4).alias("parts"))
    r = RP.drain(RP.settled(o, 2, LA.HALF, SETTLE, hot, least=0.0))
    return rounded_all(r.select("payer", "slot", "rep_landed", "rep_failed", "rep_seen"), ["rep_landed", "rep_failed"], 9)


VALUE = 100_000.0


@query("stream_decisions_versions", with_ctes("""
  SELECT unnest(['val', 'test']) AS split, unnest([1, 2]) AS version, 0 AS other_version, 0 AS only_live, 0 AS only_replay, true AS has_sent, true AS routes_in_bound
  FROM (SELECT count(*) FROM scored)"""))
def q_stream_versions(spark, d):
    """Fitted models in a stream: val rows by one version, test rows, which come after the next is published, by that one; then
    the same rows decided again as a table."""
    x = MO.matrix(spark, d)
    pools = PQ.tx_pools(spark, d).groupBy("tx_id").agg(F.sort_array(F.collect_list("pool")).alias("pools"))
    rows = x.where(F.col("split") != "train").join(pools, "tx_id", "left").select("tx_id", "split", "pools", *MO.FEATURES)
    routes, size = PQ.train_pool_routes(spark, d), MO.size_model(spark, d, x)
    arb = {1: MO.arb_model(spark, d, x), 2: MO.arb_model(spark, d, x, MO.COMPACT, name="arb-compact")}
    root, folder, checkpoint, out = (new_dir(spark, n) for n in ("bundles", "decisions-in", "decisions-ckpt", "decisions-out"))
    parts = {1: rows.where(F.col("split") == "val"), 2: rows.where(F.col("split") == "test")}
    for version, part in parts.items():
        DE.publish(spark, root, DE.Policy(version, arb[version], size, routes, VALUE * version, version))
        part.write.mode("append").parquet(f"{folder}/rows.parquet")
        log = DE.drain(R.read_table(spark, folder, "rows"), root, list(MO.FEATURES), checkpoint, out).drop("batch")
    facts = None
    for version, part in parts.items():
        live = log.join(part.select("tx_id"), "tx_id", "left_semi")
        again = DE.decide(part, DE.load(spark, root, version, list(MO.FEATURES)))
        wide = F.col("sent") & (F.size("routes") > 3 * version)
        one = live.agg(count_if(F.col("version") != version).alias("other_version"), F.bool_or("sent").alias("has_sent"), (count_if(wide) == 0).alias("routes_in_bound"))
        one = beside(beside(one, live.exceptAll(again).agg(F.count(F.lit(1)).alias("only_live"))), again.exceptAll(live).agg(F.count(F.lit(1)).alias("only_replay")))
        one = one.withColumns({"split": F.lit({1: "val", 2: "test"}[version]), "version": F.lit(version)})
        facts = one if facts is None else facts.unionByName(one)
    return facts.select("split", "version", "other_version", "only_live", "only_replay", "has_sent", "routes_in_bound")
