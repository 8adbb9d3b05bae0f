"""Gate and opportunity journals: funnels, buckets, clusters, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from txlens.functions.numbers import beside, cents, count_if, rounded_all
from txlens.functions.ordstat import index_percentiles
from txlens.operators import funnel as FU
from txlens.operators import truth as T
from txlens.plans import standin as S
from txlens.plans.registry import query
from txlens.plans.standin import r6, with_ctes
from txlens.session import new_dir
from txlens.sources import journal as J
from txlens.sources.lines import follow_lines
from txlens.streaming.run import drain_by_batch

HURDLE = 2500

S.CTE["gates"] = """
  SELECT *, CAST(floor(value * 100 + 0.5) AS BIGINT) AS gross, event_type <> 'error' AS known, k >= 10 AS routed, k >= 20 AS searchable, value > 5 AS gross_pos,
         value > 25 AS cap_hurdle, k % 2 = 0 AS synced_all, user_id % 3 = 0 AS mut_ok_all, k % 4 = 0 AS age32_all,
         event_type IN ('click', 'purchase') AS exec_fam, user_id % 5 = 0 AS race_ready FROM
    (SELECT event_id, event_type, user_id, value, ts, CAST(json_extract(props, '$.k') AS BIGINT) AS k, floor(epoch(ts))::BIGINT AS secs,
            (floor(epoch(ts))::BIGINT - 1704067200) // 3600 AS slot FROM events)"""


def gates(spark, d):
    e = S.table(spark, d, "events")
    k, v, t, u = F.col("k"), F.col("value"), F.col("event_type"), F.col("user_id")
    e = e.select("event_id", "event_type", "user_id", "value", "ts", F.from_json("props", "k bigint")["k"].alias("k"),
                 S.epoch_seconds("ts").alias("secs"))
    return e.select("*", F.floor((F.col("secs") - 1704067200) / 3600).alias("slot"), cents("value").alias("gross"), F.lit(0).alias("cap_gross"),
                    (t != "error").alias("known"), (k >= 10).alias("routed"), (k >= 20).alias("searchable"), (v > 5).alias("gross_pos"),
                    (v > 25).alias("cap_hurdle"), (k % 2 == 0).alias("synced_all"), (u % 3 == 0).alias("mut_ok_all"), (k % 4 == 0).alias("age32_all"),
                    t.isin("click", "purchase").alias("exec_fam"), (u % 5 == 0).alias("race_ready"))


STAGE_SQL = {
    "framed": "true", "known": "known", "routed": "known AND routed", "searchable": "known AND routed AND searchable",
    "gross_pos": "known AND routed AND searchable AND gross_pos", "cap_hurdle": "known AND routed AND searchable AND cap_hurdle",
    "synced": "known AND routed AND searchable AND cap_hurdle AND synced_all",
    "age32": "known AND routed AND searchable AND cap_hurdle AND synced_all AND age32_all",
    "exec": "known AND routed AND searchable AND cap_hurdle AND synced_all AND age32_all AND exec_fam",
    "race": "known AND routed AND searchable AND cap_hurdle AND synced_all AND age32_all AND exec_fam AND race_ready",
    "mut_fresh": "known AND routed AND searchable AND cap_hurdle AND synced_all AND mut_ok_all"}


def stage_sql(src: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"SELECT {lead}{i} AS stage_no, '{n}' AS stage, count(*) FILTER ({c}) AS n, coalesce(sum(gross) FILTER ({c}), 0)::BIGINT AS gross_sum, "
        f"coalesce(max(gross) FILTER ({c}), 0) AS gross_max, CASE WHEN count(*) FILTER ({c}) > 0 THEN floor(sum(gross) FILTER ({c}) / count(*) FILTER ({c}))::BIGINT ELSE 0 END AS gross_avg "
        f"FROM {src}{grp}" for i, (n, c) in enumerate(STAGE_SQL.items()))


@query("gate_funnel", with_ctes(stage_sql("gates")))
def q_gate_funnel(spark, d):
    return FU.gate_funnel(gates(spark, d)).orderBy("stage_no")


@query("gate_funnel_by_hour", with_ctes(f"SELECT * FROM ({stage_sql('gates', 'slot')})"))
def q_gate_funnel_by_hour(spark, d):
    return FU.gate_funnel(gates(spark, d), ["slot"])


@query("funnel_verdict", with_ctes(f"""
  WITH s AS ({stage_sql('gates')}), c AS (SELECT {', '.join(f"max(n) FILTER (stage = '{n}') AS {n}" for n in STAGE_SQL)} FROM s)
  SELECT CASE WHEN framed = 0 THEN 'NO_DATA' WHEN searchable * 20 < framed AND cap_hurdle = 0 THEN 'A_SEARCH'
    WHEN cap_hurdle > 0 AND age32 = 0 AND mut_fresh >= greatest(1, cap_hurdle // 4) THEN 'B_FRESHNESS' WHEN cap_hurdle > 0 AND age32 = 0 AND mut_fresh = 0 THEN 'B_STATE'
    WHEN (age32 > 0 OR mut_fresh > 0) AND exec = 0 AND race = 0 THEN 'C_EXECUTION' WHEN race > 0 THEN 'SEND_PATH' ELSE 'MIXED' END AS verdict,
    framed, cap_hurdle, age32, race FROM c"""))
def q_verdict(spark, d):
    return FU.verdict(FU.gate_funnel(gates(spark, d)))


CLICK = "kind string, ts bigint, event_id bigint, pool_idx bigint, gross bigint"
CLICK_SQL = "SELECT event_id, user_id AS pool_idx, gross FROM gates WHERE event_type = 'click' AND 1706659200 - secs <= 864000"


def journal_lines(spark, d, part):
    """Tagged lines of every other row, with a broken line after every seventh."""
    g = gates(spark, d).where(F.col("event_id") % 2 == part)
    line = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("secs").alias("ts"), "event_id", F.col("user_id").alias("pool_idx"), "gross"))
    bad = g.where(F.col("event_id") % 7 == 0).select(F.lit('{"kind":"click", broken').alias("value"))
    return g.select(line.alias("value")).unionByName(bad)


@query("scan_journal", with_ctes(CLICK_SQL))
def q_scan_journal(spark, d):
    """Two journals are written as files of tagged lines and read back by kind and time."""
    path = new_dir(spark, "journal")
    for part in (0, 1):
        journal_lines(spark, d, part).write.text(f"{path}/day={part}")
    return J.scan_journal(spark, path, "click", CLICK, 864000, 1706659200).select("event_id", "pool_idx", "gross")


@query("stream_journal", with_ctes(CLICK_SQL))
def q_stream_journal(spark, d):
    """A journal is followed: what is there, then what has come since, from where the first run stopped."""
    path, checkpoint, out = (new_dir(spark, n) for n in ("journal", "journal-ckpt", "journal-out"))
    for part in (0, 1):
        journal_lines(spark, d, part).write.text(f"{path}/day={part}")
        rows = J.parse_kind(follow_lines(spark, path), "click", CLICK)
        found = drain_by_batch(rows.where(J.in_window(F.col("ts"), 1706659200, 864000)), "journal", None, checkpoint, out)
    return found.select("event_id", "pool_idx", "gross")


@query("late_policy", with_ctes("""
  SELECT count(*) AS all_rows, count(*) FILTER (event_id % 9 <> 0) AS timed, count(*) FILTER (event_id % 9 <> 0 AND 1706659200 - secs <= 600000) AS in_window FROM gates"""))
def q_late_policy(spark, d):
    """Rows without a time stay in full runs and are outside every window; stamps may be seconds or nanoseconds."""
    g = gates(spark, d)
    ts = F.when(F.col("event_id") % 9 != 0, F.when(F.col("event_id") % 2 == 0, F.col("secs") * 1000000000).otherwise(F.col("secs")))
    return g.withColumn("t", ts).agg(F.count(F.lit(1)).alias("all_rows"), F.count("t").alias("timed"),
                                     count_if(J.in_window(F.col("t"), 1706659200, 600000)).alias("in_window"))


@query("searchable_groups", with_ctes(f"""
  WITH r AS (SELECT event_type AS seq, k % 3 + 2 AS n_hop, 'b' || (user_id % 4) AS bucket, gross, gross * 3 // 4 AS cap_gross, value > 10 AS cap_ok,
                    k % 4 = 0 AS fresh_ok, k % 5 = 0 AS sendable, CASE WHEN k % 6 <> 0 THEN k END AS age_slots FROM gates WHERE searchable)
  SELECT seq, n_hop, bucket, count(*) AS searchable_n, {r6('100 * count(*) / sum(count(*)) OVER ()')} AS pct, count(*) FILTER (fresh_ok) AS fresh_n,
    count(*) FILTER (cap_ok) AS cap_ok_n, count(*) FILTER (cap_ok AND fresh_ok) AS cap_ok_and_fresh_n,
    count(*) FILTER (cap_ok AND fresh_ok AND cap_gross > {HURDLE}) AS raceable_n, count(*) FILTER (sendable) AS sendable_n,
    floor(sum(age_slots) / count(age_slots))::BIGINT AS age_avg, coalesce(floor(sum(gross) FILTER (fresh_ok) / count(*) FILTER (fresh_ok)), 0)::BIGINT AS gross_fresh_avg,
    coalesce(max(gross) FILTER (fresh_ok), 0) AS gross_fresh_max, coalesce(floor(sum(cap_gross) FILTER (fresh_ok) / count(*) FILTER (fresh_ok)), 0)::BIGINT AS cap_gross_fresh_avg,
    coalesce(max(cap_gross) FILTER (fresh_ok), 0) AS cap_gross_fresh_max, floor(sum(cap_gross) / count(*))::BIGINT AS cap_gross_avg, max(cap_gross) AS cap_gross_max
  FROM r GROUP BY ALL"""))
def q_searchable(spark, d):
    k = F.col("k")
    r = gates(spark, d).where("searchable").select(
        F.col("event_type").alias("seq"), (k % 3 + 2).alias("n_hop"), F.concat(F.lit("b"), F.col("user_id") % 4).alias("bucket"), "gross",
        F.floor(F.col("gross") * 3 / 4).alias("cap_gross"), (F.col("value") > 10).alias("cap_ok"), (k % 4 == 0).alias("fresh_ok"),
        (k % 5 == 0).alias("sendable"), F.when(k % 6 != 0, k).alias("age_slots"))
    return rounded_all(FU.searchable_groups(r, HURDLE), ["pct"])


OPP_SQL = """opps AS (SELECT user_id AS pool_idx, slot, event_id AS line, k % 3 = 0 AS exact, k % 7 > 0 AS framed, gross AS cap_gross, value > 8 AS cap_ok,
    CASE WHEN k % 11 = 0 THEN 2 ELSE k % 2 END AS direction FROM gates WHERE event_type IN ('purchase', 'signup')),
  best AS (SELECT * FROM opps QUALIFY row_number() OVER (PARTITION BY pool_idx, slot ORDER BY exact DESC, line) = 1),
  plane AS (SELECT DISTINCT user_id AS pool_idx, user_id % 3 <> 1 AS plane_ready, user_id % 17 = 0 AS ambiguous, user_id % 13 = 0 AS cooling FROM gates WHERE user_id % 10 <> 9)"""


def opps(spark, d):
    k = F.col("k")
    return gates(spark, d).where(F.col("event_type").isin("purchase", "signup")).select(
        F.col("user_id").alias("pool_idx"), "slot", F.col("event_id").alias("line"), (k % 3 == 0).alias("exact"), (k % 7 > 0).alias("framed"),
        F.col("gross").alias("cap_gross"), (F.col("value") > 8).alias("cap_ok"), F.when(k % 11 == 0, 2).otherwise(k % 2).alias("direction"))


def gate_rows(spark, d):
    return gates(spark, d).where(F.col("event_type").isin("click", "view")).select(
        "event_id", F.col("user_id").alias("pool_idx"), "slot", (F.col("k") % 8).alias("family"), (F.col("k") % 3 + 1).alias("n_hop"),
        F.when(F.col("k") % 5 == 0, F.when(F.col("k") % 2 == 0, "a-b").otherwise("a-b-c")).alias("seq"))


@query("gate_to_opp", with_ctes(f"""
  WITH {OPP_SQL} SELECT g.event_id, b.line AS opp_line, b.exact AS opp_exact FROM gates g LEFT JOIN best b ON b.pool_idx = g.user_id AND b.slot = g.slot
  WHERE g.event_type IN ('click', 'view')"""))
def q_gate_to_opp(spark, d):
    return FU.gate_to_opp(gate_rows(spark, d), opps(spark, d)).select("event_id", F.col("opp.line").alias("opp_line"), F.col("opp.exact").alias("opp_exact"))


BUCKET_SQL = f"""CASE WHEN NOT framed THEN 'not_framed' WHEN NOT exact THEN 'ix_only' WHEN p.pool_idx IS NULL THEN 'plane_miss' WHEN ambiguous THEN 'ambiguous_pool'
  WHEN NOT plane_ready THEN 'plane_not_race_ready' WHEN direction NOT IN (0, 1) THEN 'bad_direction' WHEN cooling THEN 'cooldown' WHEN NOT cap_ok THEN 'cap_not_ok'
  WHEN cap_gross <= {HURDLE} THEN 'below_hurdle' ELSE 'would_fire' END"""
SHAPE_SQL = "CASE WHEN k % 5 = 0 THEN k % 2 = 0 ELSE k % 8 IN (0, 5) AND k % 3 + 1 < 3 END"


def plane(spark, d):
    u = F.col("user_id")
    return S.table(spark, d, "events").where(u % 10 != 9).select(u.alias("pool_idx"), u.alias("plane_pool"), (u % 3 != 1).alias("plane_ready"),
                                                                  (u % 17 == 0).alias("ambiguous"), (u % 13 == 0).alias("cooling")).distinct()


@query("drop_buckets", with_ctes(f"""
  WITH {OPP_SQL} SELECT 'would_send' AS source, CASE WHEN NOT ({SHAPE_SQL}) THEN 'not_executable' WHEN b.line IS NULL THEN 'no_opp' ELSE {BUCKET_SQL} END AS bucket,
    count(*) AS n, count(*) FILTER (coalesce(exact, false)) AS tx_exact, count(*) FILTER (coalesce(plane_ready AND b.line IS NOT NULL, false)) AS plane_ready,
    count(*) FILTER (coalesce(exact AND plane_ready, false)) AS both_flags
  FROM gates g LEFT JOIN best b ON b.pool_idx = g.user_id AND b.slot = g.slot LEFT JOIN plane p ON p.pool_idx = g.user_id WHERE event_type IN ('click', 'view') GROUP BY ALL
  UNION ALL SELECT 'opp', {BUCKET_SQL}, count(*), count(*) FILTER (exact), count(*) FILTER (coalesce(plane_ready, false)), count(*) FILTER (coalesce(exact AND plane_ready, false))
  FROM opps o LEFT JOIN plane p ON p.pool_idx = o.pool_idx GROUP BY ALL"""))
def q_drop_buckets(spark, d):
    p = plane(spark, d)
    g = FU.gate_to_opp(gate_rows(spark, d), opps(spark, d)).select("pool_idx", "family", "n_hop", "seq", "opp.*").join(p, "pool_idx", "left")
    shape = FU.shape_ok(F.col("family"), F.col("n_hop"), F.col("seq"), ["a-b"])
    base = FU.send_bucket(F.lit(True), HURDLE)
    has = F.col("line").isNotNull()
    left = g.withColumn("ready_file", F.lit(True)).select(
        F.lit("would_send").alias("source"), F.when(~shape, "not_executable").when(~has, "no_opp").otherwise(base).alias("bucket"), "exact",
        (F.col("plane_ready") & has).alias("pr"))
    right = opps(spark, d).join(p, "pool_idx", "left").withColumn("ready_file", F.lit(True)).select(
        F.lit("opp").alias("source"), base.alias("bucket"), "exact", F.col("plane_ready").alias("pr"))
    return left.unionByName(right).groupBy("source", "bucket").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("exact")).alias("tx_exact"), count_if(F.col("pr")).alias("plane_ready"),
        count_if(F.col("exact") & F.col("pr")).alias("both_flags"))


@query("send_gate_bucket", with_ctes(f"WITH {OPP_SQL} SELECT line, {BUCKET_SQL} AS bucket FROM opps o LEFT JOIN plane p ON p.pool_idx = o.pool_idx"))
def q_send_bucket(spark, d):
    o = opps(spark, d).join(plane(spark, d), "pool_idx", "left").withColumn("ready_file", F.lit(True))
    return o.select("line", FU.send_bucket(F.lit(True), HURDLE).alias("bucket"))


@query("shape_executable", with_ctes(f"SELECT event_id, {SHAPE_SQL} AS ok FROM gates WHERE event_type IN ('click', 'view')"))
def q_shape(spark, d):
    return gate_rows(spark, d).select("event_id", FU.shape_ok(F.col("family"), F.col("n_hop"), F.col("seq"), ["a-b"]).alias("ok"))


@query("fee_hurdle", with_ctes("SELECT DISTINCT k, (100000 + k * 1237) * 800000 // 1000000 + 5000 + 150000 + 50000 AS hurdle FROM gates"))
def q_fee_hurdle(spark, d):
    return gates(spark, d).select("k", FU.fee_hurdle(100000 + F.col("k") * 1237).alias("hurdle")).distinct()


@query("hurdle_by_sequence", with_ctes("""
  SELECT seq, u AS units, u * 12 // 10 AS unit_limit, (u * 12 // 10) * 800000 // 1000000 + 5000 AS chain_fee,
         (u * 12 // 10) * 800000 // 1000000 + 5000 + 200000 AS min_gross, CASE WHEN m > 0 THEN 'measured' ELSE 'estimate' END AS source
  FROM (SELECT event_type || '-' || (k % 4) AS seq, max(CASE WHEN k % 4 <> 3 THEN gross END) AS m, CASE WHEN max(CASE WHEN k % 4 <> 3 THEN gross END) > 0 THEN max(CASE WHEN k % 4 <> 3 THEN gross END) ELSE 90000 END AS u
        FROM gates GROUP BY 1)"""))
def q_hurdle_table(spark, d):
    g = gates(spark, d).groupBy(F.concat("event_type", F.lit("-"), F.col("k") % 4).alias("seq")).agg(
        F.max(F.when(F.col("k") % 4 != 3, F.col("gross"))).alias("measured")).withColumn("estimate", F.lit(90000))
    return FU.hurdle_table(g)


@query("window_intersection", with_ctes("SELECT event_id FROM gates WHERE race_ready AND exec_fam"))
def q_both(spark, d):
    g = gates(spark, d)
    return g.where("race_ready").select("event_id").intersect(g.where("exec_fam").select("event_id"))


KIND_SQL = """CASE event_type WHEN 'signup' THEN 'frame' WHEN 'view' THEN 'framed_pool' WHEN 'click' THEN 'opp_searchable' WHEN 'purchase' THEN 'opp_synced'
  ELSE CASE WHEN k % 2 = 0 THEN 'fresh_drop' ELSE 'unknown_pool' END END"""
S.CTE["journal"] = f"""
  SELECT *, {KIND_SQL} AS kind, CASE WHEN k % 6 = 0 THEN 'incomplete' ELSE 'framed' END AS class, gross - 300 AS jgross, gross * 3 // 4 AS jcap, value > 10 AS cap_ok,
         k % 4 = 0 AS fresh_ok, k % 5 = 0 AS sendable FROM gates"""


def journal(spark, d):
    k, t = F.col("k"), F.col("event_type")
    kind = (F.when(t == "signup", "frame").when(t == "view", "framed_pool").when(t == "click", "opp_searchable").when(t == "purchase", "opp_synced")
            .when(k % 2 == 0, "fresh_drop").otherwise("unknown_pool"))
    return gates(spark, d).select("event_id", "user_id", "k", "slot", "value", "event_type", kind.alias("kind"), F.when(k % 6 == 0, "incomplete").otherwise("framed").alias("class"),
                                  (F.col("gross") - 300).alias("gross"), F.floor(F.col("gross") * 3 / 4).alias("cap_gross"), (F.col("value") > 10).alias("cap_ok"),
                                  (k % 4 == 0).alias("fresh_ok"), (k % 5 == 0).alias("sendable"))


@query("lifetime_funnel", with_ctes(f"""
  SELECT count(*) FILTER (kind = 'frame' AND class = 'framed') AS framed, count(*) FILTER (kind = 'framed_pool') AS known_pool, count(*) FILTER (kind = 'unknown_pool') AS unknown_pool,
    count(*) FILTER (s) AS searchable, count(*) FILTER (s AND jgross > 0) AS gross_pos, sum(jgross) FILTER (s AND jgross > 0)::BIGINT AS gross_sum, max(jgross) FILTER (s) AS gross_max,
    count(*) FILTER (s AND cap_ok) AS cap_ok, sum(jcap) FILTER (s AND cap_ok)::BIGINT AS cap_sum, max(jcap) FILTER (s AND cap_ok) AS cap_max,
    count(*) FILTER (s AND cap_ok AND jcap > {HURDLE}) AS above_hurdle, count(*) FILTER (s AND sendable) AS sendable, count(*) FILTER (s AND fresh_ok) AS fresh,
    sum(jcap) FILTER (s AND fresh_ok)::BIGINT AS fresh_sum, count(*) FILTER (kind = 'opp_synced') AS synced_rows, count(*) FILTER (kind = 'fresh_drop') AS drops,
    count(*) FILTER (kind = 'fresh_drop' AND NOT fresh_ok) AS drop_age, count(*) FILTER (kind = 'fresh_drop' AND sendable) AS drop_mut_ok
  FROM (SELECT *, kind = 'opp_searchable' AS s FROM journal)"""))
def q_lifetime(spark, d):
    return FU.lifetime_funnel(journal(spark, d), HURDLE)


@query("kind_counts", with_ctes("""
  SELECT kind, count(*) AS n, count(*) FILTER (cap_ok) AS n_cap_ok, count(*) FILTER (fresh_ok) AS n_fresh_ok, count(*) FILTER (sendable) AS n_sendable FROM journal GROUP BY kind"""))
def q_kind_counts(spark, d):
    return FU.kind_counts(journal(spark, d), ["cap_ok", "fresh_ok", "sendable"])


@query("pool_frequency", with_ctes("""
  SELECT user_id, user_id % 4 AS proto, count(*) AS n, user_id % 6 <> 5 AS known, row_number() OVER (PARTITION BY user_id % 6 <> 5 ORDER BY count(*) DESC, user_id) AS rank
  FROM journal WHERE class = 'framed' GROUP BY user_id"""))
def q_pool_frequency(spark, d):
    """Framed frequency per pool, known or not, ranked inside each side by count then id."""
    from txlens.functions.ordstat import number_rows
    g = journal(spark, d).where(F.col("class") == "framed").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    g = g.select("user_id", (F.col("user_id") % 4).alias("proto"), "n", (F.col("user_id") % 6 != 5).alias("known"))
    a = number_rows(g.where("known"), "n", ["user_id"], "rank", desc=True, start=1)
    b = number_rows(g.where(~F.col("known")), "n", ["user_id"], "rank", desc=True, start=1)
    return a.unionByName(b)


@query("topn_groups", with_ctes("SELECT user_id, event_type, count(*) AS n FROM gates GROUP BY ALL ORDER BY n DESC, user_id, event_type LIMIT 25"))
def q_topn(spark, d):
    return FU.top_n(gates(spark, d), ["user_id", "event_type"], 25)


@query("staleness", with_ctes("""
  WITH a AS (SELECT user_id, k AS age, event_id FROM journal WHERE kind = 'opp_searchable'),
  o AS (SELECT age, row_number() OVER (ORDER BY age) - 1 AS i, count(*) OVER () AS n FROM a),
  p AS (SELECT max(age) FILTER (i = floor(0.5::DOUBLE * (n - 1))) AS p50, max(age) FILTER (i = floor(0.9::DOUBLE * (n - 1))) AS p90, max(age) FILTER (i = floor(0.99::DOUBLE * (n - 1))) AS p99, max(age) AS max_age FROM o)
  SELECT user_id, max(age) AS worst, max_by(age, event_id) AS last_age, any_value(p50) AS p50, any_value(p90) AS p90, any_value(p99) AS p99, any_value(max_age) AS max_age
  FROM a, p GROUP BY user_id ORDER BY worst DESC, user_id LIMIT 20"""))
def q_staleness(spark, d):
    a = journal(spark, d).where(F.col("kind") == "opp_searchable").select("user_id", F.col("k").alias("age"), "event_id")
    p = index_percentiles(a, "age", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).select("p50", "p90", "p99", F.col("max_value").alias("max_age"))
    worst = a.groupBy("user_id").agg(F.max("age").alias("worst"), F.max_by("age", "event_id").alias("last_age")).orderBy(F.desc("worst"), "user_id").limit(20)
    return beside(worst, p)


@query("trigger_funnel", with_ctes("""
  WITH r AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'no_bytes' WHEN k % 6 = 0 THEN 'incomplete' WHEN event_type = 'click' THEN 'direct_exact' WHEN user_id % 3 = 0 THEN 'relevant_unknown'
    WHEN k % 7 = 0 THEN 'alt_miss' ELSE 'unrecoverable' END AS stage FROM gates)
  SELECT stage, count(*) AS n, sum(gross)::BIGINT AS value FROM r GROUP BY stage"""))
def q_trigger_funnel(spark, d):
    k = F.col("k")
    r = gates(spark, d).select("gross", (k % 10 != 0).alias("has_bytes"), F.when(k % 6 == 0, "incomplete").otherwise("framed").alias("frame"),
                               (F.col("event_type") == "click").alias("direct"), (F.col("user_id") % 3 == 0).cast("int").alias("watch_hits"), (k % 7 == 0).alias("table_miss"))
    return r.groupBy(FU.trigger_stage().alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.sum("gross").alias("value"))


@query("trigger_stage", with_ctes("""
  SELECT event_id, CASE WHEN k % 10 = 0 THEN 'no_bytes' WHEN k % 6 = 0 THEN 'invalid' WHEN event_type = 'view' THEN 'direct_exact' WHEN user_id % 4 = 0 THEN 'relevant_unknown'
    WHEN k % 7 = 0 THEN 'alt_miss' ELSE 'unrecoverable' END AS stage FROM gates"""))
def q_trigger_stage(spark, d):
    k = F.col("k")
    r = gates(spark, d).select("event_id", (k % 10 != 0).alias("has_bytes"), F.when(k % 6 == 0, "invalid").otherwise("framed").alias("frame"),
                               (F.col("event_type") == "view").alias("direct"), (F.col("user_id") % 4 == 0).cast("int").alias("watch_hits"), (k % 7 == 0).alias("table_miss"))
    return r.select("event_id", FU.trigger_stage().alias("stage"))


MIS_BUCKETS = ["wrong_transaction_association", "trigger_decode_error", "fork_order", "state_missing", "plain", "plain", "plain", "plain", "plain", "plain", "plain"]
MIS_SQL = "list_extract(['wrong_transaction_association','trigger_decode_error','fork_order','state_missing','plain','plain','plain','plain','plain','plain','plain'], (k % 11 + 1)::INT)"
RESERVE_SQL = f"""CASE WHEN bucket = 'wrong_transaction_association' THEN 'wrong_tx_association' WHEN bucket = 'trigger_decode_error' THEN 'decode_apply_bug'
  WHEN bucket IN ('fork_order', 'state_missing') THEN 'publication_ordering'
  WHEN vq = 0 AND (pb <> ub OR pq <> uq) AND NOT (bb = ub AND bq = uq) THEN 'virtual_reserve_config'
  WHEN staged AND bb = ub AND bq = uq AND NOT (bb = pb AND bq = pq) THEN 'vault_mismatch' WHEN fld OR pb <> ub OR pq <> uq THEN 'reserve_mismatch' ELSE 'other' END"""
MIS_CTE = f"""m AS (SELECT event_id, slot, k, {MIS_SQL} AS bucket, user_id % 4 AS pb, user_id % 3 AS pq, k % 4 AS ub, k % 3 AS uq, (k + 1) % 4 AS bb, k % 3 AS bq, CASE WHEN k % 2 = 0 THEN 0 ELSE 5 END AS vq,
    event_type = 'view' AS staged, user_id % 7 = 0 AS fld FROM gates WHERE event_type <> 'click')"""


def mismatches(spark, d):
    k, u = F.col("k"), F.col("user_id")
    return gates(spark, d).where(F.col("event_type") != "click").select(
        "event_id", "slot", "k", F.element_at(F.array(*[F.lit(b) for b in MIS_BUCKETS]), (k % 11 + 1).cast("int")).alias("bucket"), (u % 4).alias("pred_base"), (u % 3).alias("pred_quote"),
        (k % 4).alias("pub_base"), (k % 3).alias("pub_quote"), ((k + 1) % 4).alias("before_base"), (k % 3).alias("before_quote"),
        F.when(k % 2 == 0, 0).otherwise(5).alias("virtual_quote"), (F.col("event_type") == "view").alias("vault_staged"),
        F.when(u % 7 == 0, F.array(F.lit("reserves"))).otherwise(F.array().cast("array<string>")).alias("fields"))


@query("mismatch_class", with_ctes(f"WITH {MIS_CTE} SELECT event_id, {RESERVE_SQL} AS class FROM m"))
def q_mismatch(spark, d):
    return mismatches(spark, d).select("event_id", FU.reserve_class().alias("class"))


@query("mismatch_class_bins", with_ctes(f"""
  SELECT event_id, CASE WHEN bucket = 'wrong_transaction_association' THEN 'wrong_tx_association' WHEN bucket = 'fork_order' THEN 'publication_ordering'
    WHEN k % 13 = 0 THEN 'missing_bin' WHEN user_id % 5 = 0 THEN 'active_id' WHEN user_id % 5 = 1 THEN 'volatility'
    WHEN k % 9 <> user_id % 9 OR user_id % 5 = 2 THEN 'order_inventory_related' WHEN bucket = 'state_missing' THEN 'publication_ordering' ELSE 'other' END AS class
  FROM (SELECT *, {MIS_SQL} AS bucket FROM gates WHERE event_type = 'click')"""))
def q_mismatch_bins(spark, d):
    k, u = F.col("k"), F.col("user_id")
    g = gates(spark, d).where(F.col("event_type") == "click").select(
        "event_id", F.element_at(F.array(*[F.lit(b) for b in MIS_BUCKETS]), (k % 11 + 1).cast("int")).alias("bucket"),
        F.array(F.when(u % 5 == 0, "active_id").when(u % 5 == 1, "volatility").when(u % 5 == 2, "bin_liquidity").otherwise("x")).alias("fields"),
        F.array(F.struct(F.lit(7).alias("id"), (k % 9).alias("x"))).alias("touched"), F.create_map(F.when(k % 13 == 0, 8).otherwise(7), u % 9).alias("published"))
    return g.select("event_id", FU.bins_class().alias("class"))


@query("soak_clusters", with_ctes(f"""
  WITH {MIS_CTE}, c AS (SELECT *, {RESERVE_SQL} AS class FROM m)
  SELECT class, bucket, count(*) AS n, min(event_id) AS first_event_id, min_by(slot, event_id) AS first_slot FROM c GROUP BY ALL ORDER BY n DESC, class, bucket LIMIT 20"""))
def q_clusters(spark, d):
    c = mismatches(spark, d).withColumn("class", FU.reserve_class())
    return FU.clusters(c, ["class", "bucket"], "event_id", ["event_id", "slot"], 20)


@query("example_per_group", with_ctes("SELECT event_type, k % 10 AS g, min(event_id) AS first_event_id, min_by(gross, event_id) AS first_gross, count(*) AS n FROM gates GROUP BY ALL"))
def q_example(spark, d):
    return FU.clusters(gates(spark, d).withColumn("g", F.col("k") % 10), ["event_type", "g"], "event_id", ["event_id", "gross"], None)


@query("dirty_causes", with_ctes("""
  SELECT cause, disc, count(*) AS n, min_by(sig, event_id) AS example, grouping(cause) * 2 + grouping(disc) AS level FROM
    (SELECT event_type AS cause, 'd' || (k % 5) AS disc, 'sig' || event_id AS sig, event_id FROM gates) GROUP BY ROLLUP (cause, disc)"""))
def q_causes(spark, d):
    g = gates(spark, d).select(F.col("event_type").alias("cause"), F.concat(F.lit("d"), F.col("k") % 5).alias("disc"),
                               F.concat(F.lit("sig"), "event_id").alias("sig"), F.col("event_id").alias("line"))
    return FU.causes(g)


CMP_SQL = """CASE WHEN k % 23 = 0 THEN 'stale_after' WHEN k % 5 = 2 THEN 'apply_fail' WHEN k % 5 = 0 THEN 'clean'
  WHEN user_id % 4 = k % 4 AND user_id % 3 = k % 3 AND NOT user_id % 6 = 1 AND user_id % 2 = 0 THEN 'interleave' WHEN k % 17 = 0 THEN 'interleave'
  WHEN NOT (user_id % 5 = 1 OR user_id % 7 = 1 OR user_id % 6 = 1 OR user_id % 11 = 1) AND user_id % 2 = 0 THEN 'interleave'
  WHEN user_id % 5 = 1 OR user_id % 7 = 1 OR user_id % 6 = 1 OR user_id % 11 = 1 THEN 'model_mismatch' ELSE 'mismatch' END"""


def compared(spark, d):
    k, u = F.col("k"), F.col("user_id")
    return gates(spark, d).select("event_id", (k % 3).alias("walk"), F.when(k % 23 == 0, 1).otherwise(0).alias("after_active"), F.lit(0).alias("event_end"), (k % 5).alias("rc"),
                                  (u % 4).alias("pred_out"), (k % 4).alias("event_out"), (u % 3).alias("pred_fee"), (k % 3).alias("event_fee"), (u % 6 == 1).alias("mis_active"),
                                  (u % 2 == 0).alias("mis_bin"), (k % 17 == 0).alias("mis_untouched_bin"), (u % 5 == 1).alias("mis_fee"), (u % 7 == 1).alias("mis_out"),
                                  (u % 11 == 1).alias("mis_vol")).withColumn("status", FU.compare_class())


@query("compare_class", with_ctes(f"SELECT event_id, {CMP_SQL} AS status FROM gates"))
def q_compare(spark, d):
    return compared(spark, d).select("event_id", "status")


@query("compare_tally", with_ctes(f"SELECT {CMP_SQL} AS status, count(*) AS n, count(*) FILTER (k % 3 >= 1) AS multi_step FROM gates GROUP BY 1"))
def q_tally(spark, d):
    return FU.compare_tally(compared(spark, d))


@query("corpus_gate", with_ctes(f"""
  SELECT clean, clean_multi, clean >= 10 AND clean_multi >= 1 AS open FROM (SELECT count(*) AS clean, count(*) FILTER (k % 3 >= 1) AS clean_multi FROM gates WHERE {CMP_SQL} = 'clean')"""))
def q_corpus_gate(spark, d):
    return FU.corpus_gate(FU.compare_tally(compared(spark, d)))


@query("readiness_report", with_ctes("""
  WITH r AS (SELECT user_id % 2 = 0 OR k % 3 > 0 AS template_ok, k % 4 > 0 AS table_ok, k % 5 > 0 AS vector_ok, user_id % 3 > 0 AS account_ok, k % 7 > 0 AS sim_ok FROM gates),
  f AS (SELECT *, CASE WHEN NOT template_ok THEN 'template_ok' WHEN NOT table_ok THEN 'table_ok' WHEN NOT vector_ok THEN 'vector_ok' WHEN NOT account_ok THEN 'account_ok' WHEN NOT sim_ok THEN 'sim_ok' END AS ff FROM r)
  """ + " UNION ALL ".join(f"SELECT '{c}' AS \"check\", count(*) FILTER ({c}) AS passed, count(*) FILTER (ff = '{c}') AS first_failure, count(*) AS routes FROM f"
                           for c in ("template_ok", "table_ok", "vector_ok", "account_ok", "sim_ok"))))
def q_readiness(spark, d):
    k, u = F.col("k"), F.col("user_id")
    r = gates(spark, d).select(((u % 2 == 0) | (k % 3 > 0)).alias("template_ok"), (k % 4 > 0).alias("table_ok"), (k % 5 > 0).alias("vector_ok"),
                               (u % 3 > 0).alias("account_ok"), (k % 7 > 0).alias("sim_ok"))
    return FU.readiness(r, ["template_ok", "table_ok", "vector_ok", "account_ok", "sim_ok"])


@query("readiness_units", with_ctes("""
  SELECT k % 2 AS direction, count(*) AS n, min(gross) AS min_units, max(gross) AS max_units, max(gross) FILTER (i = n // 2) AS p50 FROM
    (SELECT k, gross, row_number() OVER (PARTITION BY k % 2 ORDER BY gross) - 1 AS i, count(*) OVER (PARTITION BY k % 2) AS n FROM gates) GROUP BY 1"""))
def q_readiness_units(spark, d):
    """Units by direction: smallest, upper median (index n div 2), largest."""
    from txlens.functions.ordstat import counts
    c = counts(gates(spark, d).select((F.col("k") % 2).alias("direction"), "gross"), "gross", ["direction"])
    return c.groupBy("direction").agg(F.sum("n").alias("n"), F.min("gross").alias("min_units"), F.max("gross").alias("max_units"),
                                      F.min(F.when(F.col("cum_n") > F.floor(F.col("tot_n") / 2), F.col("gross"))).alias("p50"))


@query("profit_distribution", with_ctes(f"""
  WITH o AS (SELECT value / 100 AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM gates WHERE searchable)
  SELECT max(n) AS n, {r6('max(v) FILTER (i = floor(0.5::DOUBLE * (n - 1)))')} AS p50, {r6('max(v) FILTER (i = floor(0.9::DOUBLE * (n - 1)))')} AS p90, {r6('max(v)')} AS max_value,
         count(*) FILTER (v < 0.01::DOUBLE) AS tiny, count(*) FILTER (v >= 0.01::DOUBLE AND v < 1) AS mid, count(*) FILTER (v >= 1) AS big FROM o"""))
def q_profit_dist(spark, d):
    g = gates(spark, d).where("searchable").select((F.col("value") / 100).alias("v"))
    return rounded_all(FU.profit_distribution(g, "v"), ["p50", "p90", "max_value"])


@query("counter_health", with_ctes("""
  SELECT event_id, CASE WHEN k <= 60 AND moving THEN 'ok' WHEN k <= 60 AND NOT m THEN 'metrics_dead' WHEN k <= 60 THEN 'counters_frozen' ELSE 'heartbeat_dead' END AS status FROM
    (SELECT event_id, k, user_id % 2 = 0 AS m, coalesce(lag(k % 3) OVER w <> k % 3 OR lag(slot // 50) OVER w <> slot // 50, true) AS moving FROM gates WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""))
def q_health(spark, d):
    s = gates(spark, d).select("event_id", F.col("user_id").alias("proc"), F.col("event_id").alias("line"), (F.col("k") % 3).alias("updates"),
                               F.floor(F.col("slot") / 50).alias("stream_slot"), F.col("k").alias("hb_age"), (F.col("user_id") % 2 == 0).alias("metrics_ok"))
    return FU.counter_health(s, 60).select("event_id", "status")


@query("candidate_contract", with_ctes("""
  SELECT event_id, synced_all AND k % 3 = 2 AS hops_synced, user_id % 7 <> 0 AS not_updating, user_id NOT IN (SELECT user_id FROM gates WHERE event_type = 'error' AND k = 0) AS no_mismatch,
         k > 5 AND mut_ok_all AS generation_ok, gross > 525 AS quote_ok, race_ready OR exec_fam AS ready FROM gates WHERE searchable"""))
def q_contract(spark, d):
    g, k = gates(spark, d), F.col("k")
    journal = g.where("searchable").select("event_id", F.col("user_id").alias("pool_idx"), F.lit(1).alias("would_send_new"), "synced_all", F.lit(2).alias("n_hop"), (k % 3).alias("n_sync"),
                                           (F.col("user_id") % 7 == 0).alias("updating"), (k - 5).alias("state_gen"), F.col("mut_ok_all").alias("s007_ready"), F.col("gross").alias("cap_gross"), "exec_fam", "race_ready")
    bad = g.where((F.col("event_type") == "error") & (k == 0)).select(F.col("user_id").alias("pool_idx"))
    race = journal.where("race_ready").select("pool_idx")
    found = FU.contract(journal, bad, 525, race)
    return found.select("event_id", "hops_synced", "not_updating", "no_mismatch", "generation_ok", "quote_ok", "ready")


@query("addressable_coverage", with_ctes(f"""
  WITH c AS (SELECT *, CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'incompatible' ELSE 'compatible' END AS cls, user_id % 3 = 0 AS compiled FROM gates)
  SELECT count(*) AS all_n, count(*) FILTER (cls = 'compatible') AS addressable, count(*) FILTER (cls = 'compatible' AND compiled) AS known_addressable,
         count(*) FILTER (cls = 'incompatible') AS incompatible, count(*) FILTER (cls IS NULL) AS unclassified,
         {r6("100 * count(*) FILTER (cls = 'compatible' AND compiled) / count(*) FILTER (cls = 'compatible')")} AS coverage_pct, {r6("100 * count(*) FILTER (cls = 'compatible') / count(*)")} AS share_pct FROM c"""))
def q_addressable(spark, d):
    rows = gates(spark, d).select(F.col("user_id").alias("pool"))
    u = F.col("pool")
    cls = rows.distinct().where(u % 5 != 0).select("pool", F.when(u % 5 == 1, "incompatible").otherwise("compatible").alias("cls"), (u % 3 == 0).alias("compiled"))
    return rounded_all(FU.addressable(rows, cls), ["coverage_pct", "share_pct"])


@query("ab_causes", with_ctes("""
  SELECT cause, old, new, old - new AS vanished, cause IN ('c1', 'c2', 'c3', 'c4', 'c5') AS missing_cause FROM
    (SELECT 'c' || (k % 9) AS cause, count(*) FILTER (event_id % 2 = 0) AS old, count(*) FILTER (event_id % 2 = 1 AND k % 9 <> 4) AS new FROM gates GROUP BY 1)"""))
def q_ab_causes(spark, d):
    g = gates(spark, d).select("event_id", "k", F.concat(F.lit("c"), F.col("k") % 9).alias("cause"))
    old, new = g.where(F.col("event_id") % 2 == 0), g.where((F.col("event_id") % 2 == 1) & (F.col("k") % 9 != 4))
    return T.ab_causes(old, new, [f"c{i}" for i in range(1, 6)])
