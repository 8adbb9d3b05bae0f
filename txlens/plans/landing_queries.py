"""Landing outcome and structural features."""

from __future__ import annotations

from pyspark.sql import functions as F

from txlens.functions.numbers import count_if, rounded_all
from txlens.operators import landing as LA
from txlens.operators import metrics as M
from txlens.operators import structure as ST
from txlens.plans import standin as S
from txlens.plans.registry import query
from txlens.plans.standin import auc_sql, r6, with_ctes

HALF = 90

S.CTE["rep"] = f"""
  SELECT a.payer, a.slot, coalesce(sum(b.l * pow(2e0, b.slot // {HALF} - a.slot // {HALF})), 0e0) AS rep_landed,
         coalesce(sum(b.f * pow(2e0, b.slot // {HALF} - a.slot // {HALF})), 0e0) AS rep_failed, (count(b.payer) > 0)::INT AS rep_seen
  FROM (SELECT DISTINCT payer, slot FROM tx) a
  LEFT JOIN (SELECT payer, slot, sum(landed) AS l, sum(1 - landed) AS f FROM tx GROUP BY ALL) b ON b.payer = a.payer AND b.slot <= a.slot - 3
  GROUP BY a.payer, a.slot"""
S.CTE["land"] = f"""
  SELECT t.*, rep_landed, rep_failed, rep_seen, rep_landed + rep_failed AS rep_total,
         CASE WHEN rep_landed + rep_failed > 0 THEN rep_failed / (rep_landed + rep_failed) ELSE 'nan'::DOUBLE END AS rep_fail_rate,
         ((t.tx_id * 104729) % 997 + 300 * landed) / 1300e0 AS p_land,
         rep_landed + rep_failed >= 2 AND CASE WHEN rep_landed + rep_failed > 0 THEN rep_failed / (rep_landed + rep_failed) ELSE 0e0 END >= 0.9::DOUBLE AS bad_payer
  FROM tx t JOIN rep r ON r.payer = t.payer AND r.slot = t.slot"""


def land(spark, d):
    """Reputation at a short half-life; the stand-in history is thin, so its bad-payer rule asks for two past rows."""
    t = LA.with_reputation(S.tx(spark, d), half_life=HALF)
    rate = F.nanvl("rep_fail_rate", F.lit(0.0))
    return t.withColumn("p_land", (F.pmod(F.col("tx_id") * 104729, F.lit(997)) + 300 * F.col("landed")) / 1300.0).withColumn(
        "bad_payer", (F.col("rep_total") >= 2) & (rate >= LA.BAD_RATE))


@query("reputation", with_ctes(f"""
  SELECT tx_id, {r6('rep_landed', 9)} AS rep_landed, {r6('rep_failed', 9)} AS rep_failed, {r6('rep_total', 9)} AS rep_total,
         {r6('rep_fail_rate')} AS rep_fail_rate, rep_seen FROM land"""))
def q_reputation(spark, d):
    r = LA.with_reputation(S.tx(spark, d).select("tx_id", "payer", "slot", "landed"), half_life=HALF)
    out = r.select("tx_id", "rep_landed", "rep_failed", "rep_total", "rep_fail_rate", "rep_seen")
    return rounded_all(rounded_all(out, ["rep_landed", "rep_failed", "rep_total"], 9), ["rep_fail_rate"])


@query("policy_gates", with_ctes("""
  SELECT bad_payer, NOT bad_payer AS keep_rule, p_land >= 0.5::DOUBLE AS keep_model, count(*) AS n, sum(landed) AS landed FROM land GROUP BY ALL"""))
def q_policy_gates(spark, d):
    x = land(spark, d)
    flags = x.withColumn("keep_rule", ~F.col("bad_payer")).withColumn("keep_model", F.col("p_land") >= 0.5)
    return flags.groupBy("bad_payer", "keep_rule", "keep_model").agg(F.count(F.lit(1)).alias("n"), F.sum("landed").alias("landed"))


@query("bad_payer_flags", with_ctes(f"""
  SELECT tx_id, rep_total >= 20 AND CASE WHEN rep_total > 0 THEN rep_fail_rate ELSE 0e0 END >= 0.9::DOUBLE AS bad_payer, p_land >= 0.6::DOUBLE AS keep_model FROM land"""))
def q_bad_payer_flags(spark, d):
    return LA.policy_flags(land(spark, d), "p_land", 0.6).select("tx_id", "bad_payer", "keep_model")


@query("population", with_ctes("""
  SELECT t.tx_id, t.payer, t.slot, o.o_orderstatus AS outcome FROM tx t JOIN orders o ON o.o_orderkey = t.tx_id AND o.o_orderstatus <> 'P'
  WHERE t.payer % 13 <> 0 AND t.tx_id IN (SELECT tx_id FROM trig WHERE pool % 3 = 0)"""))
def q_population(spark, d):
    t = S.tx(spark, d).select("tx_id", "payer", "slot")
    votes = t.where(F.col("payer") % 13 == 0).select("tx_id")
    pools = S.table(spark, d, "part").select(F.col("p_partkey").alias("pool")).where(F.col("pool") % 3 == 0)
    return LA.population(t, S.trig(spark, d).select("tx_id", "pool"), pools, votes, runtime(spark, d))


def runtime(spark, d):
    return S.table(spark, d, "orders").where(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("tx_id"), F.col("o_orderstatus").alias("outcome"))


@query("runtime_outcome", with_ctes("SELECT tx_id, slot, o_orderstatus AS outcome FROM tx JOIN orders ON o_orderkey = tx_id WHERE o_orderstatus <> 'P'"))
def q_runtime_outcome(spark, d):
    return S.tx(spark, d).select("tx_id", "slot").join(runtime(spark, d), "tx_id")


LS = ["landed_rate", "roc_auc", "fail_base_rate", "fail_pr_auc", "brier"]


def landing_sql(by: str, src: str) -> str:
    lead = f"a.{by}, " if by else ""
    on1 = f"JOIN ({auc_sql('f', 'fail', 'q', by)}) b ON b.{by} = a.{by} JOIN" if by else f"CROSS JOIN ({auc_sql('f', 'fail', 'q')}) b CROSS JOIN"
    on2 = f"c ON c.{by} = a.{by}" if by else "c"
    grp = f"GROUP BY {by}" if by else ""
    bl = f"{by}, " if by else ""
    return f"""WITH f AS (SELECT {bl}landed, p_land, 1 - landed AS fail, -p_land AS q FROM {src})
      SELECT {lead}a.n, {r6('a.base_rate')} AS landed_rate, {r6('a.roc_auc')} AS roc_auc, {r6('b.base_rate')} AS fail_base_rate,
             {r6('b.pr_auc')} AS fail_pr_auc, {r6('c.brier')} AS brier
      FROM ({auc_sql('f', 'landed', 'p_land', by)}) a {on1} (SELECT {bl}avg((landed - p_land) * (landed - p_land)) AS brier FROM f {grp}) {on2}"""


@query("landing_summary", with_ctes(landing_sql("", "land")))
def q_landing_summary(spark, d):
    return rounded_all(M.landing_summary(land(spark, d), "landed", "p_land"), LS)


S.CTE["land_subsets"] = """
  SELECT * FROM (SELECT landed, p_land, unnest([CASE WHEN amount % 2 = 0 THEN 'attempted' END, CASE WHEN bad_payer THEN 'bad_payers' END,
    CASE WHEN relevant = 1 THEN 'has_swap' END, CASE WHEN payer % 5 = 0 THEN 'router' END]) AS subset FROM land) WHERE subset IS NOT NULL"""


@query("subset_summary", with_ctes(f"SELECT * FROM ({landing_sql('subset', 'land_subsets')}) WHERE n > 100 AND landed_rate > 0 AND landed_rate < 1"))
def q_subset_summary(spark, d):
    subsets = {"attempted": F.col("amount") % 2 == 0, "bad_payers": F.col("bad_payer"), "has_swap": F.col("relevant") == 1,
               "router": F.col("payer") % 5 == 0}
    x = LA.in_subsets(land(spark, d), subsets)
    out = M.landing_summary(x, "landed", "p_land", ["subset"]).where((F.col("n") > 100) & (F.col("landed_rate") > 0) & (F.col("landed_rate") < 1))
    return rounded_all(out, LS)


@query("gate_tradeoff", with_ctes(f"""
  SELECT cutoff, {r6('avg((p_land >= cutoff)::INT)')} AS kept, {r6('avg(landed) FILTER (p_land >= cutoff)')} AS landed_rate_kept,
         {r6('count(*) FILTER (landed = 0 AND p_land < cutoff) / greatest(1, count(*) FILTER (landed = 0))')} AS failures_removed,
         {r6('count(*) FILTER (landed = 1 AND p_land < cutoff) / greatest(1, sum(landed))')} AS landed_lost
  FROM land, (SELECT unnest([0.1::DOUBLE, 0.2, 0.3, 0.5, 0.7, 0.9]) AS cutoff) GROUP BY cutoff"""))
def q_gate_tradeoff(spark, d):
    return rounded_all(M.gate_tradeoff(land(spark, d), "landed", "p_land", [0.1, 0.2, 0.3, 0.5, 0.7, 0.9]),
                       ["kept", "landed_rate_kept", "failures_removed", "landed_lost"])


@query("bad_payer_rule", with_ctes(f"""
  SELECT {r6('avg(bad_payer::INT)')} AS share_flagged, {r6('avg(landed) FILTER (bad_payer)')} AS landed_if_flagged,
         {r6('avg(landed) FILTER (NOT bad_payer)')} AS landed_if_not,
         {r6('count(*) FILTER (bad_payer AND landed = 0) / greatest(1, count(*) FILTER (landed = 0))')} AS failures_caught,
         {r6('coalesce(sum(landed) FILTER (bad_payer), 0) / greatest(1, sum(landed))')} AS landed_lost FROM land"""))
def q_bad_payer_rule(spark, d):
    out = LA.bad_payer_rule(land(spark, d))
    return rounded_all(out, out.columns)


@query("policy_b_vs_c", with_ctes("""
  SELECT side, tx_id, amount, n FROM (
    SELECT side, tx_id, amount, count(*) OVER (PARTITION BY side) AS n, row_number() OVER (PARTITION BY side ORDER BY amount DESC, tx_id) AS rn FROM
      (SELECT *, CASE WHEN NOT bad_payer AND p_land < 0.5::DOUBLE THEN 'only_rule_keeps' WHEN bad_payer AND p_land >= 0.5::DOUBLE THEN 'only_model_keeps' END AS side
       FROM land WHERE landed = 1) WHERE side IS NOT NULL) WHERE rn <= 20"""))
def q_policy_diff(spark, d):
    x = land(spark, d).withColumn("keep_rule", ~F.col("bad_payer")).withColumn("keep_model", F.col("p_land") >= 0.5)
    diff = LA.policy_diff(x).select("side", "tx_id", "amount")
    w = M.W.partitionBy("side").orderBy(F.desc("amount"), "tx_id")
    top = diff.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 20).drop("_r")
    return top.join(F.broadcast(diff.groupBy("side").agg(F.count(F.lit(1)).alias("n"))), "side")  # two rows


@query("error_kinds", with_ctes("SELECT prio, count(*) AS n FROM tx WHERE landed = 0 GROUP BY prio ORDER BY n DESC, prio LIMIT 3"))
def q_error_kinds(spark, d):
    return S.tx(spark, d).where(F.col("landed") == 0).groupBy("prio").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prio").limit(3)


RAW_SQL = """raw AS (SELECT slot, tx_id AS tx_index, CASE WHEN tx_id % 1000 = 7 THEN 'X' ELSE 'S' END || tx_id AS signature, to_hex(amount) AS raw_hex FROM tx WHERE tx_id % 500 <> 3)"""


def raw(spark, d):
    t = S.tx(spark, d)
    return t.where(F.col("tx_id") % 500 != 3).select(
        "slot", F.col("tx_id").alias("tx_index"), F.concat(F.when(F.col("tx_id") % 1000 == 7, "X").otherwise("S"), "tx_id").alias("signature"),
        F.hex("amount").alias("raw_hex"))


def signed(spark, d):
    return S.tx(spark, d).select("tx_id", "slot", F.col("tx_id").alias("tx_index"), F.concat(F.lit("S"), "tx_id").alias("signature"))


@query("raw_label_join", with_ctes(f"""
  WITH {RAW_SQL} SELECT count(*) FILTER (r.slot IS NULL) AS missing, count(*) FILTER (r.signature <> 'S' || t.tx_id) AS mismatched, count(*) AS rows
  FROM tx t LEFT JOIN raw r ON r.slot = t.slot AND r.tx_index = t.tx_id"""))
def q_raw_label_join(spark, d):
    return LA.join_checked(signed(spark, d), raw(spark, d))[1]


@query("label_left_join", with_ctes(f"""
  WITH {RAW_SQL} SELECT 'S' || t.tx_id AS signature, t.tx_id, r.slot AS label_slot, r.raw_hex AS label_raw_hex
  FROM tx t LEFT JOIN raw r ON r.signature = 'S' || t.tx_id"""))
def q_label_left_join(spark, d):
    return LA.join_labels(signed(spark, d).select("signature", "tx_id"), raw(spark, d).select("signature", "slot", "raw_hex"), "signature")


@query("pending_masters", with_ctes(f"""
  WITH {RAW_SQL} SELECT count(*) AS wanted, count(*) FILTER (tx_id NOT IN (SELECT tx_index FROM raw)) AS missing FROM tx"""))
def q_pending(spark, d):
    want = S.tx(spark, d).select(F.col("tx_id").alias("tx_index"))
    got = raw(spark, d).select("tx_index", F.lit(1).alias("g"))
    return want.join(got, "tx_index", "left").agg(F.count(F.lit(1)).alias("wanted"), count_if(F.col("g").isNull()).alias("missing"))


# ---------------------------------------------------------------- structure

S.CTE["ixs"] = "SELECT tx_id, pos, min(supp) AS prog, sum(qty)::BIGINT AS data_len, max(amount) AS amount, count(*) AS n_acc FROM trig GROUP BY tx_id, pos"
S.CTE["ix_keys"] = "SELECT tx_id, pos, pool AS account, bool_or(writable) AS writable, count(*) AS uses FROM trig GROUP BY tx_id, pos, pool"
S.CTE["tx_keys"] = """
  SELECT tx_id, pool AS account, bool_or(writable) AS writable, bool_or(layer = 'TOP_LEVEL') AS is_static, min(pos) AS first_pos FROM trig GROUP BY tx_id, pool"""


def ixs(spark, d):
    return S.trig(spark, d).groupBy("tx_id", "pos").agg(F.min("supp").alias("prog"), F.sum("qty").alias("data_len"), F.max("amount").alias("amount"),
                                                        F.count(F.lit(1)).alias("n_acc"))


def ix_keys(spark, d):
    return S.trig(spark, d).groupBy("tx_id", "pos", F.col("pool").alias("account")).agg(F.bool_or("writable").alias("writable"), F.count(F.lit(1)).alias("uses"))


def tx_keys(spark, d):
    return S.trig(spark, d).groupBy("tx_id", F.col("pool").alias("account")).agg(
        F.bool_or("writable").alias("writable"), F.bool_or(F.col("layer") == "TOP_LEVEL").alias("is_static"), F.min("pos").alias("first_pos"))


S.CTE["adj"] = """
  SELECT tx_id, count(*) AS adjacent_shared, sum(w) AS adjacent_shared_writable FROM
    (SELECT a.tx_id, a.pos, max((a.writable AND b.writable)::INT) AS w FROM ix_keys a JOIN ix_keys b ON b.tx_id = a.tx_id AND b.account = a.account AND b.pos = a.pos + 1
     GROUP BY ALL) GROUP BY tx_id"""


@query("adjacent_share", with_ctes("SELECT * FROM adj"))
def q_adjacent(spark, d):
    return ST.adjacent_share(ix_keys(spark, d))


@query("tx_structure", with_ctes("""
  WITH a AS (SELECT tx_id, count(*) AS n_instructions, sum(data_len) AS data_sum, max(data_len) AS data_max, min(data_len) AS data_min FROM ixs GROUP BY tx_id),
  p AS (SELECT tx_id, count(*) AS n_programs, count(*) FILTER (n > 1) AS repeated_programs FROM (SELECT tx_id, prog, count(*) AS n FROM ixs GROUP BY ALL) GROUP BY tx_id),
  b AS (SELECT tx_id, sum(u) AS account_uses, count(*) AS n_accounts, count(*) FILTER (u > 1) AS reused_accounts, count(*) FILTER (k > 1) AS accounts_in_several
        FROM (SELECT tx_id, account, sum(uses) AS u, count(*) AS k FROM ix_keys GROUP BY ALL) GROUP BY tx_id)
  SELECT a.*, p.* EXCLUDE (tx_id), b.* EXCLUDE (tx_id), coalesce(adjacent_shared, 0) AS adjacent_shared, coalesce(adjacent_shared_writable, 0) AS adjacent_shared_writable
  FROM a JOIN p USING (tx_id) JOIN b USING (tx_id) LEFT JOIN adj USING (tx_id)"""))
def q_tx_structure(spark, d):
    return ST.tx_structure(ixs(spark, d), ix_keys(spark, d))


@query("budget_ix_rollup", with_ctes("""
  WITH b AS (SELECT tx_id, pos, CASE WHEN data_len % 2 = 0 THEN 'limit' ELSE 'price' END AS kind, CASE WHEN n_acc < 3 THEN amount END AS value FROM ixs WHERE prog % 2 = 0)
  SELECT tx_id, count(*) AS n_budget, min(pos) AS first_pos, max(pos) AS last_pos,
         max_by(value, pos) FILTER (kind = 'limit' AND value IS NOT NULL) AS limit_value, count(*) FILTER (kind = 'limit') > 1 AS limit_repeated,
         max_by(value, pos) FILTER (kind = 'price' AND value IS NOT NULL) AS price_value, count(*) FILTER (kind = 'price') > 1 AS price_repeated FROM b GROUP BY tx_id"""))
def q_budget_rollup(spark, d):
    b = ixs(spark, d).where(F.col("prog") % 2 == 0).select(
        "tx_id", "pos", F.when(F.col("data_len") % 2 == 0, "limit").otherwise("price").alias("kind"), F.when(F.col("n_acc") < 3, F.col("amount")).alias("value"))
    return ST.budget_rollup(b)


@query("ix_slots", with_ctes("""
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY pos) - 1 AS r FROM ixs WHERE prog % 10 <> 0)
  SELECT tx_id, """ + ", ".join(f"coalesce(max({c}) FILTER (r = {i}), 0) AS ix{i}_{c}" for i in range(8) for c in ("data_len", "n_acc")) +
    " FROM r WHERE r < 8 GROUP BY tx_id"))
def q_ix_slots(spark, d):
    return ST.ix_slots(ixs(spark, d).where(F.col("prog") % 10 != 0), ["data_len", "n_acc"])


@query("program_dictionary", with_ctes("SELECT DISTINCT substr(sha256(prog::VARCHAR), 1, 16) AS program_hash, prog FROM ixs"))
def q_program_dictionary(spark, d):
    return ST.program_dictionary(ixs(spark, d))


@query("relevance_audit_pop", with_ctes("""
  WITH s AS (SELECT tx_id, list(prog::VARCHAR ORDER BY pos) AS p, coalesce(string_agg(prog::VARCHAR, '|' ORDER BY pos) FILTER (prog % 10 <> 0), '') AS q FROM ixs GROUP BY tx_id)
  SELECT tx_id, coalesce(substr(sha256(p[1]), 1, 16), '0') AS prog0, coalesce(substr(sha256(p[2]), 1, 16), '0') AS prog1,
         coalesce(substr(sha256(p[3]), 1, 16), '0') AS prog2, substr(sha256(p[-1]), 1, 16) AS prog_last, substr(sha256(q), 1, 16) AS prog_seq FROM s"""))
def q_program_hashes(spark, d):
    return ST.program_hashes(ixs(spark, d), F.col("prog") % 10 == 0)


@query("data_len_class", with_ctes("""
  SELECT class, count(*) AS n FROM (SELECT CASE WHEN x = 0 THEN 0 WHEN x > 1024 THEN 11 ELSE greatest(1, ceil(log2(x)))::INT END AS class
    FROM (SELECT amount % 1500 AS x FROM trig)) GROUP BY class"""))
def q_data_len_class(spark, d):
    return S.trig(spark, d).groupBy(ST.data_len_class(F.col("amount") % 1500).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("family_fields", with_ctes("""
  SELECT DISTINCT family, pos % 9 AS prefix_bytes, CASE WHEN qty % 2 = 0 THEN qty ELSE 0 END AS data_len, supp % 20 AS accounts FROM
    (SELECT *, 'prefix' || (pos % 9) || ':ab' || pos || CASE WHEN qty % 2 = 0 THEN ':len' || qty ELSE '' END || ':accounts' || (supp % 20) AS family FROM (SELECT * EXCLUDE (family) FROM trig))"""))
def q_family_fields(spark, d):
    t = S.trig(spark, d)
    fam = F.concat(F.lit("prefix"), F.col("pos") % 9, F.lit(":ab"), F.col("pos"),
                   F.when(F.col("qty") % 2 == 0, F.concat(F.lit(":len"), F.col("qty"))).otherwise(""), F.lit(":accounts"), F.col("supp") % 20)
    return t.select(fam.alias("family")).distinct().select(
        "family", ST.family_field("family", "prefix").alias("prefix_bytes"), ST.family_field("family", "len").alias("data_len"),
        ST.family_field("family", "accounts").alias("accounts"))


CODE_SQL = "coalesce(('0x' || substr(sha256({}), 1, 15))::BIGINT, 0)"

FAMILIES, PROGRAMS = ["ECONOMY", "SMALL"], ["P1", "P2", "P3"]
S.CTE["legs"] = """
  SELECT route, rn AS leg_no, p_type AS family, 'P' || (p_partkey % 7) AS program FROM
    (SELECT *, p_brand || '/s' || (p_size % 5) AS route, row_number() OVER (PARTITION BY p_brand, p_size % 5 ORDER BY p_partkey) AS rn FROM part)"""


def legs(spark, d):
    w = M.W.partitionBy("p_brand", "r").orderBy("p_partkey")
    p = S.table(spark, d, "part").withColumn("r", F.col("p_size") % 5).withColumn("rn", F.row_number().over(w))
    return p.select(
        F.concat("p_brand", F.lit("/s"), "r").alias("route"), F.col("rn").alias("leg_no"), F.col("p_type").alias("family"),
        F.concat(F.lit("P"), F.col("p_partkey") % 7).alias("program"))


@query("pack_structure", with_ctes("""
  WITH rt AS (SELECT route, count(*) AS hops, string_agg(family, '>' ORDER BY leg_no) AS pattern, """ +
    ", ".join(f"count(*) FILTER (family = '{f}') AS f_{f}" for f in FAMILIES) + ", count(*) FILTER (family NOT IN ('ECONOMY', 'SMALL')) AS f_other, " +
    ", ".join(f"count(*) FILTER (program = '{p}') AS p_{p}" for p in PROGRAMS) + """, count(*) FILTER (program NOT IN ('P1', 'P2', 'P3')) AS p_other FROM legs GROUP BY route)
  , f AS (SELECT pack_id, count(*) AS route_count, min(hops) AS hops_min, max(hops) AS hops_max, sum(hops) AS hops_sum, count(*) FILTER (hops = 2) AS routes_2hop,
         count(*) FILTER (hops = 3) AS routes_3hop, count(*) FILTER (hops = 4) AS routes_4hop, count(*) FILTER (hops >= 5) AS routes_5plus_hop,
         count(DISTINCT pattern) AS distinct_patterns, """ + ", ".join(f"sum(f_{f}) AS legs_{f}" for f in [*FAMILIES, "other"]) + ", " +
    ", ".join(f"sum(p_{p}) AS legs_p_{p}" for p in [*PROGRAMS, "other"]) + f""" FROM pack_routes JOIN rt USING (route) GROUP BY pack_id)
  SELECT f.*, CASE layer WHEN 'TOP_LEVEL' THEN 0 WHEN 'INNER' THEN 1 WHEN 'ATTRIBUTED' THEN 2 ELSE 3 END AS layer_code, {CODE_SQL.format('program')} AS program_hash,
    {CODE_SQL.format("'prefix' || (gain % 9) || ':00ff:len' || gain || ':accounts' || j")} AS family_hash, gain % 9 AS family_prefix_bytes, gain AS family_data_len, j AS family_account_count
  FROM f JOIN packs USING (pack_id)"""))
def q_pack_structure(spark, d):
    packs = S.packs(spark, d)
    family = F.concat(F.lit("prefix"), F.col("gain") % 9, F.lit(":00ff:len"), F.col("gain"), F.lit(":accounts"), F.col("j"))
    return ST.pack_structure(packs.withColumn("family", family), S.pack_routes(packs), legs(spark, d), FAMILIES, PROGRAMS)


ROLE_SQL = "CASE pos WHEN 1 THEN 'POOL_STATE' WHEN 2 THEN 'VAULT' WHEN 3 THEN 'MINT' WHEN 4 THEN 'ORACLE' WHEN 5 THEN 'PROGRAM' ELSE 'TICK_ARRAY' END"
S.CTE["uni_accounts"] = f"""
  SELECT DISTINCT 'A' || supp AS account FROM trig WHERE {ROLE_SQL} IN ('POOL_STATE', 'VAULT', 'ORACLE', 'TICK_ARRAY') AND supp % 3 = 0
    AND pool IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0)
  UNION SELECT p_partkey::VARCHAR FROM part WHERE p_size % 2 = 0"""


def universe(spark, d):
    markets = S.table(spark, d, "part").where(F.col("p_size") % 2 == 0).select(F.col("p_partkey").alias("pool"), F.col("p_brand").alias("program"))
    n = F.col("pos")
    role = (F.when(n == 1, "POOL_STATE").when(n == 2, "VAULT").when(n == 3, "MINT").when(n == 4, "ORACLE").when(n == 5, "PROGRAM").otherwise("TICK_ARRAY"))
    catalog = S.trig(spark, d).select("pool", role.alias("role"), F.when(F.col("supp") % 3 == 0, F.concat(F.lit("A"), "supp")).otherwise("").alias("pubkey"))
    return ST.tracked_universe(markets, catalog)


@query("tracked_universe", with_ctes("SELECT account FROM uni_accounts"))
def q_universe(spark, d):
    return universe(spark, d)[0]


KEY_SQL = """(SELECT tx_id, account::VARCHAR AS account, writable, is_static FROM tx_keys
  UNION ALL SELECT tx_id, 'A' || supp, bool_or(writable), true FROM trig GROUP BY tx_id, supp
  UNION ALL SELECT tx_id, 'Brand#' || (pool % 30), false, true FROM trig GROUP BY tx_id, pool % 30)"""


def named_keys(spark, d):
    t = S.trig(spark, d)
    a = tx_keys(spark, d).select("tx_id", F.col("account").cast("string").alias("account"), "writable", "is_static")
    b = t.groupBy("tx_id", F.concat(F.lit("A"), "supp").alias("account")).agg(F.bool_or("writable").alias("writable"), F.lit(True).alias("is_static"))
    c = t.select("tx_id", F.concat(F.lit("Brand#"), F.col("pool") % 30).alias("account"), F.lit(False).alias("writable"), F.lit(True).alias("is_static")).distinct()
    return a.unionByName(b).unionByName(c)


@query("relevance_gate", with_ctes(f"""
  SELECT *, (market_writable + market_readonly + venue_program > 0)::INT AS relevant FROM (
    SELECT tx_id, count(u.account) FILTER (k.writable) AS market_writable, count(u.account) FILTER (NOT k.writable) AS market_readonly, count(p.program) AS venue_program
    FROM {KEY_SQL} k LEFT JOIN uni_accounts u ON u.account = k.account
    LEFT JOIN (SELECT DISTINCT p_brand AS program FROM part WHERE p_size % 2 = 0) p ON p.program = k.account WHERE k.is_static GROUP BY tx_id)"""))
def q_relevance(spark, d):
    accounts, programs = universe(spark, d)
    return ST.relevance(named_keys(spark, d), accounts, programs)


@query("program_census", with_ctes("""
  WITH top AS (SELECT supp AS key, count(DISTINCT tx_id) AS top_level_txs FROM trig WHERE layer = 'TOP_LEVEL' GROUP BY supp HAVING count(DISTINCT tx_id) >= 20),
  n AS (SELECT supp AS key, count(DISTINCT tx_id) AS named_txs, count(DISTINCT CASE WHEN tx_id IN (SELECT tx_id FROM trig WHERE supp % 5 = 0) THEN tx_id END) AS named_in_routed_txs
        FROM trig GROUP BY supp)
  SELECT top.key, top_level_txs, named_txs, named_in_routed_txs FROM top JOIN n ON n.key = top.key"""))
def q_census(spark, d):
    t = S.trig(spark, d)
    return ST.census(t.select("tx_id", F.col("supp").alias("key")).distinct(),
                     t.where(F.col("layer") == "TOP_LEVEL").select("tx_id", F.col("supp").alias("key")).distinct(),
                     t.where(F.col("supp") % 5 == 0).select("tx_id").distinct())


STATIC_INPUTS = ST.LANDING_NUMBERS + ST.LANDING_HASHES

S.CTE["land_ixs"] = """
  SELECT *, prog % 10 = 0 AS is_budget, prog % 7 = 0 AS is_transfer, prog % 7 = 0 AND n_acc > 1 AS is_tip, prog % 2 = 1 AS is_swap, prog % 3 = 0 AS is_router FROM ixs"""


@query("landing_static", with_ctes("""
  WITH k AS (SELECT tx_id, count(*) AS n_keys, count(*) FILTER (is_static) AS n_static_keys, count(*) FILTER (writable) AS n_writable,
                    count(*) FILTER (account % 3 = 0) AS n_pools, count(*) FILTER (account % 3 = 0 AND is_static) AS n_pools_static,
                    count(*) FILTER (account % 3 = 0 AND writable) AS n_pools_writable, bool_or(account = 97)::BIGINT AS base_in_keys, count(*) FILTER (account % 3 = 0 AND is_static) > 1 AS cycle FROM tx_keys GROUP BY tx_id),
  i AS (SELECT tx_id, count(*) AS n_instructions, count(DISTINCT prog) AS n_distinct_programs, sum(data_len)::BIGINT AS data_bytes, max(data_len) AS max_ix_data, count(*) FILTER (is_budget) AS n_budget_ix,
               count(*) FILTER (is_transfer) AS n_transfers, coalesce(sum(amount) FILTER (is_tip), 0)::BIGINT AS tip, count(*) FILTER (is_swap) AS n_swaps, coalesce(max(amount) FILTER (is_swap), 0) AS max_swap,
               count(*) FILTER (is_router) AS n_router, coalesce(max(amount) FILTER (is_router), 0) AS max_router, list(prog::VARCHAR ORDER BY pos) AS l,
               coalesce(string_agg(CASE WHEN NOT is_budget THEN prog::VARCHAR END, '|' ORDER BY pos), '') AS seq FROM land_ixs GROUP BY tx_id),
  t AS (SELECT tx_id, (tx_id % 3 > 0)::BIGINT AS version, tx_id % 4 AS n_tables, 1 + tx_id % 3 AS n_signers, amount % 1232 AS raw_len, (tx_id % 13 = 0)::BIGINT AS durable_nonce, amount % 1400000 AS unit_limit,
               tx_id % 5000 AS unit_price, tx_id % 64 AS entry_index, tx_id % 1000 AS tx_index FROM tx)
  SELECT t.*, """ + ", ".join(f"coalesce(k.{c}, 0) AS {c}" for c in ("n_keys", "n_static_keys", "n_writable", "n_pools", "n_pools_static", "n_pools_writable", "base_in_keys")) + ", " +
  ", ".join(f"coalesce(i.{c}, 0) AS {c}" for c in ("n_instructions", "n_distinct_programs", "data_bytes", "max_ix_data", "n_budget_ix", "n_transfers", "tip", "n_swaps", "max_swap", "n_router", "max_router")) + """,
    (coalesce(n_keys, 0) > coalesce(n_static_keys, 0))::BIGINT AS uses_tables, unit_limit * unit_price // 1000000 AS priority_fee, (coalesce(tip, 0) > 0)::BIGINT AS has_tip, (n_signers = 1)::BIGINT AS payer_only_signer,
    coalesce(cycle, false)::BIGINT AS attempted_cycle, """ + ", ".join(f"{CODE_SQL.format(e)} AS {n}" for n, e in (("prog0", "l[1]"), ("prog1", "l[2]"), ("prog2", "l[3]"), ("prog_last", "l[-1]"), ("prog_seq", "seq"))) + """
  FROM t LEFT JOIN k USING (tx_id) LEFT JOIN i USING (tx_id)"""))
def q_landing_static(spark, d):
    n, p = F.col("tx_id"), F.col("prog")
    tx = S.tx(spark, d).select("tx_id", (n % 3 > 0).cast("bigint").alias("version"), (n % 4).alias("n_tables"), (1 + n % 3).alias("n_signers"), (F.col("amount") % 1232).alias("raw_len"),
                               (n % 13 == 0).cast("bigint").alias("durable_nonce"), (F.col("amount") % 1400000).alias("unit_limit"), (n % 5000).alias("unit_price"), (n % 64).alias("entry_index"),
                               (n % 1000).alias("tx_index"))
    flags = {"is_budget": p % 10 == 0, "is_transfer": p % 7 == 0, "is_tip": (p % 7 == 0) & (F.col("n_acc") > 1), "is_swap": p % 2 == 1, "is_router": p % 3 == 0}
    keys = tx_keys(spark, d)
    pools = S.table(spark, d, "part").where(F.col("p_partkey") % 3 == 0).select(F.col("p_partkey").alias("pool"))
    cycles = keys.where((F.col("account") % 3 == 0) & F.col("is_static")).groupBy("tx_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return ST.landing_static(tx, keys, ixs(spark, d).withColumns(flags), pools, "97", cycles)
