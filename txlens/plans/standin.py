"""The roles of the data model filled from the driver tables.

Each role exists twice: as a DataFrame (`tx(spark, d)`) and as SQL text (`CTE["tx"]`) for the oracles. Everything is
integer arithmetic, so both engines see the same values.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from txlens.functions.numbers import cents

LAYERS = ("TOP_LEVEL", "INNER", "ATTRIBUTED")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def epoch_seconds(c: str):
    """Whole seconds of a zone-less timestamp, independent of the session zone."""
    t = F.col(c)
    return (F.datediff(t, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t))


def epoch_micros(c: str):
    part = F.date_part(F.lit("SECOND"), F.col(c)) - F.second(c)
    return epoch_seconds(c) * 1000000 + F.floor(part * 1000000).cast("bigint")


CTE: dict[str, str] = {}

CTE["tx"] = """
  SELECT o_orderkey AS tx_id, o_custkey AS payer, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS slot,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS landed, o_orderpriority AS prio,
         CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS amount,
         CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS encode_status,
         CASE WHEN o_orderkey % 7 <= 4 THEN 1 ELSE 0 END AS relevant,
         CASE WHEN o_orderkey % 50 = 0 THEN NULL
              ELSE date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) * 86400 + o_orderkey % 86400 END AS block_time
  FROM orders"""


def tx(spark, d) -> DataFrame:
    """Transactions: id, payer, slot, outcome, amount, encode status, gate, block time (null for some)."""
    k = F.col("o_orderkey")
    slot = F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("bigint")
    return table(spark, d, "orders").select(
        k.alias("tx_id"), F.col("o_custkey").alias("payer"), slot.alias("slot"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("landed"), F.col("o_orderpriority").alias("prio"),
        cents("o_totalprice").alias("amount"),
        F.when(k % 11 == 0, 1).otherwise(0).alias("encode_status"), F.when(k % 7 <= 4, 1).otherwise(0).alias("relevant"),
        F.when(k % 50 != 0, slot * 86400 + k % 86400).alias("block_time"))


CTE["trig"] = """
  SELECT l_orderkey AS tx_id, l_partkey AS pool, 'P' || l_suppkey AS program, 'F' || (l_linenumber % 4) AS family,
         CASE l_linenumber % 3 WHEN 0 THEN 'TOP_LEVEL' WHEN 1 THEN 'INNER' ELSE 'ATTRIBUTED' END AS layer,
         CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN ''
              WHEN floor(l_tax * 100 + 0.5) >= 6 THEN 'ALT' ELSE 'BASE' END AS base,
         CASE l_returnflag WHEN 'R' THEN 'POSITIVE' WHEN 'A' THEN 'CERTIFIED_NEGATIVE' ELSE 'UNKNOWN' END AS status,
         CASE WHEN l_returnflag <> 'N' THEN '' WHEN l_linestatus = 'F' THEN 'NO_LABEL'
              WHEN floor(l_tax * 100 + 0.5) >= 4 THEN 'UNRESOLVED' ELSE 'ENTRY_DEPENDENT' END AS reason,
         CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_extendedprice * l_discount * 100 + 0.5) AS BIGINT) END AS profit,
         CASE WHEN l_returnflag = 'R' THEN 'Q' || (l_linenumber % 2) ELSE '' END AS quality,
         l_linenumber AS pos, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS amount,
         CAST(floor(l_quantity + 0.5) AS BIGINT) AS qty, l_linestatus = 'O' AS writable, l_suppkey AS supp
  FROM lineitem"""


def trig(spark, d) -> DataFrame:
    """Trigger rows: one per call, three-valued status, base empty on rows without a label."""
    n, flag, f_line = F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus") == "F"
    tax = F.floor(F.col("l_tax") * 100 + 0.5)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("tx_id"), F.col("l_partkey").alias("pool"),
        F.concat(F.lit("P"), F.col("l_suppkey")).alias("program"), F.concat(F.lit("F"), n % 4).alias("family"),
        F.when(n % 3 == 0, "TOP_LEVEL").when(n % 3 == 1, "INNER").otherwise("ATTRIBUTED").alias("layer"),
        F.when((flag == "N") & f_line, "").when(tax >= 6, "ALT").otherwise("BASE").alias("base"),
        F.when(flag == "R", "POSITIVE").when(flag == "A", "CERTIFIED_NEGATIVE").otherwise("UNKNOWN").alias("status"),
        F.when(flag != "N", "").when(f_line, "NO_LABEL").when(tax >= 4, "UNRESOLVED").otherwise("ENTRY_DEPENDENT").alias("reason"),
        F.when(flag == "R", cents(F.col("l_extendedprice") * F.col("l_discount"))).alias("profit"),
        F.when(flag == "R", F.concat(F.lit("Q"), n % 2)).otherwise("").alias("quality"),
        n.alias("pos"), cents("l_extendedprice").alias("amount"), F.floor(F.col("l_quantity") + 0.5).alias("qty"),
        (F.col("l_linestatus") == "O").alias("writable"), F.col("l_suppkey").alias("supp"))


CTE["pool_route_ids"] = """
  SELECT p_partkey AS pool, unnest([p_brand || '/' || p_type, p_brand || '/s' || (p_size % 5),
                                    p_type || '/z' || (p_size % 7)]) AS route
  FROM part"""


def pool_route_ids(spark, d) -> DataFrame:
    """Every pool lies on three routes."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("pool"),
        F.explode(F.array(F.concat_ws("/", "p_brand", "p_type"),
                          F.concat(F.col("p_brand"), F.lit("/s"), F.col("p_size") % 5),
                          F.concat(F.col("p_type"), F.lit("/z"), F.col("p_size") % 7))).alias("route"))


CTE["routes_long"] = "SELECT route AS route_id, pool FROM pool_route_ids"

CTE["positives"] = """
  SELECT t.tx_id, p.p_brand || '/' || p.p_type || ',' || p.p_brand || '/s' || (p.p_size % 5)
         || CASE WHEN t.pos % 2 = 0 THEN ',' || p.p_type || '/z' || (p.p_size % 7) ELSE ',' END AS routes
  FROM trig t JOIN part p ON p.p_partkey = t.pool WHERE t.status = 'POSITIVE'"""


def positives(spark, d) -> DataFrame:
    """Positive occurrences with a packed route list; some lists end in an empty entry."""
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("pool"), "p_brand", "p_type", "p_size")
    t = trig(spark, d).where(F.col("status") == "POSITIVE").select("tx_id", "pool", "pos")
    return t.join(p, "pool").select("tx_id", F.concat(
        "p_brand", F.lit("/"), "p_type", F.lit(","), "p_brand", F.lit("/s"), F.col("p_size") % 5,
        F.when(F.col("pos") % 2 == 0, F.concat(F.lit(","), F.col("p_type"), F.lit("/z"), F.col("p_size") % 7))
        .otherwise(",")).alias("routes"))


CTE["pos_routes"] = """
  SELECT DISTINCT tx_id, route FROM (SELECT tx_id, unnest(string_split(routes, ',')) AS route FROM positives)
  WHERE route <> ''"""

CTE["packs"] = """
  SELECT *, row_number() OVER (PARTITION BY program, family, layer, base ORDER BY gain DESC, pack_id) - 1 AS rank FROM (
    SELECT 'K' || s_suppkey || '_' || j AS pack_id, 'P' || s_suppkey AS program,
           'F' || (((s_suppkey + j // 2) % 7 + 1) % 4) AS family,
           CASE ((s_suppkey + j // 2) % 7 + 1) % 3 WHEN 0 THEN 'TOP_LEVEL' WHEN 1 THEN 'INNER' ELSE 'ATTRIBUTED' END AS layer,
           CASE WHEN (s_suppkey + j // 2) % 3 = 0 THEN 'ALT' ELSE 'BASE' END AS base,
           (s_suppkey * 7 + j * 13) % 101 AS gain, s_suppkey AS supp, j
    FROM supplier, (SELECT unnest(range(8)) AS j))"""


def packs(spark, d) -> DataFrame:
    """Pack catalog: eight packs per program over four trigger keys, ranked within the key.

    The optimizer takes exploded rows for as few as the suppliers they come from and would broadcast 8 packs and 120 routes
    of each through the driver, so joins with the catalog, or with what is made of it, merge.
    """
    s, j = F.col("s_suppkey"), F.col("j")
    n = (s + F.floor(j / 2)) % 7 + 1
    w = W.partitionBy("program", "family", "layer", "base").orderBy(F.desc("gain"), "pack_id")
    return (table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
            .select(F.concat(F.lit("K"), s, F.lit("_"), j).alias("pack_id"), F.concat(F.lit("P"), s).alias("program"),
                    F.concat(F.lit("F"), n % 4).alias("family"),
                    F.when(n % 3 == 0, "TOP_LEVEL").when(n % 3 == 1, "INNER").otherwise("ATTRIBUTED").alias("layer"),
                    F.when((s + F.floor(j / 2)) % 3 == 0, "ALT").otherwise("BASE").alias("base"),
                    ((s * 7 + j * 13) % 101).alias("gain"), s.alias("supp"), j)
            .withColumn("rank", (F.row_number().over(w) - 1).cast("bigint")).hint("merge"))


CTE["pack_routes"] = """
  SELECT pack_id, 'Brand#' || ((supp + j + 8 * o) % 25 + 1) || '/s' || r AS route
  FROM packs, (SELECT unnest(range(3)) AS o), (SELECT unnest(range(5)) AS r)"""


def pack_routes(packs_df: DataFrame) -> DataFrame:
    """The fifteen routes of a pack."""
    return (packs_df.select("pack_id", "supp", "j", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("o"))
            .select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r"))
            .select("pack_id", F.concat(F.lit("Brand#"), (F.col("supp") + F.col("j") + 8 * F.col("o")) % 25 + 1,
                                        F.lit("/s"), F.col("r")).alias("route")))

CTE["labels"] = """
  SELECT *, CASE label WHEN 'POSITIVE' THEN 1 WHEN 'CERTIFIED_NEGATIVE' THEN 0 END AS target FROM (
    SELECT tx_id, count(*) FILTER (status = 'POSITIVE') AS n_pos, count(*) FILTER (status = 'CERTIFIED_NEGATIVE') AS n_neg,
           count(*) AS n_occurrences,
           count(*) FILTER (layer = 'TOP_LEVEL') AS n_top_level, count(*) FILTER (layer = 'INNER') AS n_inner,
           count(*) FILTER (layer = 'ATTRIBUTED') AS n_attributed,
           coalesce(string_agg(DISTINCT CASE WHEN status = 'UNKNOWN' THEN reason END, '|'
                    ORDER BY CASE WHEN status = 'UNKNOWN' THEN reason END), '') AS unknown_reasons,
           coalesce(string_agg(DISTINCT CASE WHEN quality <> '' THEN quality END, '|'
                    ORDER BY CASE WHEN quality <> '' THEN quality END), '') AS label_quality,
           max(profit) AS best_profit,
           CASE WHEN count(*) FILTER (status = 'POSITIVE') > 0 THEN 'POSITIVE'
                WHEN count(*) FILTER (status = 'CERTIFIED_NEGATIVE') > 0
                     AND count(*) FILTER (status = 'UNKNOWN' AND base <> '') = 0 THEN 'CERTIFIED_NEGATIVE'
                ELSE 'UNKNOWN' END AS label
    FROM trig GROUP BY tx_id)"""

CTE["elig"] = """
  SELECT DISTINCT t.tx_id, p.pack_id, p.rank AS pack_rank, p.layer = 'TOP_LEVEL' AS live
  FROM (SELECT DISTINCT tx_id, program, family, layer, base FROM trig) t JOIN packs p
    ON p.program = t.program AND p.family = t.family AND p.layer = t.layer AND (t.base = '' OR p.base = t.base)"""

CTE["cover"] = """
  SELECT e.* FROM elig e SEMI JOIN (SELECT DISTINCT r.pack_id, w.tx_id FROM pack_routes r JOIN pos_routes w ON w.route = r.route) x
    ON x.pack_id = e.pack_id AND x.tx_id = e.tx_id"""

CTE["cover_counts"] = """
  SELECT e.tx_id, count(*) AS n_eligible, count(*) FILTER (e.live) AS n_eligible_live,
         count(c.pack_id) AS n_covering, count(c.pack_id) FILTER (e.live) AS n_covering_live,
         min(c.pack_rank) AS min_cover_rank, min(c.pack_rank) FILTER (e.live) AS min_cover_rank_live
  FROM elig e LEFT JOIN cover c ON c.tx_id = e.tx_id AND c.pack_id = e.pack_id GROUP BY e.tx_id"""

SAMPLE_PPM = 250_000

# The mixed id of the sampler in wide integers.
CTE["mixed"] = """
  SELECT o_orderkey AS tx_id, ((26719298539695165::UHUGEINT + o_orderkey::UHUGEINT) * 11400714785074694791::UHUGEINT)
         % 18446744073709551616::UHUGEINT AS x FROM orders"""

CTE["sampled_tx"] = f"""
  SELECT tx_id FROM mixed WHERE xor(x::UBIGINT, (x // 1073741824::UHUGEINT)::UBIGINT) % 1000000 < {SAMPLE_PPM}"""

CTE["slot_list"] = """
  SELECT slot, row_number() OVER (ORDER BY slot) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT slot FROM tx)"""

CTE["bounds"] = """
  SELECT min(slot) AS first_slot, max(slot) FILTER (rn = round_even(n * 0.7::DOUBLE, 0)) AS train_hi,
         max(slot) FILTER (rn = round_even(n * (0.7::DOUBLE + 0.15::DOUBLE), 0)) AS val_hi, max(slot) AS last_slot, max(n) AS n
  FROM slot_list"""

CTE["split_tx"] = """
  SELECT tx.*, CASE WHEN slot <= train_hi THEN 'train' WHEN slot <= val_hi THEN 'val' ELSE 'test' END AS split FROM tx, bounds"""

CTE["scored"] = """
  SELECT g.*, CASE WHEN slot <= train_hi THEN 'train' WHEN slot <= val_hi THEN 'val' ELSE 'test' END AS split,
         ((g.tx_id * 7919) % 211 + CASE WHEN n_pos > 0 THEN 40 ELSE 0 END + n_occurrences) / 300e0 AS arb_score,
         (amount % 1000003) / 1000003e0 AS p2, (amount % 7919 + n_occurrences) / 1000e0 AS size_pred,
         ((g.tx_id * 7919) % 211 + CASE WHEN n_pos > 0 THEN 40 ELSE 0 END + n_occurrences) / 300e0 * amount / 1000000e0 AS ev,
         CASE WHEN label = 'UNKNOWN' AND s.tx_id IS NOT NULL THEN 1 ELSE 0 END AS pair_sample,
         CASE WHEN target IS NOT NULL THEN 1 WHEN s.tx_id IS NOT NULL THEN 4 ELSE 0 END AS weight
  FROM grouped g CROSS JOIN bounds LEFT JOIN sampled_tx s ON s.tx_id = g.tx_id"""

CTE["scored_cov"] = """
  SELECT s.*, c.* EXCLUDE (tx_id), coalesce(z.n_seen, 0) AS n_seen_in_train
  FROM scored s LEFT JOIN cover_counts c ON c.tx_id = s.tx_id
  LEFT JOIN (SELECT tx_id, count(*) AS n_seen FROM pos_routes WHERE route IN
             (SELECT route FROM pos_routes r JOIN scored q ON q.tx_id = r.tx_id WHERE q.split = 'train') GROUP BY tx_id) z ON z.tx_id = s.tx_id"""

CTE["spairs"] = """
  SELECT p.*, -p.pack_rank::DOUBLE AS static, ((p.tx_id * 31 + k.gain * 17) % 101) / 101e0 AS learned
  FROM pairs p JOIN packs k ON k.pack_id = p.pack_id"""


def r6(e: str, digits: int = 6) -> str:
    """Half-up rounding, the SQL twin of functions.numbers.rounded."""
    return f"(floor(CAST({e} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits})"


def auc_sql(source: str, y: str, p: str, by: str = "") -> str:
    """n, positives, base_rate, pr_auc, roc_auc of a source, per group when `by` names columns."""
    part = f"PARTITION BY {by} " if by else ""
    lead = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"""SELECT {lead}sum(n) AS n, sum(pos) AS positives, sum(pos) / sum(n) AS base_rate,
      CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN sum(pos / tp * (cp / cn)) END AS pr_auc,
      CASE WHEN max(tp) > 0 AND max(tp) < max(tn)
           THEN (sum(pos * (tn - cn + (n + 1) / 2e0)) - max(tp) * (max(tp) + 1) / 2e0) / (max(tp)::DOUBLE * (max(tn) - max(tp))) END AS roc_auc
      FROM (SELECT *, sum(pos) OVER ({part}ORDER BY p DESC) AS cp, sum(n) OVER ({part}ORDER BY p DESC) AS cn,
                   sum(pos) OVER ({part}) AS tp, sum(n) OVER ({part}) AS tn
            FROM (SELECT {lead}{p} AS p, count(*) AS n, sum({y}) AS pos FROM {source} WHERE {y} IS NOT NULL GROUP BY {lead}{p})){grp}"""


def with_ctes(*names_and_body: str) -> str:
    """WITH clause of every role the body or another role mentions, followed by the body."""
    body = names_and_body[-1]
    extra = list(names_and_body[:-1])
    need: list[str] = []

    def visit(text: str):
        for name in CTE:
            if re.search(rf"\b{name}\b", text) and name not in need:
                visit_name(name)

    def visit_name(name: str):
        if name in need:
            return
        pending = [n for n in CTE if n != name and re.search(rf"\b{n}\b", CTE[name])]
        for n in pending:
            visit_name(n)
        if name not in need:
            need.append(name)

    for e in extra:
        visit_name(e)
    visit(body)
    parts = [f"{n} AS ({CTE[n]})" for n in need]
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body, re.I)
    if m and parts:
        return f"WITH {m.group(1) or ''}" + ",\n".join(parts) + ",\n" + body[m.end():]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
