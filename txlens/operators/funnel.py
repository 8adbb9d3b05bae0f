"""Journal funnels, drop buckets, clusters and readiness reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txlens.functions.numbers import beside, count_if, int_mean, ratio, sum_if
from txlens.functions.ordstat import index_percentiles, with_previous

# Fixed values
UNIT_LIMIT = 400_000
UNIT_PRICE = 800_000
SIGNATURE_FEE = 5_000
PRIORITY_UNIT = 150_000
SAFETY = 50_000
TWO_HOP_FAMILIES = (0, 5)
CORPUS_CLEAN, CORPUS_MULTI = 10, 1


def fee_hurdle(limit=UNIT_LIMIT, price=UNIT_PRICE) -> Column:
    """Requested units at their price, rounded down, plus signature, priority unit and safety."""
    lim = F.lit(limit) if isinstance(limit, int) else limit
    onchain = F.floor(lim.cast("bigint") * F.lit(price) / 1_000_000).cast("bigint") + SIGNATURE_FEE
    return onchain + PRIORITY_UNIT + SAFETY


STAGES = ("framed", "known", "routed", "searchable", "gross_pos", "cap_hurdle", "synced", "age32", "exec", "race", "mut_fresh")


def gate_stages() -> dict[str, Column]:
    """Nested stages of a gate row; `gross_pos` and `mut_fresh` are side branches that do not filter what follows."""
    yes = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    s = {"framed": F.lit(True), "known": yes("known")}
    s["routed"] = s["known"] & yes("routed")
    s["searchable"] = s["routed"] & yes("searchable")
    s["gross_pos"] = s["searchable"] & yes("gross_pos")
    s["cap_hurdle"] = s["searchable"] & yes("cap_hurdle")
    s["synced"] = s["cap_hurdle"] & yes("synced_all")
    s["mut_fresh"] = s["synced"] & yes("mut_ok_all")
    s["age32"] = s["synced"] & yes("age32_all")
    s["exec"] = s["age32"] & yes("exec_fam")
    s["race"] = s["exec"] & yes("race_ready")
    return {k: s[k] for k in STAGES}


def stage_sums(df: DataFrame, stages: dict[str, Column], value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, sum, whole mean and maximum per stage, in one pass; empty stages show zeros."""
    aggs = []
    for name, cond in stages.items():
        v = F.when(cond, F.col(value))
        aggs += [count_if(cond).alias(f"n_{name}"), F.coalesce(F.sum(v), F.lit(0)).alias(f"s_{name}"),
                 F.greatest(F.coalesce(F.max(v), F.lit(0)), F.lit(0)).alias(f"m_{name}")]
    one = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(n).alias("stage"), F.col(f"n_{n}").alias("n"),
                              F.col(f"s_{n}").alias("gross_sum"), F.col(f"m_{n}").alias("gross_max")) for i, n in enumerate(stages)])
    out = one.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    return out.withColumn("gross_avg", int_mean("gross_sum", "n"))


def gate_funnel(gates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    value = F.coalesce(F.when(F.col("cap_gross") != 0, F.col("cap_gross")), F.col("gross"), F.lit(0))
    return stage_sums(gates.withColumn("_g", value), gate_stages(), "_g", by)


def verdict(stages: DataFrame) -> DataFrame:
    """One word on where the funnel is starved, from the stage counts."""
    n = {s: F.max(F.when(F.col("stage") == s, F.col("n"))) for s in STAGES}
    one = stages.agg(*[c.alias(s) for s, c in n.items()])
    c = {s: F.col(s) for s in STAGES}
    starved = (c["cap_hurdle"] > 0) & (c["age32"] == 0)
    quarter = F.greatest(F.lit(1), F.floor(c["cap_hurdle"] / 4))
    text = (F.when(c["framed"] == 0, "NO_DATA")
            .when((c["searchable"] * 20 < c["framed"]) & (c["cap_hurdle"] == 0), "A_SEARCH")
            .when(starved & (c["mut_fresh"] >= quarter), "B_FRESHNESS").when(starved & (c["mut_fresh"] == 0), "B_STATE")
            .when(((c["age32"] > 0) | (c["mut_fresh"] > 0)) & (c["exec"] == 0) & (c["race"] == 0), "C_EXECUTION")
            .when(c["race"] > 0, "SEND_PATH").otherwise("MIXED"))
    return one.select(text.alias("verdict"), "framed", "cap_hurdle", "age32", "race")


def searchable_groups(rows: DataFrame, hurdle: int) -> DataFrame:
    """Per (sequence, hops, bucket): counts, fresh and raceable counts, whole averages, maxima and share of all rows."""
    fresh, cap = F.col("fresh_ok"), F.col("cap_ok")
    g = rows.groupBy("seq", "n_hop", "bucket").agg(
        F.count(F.lit(1)).alias("searchable_n"), count_if(fresh).alias("fresh_n"), count_if(cap).alias("cap_ok_n"),
        count_if(cap & fresh).alias("cap_ok_and_fresh_n"), count_if(cap & fresh & (F.col("cap_gross") > hurdle)).alias("raceable_n"),
        count_if(F.col("sendable")).alias("sendable_n"), F.sum("age_slots").alias("_as"), F.count("age_slots").alias("_an"),
        sum_if(fresh, "gross").alias("_gf"), F.coalesce(F.max(F.when(fresh, F.col("gross"))), F.lit(0)).alias("gross_fresh_max"),
        sum_if(fresh, "cap_gross").alias("_cf"), F.coalesce(F.max(F.when(fresh, F.col("cap_gross"))), F.lit(0)).alias("cap_gross_fresh_max"),
        F.sum("cap_gross").alias("_cg"), F.max("cap_gross").alias("cap_gross_max"))
    total = g.agg(F.sum("searchable_n").alias("_t"))  # one row
    out = beside(g, total)
    return out.select("seq", "n_hop", "bucket", "searchable_n", (100.0 * F.col("searchable_n") / F.col("_t")).alias("pct"), "fresh_n", "cap_ok_n",
                      "cap_ok_and_fresh_n", "raceable_n", "sendable_n", F.when(F.col("_an") > 0, F.floor(F.col("_as") / F.col("_an"))).alias("age_avg"),
                      int_mean("_gf", "fresh_n").alias("gross_fresh_avg"), "gross_fresh_max", int_mean("_cf", "fresh_n").alias("cap_gross_fresh_avg"),
                      "cap_gross_fresh_max", int_mean("_cg", "searchable_n").alias("cap_gross_avg"), "cap_gross_max")


def gate_to_opp(gates: DataFrame, opps: DataFrame) -> DataFrame:
    """Each gate with one journal row of its (pool, slot): an exact one if there is any, else the first."""
    rest = [c for c in opps.columns if c not in ("pool_idx", "slot")]
    best = opps.groupBy("pool_idx", "slot").agg(
        F.min_by(F.struct(*rest), F.struct((~F.col("exact")).cast("int"), F.col("line"))).alias("opp"))
    return gates.join(best, ["pool_idx", "slot"], "left")


def shape_ok(family: Column, hops: Column, seq: Column, allowed: Sequence[str]) -> Column:
    """A named sequence must be allowed; without a name, a two-hop family with fewer than three hops."""
    named = seq.isNotNull() & (seq != "")
    plain = F.coalesce(family.isin(*TWO_HOP_FAMILIES), F.lit(False)) & (F.coalesce(hops, F.lit(0)) < 3)
    return F.when(named, seq.isin(*allowed)).otherwise(plain)


def send_bucket(shape: Column, hurdle: int) -> Column:
    """One drop bucket per opportunity, first failing check in fixed order."""
    c = F.col
    return (F.when(~shape, "not_executable").when(~c("framed"), "not_framed").when(~c("exact"), "ix_only")
            .when(~c("ready_file"), "ready_file_missing").when(c("plane_pool").isNull(), "plane_miss").when(c("ambiguous"), "ambiguous_pool")
            .when(~c("plane_ready"), "plane_not_race_ready").when(~F.coalesce(c("direction").isin(0, 1), F.lit(False)), "bad_direction")
            .when(c("cooling"), "cooldown").when(~c("cap_ok"), "cap_not_ok").when(c("cap_gross") <= hurdle, "below_hurdle").otherwise("would_fire"))


def lifetime_funnel(rows: DataFrame, hurdle: int) -> DataFrame:
    """Untimed totals over six journal kinds in one pass."""
    k = F.col("kind")
    s = k == "opp_searchable"
    cap = s & F.col("cap_ok")
    drop = k == "fresh_drop"
    return rows.agg(
        count_if((k == "frame") & (F.col("class") == "framed")).alias("framed"), count_if(k == "framed_pool").alias("known_pool"),
        count_if(k == "unknown_pool").alias("unknown_pool"), count_if(s).alias("searchable"),
        count_if(s & (F.col("gross") > 0)).alias("gross_pos"), sum_if(s & (F.col("gross") > 0), "gross").alias("gross_sum"),
        F.coalesce(F.max(F.when(s, F.col("gross"))), F.lit(0)).alias("gross_max"), count_if(cap).alias("cap_ok"),
        sum_if(cap, "cap_gross").alias("cap_sum"), F.coalesce(F.max(F.when(cap, F.col("cap_gross"))), F.lit(0)).alias("cap_max"),
        count_if(cap & (F.col("cap_gross") > hurdle)).alias("above_hurdle"), count_if(s & F.col("sendable")).alias("sendable"),
        count_if(s & F.col("fresh_ok")).alias("fresh"), sum_if(s & F.col("fresh_ok"), "cap_gross").alias("fresh_sum"),
        count_if(k == "opp_synced").alias("synced_rows"), count_if(drop).alias("drops"), count_if(drop & ~F.col("fresh_ok")).alias("drop_age"),
        count_if(drop & F.col("sendable")).alias("drop_mut_ok"))


def reserve_class() -> Column:
    """Failure class of a reserve-type state row: predicted against published reserves, in fixed order."""
    c = F.col
    differs = (c("pred_base") != c("pub_base")) | (c("pred_quote") != c("pub_quote"))
    pub_same = (c("before_base") == c("pub_base")) & (c("before_quote") == c("pub_quote"))
    pred_same = (c("before_base") == c("pred_base")) & (c("before_quote") == c("pred_quote"))
    both = c("pred_base").isNotNull() & c("pub_base").isNotNull()
    f = lambda x: F.coalesce(x, F.lit(False))
    return (F.when(c("bucket") == "wrong_transaction_association", "wrong_tx_association")
            .when(c("bucket") == "trigger_decode_error", "decode_apply_bug")
            .when(c("bucket").isin("fork_order", "publication_incomplete", "missing_transaction_local_write", "state_missing"), "publication_ordering")
            .when((F.coalesce(c("virtual_quote"), F.lit(0)) == 0) & both & f(differs) & ~f(pub_same), "virtual_reserve_config")
            .when(c("vault_staged") & f(pub_same) & ~f(pred_same), "vault_mismatch")
            .when(F.array_contains("fields", "reserves") | (both & f(differs)), "reserve_mismatch").otherwise("other"))


def bins_class() -> Column:
    """Failure class of a bin-type state row; `touched` are predicted bins, `published` the map of published ones."""
    c = F.col
    missing = F.exists("touched", lambda t: ~F.array_contains(F.map_keys(c("published")), t["id"]))
    moved = F.exists("touched", lambda t: F.coalesce(F.element_at(c("published"), t["id"]) != t["x"], F.lit(False)))
    fields = c("fields")
    only_fee = F.size(F.array_except(fields, F.array(F.lit("volatility"), F.lit("fee_state")))) == 0
    return (F.when(c("bucket") == "wrong_transaction_association", "wrong_tx_association")
            .when(c("bucket").isin("fork_order", "publication_incomplete", "missing_transaction_local_write"), "publication_ordering")
            .when((c("bucket") == "bin_traversal_account_coverage") | missing, "missing_bin")
            .when(F.array_contains(fields, "active_id"), "active_id")
            .when(only_fee | (c("bucket") == "fee_volatility_timing"), "volatility")
            .when(moved | F.array_contains(fields, "bin_liquidity"), "order_inventory_related")
            .when(c("bucket") == "state_missing", "publication_ordering").otherwise("other"))


def clusters(df: DataFrame, keys: Sequence[str], order: str, example: Sequence[str], n: int | None = 20) -> DataFrame:
    """Size and first example of every cluster, largest first."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*example), F.col(order)).alias("ex")).select(
        *keys, "n", *[F.col(f"ex.{e}").alias(f"first_{e}") for e in example])
    return g.orderBy(F.desc("n"), *keys).limit(n) if n else g


def causes(df: DataFrame) -> DataFrame:
    """Counts per cause and discriminator with a subtotal per cause (null discriminator) and the first example."""
    return df.rollup("cause", "disc").agg(F.count(F.lit(1)).alias("n"), F.min_by("sig", "line").alias("example"), F.grouping_id().alias("level"))


def compare_class() -> Column:
    """clean / interleave / stale_after / apply_fail / model_mismatch / mismatch from compared fields."""
    c = F.col
    event_match = (c("pred_out") == c("event_out")) & (c("pred_fee") == c("event_fee")) & ~c("mis_active")
    model = c("mis_fee") | c("mis_out") | c("mis_active") | c("mis_vol")
    return (F.when(F.coalesce(c("after_active") != c("event_end"), F.lit(False)), "stale_after").when(c("rc") == 2, "apply_fail")
            .when(c("rc") == 0, "clean").when(F.coalesce(event_match, F.lit(False)) & c("mis_bin"), "interleave")
            .when(c("mis_untouched_bin"), "interleave").when(~model & c("mis_bin"), "interleave").when(model, "model_mismatch").otherwise("mismatch"))


def compare_tally(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("walk") >= 1).alias("multi_step"))


def corpus_gate(tally: DataFrame) -> DataFrame:
    clean = F.col("status") == "clean"
    one = tally.agg(sum_if(clean, "n").alias("clean"), sum_if(clean, "multi_step").alias("clean_multi"))
    return one.withColumn("open", (F.col("clean") >= CORPUS_CLEAN) & (F.col("clean_multi") >= CORPUS_MULTI))


def trigger_stage() -> Column:
    c = F.col
    return (F.when(~c("has_bytes"), "no_bytes").when(c("frame") != "framed", c("frame")).when(c("direct"), "direct_exact")
            .when(c("watch_hits") > 0, "relevant_unknown").when(c("table_miss"), "alt_miss").otherwise("unrecoverable"))


def first_failing(checks: Sequence[str]) -> Column:
    out = F.lit("ok")
    for name in reversed(list(checks)):
        out = F.when(~F.col(name), name).otherwise(out)
    return out


def readiness(routes: DataFrame, checks: Sequence[str]) -> DataFrame:
    """Pass count per check and failures attributed to the first failing check."""
    g = routes.withColumn("_f", first_failing(checks)).agg(
        F.count(F.lit(1)).alias("n"), *[count_if(F.col(c)).alias(f"p_{c}") for c in checks], *[count_if(F.col("_f") == c).alias(f"f_{c}") for c in checks])
    rows = F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"p_{c}").alias("passed"), F.col(f"f_{c}").alias("first_failure")) for c in checks])
    return g.select("n", F.explode(rows).alias("r")).select("r.*", F.col("n").alias("routes"))


def kind_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), *[count_if(F.col(f)).alias(f"n_{f}") for f in flags])


def hurdle_table(seqs: DataFrame) -> DataFrame:
    """Per sequence: limit = units x 12 / 10 rounded down, chain fee, smallest gross, measured or estimated units."""
    used = F.coalesce(F.when(F.col("measured") > 0, F.col("measured")), F.col("estimate")).cast("bigint")
    lim = F.floor(used * 12 / 10).cast("bigint")
    fee = F.floor(lim * UNIT_PRICE / 1_000_000).cast("bigint") + SIGNATURE_FEE
    src = F.when(F.coalesce(F.col("measured"), F.lit(0)) > 0, "measured").otherwise("estimate")
    return seqs.select("seq", used.alias("units"), lim.alias("unit_limit"), fee.alias("chain_fee"), (fee + PRIORITY_UNIT + SAFETY).alias("min_gross"), src.alias("source"))


def profit_distribution(df: DataFrame, value: str) -> DataFrame:
    p = index_percentiles(df, value, {"p50": 0.5, "p90": 0.9})
    bands = df.agg(count_if(F.col(value) < 0.01).alias("tiny"), count_if((F.col(value) >= 0.01) & (F.col(value) < 1)).alias("mid"),
                   count_if(F.col(value) >= 1).alias("big"))
    return beside(p.select("n", "p50", "p90", "max_value"), bands)


def top_n(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *by).limit(n)


def counter_health(snaps: DataFrame, max_age: int) -> DataFrame:
    """Alive only when a counter moved since the process's previous snapshot and the heartbeat is young."""
    snaps = with_previous(snaps, ["proc"], "line", ["updates", "stream_slot"])
    moving = F.coalesce((F.col("prev_updates") != F.col("updates")) | (F.col("prev_stream_slot") != F.col("stream_slot")), F.lit(True))
    young = F.col("hb_age") <= max_age
    status = (F.when(young & moving, "ok").when(young & ~F.col("metrics_ok"), "metrics_dead").when(young, "counters_frozen").otherwise("heartbeat_dead"))
    return snaps.withColumn("status", status)


def share_table(df: DataFrame, key: str) -> DataFrame:
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return beside(g, g.agg(F.sum("n").alias("_t"))).select(key, "n", ratio("n", "_t").alias("share"))


def contract(gates: DataFrame, mismatches: DataFrame, hurdle: int | None = None, ready_pools: DataFrame | None = None) -> DataFrame:
    """Checklist per candidate (`would_send_new`): hops synced, not updating, no unresolved mismatch of its pool, a ready
    generation, a quote above the hurdle, ready to race; `open` when all hold.

    `gates` has the columns of the gate journal; `mismatches`: (pool_idx) still unresolved; `ready_pools`: (pool_idx) that can
    be raced besides the executable family. A missing value fails its check.
    """
    true = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False))
    limit = fee_hurdle() if hurdle is None else F.lit(hurdle)
    x = gates.where(true("would_send_new")).join(mismatches.select("pool_idx", F.lit(True).alias("_m")).distinct(), "pool_idx", "left")
    ready = true("exec_fam")
    if ready_pools is not None:
        x = x.join(ready_pools.select("pool_idx", F.lit(True).alias("_r")).distinct(), "pool_idx", "left")
        ready = ready | F.col("_r").isNotNull()
    checks = {"hops_synced": true("synced_all") & F.coalesce(F.col("n_sync") == F.col("n_hop"), F.lit(False)), "not_updating": ~true("updating"), "no_mismatch": F.col("_m").isNull(),
              "generation_ok": F.coalesce(F.col("state_gen") > 0, F.lit(False)) & true("s007_ready"), "quote_ok": F.coalesce(F.col("cap_gross") > limit, F.lit(False)), "ready": ready}
    out = x.select(*gates.columns, *[c.alias(n) for n, c in checks.items()])
    return out.withColumn("open", F.expr(" AND ".join(checks)))


def addressable(rows: DataFrame, classes: DataFrame, key: str = "pool") -> DataFrame:
    """Coverage of what could be addressed: known addressable rows over addressable ones; rows whose pool has no class are
    counted, but are in no denominator of the coverage.

    `classes`: (pool, cls, compiled), one row per pool; `cls` is `compatible` or anything else.
    """
    x = rows.join(classes.select(key, "cls", "compiled"), key, "left")
    ok = F.col("cls") == "compatible"
    g = x.agg(F.count(F.lit(1)).alias("all_n"), count_if(ok).alias("addressable"), count_if(ok & F.col("compiled")).alias("known_addressable"),
              count_if(F.col("cls").isNotNull() & ~ok).alias("incompatible"), count_if(F.col("cls").isNull()).alias("unclassified"))
    share = lambda a, b: 100.0 * ratio(a, b)
    return g.select("*", share("known_addressable", "addressable").alias("coverage_pct"), share("addressable", "all_n").alias("share_pct"))


def first_kill(events: DataFrame) -> DataFrame:
    """Pools by the return code of their first change from exact to dirty, in log order.

    `events`: (pool, seq, rc, before, after), grades in capitals. Each task hands on one row per pool.
    """
    killed = events.where((F.col("before") == "EXACT") & (F.col("after") == "DIRTY"))
    first = killed.groupBy("pool").agg(F.min_by("rc", "seq").alias("rc"))
    return first.groupBy("rc").agg(F.count(F.lit(1)).alias("pools"))


def kill_gap(events: DataFrame, kill_rc: str, gap_rc: str) -> DataFrame:
    """Per pool in log order: events, first kill with this return code, first gap, and gaps after that kill.

    Events meet one row per pool with its kill, and are counted in the tasks that hold them.
    """
    kill = events.where((F.col("before") == "EXACT") & (F.col("after") == "DIRTY") & (F.col("rc") == kill_rc)).groupBy("pool").agg(F.min("seq").alias("kill_seq"))
    gap = F.col("rc") == gap_rc
    x = events.join(kill, "pool", "left")
    return x.groupBy("pool").agg(F.count(F.lit(1)).alias("events"), F.max("kill_seq").alias("kill_seq"), F.min(F.when(gap, F.col("seq"))).alias("first_gap"),
                                 count_if(gap & (F.col("seq") > F.col("kill_seq"))).alias("gaps_after"))
