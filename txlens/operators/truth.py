"""Feeds against truth, races, gaps, outcomes and decision follow-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from txlens.functions import ordstat
from txlens.functions.numbers import count_if, ratio, sum_if, wilson_bounds

# Fixed values
LEAD_LIMITS = ((20_000_000, ">20ms"), (10_000_000, "10-20ms"), (5_000_000, "5-10ms"), (2_000_000, "2-5ms"), (1_000_000, "1-2ms"),
               (500_000, "0.5-1ms"), (0, "0-0.5ms"))
LEAD_PERCENTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}
SEND_BUDGETS_US = (100, 250, 500, 1000, 2000, 5000, 10000)


def feed_compare(recon: DataFrame, truth: DataFrame, limit_slots: int = 0) -> DataFrame:
    """Rebuilt rows against truth by signature; a null on either side never counts as a mismatch.

    `limit_slots` keeps the first so many distinct rebuilt slots.
    """
    if limit_slots:
        last = recon.select("slot").distinct().orderBy("slot").limit(limit_slots).agg(F.max("slot").alias("_m"))  # one row
        recon = recon.join(F.broadcast(last), F.col("slot") <= F.col("_m")).drop("_m")
    r = recon.select("sig", *[F.col(c).alias(f"r_{c}") for c in ("slot", "idx", "version")], F.lit(1).alias("_r"))
    t = truth.select("sig", *[F.col(c).alias(f"t_{c}") for c in ("slot", "idx", "version")], F.lit(1).alias("_t"))
    j = t.join(r, "sig", "full_outer")
    both = F.col("_r").isNotNull() & F.col("_t").isNotNull()
    off = lambda c: both & F.coalesce(F.col(f"r_{c}") != F.col(f"t_{c}"), F.lit(False))
    return j.agg(F.count("_t").alias("truth"), F.count("_r").alias("recon"), count_if(both).alias("compared"), count_if(both & ~off("slot")).alias("slot_match"),
                 count_if(off("slot")).alias("slot_mismatch"), count_if(off("idx")).alias("index_mismatch"), count_if(off("version")).alias("version_mismatch"),
                 count_if(F.col("_t").isNotNull() & F.col("_r").isNull()).alias("truth_only"))


def first_arrivals(feed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return feed.groupBy("sig").agg(F.min("rx_ns").alias("rx_ns"), *[F.min_by(c, "rx_ns").alias(c) for c in keep])


def feed_race(a: DataFrame, b: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Per signature: lead = second feed's first arrival minus the first feed's; null when only one has it."""
    x = first_arrivals(a, keep).withColumnRenamed("rx_ns", "a_ns")
    y = first_arrivals(b).withColumnRenamed("rx_ns", "b_ns")
    lead = F.col("b_ns") - F.col("a_ns")
    first = (F.when(F.col("b_ns").isNull(), "a_only").when(F.col("a_ns").isNull(), "b_only").when(lead > 0, "a").when(lead < 0, "b").otherwise("tie"))
    return x.join(y, "sig", "full_outer").withColumn("lead_ns", lead).withColumn("first", first)


def race_summary(race: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """Lead percentiles and first counts of matched signatures per slice; slices may overlap."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in slices.items()]), lambda v: v.isNotNull())
    long = race.where(F.col("lead_ns").isNotNull()).select("lead_ns", F.explode(names).alias("slice"))
    p = ordstat.index_percentiles(long, "lead_ns", LEAD_PERCENTILES, ["slice"])
    wins = long.groupBy("slice").agg(count_if(F.col("lead_ns") > 0).alias("a_first"), count_if(F.col("lead_ns") < 0).alias("b_first"),
                                     count_if(F.col("lead_ns") == 0).alias("ties"))
    return p.join(wins, "slice")


def lead_bucket(ns) -> Column:
    size = F.abs(F.col(ns) if isinstance(ns, str) else ns)
    out = F.lit(LEAD_LIMITS[-1][1])
    for limit, name in reversed(LEAD_LIMITS):
        out = F.when(size > limit, name).otherwise(out)
    return out


def race_matrix(packets: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per (first source, late source): count, minimum, percentiles and maximum of the delay behind the first copy.

    The first copy is the one with the smallest receive time (a live table decides by arrival order instead, so there a
    delay can be negative). Joining back to one row per key lets a key with very many copies be split between tasks.
    """
    key = list(key)
    first = packets.groupBy(*key).agg(F.min(F.struct("rx_ns", "source_id", "seq")).alias("f"))
    late = packets.join(first, key).where(F.struct("rx_ns", "source_id", "seq") != F.col("f")).select(
        F.col("f.source_id").alias("first"), F.col("source_id").alias("late"), (F.col("rx_ns") - F.col("f.rx_ns")).alias("delta"))
    return ordstat.index_percentiles(late, "delta", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["first", "late"])


def first_counts(packets: DataFrame, key: Sequence[str]) -> DataFrame:
    f = packets.groupBy(*key).agg(F.min(F.struct("rx_ns", "source_id", "seq")).alias("f"), F.count(F.lit(1)).alias("_n"))
    return f.groupBy(F.col("f.source_id").alias("source_id")).agg(F.count(F.lit(1)).alias("first_n"), F.sum(F.col("_n") - 1).alias("copies_behind"))


def feed_counters(packets: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per source: received, bytes, malformed, first and late."""
    g = packets.groupBy("source_id").agg(F.count(F.lit(1)).alias("received"), F.sum("bytes").alias("bytes"), count_if(F.col("malformed")).alias("malformed"))
    ok = packets.where(~F.col("malformed"))
    first = first_counts(ok, key).select("source_id", "first_n")
    out = g.join(first, "source_id", "left").withColumn("first_n", F.coalesce("first_n", F.lit(0)))
    return out.withColumn("late_n", F.col("received") - F.col("malformed") - F.col("first_n"))


def slot_coverage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per slot: rows on each side, on both, on one only. Inputs are distinct (slot, sig)."""
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), ["slot", "sig"], "full_outer")
    return j.groupBy("slot").agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"),
                                 count_if(F.col("_b").isNull()).alias("a_only"), count_if(F.col("_a").isNull()).alias("b_only"))


def prefix_gap(rows: DataFrame) -> DataFrame:
    """Per slot: distinct indexes, whether index 0 is there, first hole.

    The indexes up to the first hole are those with as many smaller ones as their own value. The running count comes from
    range buckets, so a slot with very many rows is not one task.
    """
    d = rows.select("slot", "index").distinct()
    c = ordstat.counts(d, "index", ["slot"])
    run = F.col("cum_n") - 1 == F.col("index")
    return c.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), (F.min("index") == 0).alias("has_zero"), count_if(run).alias("first_hole"))


def gap_attribution(missing: DataFrame, prefix: DataFrame, repaired: DataFrame) -> DataFrame:
    """Missing rows: inside the data prefix, only inside the repaired prefix, or absent."""
    p = prefix.select("slot", F.col("first_hole").alias("_p"))
    r = repaired.select("slot", F.col("first_hole").alias("_r"))
    j = missing.join(p, "slot", "left").join(r, "slot", "left")
    cause = F.when(F.col("index") < F.col("_p"), "in_prefix").when(F.col("index") < F.col("_r"), "in_repaired_prefix").otherwise("absent")
    return j.select("slot", "index", cause.alias("cause"))


def loss_class() -> Column:
    c = F.col
    return (F.when(~c("slot_seen"), "slot_absent").when(~c("raw"), "bytes_absent").when(~c("recon"), "not_rebuilt").when(~c("verified"), "bad_signature").otherwise("ok"))


def loss_stage() -> Column:
    c = F.col
    return (F.when(~c("slot_seen") | ~c("raw"), "feed_missing").when(c("conflict"), "wrong_branch").when(~c("have0") | ~c("below_mark"), "prefix_gap")
            .when(c("recon") & c("verified") & ~c("idx_match"), "tx_parse").when(c("recon") & c("verified") & c("unresolved"), "classifier")
            .when(c("recon") & c("verified"), "ok").when(c("recon"), "tx_parse").when(c("slot_n") == 0, "entry_parse").otherwise("tx_parse"))


def wire_class() -> Column:
    c = F.col
    return (F.when(c("direct_a"), "direct_a").when(c("direct_b"), "direct_b").when(c("router"), "router").when(c("watched"), "watched")
            .when(c("unresolved"), "unresolved").otherwise("other"))


def outcome_class() -> Column:
    """From a left-joined status row: nothing found, landed, or landed with an error."""
    return F.when(F.col("status_slot").isNull(), "disappeared").when(F.col("err").isNull(), "landed-success").otherwise("landed-failed")


def resolve_keys(static: DataFrame, lookups: DataFrame, tables: DataFrame) -> DataFrame:
    """Account list of each transaction: static keys, then writable lookups in descriptor order, then read-only ones.

    `static`: (tx_id, pos, account); `lookups`: (tx_id, pos, idx, table, writable); `tables`: (table, idx, account).
    One missing entry voids the transaction. Repeated accounts stay.
    """
    l = lookups.join(tables.withColumnRenamed("account", "_acc"), ["table", "idx"], "left").select(
        "tx_id", F.when(F.col("writable"), 1).otherwise(2).alias("section"), "pos", "idx", F.col("_acc").alias("account"))
    s = static.select("tx_id", F.lit(0).alias("section"), "pos", F.lit(0).cast("bigint").alias("idx"), "account")
    u = s.unionByName(l)
    g = u.groupBy("tx_id").agg(F.bool_or(F.col("account").isNull()).alias("miss"), F.count(F.lit(1)).alias("n"),
                               F.array_sort(F.collect_list(F.struct("section", "pos", "idx", "account"))).alias("k"))
    keys = F.transform("k", lambda x: x["account"])
    return g.select("tx_id", (~F.col("miss")).alias("resolved"), F.when(~F.col("miss"), keys).alias("accounts"), F.when(~F.col("miss"), F.col("n")).alias("n_accounts"))


def later_arbs(decisions: DataFrame, rows: DataFrame, horizon: int) -> DataFrame:
    """First later successful transaction on the decision's pool that uses both programs, at most `horizon` slots later.

    `rows`: (tx_id, pool, slot, ok, both), in order of (slot, tx_id) on a pool. Slots are cut in chunks one longer than
    the horizon, so the answer lies in the decision's chunk or the next one: a window sees one chunk of one pool, and a
    join brings the first hit of the next.
    """
    hit = F.col("ok") & F.col("both")
    x = rows.select("tx_id", "pool", "slot", F.floor(F.col("slot") / (horizon + 1)).alias("chunk"), F.when(hit, F.struct("slot", "tx_id")).alias("h"))
    later = W.partitionBy("pool", "chunk").orderBy("slot", "tx_id").rowsBetween(1, W.unboundedFollowing)
    firsts = x.groupBy(F.col("pool").alias("_p"), (F.col("chunk") - 1).alias("_c")).agg(F.min("h").alias("_next"))
    x = x.withColumn("_own", F.min("h").over(later)).join(decisions.select("tx_id", "pool").distinct(), ["tx_id", "pool"], "left_semi")
    x = x.join(firsts, (F.col("pool") == F.col("_p")) & (F.col("chunk") == F.col("_c")), "left").withColumn("_h", F.coalesce("_own", "_next"))
    near = F.col("_h.slot") <= F.col("slot") + horizon
    return x.select("tx_id", "pool", F.when(near, F.col("_h.tx_id")).alias("later_tx"), F.when(near, F.col("_h.slot") == F.col("slot")).alias("same_slot"))


def horizon_confusion(rows: DataFrame) -> DataFrame:
    """Per (horizon, class): rows by outcome, commit share; per horizon precision if framed is sent and recall of landed.

    `rows`: (horizon, class, outcome).
    """
    o = F.col("outcome")
    g = rows.groupBy("horizon", "class").agg(F.count(F.lit(1)).alias("n"), count_if(o == "landed-success").alias("landed"), count_if(o == "landed-failed").alias("failed"),
                                             count_if(o == "disappeared").alias("gone"))
    framed = F.col("class") == "framed"
    t = g.groupBy("horizon").agg(sum_if(framed, "landed").alias("_tp"), sum_if(framed, F.col("gone") + F.col("failed")).alias("_fp"), F.sum("landed").alias("_all"))
    j = g.join(t, "horizon")
    return j.select("horizon", "class", "n", "landed", "failed", "gone", (100.0 * ratio(F.col("landed") + F.col("failed"), "n")).alias("commit_pct"),
                    (100.0 * ratio("_tp", F.col("_tp") + F.col("_fp"))).alias("precision_if_framed"), (100.0 * ratio("_tp", "_all")).alias("recall_of_landed"))


def horizons_long(frames: DataFrame, horizons: Sequence[str]) -> DataFrame:
    """Wide horizon columns (class and microseconds) to one row per horizon; missing cells are incomplete."""
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.coalesce(F.col(f"{h}_class"), F.lit("incomplete")).alias("class"), F.col(f"{h}_us").alias("us"))
                                for h in horizons]))
    rest = [c for c in frames.columns if not any(c in (f"{h}_class", f"{h}_us") for h in horizons)]
    return frames.select(*rest, cells.alias("c")).select(*rest, "c.*")


def latency_spans(long: DataFrame, by: Sequence[str]) -> DataFrame:
    return ordstat.index_percentiles(long, "ns", {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}, by)


def spans_long(df: DataFrame, spans: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    s = F.explode(F.array(*[F.struct(F.lit(n).alias("span"), c.alias("ns")) for n, c in spans.items()]))
    return df.select(*keep, s.alias("s")).select(*keep, "s.*").where(F.col("ns").isNotNull())


def attempt_summary(df: DataFrame) -> DataFrame:
    """By phase: errors, connections, landed, send percentiles (half-up index), counts within seven budgets, fees."""
    ok = (F.col("err") != "send_fail") & (F.col("send_ns") > 0)
    p = ordstat.index_percentiles(df.where(ok), "send_ns", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, ["phase"], "half").select(
        "phase", F.col("n").alias("ok_send"), "p50", "p90", "p99", F.col("min_value").alias("send_min"), F.col("max_value").alias("send_max"))
    g = df.groupBy("phase").agg(F.count(F.lit(1)).alias("attempts"), count_if(F.col("err") == "send_fail").alias("send_fail"), count_if(F.col("conn") == "reused").alias("reused"),
                                count_if(ok & F.col("landed")).alias("landed"), F.coalesce(F.sum("fee_lamports"), F.lit(0)).alias("fees"),
                                *[count_if(ok & (F.col("send_ns") <= us * 1000)).alias(f"le_{us}us") for us in SEND_BUDGETS_US])
    return g.join(p, "phase", "left")


def walk_join(walk: DataFrame, chain: DataFrame) -> DataFrame:
    """Local state walk beside chain balances: rows touched on chain, hidden touches, first divergences in order."""
    j = walk.join(chain, "sig", "left")
    touch = F.coalesce(F.col("touched"), F.lit(False))
    good = touch & F.coalesce(F.col("ok"), F.lit(False)) & F.col("chain_pre").isNotNull() & F.col("local_pre").isNotNull()
    pre = good & (F.col("local_pre") != F.col("chain_pre"))
    apply = (good & (F.col("local_pre") == F.col("chain_pre")) & F.col("local_post").isNotNull() & F.col("chain_post").isNotNull()
             & (F.col("local_post") - F.col("local_pre") != F.col("chain_post") - F.col("chain_pre")))
    first = lambda cond: F.min_by(F.struct("seq", "sig"), F.when(cond, F.col("seq")))
    return j.agg(count_if(touch).alias("touched_rows"), count_if(touch & F.col("lut_miss")).alias("hidden_touches"), count_if(pre).alias("pre_diverging"),
                 count_if(apply).alias("apply_diverging"), first(pre).alias("p"), first(apply).alias("a")).select(
        "touched_rows", "hidden_touches", "pre_diverging", "apply_diverging", F.col("p.seq").alias("first_pre_seq"), F.col("p.sig").alias("first_pre_sig"),
        F.col("a.seq").alias("first_apply_seq"), F.col("a.sig").alias("first_apply_sig"))


def ab_join(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old accepted rows against the first new row of the same signature: result histogram, missing ones as null."""
    first = new.groupBy("sig").agg(F.min_by("rc", "line").alias("new_rc"))
    return old.join(first, "sig", "left").groupBy("new_rc").agg(F.count(F.lit(1)).alias("n"))


def predict_check() -> Column:
    """Predicted reserves against post balances: failed, unseen, exact, within one basis point (bins only), mismatch."""
    c = F.col
    dx, dy = F.abs(c("pred_x") - c("post_x")), F.abs(c("pred_y") - c("post_y"))
    close = (dx * 10000 < F.greatest(c("post_x"), F.lit(1))) & (dy * 10000 < F.greatest(c("post_y"), F.lit(1)))
    return (F.when(c("failed"), "failed").when(c("post_x").isNull() | c("post_y").isNull(), "unseen").when((dx == 0) & (dy == 0), "exact")
            .when((c("pool_kind") == "bins") & close, "close").otherwise("mismatch"))


def vault_check(pre: DataFrame, post: DataFrame, events: DataFrame) -> DataFrame:
    """Per transaction the two vault identities: in-vault after = before + in - host fee; out-vault after = before - out.

    `pre`/`post`: (tx_id, role, amount) with roles vault_x, vault_y, host_fee; `events`: (tx_id, amount_in, amount_out,
    host_fee, x_to_y).
    """
    j = pre.withColumnRenamed("amount", "a0").join(post.withColumnRenamed("amount", "a1"), ["tx_id", "role"], "full_outer")
    side = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    g = j.groupBy("tx_id").agg(*[side(r, c).alias(f"{r}_{c}") for r in ("vault_x", "vault_y") for c in ("a0", "a1")],
                               F.bool_or((F.col("role") == "host_fee") & F.coalesce(F.col("a0") != F.col("a1"), F.lit(False))).alias("host_moved"))
    e = g.join(events, "tx_id", "left")
    fwd = F.col("x_to_y")
    pick = lambda a, b: F.when(fwd, F.col(a)).otherwise(F.col(b))
    in0, in1 = pick("vault_x_a0", "vault_y_a0"), pick("vault_x_a1", "vault_y_a1")
    out0, out1 = pick("vault_y_a0", "vault_x_a0"), pick("vault_y_a1", "vault_x_a1")
    return e.select("tx_id", F.col("amount_in").isNotNull().alias("has_event"), (in0 + F.col("amount_in") - F.coalesce("host_fee", F.lit(0)) == in1).alias("in_exact"),
                    (in1 - in0 == F.col("amount_in")).alias("in_delta_exact"), (out0 - F.col("amount_out") == out1).alias("out_exact"), "host_moved")


def slot_overlap(labels: DataFrame, feed: DataFrame, label_accounts: DataFrame, feed_accounts: DataFrame) -> DataFrame:
    """Labels whose slot lies in the feed's slot range, and of those the ones with any account in the feed."""
    span = feed.agg(F.min("slot").alias("_lo"), F.max("slot").alias("_hi"))  # one row
    inside = labels.join(F.broadcast(span), F.col("slot").between(F.col("_lo"), F.col("_hi")))
    seen = label_accounts.join(feed_accounts.select("account").distinct(), "account", "left_semi").select("tx_id").distinct().withColumn("_s", F.lit(1))
    return inside.join(seen, "tx_id", "left").agg(F.count(F.lit(1)).alias("in_range"), F.count("_s").alias("with_account"))


def six_way() -> Column:
    """Exactly one outcome per swap."""
    c = F.col
    return (F.when(c("tx_mismatch"), "TX_MISMATCH").when(c("table_miss"), "NO_LUT").when(~c("prestate"), "NO_PRESTATE").when(~c("published"), "FALLBACK")
            .when(c("post_equal").isNotNull() & ~c("post_equal"), "EXACT_MISMATCH").otherwise("EXACT_MATCH"))


def tables_to_fetch(misses: DataFrame, learned: DataFrame, bad: DataFrame, n: int = 16) -> DataFrame:
    """Missing tables that are neither learned nor known bad, in first-seen order, capped per round."""
    m = misses.groupBy("table").agg(F.min("seq").alias("first_seq"))
    return m.join(learned, "table", "left_anti").join(bad, "table", "left_anti").orderBy("first_seq", "table").limit(n)


def missing_from_walk(a: DataFrame, b: DataFrame, walk: DataFrame, lo: int, hi: int) -> DataFrame:
    """Two histories in (lo, hi], merged by signature; successful ones the walk does not have."""
    both = a.unionByName(b).where((F.col("slot") > lo) & (F.col("slot") <= hi)).dropDuplicates(["sig"])
    return both.where("ok").join(walk.select("sig"), "sig", "left_anti")


def watch_hits(keys: DataFrame, universe: DataFrame) -> DataFrame:
    """Hits per transaction on watched accounts; the universe is unpivoted to (account, pool, role) first."""
    roles = F.explode(F.array(*[F.struct(F.col(c).alias("account"), F.lit(c).alias("role")) for c in ("pool", "vault_x", "vault_y")]))
    idx = universe.select(F.col("pool").alias("owner"), roles.alias("r")).select("owner", "r.account", "r.role")
    h = keys.join(idx, "account")
    return h.groupBy("tx_id").agg(F.count(F.lit(1)).alias("hits"), count_if(F.col("role") == "pool").alias("pool_hits"), F.min("owner").alias("first_pool"))


def membership(rows: DataFrame, universe: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Share of rows whose pool is in the universe, and the n most frequent hits and misses."""
    freq = rows.groupBy("pool").agg(F.count(F.lit(1)).alias("n"))
    j = freq.join(universe.select("pool", F.lit(1).alias("_u")), "pool", "left").withColumn("hit", F.col("_u").isNotNull())
    total = j.agg(F.sum("n").alias("rows"), sum_if(F.col("hit"), "n").alias("hits"), F.count(F.lit(1)).alias("pools"), count_if(F.col("hit")).alias("pools_hit"))
    w = W.partitionBy("hit").orderBy(F.desc("n"), "pool")
    top = j.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("hit", "pool", "n")
    return total, top


def parity(a: DataFrame, b: DataFrame, key: str, by: str, columns: Sequence[str]) -> DataFrame:
    """Mismatches per column and transaction type between two versions of one feature table; null equals null."""
    x = a.select(key, by, *[F.col(c).alias(f"a_{c}") for c in columns])
    y = b.select(key, *[F.col(c).alias(f"b_{c}") for c in columns])
    g = x.join(y, key).groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *[count_if(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mismatches")) for c in columns]))
    return g.select(by, "rows", cells.alias("s")).select(by, "rows", "s.*")


def decision_truth(dec: DataFrame, realised: DataFrame, labels: DataFrame, hour: str = "hour") -> DataFrame:
    """Per hour: decisions, share with a realised trade, share labelled positive, value targeted, with intervals."""
    j = dec.join(realised, "tx_id", "left").join(labels, "tx_id", "left")
    g = j.groupBy(hour).agg(F.count(F.lit(1)).alias("decisions"), F.count("realised").alias("with_realised"), count_if(F.col("target") == 1).alias("positives"),
                            sum_if((F.col("target") == 1) & F.col("route_hit"), "best_profit").alias("value"))
    lo, hi = wilson_bounds("positives", "decisions")
    return g.select("*", ratio("with_realised", "decisions").alias("realised_share"), ratio("positives", "decisions").alias("positive_share"), lo.alias("positive_lo"), hi.alias("positive_hi"))


def drift(live: DataFrame, offline: DataFrame, columns: Sequence[str], limit: float = 0.10) -> DataFrame:
    """Live against offline deciles per feature, flagged when they differ by more than the limit."""
    qs = [i / 10 for i in range(1, 10)]

    def deciles(df, name):
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
        return ordstat.linear_quantiles(long, "v", qs, ["feature"]).withColumnRenamed("value", name)

    j = deciles(live, "live").join(deciles(offline, "offline"), ["feature", "q"])
    shift = F.abs(F.col("live") - F.col("offline")) / F.greatest(F.abs("offline"), F.lit(1e-9))
    return j.select("feature", "q", "live", "offline", (shift > limit).alias("shifted"))


def reference_hour(mev: DataFrame, events: DataFrame, by: str = "hour") -> DataFrame:
    """Size of the market beside what was seen live, per hour: all trades and the simple ones with their value, and live
    events by class; an hour without live events has null there.

    `mev`: (hour, value, simple); `events`: (hour, cls) with classes exact, unknown and others.
    """
    simple = F.coalesce(F.col("simple"), F.lit(False))
    h = mev.groupBy(by).agg(F.count(F.lit(1)).alias("all_n"), sum_if(F.lit(True), "value").alias("all_value"), count_if(simple).alias("two_n"), sum_if(simple, "value").alias("two_value"))
    known = F.col("cls").isin("exact", "unknown")
    e = events.groupBy(by).agg(count_if(F.col("cls") == "exact").alias("exact_n"), count_if(F.col("cls") == "unknown").alias("unknown_n"), count_if(~known | F.col("cls").isNull()).alias("other_n"))
    return h.join(e, by, "left")


def ab_causes(old: DataFrame, new: DataFrame, missing: Sequence[str]) -> DataFrame:
    """Causes of the old run beside those of the new one, what vanished of each, and which belong to the missing inputs.

    `old`, `new`: (cause), a row per occurrence; both sides are counted in one pass.
    """
    both = old.select("cause", F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select("cause", F.lit(0).alias("o"), F.lit(1).alias("n")))
    g = both.groupBy("cause").agg(F.sum("o").alias("old"), F.sum("n").alias("new"))
    return g.select("cause", "old", "new", (F.col("old") - F.col("new")).alias("vanished"), F.coalesce(F.col("cause").isin(*missing), F.lit(False)).alias("missing_cause"))
