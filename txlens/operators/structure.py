"""Structural features from decoded key and instruction rows, catalog features, and the tracked universe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from txlens.functions.numbers import count_if

# Fixed values
MARKET_ROLES = ("POOL_STATE", "VAULT", "TICK_ARRAY", "BIN_ARRAY", "BIN_BITMAP", "TICK_BITMAP", "OBSERVATION", "ORACLE")
LENGTH_CLASSES = (0, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024)
IX_SLOTS = 8


def data_len_class(length) -> Column:
    """0 for empty, then one class per doubling up to 1024 bytes, 11 above."""
    c = F.col(length) if isinstance(length, str) else length
    out = F.lit(len(LENGTH_CLASSES))
    for i, top in reversed(list(enumerate(LENGTH_CLASSES))):
        out = F.when(c <= top, i).otherwise(out)
    return out


def family_field(family, name: str) -> Column:
    """Number after a field name in a family text such as `prefix8:00ff:len28:accounts19`; 0 when absent."""
    c = F.col(family) if isinstance(family, str) else family
    return F.coalesce(F.try_to_number(F.regexp_extract(c, rf"(?:^|:){name}(\d+)(?=:|$)", 1), F.lit("999999999")).cast("bigint"), F.lit(0))


def tracked_universe(markets: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(account) of market-specific roles of known pools plus the pools themselves; (program) of the venues."""
    pools = markets.select("pool").distinct()
    accounts = (catalog.where(F.col("role").isin(*MARKET_ROLES) & (F.col("pubkey") != "")).join(pools, "pool", "left_semi")
                .select(F.col("pubkey").alias("account")))
    return accounts.unionByName(pools.select(F.col("pool").cast("string").alias("account"))).distinct(), markets.select("program").distinct()


def relevance(keys: DataFrame, accounts: DataFrame, programs: DataFrame) -> DataFrame:
    """Counts of tracked writable, tracked read-only and venue-program static keys; relevant when any is positive."""
    a = accounts.select("account", F.lit(1).alias("_a"))
    p = programs.select(F.col("program").alias("account"), F.lit(1).alias("_p"))
    j = keys.where("is_static").join(a, "account", "left").join(p, "account", "left")
    g = j.groupBy("tx_id").agg(count_if(F.col("_a").isNotNull() & F.col("writable")).alias("market_writable"),
                               count_if(F.col("_a").isNotNull() & ~F.col("writable")).alias("market_readonly"),
                               F.count("_p").alias("venue_program"))
    return g.withColumn("relevant", (F.col("market_writable") + F.col("market_readonly") + F.col("venue_program") > 0).cast("int"))


def gate(name: str) -> Column:
    """A gate over the counts of `relevance`: `relevant` (any of them), `writes` (a tracked account is writable), or
    `writes_or_program` (that, or a program of a venue is named). A missing count is no hit."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    found = {"relevant": F.coalesce(F.col("relevant") == 1, F.lit(False)), "writes": n("market_writable"), "writes_or_program": n("market_writable") | n("venue_program")}
    if name not in found:
        raise ValueError(name)
    return found[name]


GATES = ("relevant", "writes", "writes_or_program")


def extras(keys: DataFrame, ixs: DataFrame, pools: DataFrame, base: str) -> DataFrame:
    """Per transaction of `keys`: distinct known pools named at all, statically and writably, swaps and router calls with
    their largest amount, and whether the base account is among its keys.

    `keys`: (tx_id, account, is_static, writable); `ixs`: (tx_id, kind, amount) with kinds `swap` and `router`; `pools`: (pool).
    Lists are sorted and empty where nothing is named; amounts are 0 without a call.
    """
    known = pools.select(F.col("pool").cast("string").alias("account"), F.lit(True).alias("_p")).distinct()
    k = keys.withColumn("account", F.col("account").cast("string")).join(known, "account", "left")
    named = lambda c: F.array_sort(F.collect_set(F.when(F.col("_p") & c, F.col("account"))))
    per = k.groupBy("tx_id").agg(named(F.lit(True)).alias("pools_all"), named(F.col("is_static")).alias("pools_static"), named(F.col("writable")).alias("pools_writable"),
                                 F.max((F.col("account") == base).cast("int")).cast("boolean").alias("base_in_keys"))
    call = lambda kind: F.col("kind") == kind
    largest = lambda kind: F.coalesce(F.max(F.when(call(kind), F.col("amount"))), F.lit(0)).cast("bigint")
    calls = ixs.groupBy("tx_id").agg(count_if(call("swap")).alias("n_swaps"), largest("swap").alias("max_swap"), count_if(call("router")).alias("n_router"), largest("router").alias("max_router"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_swaps", "max_swap", "n_router", "max_router")]
    return per.join(calls, "tx_id", "left").select("tx_id", "pools_all", "pools_writable", "pools_static", *zero, F.coalesce("base_in_keys", F.lit(False)).alias("base_in_keys"))


def adjacent_share(ix_keys: DataFrame) -> DataFrame:
    """Per transaction: consecutive instructions that share an account, and that share a writable account.

    `ix_keys` has one row per (tx_id, pos, account) with `writable`; the join key includes the account and the position,
    so a long transaction spreads over tasks.
    """
    nxt = ix_keys.select("tx_id", (F.col("pos") - 1).alias("pos"), "account", F.col("writable").alias("_w"))
    pairs = ix_keys.join(nxt, ["tx_id", "pos", "account"])
    per = pairs.groupBy("tx_id", "pos").agg(F.max((F.col("writable") & F.col("_w")).cast("int")).alias("w"))
    return per.groupBy("tx_id").agg(F.count(F.lit(1)).alias("adjacent_shared"), F.sum("w").alias("adjacent_shared_writable"))


def tx_structure(ixs: DataFrame, ix_keys: DataFrame) -> DataFrame:
    """Instruction and account structure of a transaction."""
    a = ixs.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n_instructions"), F.sum("data_len").alias("data_sum"), F.max("data_len").alias("data_max"),
                                 F.min("data_len").alias("data_min"))
    progs = ixs.groupBy("tx_id", "prog").agg(F.count(F.lit(1)).alias("n")).groupBy("tx_id").agg(
        F.count(F.lit(1)).alias("n_programs"), count_if(F.col("n") > 1).alias("repeated_programs"))
    per_account = ix_keys.groupBy("tx_id", "account").agg(F.sum("uses").alias("u"), F.count(F.lit(1)).alias("k"))
    b = per_account.groupBy("tx_id").agg(F.sum("u").alias("account_uses"), F.count(F.lit(1)).alias("n_accounts"),
                                         count_if(F.col("u") > 1).alias("reused_accounts"), count_if(F.col("k") > 1).alias("accounts_in_several"))
    adj = adjacent_share(ix_keys)
    out = a.join(progs, "tx_id").join(b, "tx_id").join(adj, "tx_id", "left")
    return out.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c.startswith("adjacent") else F.col(c) for c in out.columns])


LAYER_ORDER = ("TOP_LEVEL", "INNER", "ATTRIBUTED")


def pack_structure(packs: DataFrame, pack_routes: DataFrame, legs: DataFrame, families: list[str], programs: list[str]) -> DataFrame:
    """Key and route structure of every pack: codes of its layer, program and family, the numbers in its family text, and the
    columns of `pack_features`; a pack without routes has 0 there.

    `packs`: (pack_id, program, family, layer). A layer that is not known has the next code after the known ones.
    """
    layer = F.lit(len(LAYER_ORDER))
    for i, name in enumerate(LAYER_ORDER):
        layer = F.when(F.col("layer") == name, i).otherwise(layer)
    key = packs.select("pack_id", layer.alias("layer_code"), name_code("program").alias("program_hash"), name_code("family").alias("family_hash"),
                       family_field("family", "prefix").alias("family_prefix_bytes"), family_field("family", "len").alias("family_data_len"), family_field("family", "accounts").alias("family_account_count"))
    routes = pack_features(pack_routes, legs, families, programs)
    counts = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in routes.columns if c != "pack_id"]
    return key.join(routes, "pack_id", "left").select(*key.columns, *counts)


def name_code(text) -> Column:
    """A name as a whole number: the first 60 bits of its SHA-256; null stays null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.conv(F.substring(F.sha2(c.cast("string"), 256), 1, 15), 16, 10).cast("bigint")


LANDING_HASHES = ["prog0", "prog1", "prog2", "prog_last", "prog_seq"]
LANDING_NUMBERS = ["version", "uses_tables", "n_tables", "n_static_keys", "n_keys", "n_signers", "n_writable", "n_instructions", "n_distinct_programs", "data_bytes", "max_ix_data", "raw_len",
                   "n_budget_ix", "unit_limit", "unit_price", "priority_fee", "tip", "has_tip", "n_transfers", "durable_nonce", "payer_only_signer", "n_pools", "n_pools_static",
                   "n_pools_writable", "n_swaps", "max_swap", "n_router", "max_router", "base_in_keys", "attempted_cycle", "entry_index", "tx_index"]


def landing_static(tx: DataFrame, keys: DataFrame, ixs: DataFrame, pools: DataFrame, base: str, cycles: DataFrame | None = None) -> DataFrame:
    """The static inputs of the landing model per transaction of `tx`: LANDING_NUMBERS, and LANDING_HASHES of its programs.

    `tx`: (tx_id, version, n_tables, n_signers, raw_len, durable_nonce, unit_limit, unit_price, entry_index, tx_index);
    `keys`: (tx_id, account, is_static, writable), one row per account; `ixs`: (tx_id, pos, prog, data_len, amount and the flags
    is_budget, is_transfer, is_tip, is_swap, is_router); `pools`: (pool); `cycles`: (tx_id) of transactions whose static pools
    close a cycle. What a transaction lacks is 0, a program it lacks has code 0. Programs are taken in order of position, the
    sequence leaves budget instructions out.
    """
    known = pools.select(F.col("pool").cast("string").alias("account"), F.lit(True).alias("_p")).distinct()
    k = keys.withColumn("account", F.col("account").cast("string")).join(known, "account", "left")
    p = F.coalesce("_p", F.lit(False))
    per_key = k.groupBy("tx_id").agg(
        F.count(F.lit(1)).alias("n_keys"), count_if(F.col("is_static")).alias("n_static_keys"), count_if(F.col("writable")).alias("n_writable"), count_if(p).alias("n_pools"),
        count_if(p & F.col("is_static")).alias("n_pools_static"), count_if(p & F.col("writable")).alias("n_pools_writable"), F.max((F.col("account") == base).cast("int")).alias("base_in_keys"))
    largest = lambda flag: F.max(F.when(F.col(flag), F.col("amount")))
    listed = F.array_sort(F.collect_list(F.struct("pos", F.col("prog").cast("string").alias("prog"), F.col("is_budget").alias("b"))))
    per_ix = ixs.groupBy("tx_id").agg(
        F.count(F.lit(1)).alias("n_instructions"), F.countDistinct("prog").alias("n_distinct_programs"), F.sum("data_len").alias("data_bytes"), F.max("data_len").alias("max_ix_data"),
        count_if(F.col("is_budget")).alias("n_budget_ix"), count_if(F.col("is_transfer")).alias("n_transfers"), F.sum(F.when(F.col("is_tip"), F.col("amount"))).alias("tip"),
        count_if(F.col("is_swap")).alias("n_swaps"), largest("is_swap").alias("max_swap"), count_if(F.col("is_router")).alias("n_router"), largest("is_router").alias("max_router"), listed.alias("_l"))
    named = F.transform("_l", lambda x: x["prog"])
    codes = {f"prog{i}": name_code(F.get(named, F.lit(i))) for i in range(3)}
    codes["prog_last"] = name_code(F.element_at(named, -1))
    codes["prog_seq"] = name_code(F.array_join(F.transform(F.filter("_l", lambda x: ~F.coalesce(x["b"], F.lit(False))), lambda x: x["prog"]), "|"))
    x = tx.join(per_key, "tx_id", "left").join(per_ix.withColumns(codes).drop("_l"), "tx_id", "left")
    if cycles is not None:
        x = x.join(cycles.select("tx_id", F.lit(1).alias("attempted_cycle")).distinct(), "tx_id", "left")
    else:
        x = x.withColumn("attempted_cycle", F.lit(0))
    zero = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(0))
    made = {"uses_tables": (zero("n_keys") > zero("n_static_keys")).cast("bigint"), "priority_fee": F.floor(zero("unit_limit") * zero("unit_price") / 1_000_000).cast("bigint"),
            "has_tip": (zero("tip") > 0).cast("bigint"), "payer_only_signer": (zero("n_signers") == 1).cast("bigint")}
    return x.select("tx_id", *[made.get(c, zero(c)).alias(c) for c in LANDING_NUMBERS + LANDING_HASHES])


def budget_rollup(ixs: DataFrame, kinds: tuple[str, ...] = ("limit", "price")) -> DataFrame:
    """Budget instructions of a transaction: count, first and last position, last well-formed value and repeats per kind.

    `ixs` are budget instructions with kind, value (null when malformed) and pos.
    """
    aggs = [F.count(F.lit(1)).alias("n_budget"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")]
    for k in kinds:
        good = (F.col("kind") == k) & F.col("value").isNotNull()
        aggs += [F.max_by(F.when(good, F.col("value")), F.when(good, F.col("pos"))).alias(f"{k}_value"),
                 (count_if(F.col("kind") == k) > 1).alias(f"{k}_repeated")]
    return ixs.groupBy("tx_id").agg(*aggs)


def ix_slots(ixs: DataFrame, columns: list[str], n: int = IX_SLOTS) -> DataFrame:
    """First n instructions in position order as columns ix0_*, ix1_* ...; zero where there is none."""
    w = W.partitionBy("tx_id").orderBy("pos")
    r = ixs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).withColumn("_r", F.col("_r") - 1)
    return r.groupBy("tx_id").agg(*[F.coalesce(F.max(F.when(F.col("_r") == i, F.col(c))), F.lit(0)).alias(f"ix{i}_{c}")
                                    for i in range(n) for c in columns])


def text_hash(c: Column) -> Column:
    """64-bit identity of a text as 16 hex digits."""
    return F.substring(F.sha2(c.cast("string"), 256), 1, 16)


def program_dictionary(ixs: DataFrame) -> DataFrame:
    d = ixs.select("prog").distinct()
    return d.select(text_hash(F.col("prog")).alias("program_hash"), "prog")


def program_hashes(ixs: DataFrame, budget: Column) -> DataFrame:
    """First three and last program of a transaction, and the joined sequence without budget instructions, as hashes."""
    seq = ixs.groupBy("tx_id").agg(F.array_sort(F.collect_list(F.struct("pos", "prog", budget.alias("b")))).alias("s"))
    names = F.transform("s", lambda x: x["prog"].cast("string"))
    kept = F.transform(F.filter("s", lambda x: ~x["b"]), lambda x: x["prog"].cast("string"))
    at = lambda i: F.get(names, F.lit(i))
    h = lambda c: F.when(c.isNotNull(), text_hash(c)).otherwise("0")
    return seq.select("tx_id", h(at(0)).alias("prog0"), h(at(1)).alias("prog1"), h(at(2)).alias("prog2"),
                      h(F.element_at(names, -1)).alias("prog_last"), text_hash(F.array_join(kept, "|")).alias("prog_seq"))


def pack_features(pack_routes: DataFrame, legs: DataFrame, families: list[str], programs: list[str]) -> DataFrame:
    """Hops, route counts by hops, distinct leg patterns, and legs by family and program of every pack.

    `legs`: (route, leg_no, family, program). A pattern is as long as its route, so routes of one pattern share a
    name, the smallest of theirs, and only that travels with the packs.
    """
    fam, prog = F.col("family"), F.col("program")
    route = legs.groupBy("route").agg(
        F.count(F.lit(1)).alias("hops"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leg_no", "family"))), lambda x: x["family"]), ">").alias("pattern"),
        *[count_if(fam == f).alias(f"f_{f}") for f in families], count_if(~fam.isin(*families)).alias("f_other"),
        *[count_if(prog == p).alias(f"p_{p}") for p in programs], count_if(~prog.isin(*programs)).alias("p_other"))
    alike = W.partitionBy("pattern")
    named = route.withColumn("pattern", F.sha2("pattern", 256)).withColumn("pattern", F.min("route").over(alike))
    j = pack_routes.join(named, "route")
    h = F.col("hops")
    legs_by = [c for c in named.columns if c.startswith(("f_", "p_"))]
    return j.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("route_count"), F.min(h).alias("hops_min"), F.max(h).alias("hops_max"), F.sum(h).alias("hops_sum"),
        count_if(h == 2).alias("routes_2hop"), count_if(h == 3).alias("routes_3hop"), count_if(h == 4).alias("routes_4hop"),
        count_if(h >= 5).alias("routes_5plus_hop"), F.countDistinct("pattern").alias("distinct_patterns"),
        *[F.sum(c).alias(f"legs_{c[2:] if c.startswith('f_') else c}") for c in legs_by])


def census(named: DataFrame, invoked: DataFrame, routed: DataFrame, min_invoked: int = 20) -> DataFrame:
    """Per key: transactions that invoke it, name it, or name it inside routed flow; only keys invoked often.

    All three inputs are distinct (tx_id, key); `routed` is distinct tx_id.
    """
    top = invoked.groupBy("key").agg(F.count(F.lit(1)).alias("top_level_txs")).where(F.col("top_level_txs") >= min_invoked)
    r = routed.withColumn("_r", F.lit(1))
    n = named.join(top.select("key"), "key", "left_semi").join(r, "tx_id", "left").groupBy("key").agg(
        F.count(F.lit(1)).alias("named_txs"), F.count("_r").alias("named_in_routed_txs"))
    return top.join(n, "key", "left").fillna(0)
