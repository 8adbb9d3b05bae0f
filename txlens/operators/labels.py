"""Trigger rows to labels, pack eligibility and coverage, and (transaction, pack) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from txlens.functions import bits, ordstat
from txlens.functions.numbers import beside, count_if

KEY = ["program", "family", "layer", "base"]
LIVE_LAYER = "TOP_LEVEL"


def packed_routes(df: DataFrame, key: str = "tx_id", packed: str = "routes") -> DataFrame:
    """Occurrence rows with a comma list to one row per (occurrence, route), empty entries dropped."""
    parts = F.filter(F.split(packed, ","), lambda x: x != "")
    return df.select(key, F.explode(parts).alias("route"))


def label_of(n_pos, n_neg, n_unknown_with_base) -> Column:
    """Positive wins; negative needs a negative row and no unknown row that has a base; else unknown."""
    return (F.when(n_pos > 0, "POSITIVE").when((n_neg > 0) & (n_unknown_with_base == 0), "CERTIFIED_NEGATIVE")
            .otherwise("UNKNOWN"))


def target_of(label: Column) -> Column:
    """1, 0, and null for unknown: never 0."""
    return F.when(label == "POSITIVE", 1).when(label == "CERTIFIED_NEGATIVE", 0)


def _joined_distinct(value: Column, sep: str = "|") -> Column:
    """Sorted distinct values in one text. The set is as small as the column's own vocabulary."""
    return F.array_join(F.array_sort(F.collect_set(value)), sep)


def tx_labels(trig: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """One row per transaction from its trigger rows; `routes` is (tx_id, route) of its positive occurrences."""
    s = F.col("status")
    per_tx = trig.groupBy("tx_id").agg(
        count_if(s == "POSITIVE").alias("n_pos"), count_if(s == "CERTIFIED_NEGATIVE").alias("n_neg"),
        count_if((s == "UNKNOWN") & (F.col("base") != "")).alias("_unk_base"),
        F.count(F.lit(1)).alias("n_occurrences"),
        *[count_if(F.col("layer") == layer).alias(f"n_{layer.lower()}") for layer in ("TOP_LEVEL", "INNER", "ATTRIBUTED")],
        _joined_distinct(F.when(s == "UNKNOWN", F.col("reason"))).alias("unknown_reasons"),
        _joined_distinct(F.when(F.col("quality") != "", F.col("quality"))).alias("label_quality"),
        F.max("profit").alias("best_profit"))
    label = label_of(F.col("n_pos"), F.col("n_neg"), F.col("_unk_base"))
    out = per_tx.withColumn("label", label).withColumn("target", target_of(F.col("label"))).drop("_unk_base")
    if routes is not None:
        r = routes.select("tx_id", "route").distinct().groupBy("tx_id").agg(
            F.count(F.lit(1)).alias("n_routes"), F.array_join(F.array_sort(F.collect_list("route")), ",").alias("profitable_routes"))
        out = out.join(r, "tx_id", "left").withColumn("n_routes", F.coalesce("n_routes", F.lit(0))).withColumn(
            "profitable_routes", F.coalesce("profitable_routes", F.lit("")))
    return out


def label_problems(trig: DataFrame, labels: DataFrame, positives: DataFrame) -> DataFrame:
    """Counts that must all be zero: identity columns that differ inside a transaction, positive rows that do not match
    the index of positives, routes on a transaction that is not positive."""
    rows = trig.groupBy("tx_id").agg(count_if(F.col("status") == "POSITIVE").alias("n"),
                                     (F.min("slot") != F.max("slot")).alias("mixed"))
    index = positives.groupBy("tx_id").agg(F.count(F.lit(1)).alias("m"))
    both = rows.join(index, "tx_id", "full_outer")
    a = both.agg(count_if(F.col("mixed")).alias("mixed_identity"),
                 count_if(F.coalesce("n", F.lit(0)) != F.coalesce("m", F.lit(0))).alias("count_mismatch"),
                 F.coalesce(F.sum("n"), F.lit(0)).alias("positive_rows"),
                 F.coalesce(F.sum("m"), F.lit(0)).alias("indexed_positives"))
    with_route = packed_routes(positives).select("tx_id").distinct()
    b = labels.where(F.col("label") != "POSITIVE").join(with_route, "tx_id", "left_semi").agg(
        F.count(F.lit(1)).alias("routes_without_positive"))
    return beside(a, b)


def label_summary(labels: DataFrame) -> DataFrame:
    """One row of totals; `labels` has the columns of tx_labels, cover columns, seen count and slot."""
    pos = F.col("label") == "POSITIVE"
    return labels.agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("n_occurrences").alias("trigger_rows"),
        F.sum("n_pos").alias("rows_positive"), F.sum("n_neg").alias("rows_negative"),
        F.sum(F.col("n_occurrences") - F.col("n_pos") - F.col("n_neg")).alias("rows_unknown"),
        count_if(pos).alias("tx_positive"), count_if(F.col("label") == "CERTIFIED_NEGATIVE").alias("tx_negative"),
        count_if(F.col("label") == "UNKNOWN").alias("tx_unknown"),
        count_if(pos & (F.col("n_eligible_live") > 0)).alias("positive_eligible_live"),
        count_if(pos & (F.col("n_eligible") > 0)).alias("positive_eligible"),
        count_if(pos & (F.col("n_covering_live") > 0)).alias("positive_covered_live"),
        count_if(pos & (F.col("n_covering") > 0)).alias("positive_covered"),
        count_if(pos & (F.col("n_seen_in_train") > 0)).alias("positive_seen_in_train"),
        F.min("slot").alias("slot_min"), F.max("slot").alias("slot_max"))


def masters(trig: DataFrame) -> DataFrame:
    return trig.select("tx_id", "slot").distinct()


def key_dictionary(trig: DataFrame) -> DataFrame:
    """Distinct four-part keys numbered from 0 in order of first transaction, then key text."""
    first = trig.groupBy(*KEY).agg(F.min("tx_id").alias("first_tx"))
    return ordstat.number_rows(first, "first_tx", KEY, "key_id")


def trigger_keys(trig: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Sorted key ids of each transaction."""
    keyed = trig.select("tx_id", *KEY).distinct().join(dictionary.select("key_id", *KEY), KEY)
    return keyed.groupBy("tx_id").agg(F.array_sort(F.collect_list("key_id")).alias("keys"))


def eligible_packs(trig: DataFrame, packs: DataFrame) -> DataFrame:
    """(tx_id, pack_id, rank, live): exact key match, or any base of the key when the row has no base.

    Two equality joins, so no base is ever matched by a loop; distinct because two rows may name one pack.
    """
    keys = trig.select("tx_id", *KEY).distinct()
    cat = packs.select(*KEY, "pack_id", F.col("rank").alias("pack_rank"), (F.col("layer") == LIVE_LAYER).alias("live"))
    exact = keys.where(F.col("base") != "").join(cat, KEY)
    loose = keys.where(F.col("base") == "").drop("base").join(cat.drop("base"), KEY[:3])
    cols = ["tx_id", "pack_id", "pack_rank", "live"]
    return exact.select(cols).unionByName(loose.select(cols)).distinct()


def covering(eligible: DataFrame, pack_routes: DataFrame, tx_routes: DataFrame) -> DataFrame:
    """Eligible pairs whose pack holds at least one profitable route of the transaction.

    Routes travel as one array per transaction and one per pack: no pair is expanded by routes, and the packs and routes of
    one transaction are never multiplied.
    """
    wanted = tx_routes.groupBy("tx_id").agg(F.collect_set("route").alias("_routes"))
    of_pack = pack_routes.groupBy("pack_id").agg(F.collect_set("route").alias("_of_pack"))
    both = eligible.join(wanted, "tx_id").join(of_pack, "pack_id")
    return both.where(F.arrays_overlap("_routes", "_of_pack")).select(*eligible.columns)


def cover_rank(eligible: DataFrame, cover: DataFrame) -> DataFrame:
    """Eligible and covering counts and the lowest covering catalog rank, over all layers and live only."""
    flagged = eligible.withColumn("c", F.lit(0)).unionByName(cover.withColumn("c", F.lit(1)))
    e, c, live = F.col("c") == 0, F.col("c") == 1, F.col("live")
    return flagged.groupBy("tx_id").agg(
        count_if(e).alias("n_eligible"), count_if(e & live).alias("n_eligible_live"),
        count_if(c).alias("n_covering"), count_if(c & live).alias("n_covering_live"),
        F.min(F.when(c, F.col("pack_rank"))).alias("min_cover_rank"),
        F.min(F.when(c & live, F.col("pack_rank"))).alias("min_cover_rank_live"))


def expand_pairs(labels: DataFrame, relevant: DataFrame, eligible: DataFrame, cover: DataFrame, depth: int,
                 ppm: int) -> DataFrame:
    """(transaction, pack) rows up to a catalog depth.

    Positives keep every layer; negatives keep live packs; unknown rows appear only when relevant and sampled, live
    packs only, and their target stays null.
    """
    base = labels.select("tx_id", "label").join(relevant.select("tx_id", "relevant"), "tx_id", "left")
    pos, neg = F.col("label") == "POSITIVE", F.col("label") == "CERTIFIED_NEGATIVE"
    keep_unknown = (F.col("label") == "UNKNOWN") & (F.col("relevant") == 1) & bits.sampled(F.col("tx_id"), ppm)
    pairs = (base.where(pos | neg | keep_unknown).join(eligible.where(F.col("pack_rank") < depth), "tx_id")
             .where(pos | F.col("live")))
    hit = cover.select("tx_id", "pack_id", F.lit(1).alias("_hit"))
    out = pairs.join(hit, ["tx_id", "pack_id"], "left")
    return out.select("tx_id", "pack_id", "pack_rank", "label",
                      F.when(pos | neg, F.coalesce("_hit", F.lit(0))).alias("pack_target"), F.col("live").alias("eligible_live"))


def eligible_hits(trig: DataFrame, packs: DataFrame, pack_routes: DataFrame, tx_routes: DataFrame) -> DataFrame:
    """The rows of `eligible_packs`, each with `hit`: does the pack hold a profitable route of the transaction?

    Routes travel as one array per transaction and one per pack, so no pair is expanded by routes.
    """
    wanted = tx_routes.groupBy("tx_id").agg(F.collect_set("route").alias("_routes"))
    keys = trig.select("tx_id", *KEY).distinct().join(wanted, "tx_id", "left")
    cat = packs.select(*KEY, "pack_id", F.col("rank").alias("pack_rank"), (F.col("layer") == LIVE_LAYER).alias("live"))
    cat = cat.join(pack_routes.groupBy("pack_id").agg(F.collect_set("route").alias("_of_pack")), "pack_id", "left")
    hit = F.coalesce(F.arrays_overlap("_routes", "_of_pack"), F.lit(False)).alias("hit")
    cols = ["tx_id", "pack_id", "pack_rank", "live", hit]
    exact = keys.where(F.col("base") != "").join(cat, KEY).select(*cols)
    loose = keys.where(F.col("base") == "").drop("base").join(cat.drop("base"), KEY[:3]).select(*cols)
    return exact.unionByName(loose).dropDuplicates(["tx_id", "pack_id"])


def pairs_of(labels: DataFrame, relevant: DataFrame, trig: DataFrame, packs: DataFrame, pack_routes: DataFrame, tx_routes: DataFrame, depth: int, ppm: int) -> DataFrame:
    """The rows of `expand_pairs` straight from their tables: catalog and transactions are cut down before they meet.

    Packs beyond the depth and transactions that give no rows go first. Keys, labels, gates and profitable routes all
    meet by transaction; the catalog, with the routes of a pack in an array, meets them by trigger key, and a pack is right
    when the two arrays share a route. Nothing is expanded by routes and no pair is looked at twice.
    """
    pos, neg = F.col("label") == "POSITIVE", F.col("label") == "CERTIFIED_NEGATIVE"
    keep_unknown = (F.col("label") == "UNKNOWN") & (F.col("relevant") == 1) & bits.sampled(F.col("tx_id"), ppm)
    wanted = tx_routes.groupBy("tx_id").agg(F.collect_set("route").alias("_routes"))
    base = labels.select("tx_id", "label").join(relevant.select("tx_id", "relevant"), "tx_id", "left").where(pos | neg | keep_unknown)
    base = base.join(wanted, "tx_id", "left").select("tx_id", "label", "_routes")
    keys = trig.select("tx_id", *KEY).distinct().join(base, "tx_id")
    cat = packs.where(F.col("rank") < depth).select(*KEY, "pack_id", F.col("rank").alias("pack_rank"), (F.col("layer") == LIVE_LAYER).alias("live"))
    cat = cat.join(pack_routes.groupBy("pack_id").agg(F.collect_set("route").alias("_of_pack")), "pack_id", "left")
    exact = keys.where(F.col("base") != "").join(cat, KEY)
    loose = keys.where(F.col("base") == "").drop("base").join(cat.drop("base"), KEY[:3])
    hit = F.coalesce(F.arrays_overlap("_routes", "_of_pack").cast("int"), F.lit(0))
    cols = ["tx_id", "pack_id", "pack_rank", "label", F.when(pos | neg, hit).alias("pack_target"), F.col("live").alias("eligible_live")]
    # a row without a base may name a pack that another row names with it
    return exact.where(pos | F.col("live")).select(*cols).unionByName(loose.where(pos | F.col("live")).select(*cols)).dropDuplicates(["tx_id", "pack_id"])


def with_group(df: DataFrame) -> DataFrame:
    """`group`: the unknown reasons of an unknown row, else its label."""
    return df.withColumn("group", F.when(F.col("label") == "UNKNOWN", F.col("unknown_reasons")).otherwise(F.col("label")))


def with_target3(df: DataFrame) -> DataFrame:
    """1 positive, 0 certified negative or never labelled, null for the rest."""
    g = F.col("group")
    return df.withColumn("target3", F.when(g == "POSITIVE", 1).when(g.isin("CERTIFIED_NEGATIVE", "NO_LABEL"), 0))


def subsample(df: DataFrame, k: int = 8) -> DataFrame:
    """Training rows: never-labelled rows kept one in k by id with weight k, others with weight 1."""
    unlabelled = F.col("group") == "NO_LABEL"
    return df.where(~unlabelled | (F.pmod("tx_id", F.lit(k)) == 0)).withColumn(
        "w", F.when(unlabelled, F.lit(float(k))).otherwise(F.lit(1.0)))


def sample_weight(ppm: int) -> Column:
    """1 for labelled rows, 1e6/ppm for sampled unknown rows, 0 for the rest."""
    up = 1e6 / ppm if ppm > 0 else 0.0
    return F.when(F.col("target").isNotNull(), 1.0).when(F.col("pair_sample") == 1, up).otherwise(0.0)


def training_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("target").isNotNull() & (F.col("encode_status") == 0))


def library_support(routes: DataFrame, pack_routes: DataFrame) -> DataFrame:
    """First metadata row (lowest partition) of every wanted route, and a flag for routes without any row."""
    wanted = pack_routes.select("route").distinct()
    rest = [c for c in routes.columns if c not in ("route", "part")]
    first = routes.groupBy("route").agg(F.min_by(F.struct("part", *rest), F.struct("part", *rest)).alias("r"))
    return wanted.join(first, "route", "left").select(
        "route", "r.*", F.col("r").isNull().alias("missing"))


def train_routes(tx_routes: DataFrame, lo: int, hi: int) -> DataFrame:
    return tx_routes.where(F.col("tx_id").between(lo, hi)).select("route").distinct()


def distinct_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key: the first in a stated order."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
