"""Prepared tables, weeks of partitions, slot parts, catalogs; and writing them."""

from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from txlens.functions.ordstat import carry_forward
from txlens.sources.kept import files

# Fixed values
HEAVY_COLUMNS = ("signature", "profitable_routes", "unknown_reasons", "label_quality")
ID_SHIFT = 40


def manifest_path(path: str) -> str:
    """Where the manifest of a table lies: beside it, in a folder that readers of tables skip."""
    parent, name = path.rstrip("/").rsplit("/", 1)
    return f"{parent}/_manifests/{name}"


def write_checked(df: DataFrame, path: str, key: str | None = None, inputs: dict | None = None) -> dict:
    """Write a table and what was seen of it on the way: rows, digests of ids and of whole rows, repeated ids, range of ids, files.

    Everything is collected by the tasks that write. With a key, rows are dealt by it, which also brings repeats together.
    The manifest is written last; a table without one is not whole.
    """
    spark, seen = df.sparkSession, Observation()
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    metrics = [F.count(F.lit(1)).alias("rows"), F.sum(row).alias("digest")]
    x = df
    if key:
        x = x.repartition(key).withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.lit(0))))
        metrics += [F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("ids"), F.sum((F.col("_n") > 1).cast("bigint")).alias("repeated"), F.min(key).alias("low"), F.max(key).alias("high"),
                    F.sum(F.col(key).isNull().cast("bigint")).alias("without_id")]
    x.observe(seen, *metrics).drop("_n").write.mode("overwrite").parquet(path)
    found = {k: str(v) if isinstance(v, Decimal) else v for k, v in seen.get.items()}
    found["rows"] = found["rows"] or 0
    # footers of the files; a task that ran twice would show here
    if spark.read.schema(df.schema).parquet(path).count() != found["rows"]:
        raise ValueError(f"{path} does not hold the rows that were written")
    text = json.dumps({**found, "key": key, "inputs": inputs or {}, "files": _files(spark, path)}, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(manifest_path(path))
    return json.loads(text)


def _files(spark: SparkSession, path: str) -> list:
    """Name and length of every file of a table, from listings alone."""
    return sorted([p.rsplit("/", 1)[1], n] for p, n, _ in files(spark, [path]))


def checked(spark: SparkSession, path: str, whole: bool = False) -> tuple[DataFrame, dict | None]:
    """A table and its manifest; a file that is missing, new or of another length is refused without reading any.

    `whole` reads all rows and compares digests too. A table that came without a manifest has none.
    """
    known = read_manifest(spark, manifest_path(path))
    if known is None:
        return spark.read.parquet(path), None
    if _files(spark, path) != [list(f) for f in known["files"]]:
        raise ValueError(f"{path} does not hold the files that were written")
    df = spark.read.parquet(path)
    if whole:
        now = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")).alias("d")).first()
        if now.n != known["rows"] or str(now.d) != str(known["digest"]):
            raise ValueError(f"{path} does not hold the rows that were written")
    return df, known


def scan_prepared(spark: SparkSession, root: str, key: str = "tx_id", check: bool = True) -> DataFrame:
    """Label and feature tables of one partition joined by id; fails when either side has rows the other lacks.

    Tables written by `write_checked` are compared by their manifests; others are compared by reading their ids.
    """
    (labels, a), (feats, b) = (checked(spark, f"{root}/{n}") for n in ("tx_labels", "tx_features"))
    if check and a and b:
        if any(m["key"] != key or m["repeated"] or m["without_id"] for m in (a, b)) or (a["rows"], a["ids"]) != (b["rows"], b["ids"]):
            raise ValueError("labels and features do not hold the same ids, each once")
    elif check:
        gap = (labels.join(feats.select(key), key, "left_anti").select(key).unionByName(feats.join(labels.select(key), key, "left_anti").select(key)).limit(1).collect())
        if gap:
            raise ValueError(f"labels and features do not hold the same ids, for example {gap[0][0]}")
    extra = [c for c in feats.columns if c != key and c in labels.columns]
    return labels.join(feats.drop(*extra), key)


def scan_week(spark: SparkSession, root: str, heavy: bool = False, key: str = "tx_id", check: bool = True) -> DataFrame:
    """All partitions (`partition_index=<n>` folders) in one id space: index << 40 | id. Text columns only when asked.

    Ids are unique when every partition holds each id once, between 0 and 2^40; manifests say so without a look at rows.
    """
    df = spark.read.parquet(root)
    if not heavy:
        df = df.drop(*[c for c in HEAVY_COLUMNS if c in df.columns])
    out = df.withColumn(key, F.shiftleft(F.col("partition_index").cast("bigint"), ID_SHIFT).bitwiseOR(F.col(key)))
    if not check:
        return out
    found = {(m := re.match(r"(.*/(partition_index=[^/]+))/[^/]+$", p))[2]: m[1] for p, _, _ in files(spark, [root])}
    known = [checked(spark, f"{root.rstrip('/')}/{name}")[1] for name in sorted(found)]
    if known and all(known):
        for m in known:
            if m["key"] != key or m["repeated"] or m["without_id"] or (m["rows"] and not 0 <= m["low"] <= m["high"] < 1 << ID_SHIFT):
                raise ValueError("a partition holds an id twice, or one that is out of range")
        return out
    twice = out.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).limit(1).collect()
    if twice:
        raise ValueError(f"id found twice: {twice[0][0]}")
    return out


def scan_pairs(spark: SparkSession, root: str, slot_range: tuple[int, int] | None = None, slots_per_part: int | None = None) -> DataFrame:
    """Pair rows in an inclusive slot range; the range prunes part folders and reaches the Parquet row groups."""
    df = spark.read.parquet(root)
    if slot_range is None:
        return df
    lo, hi = slot_range
    if slots_per_part and "part" in df.columns:
        df = df.where(F.col("part").between(lo // slots_per_part, hi // slots_per_part))
    return df.where(F.col("slot").between(lo, hi))


def scan_slot_parts(spark: SparkSession, root: str, lo: int, hi: int, slots_per_part: int, time: str = "block_time") -> DataFrame:
    """Rows of the slots from lo to hi, each with the earliest time of its slot.

    A slot without a time takes that of the last slot before it that has one, also from before the range: times come
    from all slots up to `hi`, of which two columns are read.
    """
    rows = scan_pairs(spark, root, (lo, hi), slots_per_part)
    per = spark.read.parquet(root).where(F.col("slot") <= hi).groupBy("slot").agg(F.min(time).alias("_t"))
    times = carry_forward(per, "slot", "_t", "slot_time").select("slot", "slot_time")
    return rows.join(times, "slot")


CATALOG = ["pack_id", "program", "family", "layer", "base", "rank", "train_lo", "train_hi"]


def scan_catalog(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Pack catalog of either format in one schema; all rows must carry the same training window.

    Without `fmt` the format is told by what is there: a table `library` below the path, or else a legacy table. A library
    also gives its routes as an array and counts of the pools and sequences it lists; a legacy catalog has null there.
    """
    if fmt is None:
        fmt = "library" if any("/library/" in f[0] for f in files(spark, [path])) else "legacy"
    if fmt == "library":
        listed = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
        df = spark.read.parquet(f"{path}/library").withColumnsRenamed({"program_id": "program", "family_id": "family", "train_min_slot": "train_lo", "train_max_slot": "train_hi"})
        out = df.withColumns({"routes": listed(F.col("route_ids")), "n_pools": F.size(F.array_distinct(listed(F.col("pools")))),
                              "n_sequences": F.size(F.array_distinct(listed(F.col("sequences"))))})
    elif fmt == "legacy":
        df = spark.read.parquet(path).withColumnsRenamed({"pack": "pack_id", "order": "rank", "train_min": "train_lo", "train_max": "train_hi"})
        out = df.withColumns({"routes": F.lit(None).cast("array<string>"), "n_pools": F.lit(None).cast("int"), "n_sequences": F.lit(None).cast("int")})
    else:
        raise ValueError(fmt)
    out = out.withColumn("rank", F.col("rank").cast("bigint")).select(*CATALOG, "routes", "n_pools", "n_sequences")
    windows = out.agg(F.min("train_lo").alias("a"), F.max("train_lo").alias("b"), F.min("train_hi").alias("c"), F.max("train_hi").alias("d"), F.count(F.lit(1)).alias("n"),
                      F.count("train_lo").alias("m"), F.count("train_hi").alias("o")).first()
    if windows.n == 0 or (windows.a, windows.c) != (windows.b, windows.d) or windows.n != windows.m or windows.n != windows.o:
        raise ValueError("catalog rows carry different training windows")
    return out


def write_parts(df: DataFrame, path: str, slots_per_part: int, order: list[str]) -> DataFrame:
    """Write part folders by slot and return their manifest: rows and an order-free digest per part.

    Rows are ranged by (slot, order), so a part with very many rows is spread over several files and tasks. A part folder
    is replaced as a whole, so a repeated run gives the same table.
    """
    spark = df.sparkSession
    rows = df.withColumn("part", F.floor(F.col("slot") / slots_per_part))
    (rows.repartitionByRange("slot", *order).sortWithinPartitions("slot", *order)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path))
    return manifest(spark.read.parquet(path), "part")


def digest(df: DataFrame, skip: tuple[str, ...] = ()) -> list:
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns) if c not in skip]).cast("decimal(28,0)")
    return [F.count(F.lit(1)).alias("rows"), F.sum(h).alias("digest")]


def manifest(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(*digest(df, (by,)))


def write_manifest(spark: SparkSession, path: str, inputs: dict, config: dict, counts: dict) -> None:
    """Publish a manifest after the data; a resumed build must have the same inputs and settings as the one on disk."""
    old = read_manifest(spark, path)
    if old is not None and (old["inputs"] != inputs or old["config"] != config):
        raise ValueError("the published manifest has other inputs or settings")
    text = json.dumps({"inputs": inputs, "config": config, "counts": counts}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    from pyspark.errors import AnalysisException
    try:
        row = spark.read.text(path).first()
    except AnalysisException:
        return None
    return json.loads(row.value) if row else None


BUNDLE = ("pool_stats", "pool_routes", "routes", "thresholds", "eval")


def export_bundle(path: str, stats: DataFrame, pool_routes: DataFrame, routes: DataFrame, thresholds: DataFrame, grid: DataFrame) -> dict[str, dict]:
    """Pool tables, only the routes that a pool list uses, thresholds and the evaluation grid; manifests of all of them."""
    used = routes.join(pool_routes.select(F.col("route").alias("route_id")).distinct(), "route_id", "left_semi")
    return {name: write_checked(df, f"{path}/{name}") for name, df in zip(BUNDLE, (stats, pool_routes, used, thresholds, grid))}


def scan_bundle(spark: SparkSession, path: str, whole: bool = False) -> dict[str, DataFrame]:
    """The tables of a bundle; one that is not as it was written is refused."""
    found = {name: checked(spark, f"{path}/{name}", whole) for name in BUNDLE}
    if not all(m for _, m in found.values()):
        raise ValueError("a table of the bundle has no manifest")
    return {name: df for name, (df, _) in found.items()}


def parity_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """A fixed sample of n rows, the same for the same seed: the smallest seeded hashes of the key."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), key)).orderBy("_h", key).limit(n).drop("_h")


def export_landing(path: str, universe: DataFrame, rows: DataFrame, key: str, window: tuple[int, int], seed: int = 7, n: int = 50_000) -> None:
    universe.write.mode("overwrite").parquet(f"{path}/pools")
    parity_sample(rows, key, seed, n).write.mode("overwrite").parquet(f"{path}/parity_sample")
    rows.where(F.col("slot").between(*window)).write.mode("overwrite").parquet(f"{path}/parity_window")
