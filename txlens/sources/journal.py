"""Tagged JSON-lines journals, truth files, attempts, raw rows and packet logs as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txlens.sources.lines import read_lines

# Fixed values
MIN_SIGNATURE_CHARS = 64
GATE_SCHEMA = ("kind string, ts bigint, pool_idx bigint, proto string, known int, routed int, searchable int, gross bigint, gross_pos int, "
    "cap_gross bigint, cap_pos int, cap_hurdle int, n_hop int, n_sync int, synced_all int, age_max bigint, age32_all int, mut_ok_all int, "
    "mut_authoritative int, would_send_new int, s007_ready int, updating int, state_gen bigint, family int, seq string, exec_fam int, shred_slot bigint")
ATTEMPT_SCHEMA = ("attempt bigint, phase string, signature string, slot bigint, conn string, t0_ns bigint, t1_ns bigint, t2_ns bigint, t3_ns bigint, "
    "sign_ns bigint, send_ns bigint, sign_to_send_ns bigint, send_to_seen_ns bigint, sign_to_seen_ns bigint, landed boolean, err string, "
    "rpc_poll_count bigint, fee_lamports bigint")
RAW_SCHEMA = ("slot bigint, tx_index bigint, signature string, version string, raw_len bigint, raw_hex string")
TRUTH_SCHEMA = ("sig_hex string, slot bigint, index bigint, tx_i bigint, version bigint")
PACKET_SCHEMA = ("source_id int, seq bigint, rx_ns bigint, rx_tsc bigint, slot bigint, index bigint, fec_set bigint, type string, bytes bigint")


def _fields(ddl: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in ddl.split(", ")]


def seconds(ts: Column) -> Column:
    """Seconds from a stamp that may be in nanoseconds."""
    x = ts.cast("double")
    return F.when(x > 1e12, x / 1e9).otherwise(x)


def in_window(ts: Column, now: float, window: float) -> Column:
    """Rows without a time are outside every time window."""
    return F.coalesce(F.lit(now) - seconds(ts) <= window, F.lit(False))


def parse_kind(lines: DataFrame, kind: str, schema, text: str = "value") -> DataFrame:
    """Rows of one kind. Lines that are not JSON are dropped; each kind is parsed with its own schema."""
    tagged = lines.where(F.get_json_object(text, "$.kind") == kind)
    return tagged.select(F.from_json(text, schema, {"mode": "PERMISSIVE"}).alias("r")).where(F.col("r").isNotNull()).select("r.*")


def scan_journal(spark: SparkSession, path: str, kind: str, schema=GATE_SCHEMA, window_s: float | None = None,
                 now: float | None = None) -> DataFrame:
    df = parse_kind(spark.read.text(path), kind, schema)
    if window_s is not None and now is not None:
        df = df.where(in_window(F.col("ts"), now, window_s))
    return df


def last_truth_rows(rows: DataFrame, order: Column) -> DataFrame:
    """Lowercase signature keys; short keys dropped; the last row of a key wins."""
    sig = F.lower("sig_hex")
    ok = rows.where(F.length(sig) >= MIN_SIGNATURE_CHARS).withColumn("sig_hex", sig).withColumn("_o", order)
    rest = [c for c in rows.columns if c != "sig_hex"]
    return ok.groupBy("sig_hex").agg(F.max_by(F.struct(*rest), F.col("_o")).alias("r")).select("sig_hex", "r.*")


def truth_of(lines: DataFrame) -> DataFrame:
    """Truth rows of lines (file, start, value); the place in the files decides which row of a key is last."""
    row = lines.select("file", "start", F.from_json("value", TRUTH_SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).where(F.col("r.sig_hex").isNotNull())
    return last_truth_rows(row.select("r.*", "file", "start"), F.struct("file", "start")).drop("file", "start")


def scan_truth(spark: SparkSession, path: str) -> DataFrame:
    return truth_of(read_lines(spark, path))


def scan_attempts(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    if fmt == "json":
        return spark.read.schema(ATTEMPT_SCHEMA).json(path)
    if fmt == "csv":
        df = spark.read.option("header", True).csv(path)
        have = set(df.columns)
        return df.select(*[(F.col(f) if f in have else F.lit(None)).cast(t).alias(f) for f, t in _fields(ATTEMPT_SCHEMA)])
    raise ValueError(fmt)


def scan_raw_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_SCHEMA).json(path).withColumn("raw", F.unhex("raw_hex")).drop("raw_hex")


def scan_packets(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    if fmt == "json":
        return spark.read.schema(PACKET_SCHEMA).json(path)
    return spark.read.parquet(path).select(*[F.col(f).cast(t).alias(f) for f, t in _fields(PACKET_SCHEMA)])
