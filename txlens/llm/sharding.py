"""Rendezvous hashing of record keys over weighted shards.

Every shard draws a number for a key from a hash of both; the shard with the largest draw takes the record. Draws of
one shard do not depend on the others, so one more shard takes records only into itself, and a shard that goes
spreads its records over the rest. A weight w turns a uniform draw u into -w / ln(u), which makes the chance of
winning proportional to w.

Slots number the records of a shard from 0 without gaps. Equal (key, size, checksum) triples are counted first, so a
key with a third of all rows is one row; counts per (shard, first digits of the key's hash) give the offsets, and
each such piece is numbered on its own. The list of pieces is at most shards x 4096 rows.

Null text: size 8 and the checksum of no bytes. Null keys are one key of their own (an empty hash input). Repeated
rows all get slots; they are indistinguishable, so which gets which does not matter. An empty table gives an empty
table. Only key and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txlens.session import materialise

#: Bytes that a record takes beside its text.
RECORD_BYTES = 8
#: Hex digits of a draw: 52 bits are exact in a double.
DIGITS = 13
#: Hex digits of the pieces that are numbered on their own.
PIECE_DIGITS = 3
#: Repeats that are written by one row of the block list.
BLOCK = 10_000


def draw(key: Column, shard: Column) -> Column:
    """A number in (0, 1) that depends on the key and the shard."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard (0 to n-1) with the largest draw; ties go to the smaller number."""
    shards = F.array(*[F.lit(float(w)) for w in weights])
    scored = F.transform(shards, lambda w, i: F.struct((-w / F.ln(draw(key, i))).alias("score"), (-i).alias("no")))
    return -F.array_max(scored)["no"]


def assign(records: DataFrame, key: str, text: str, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """One row per record: key, size, text_crc32, shard, slot, and grown_shard under the weights `grown`."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    seen = records.select(F.col(key).alias("key"), (F.octet_length(body).cast("long") + RECORD_BYTES).alias("size"), F.crc32(body).alias("text_crc32"))
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    kinds = materialise(
        seen.groupBy("key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("shard", rendezvous(name, weights))
        .withColumn("grown_shard", rendezvous(name, grown) if grown else F.lit(None).cast("int"))
        .withColumn("place", F.md5(name.cast("binary")))
        .withColumn("piece", F.substring("place", 1, PIECE_DIGITS)),
        "kinds",
    )
    counted = kinds.groupBy("shard", "piece").agg(F.sum("n").alias("rows"))
    ahead = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("shard", "piece", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "piece").orderBy("place", F.col("key").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.join(offsets, ["shard", "piece"]).withColumn("first", F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    blocks = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))
    start = F.col("block") * BLOCK
    return blocks.select(
        F.col("key").alias(key), "size", "text_crc32", "shard",
        F.explode(F.sequence(F.col("first") + start, F.col("first") + F.least(start + BLOCK, F.col("n")) - 1)).alias("slot"), "grown_shard",
    )
