"""Shards of all documents by key, and one shard more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txlens.llm import sharding
from txlens.llm.common import table

SHARDS = 24


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.assign(documents, "doc_id", "text", [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


SQL = f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i] || range(8), lambda a, s: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
d AS (
  SELECT doc_id, coalesce(cast(doc_id AS VARCHAR), '') AS name, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT doc_id, name, length(h) // 2 + {sharding.RECORD_BYTES} AS size,
    xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(h), 2), lambda p: ('0x' || substr(h, p, 2))::BIGINT),
        lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, crc),
u AS (
  SELECT name, j, ('0x' || substr(md5(name || ':' || j), 1, {sharding.DIGITS}))::BIGINT AS u
  FROM (SELECT DISTINCT name FROM s), (SELECT unnest(range({SHARDS + 1})) AS j)),
w AS (
  SELECT name, arg_min(j, (-u, j)) FILTER (j < {SHARDS}) AS top, arg_min(j, (-u, j)) AS grown FROM u GROUP BY name)
SELECT doc_id, size, text_crc32, 'key' AS law, cast(top AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY top ORDER BY md5(name), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, cast(grown AS INTEGER) AS grown_shard
FROM s JOIN w USING (name)
"""
