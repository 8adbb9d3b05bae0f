"""Divergence of the sources of each language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txlens.llm import source_audit
from txlens.llm.common import table


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = source_audit.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))
    return found.select("lang", "source", "part", "item", "value", "rank")


_SCALE, _ADD = source_audit.SCALE, source_audit.SMOOTHING
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {source_audit.TEXTS}),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce((SELECT sum(c) FROM counts x WHERE x.lang = g.lang AND x.source = g.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN size USING (lang)),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + ({_SCALE}::HUGEINT * (coalesce(c, 0) + {_ADD})) // (g.n + {_ADD} * g.v) AS p
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
q AS (
  SELECT lang, term, 1 + ({_SCALE}::HUGEINT * (sum(c) + {_ADD})) // (sum(sum(c)) OVER (PARTITION BY lang) + {_ADD} * count(*) OVER (PARTITION BY lang)) AS q
  FROM p GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((
    SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
    WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
SELECT lang, source, part, item, cast(value AS BIGINT) AS value, cast(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {source_audit.LISTED}
"""
