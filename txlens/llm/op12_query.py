"""Collocations of all documents, by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txlens.llm import collocations
from txlens.llm.common import table


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents").select("text", "lang"))


_LEAST, _SCALE = collocations.LEAST, collocations.SCALE
SQL = f"""
WITH d AS (
  SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
f1 AS (SELECT lang, w1, count(*) AS n FROM (SELECT lang, unnest(w) AS w1 FROM w) GROUP BY ALL),
f2 AS (SELECT lang, x[1] AS w1, x[2] AS w2, count(*) AS n FROM (
  SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i+1])) AS x FROM w WHERE len(w) > 1) GROUP BY ALL HAVING count(*) >= {_LEAST}),
f3 AS (SELECT lang, x[1] AS w1, x[2] AS w2, x[3] AS w3, count(*) AS n FROM (
  SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i+2])) AS x FROM w WHERE len(w) > 2) GROUP BY ALL HAVING count(*) >= {_LEAST}),
more AS (SELECT lang, w1, w2, max(n) AS m FROM (SELECT lang, w1, w2, n FROM f3 UNION ALL SELECT lang, w2, w3, n FROM f3) GROUP BY ALL),
cuts AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.n AS a, 1 AS k, x.n AS l, y.n AS r
  FROM f2 b JOIN f1 x ON x.lang = b.lang AND x.w1 = b.w1 JOIN f1 y ON y.lang = b.lang AND y.w1 = b.w2
  LEFT JOIN more m ON m.lang = b.lang AND m.w1 = b.w1 AND m.w2 = b.w2 WHERE 100 * coalesce(m, 0) < {collocations.INSIDE} * b.n
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.n, 1, x.n, y.n
  FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f2 y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.n, 2, x.n, y.n
  FROM f3 t JOIN f2 x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, ({_SCALE}::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM lowest)
SELECT r.lang, r.rank, phrase, a, l, r.r, t.n::BIGINT AS n, score::BIGINT AS score
FROM ranked r JOIN (SELECT lang, sum(n) AS n FROM f1 GROUP BY lang) t USING (lang) WHERE r.rank <= {collocations.LISTED}
"""
