"""Words of all documents without windows that start in an earlier document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txlens.llm import word_spans
from txlens.llm.common import table


def op8_word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return word_spans.remove_repeats(documents, digest=True).withColumnRenamed("kept", "kept_sha256")


_WINDOW = " || ' ' || ".join(["word", *(f"lead(word, {i}) OVER o" for i in range(1, word_spans.LENGTH))])
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM d),
windows AS (SELECT doc_id, place, {_WINDOW} AS x FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
firsts AS (SELECT x, min(doc_id) AS m FROM windows WHERE x IS NOT NULL GROUP BY x),
gone AS (SELECT DISTINCT doc_id, place + i AS place FROM windows JOIN firsts USING (x), (SELECT unnest(range({word_spans.LENGTH})) AS i) WHERE m < doc_id),
kept AS (SELECT w.doc_id, count(*) AS n_words, count(g.place) AS n_removed, string_agg(word, ' ' ORDER BY w.place) FILTER (g.place IS NULL) AS t
         FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.place = w.place GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
