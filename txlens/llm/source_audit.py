"""How the words of the sources of a language differ: an audit by Arrow compute inside Spark tasks.

1. Partial counts. A batch of texts goes through `ascii_lower`, `split_pattern_regex` and `dictionary_encode`; a hash
   `group_by` over (text, code) gives the occurrences per text, a second one over (group, code) the occurrences and the
   number of texts per (language, source). A task merges the partial counts of its batches before it hands them on.
2. Merged terms. Partial counts meet by (language, term), so a term in every text is a row per task and source. Terms
   found in too few texts of their language are dropped here.
3. Shards. The terms of a language are dealt over as many shards as its cells (terms by sources) ask for; each shard starts
   with a header row (sources of the language with their totals) and streams its terms in blocks of a bounded number of
   cells: a matrix of counts, terms by sources.
   From a block come sums of differences per pair of sources and the best terms per source. Sums over shards are the
   divergences; best terms of shards are ranked once more.

A share is 1 + floor(SCALE x (count + SMOOTHING) / (total + SMOOTHING x terms)), in whole numbers: the quotient is found
digit by digit to base 1000, exact for totals up to 9 x 10^15.

Null text, language and source count as empty. A text without terms still makes its group. A language without kept terms
gives pairs of value 0 and no terms; a language with one source gives no pairs. Repeated rows count each time. An empty
table gives an empty table. Only the columns text, lang and source are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txlens.llm.common import byte_batches, partitions, step

#: What lies between terms: everything in ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE, SMOOTHING = 1_000_000_000, 5
#: Texts of its language that a kept term is found in.
TEXTS = 30
#: Terms listed per group.
LISTED = 50
#: Rows of partial counts that a task merges before it hands them on.
HELD = 400_000
#: Cells of a shard and of a block (terms by sources), and sources up to which sums stay in the task until its shard ends.
SHARD_CELLS, CELLS, SUMMED = 1 << 20, 1 << 18, 1024

PARTIAL = "lang string, source string, term string, n long, texts long"
FOUND = "lang string, source string, part string, item string, value long"
_KEYS = ["lang", "source", "term"]


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """Partial counts of a batch; a row with a null term holds the number of texts of a group."""
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = pc.add(pc.multiply(lang.indices.cast("int64"), len(source.dictionary)), source.indices.cast("int64"))
    words = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), pattern=BETWEEN)
    row, word = pc.list_parent_indices(words), pc.list_flatten(words)
    some = pc.not_equal(word, "")
    row, word = row.filter(some), word.filter(some).dictionary_encode()
    per_text = pa.table({"row": row, "code": word.indices}).group_by(["row", "code"], use_threads=False).aggregate([([], "count_all")])
    cells = pa.table({"group": pc.take(group, per_text["row"]), "code": per_text["code"], "n": per_text["count_all"]})
    cells = cells.group_by(["group", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    groups = pa.table({"group": group}).group_by("group", use_threads=False).aggregate([([], "count_all")])

    def named(found: pa.Table, term: pa.ChunkedArray | pa.Array, n: pa.ChunkedArray | pa.Array, texts: pa.ChunkedArray) -> pa.Table:
        at = found["group"].to_numpy()
        names = [pc.take(x.dictionary, pa.array(i)) for x, i in ((lang, at // len(source.dictionary)), (source, at % len(source.dictionary)))]
        return pa.table([*names, term, n, texts], ["lang", "source", "term", "n", "texts"])

    rows = named(cells, pc.take(word.dictionary, cells["code"]), cells["n_sum"], cells["n_count"])
    heads = named(groups, pa.nulls(len(groups), pa.string()), pa.array(np.zeros(len(groups), np.int64)), groups["count_all"])
    return pa.concat_tables([rows, heads])


def partial_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, texts): counts of parts of the table, several rows per key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            if b.num_rows:
                held.append(_counted(b))
            if sum(map(len, held)) > HELD:
                held = [_merged(held)]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().to_batches(max_chunksize=50_000)
        if held:
            yield from _merged(held).to_batches(max_chunksize=50_000)

    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return documents.select(*columns).mapInArrow(run, PARTIAL)


def _merged(parts: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(parts).group_by(_KEYS, use_threads=False).aggregate([("n", "sum"), ("texts", "sum")])
    return found.select([*_KEYS, "n_sum", "texts_sum"]).rename_columns([*_KEYS, "n", "texts"])


def merged_terms(partial: DataFrame, texts: int = TEXTS) -> DataFrame:
    """(lang, term, n, cells): kept terms with their counts per source, and per language a null term with all its sources."""
    counts = partial.repartition(partitions(partial.sparkSession), "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    cells = F.collect_list(F.struct("source", "n")).alias("cells")
    return counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"), cells).where(F.col("term").isNull() | (F.col("texts") >= texts)).drop("texts")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE x count / total), digits to base 1000; count is at most total."""
    digits, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(3):
        up, rest = np.divmod(rest * 1000, total)
        digits = digits * 1000 + up
    return 1 + digits


def _shard(header: dict, blocks: Iterator[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]], listed: int) -> Iterator[pa.RecordBatch]:
    """What one shard of a language gives: sums of differences for pairs of sources, and the best terms of each source."""
    lang, sources, vocabulary = header["lang"], header["sources"], header["terms"]
    count, value_set = len(sources), pa.array(sources, pa.string())
    totals = np.array(header["totals"], np.int64) + SMOOTHING * vocabulary
    whole = np.int64(header["n"] + SMOOTHING * vocabulary)

    def rows(source: list, part: str, item: list, value: np.ndarray) -> pa.RecordBatch:
        n = len(source)
        columns = [pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "part", "item", "value"])

    def pairs(g: int, value: np.ndarray) -> pa.RecordBatch:
        return rows([sources[g]] * (count - g - 1), "pair", sources[g + 1:], value)

    sums = np.zeros((count, count), np.int64) if count <= SUMMED else None
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, object))] * count
    used = header["shard"] == 0
    for terms, n, cell_sources, cuts in blocks:
        used = used or len(terms) > 0
        values = cell_sources.field("n").to_numpy()
        at = pc.index_in(cell_sources.field("source"), value_set=value_set).to_numpy()
        matrix = np.zeros((len(terms), count), np.int64)
        matrix[np.repeat(np.arange(len(terms)), np.diff(cuts)), at] = values
        p = shares(matrix + SMOOTHING, totals[None, :])
        above = np.where(matrix > 0, p - shares(n + SMOOTHING, whole)[:, None], 0)
        for g in range(count):
            off = np.abs(p[:, g + 1:] - p[:, g:g + 1]).sum(axis=0)
            if sums is None:
                yield pairs(g, off)
            else:
                sums[g, g + 1:] += off
            some = np.flatnonzero(above[:, g] > 0)
            if len(some):
                # terms come in order, so a stable sort leaves ties in order
                some = some[np.argsort(-above[some, g], kind="stable")[:listed]]
                v, names = np.concatenate([best[g][0], above[some, g]]), np.concatenate([best[g][1], np.array(terms.take(pa.array(some)).to_pylist(), object)])
                first = np.argsort(-v, kind="stable")[:listed]
                best[g] = (v[first], names[first])
    # every pair needs a row from one shard at least
    for g in range(count if used else 0):
        yield pairs(g, sums[g, g + 1:] if sums is not None else np.zeros(count - g - 1, np.int64))
        yield rows([sources[g]] * len(best[g][0]), "term", best[g][1].tolist(), best[g][0])


def _blocks(batch: pa.RecordBatch, count: int) -> Iterator[tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]]:
    height = max(1, CELLS // count)
    for i in range(0, batch.num_rows, height):
        part = batch.slice(i, height)
        cells = part.column("cells")
        yield part.column("term"), part.column("n").to_numpy(), cells.flatten(), cells.offsets.to_numpy()


def differences(terms: DataFrame, listed: int = LISTED) -> DataFrame:
    """Rows of FOUND: per shard, sums for pairs of sources and best terms."""
    spark = terms.sparkSession
    body = terms.where("term IS NOT NULL")
    totals = body.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    size = body.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("n"))
    groups = terms.where("term IS NULL").select("lang", F.explode("cells.source").alias("source")).join(totals, ["lang", "source"], "left")
    listing = F.sort_array(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total"))))
    headers = groups.groupBy("lang").agg(listing.alias("all")).join(size, "lang", "left")
    zero = F.lit(0).cast("long")
    # one number: the shards that the language with most cells asks for
    most = headers.agg(F.max(F.col("terms") * F.size("all"))).first()[0] or 0
    shards = 1 + most // SHARD_CELLS
    header = F.struct(F.col("all.source").alias("sources"), F.col("all.total").alias("totals"), F.coalesce("terms", zero).alias("terms"), F.coalesce("n", zero).alias("n"))
    headers = headers.select("lang", header.alias("header")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    body = body.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int"))
    dealt = headers.unionByName(body, allowMissingColumns=True).repartition(partitions(spark), "lang", "shard").sortWithinPartitions("lang", "shard", F.col("header").isNull(), "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = ((b.slice(i, j - i)) for b in batches for i, j in _runs(b))
        part = next(todo, None)
        while part is not None:
            # the first row of a shard is its header
            header = part.column("header")[0].as_py() | {c: part.column(c)[0].as_py() for c in ("lang", "shard")}
            rest = [part.slice(1)]

            def blocks() -> Iterator:
                nonlocal part
                yield from _blocks(rest.pop(), max(1, len(header["sources"])))
                while (part := next(todo, None)) is not None and not part.column("header")[0].is_valid:
                    yield from _blocks(part, max(1, len(header["sources"])))

            yield from _shard(header, blocks(), listed)

    return dealt.select("lang", "shard", "header", "term", "n", "cells").mapInArrow(run, FOUND)


def _runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """Slices of a batch that each start at a header, but for a first one that goes on with the shard before."""
    heads = np.flatnonzero(np.asarray(batch.column("header").is_valid()))
    cuts = sorted({0, *heads.tolist(), batch.num_rows})
    return list(zip(cuts[:-1], cuts[1:]))


def audit(documents: DataFrame, texts: int = TEXTS, listed: int = LISTED) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows give the divergence from each other source, `term` rows the terms that stand out."""
    with byte_batches(documents.sparkSession):
        terms = step(merged_terms(partial_counts(documents), texts), "terms")
        found = step(differences(terms, listed), "differences")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = both.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= listed))
