"""Phrases whose words come together more often than chance, from count streams kept in sorted order.

1. Sorted runs. A task cuts its texts into blocks and sorts the numbered one-, two- and three-word runs of a block. The
   different ones, with their counts, are packed by bucket: one row per block, length and bucket. A word run is in one
   bucket, as one entry per block however often it occurs, so no word or pair fills a bucket; the number of buckets follows
   from the bytes of all texts, and a bucket is read, sorted and added up on its own. Runs found fewer than ten times end here.
2. Lockstep in prefix order. The streams of the three lengths, laid over each other by (language, first word, second word,
   third word), hold each run right before its extensions to the right. One pass reads them side by side and gives every
   phrase the counts of its beginnings, and every two-word phrase the largest count of its extensions.
3. Lockstep in suffix order. The same pass over (language, last word, word before, ...) gives the counts of the endings and
   of the extensions to the left. Both passes hold one row per length, no table of counts.
4. A range border may part a word from its extensions. Those rows, all of one word per partition, get its count by a
   broadcast of at most one word per partition.

Texts (A-Z in lower case) fall into pieces at punctuation and line ends, pieces into words at blanks and tabs; phrases never
cross pieces. Null text is empty, null language is `und`. Empty texts and tables give no rows. Repeated rows count each
time. Scores are whole numbers of any size. A long text is cut between pieces; a single piece is held whole by its task.
Only the text and language columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txlens.llm.common import byte_batches, partitions, step, trim, trimmed

#: Ends of pieces, and what lies between words.
PIECE_END, BETWEEN = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
UNKNOWN = "und"
#: Occurrences of a candidate; percent of them inside a longer candidate at which it goes.
LEAST, INSIDE = 10, 50
SCALE = 1_000_000
#: Phrases listed per language.
LISTED = 2000
#: Bytes of text that are counted together, length from which a text is cut between pieces, and bytes of text per bucket.
BLOCK, LONG, BUCKET = 8 << 20, 4 << 20, 16 << 20
#: Bytes of text that are split at once, and runs of a bucket that are sorted at once.
SLICE, PART = 1 << 20, 1 << 19

RUNS = "bucket int, words int, run binary"
STREAM = "lang string, w1 string, w2 string, w3 string, n long"
_NAMES = ["lang", "w1", "w2", "w3"]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _hashes(words: pa.Array) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in words.cast("binary").to_pylist()), np.uint64, len(words))


def _parts(text: str) -> Iterator[str]:
    """A text cut between pieces."""
    end, at = re.compile(PIECE_END), 0
    while len(text) - at > LONG and (m := end.search(text, at + LONG)):
        yield text[at:m.end()]
        at = m.end()
    yield text[at:]


def _keys(columns: Iterable[np.ndarray], sizes: list[int]) -> np.ndarray:
    """A number for each row of numbered columns, in the order of the rows; one column is held at a time."""
    key, room = None, 1
    for column, size in zip(columns, sizes):
        if room * size >= 2**62:
            found, key = np.unique(key, return_inverse=True)
            room = len(found)
        if key is None:
            key = column.astype(np.int64)
        else:
            key *= size
            key += column
        room *= size
    return key


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by key, and where each different key begins in it."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _packed(columns: list[np.ndarray], tables: list[pa.Array], n: np.ndarray) -> bytes:
    """A run of word numbers with the words they stand for, compressed."""
    fields = []
    for c, table in zip(columns, tables):
        used, code = np.unique(c, return_inverse=True)
        fields.append(pa.DictionaryArray.from_arrays(pa.array(code.astype(np.int32)), table.take(pa.array(used))))
    batch = pa.RecordBatch.from_arrays([*fields, pa.array(n)], [*_NAMES[:len(fields)], "n"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(number of the first text, texts) of about SLICE bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, side="right")))
        yield i, texts.slice(i, j - i)
        i = j


def _numbered(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of each word of the texts its number, then the different words, and of each word its piece and its text. What splits
    the texts is in memory for a slice of them at a time."""
    word, piece_of, text_of, before = [], [], [], 0
    for first, part in _slices(texts):
        pieces = pc.split_pattern_regex(pc.ascii_lower(part), pattern=PIECE_END)
        text, piece = pc.list_parent_indices(pieces).to_numpy(), pc.list_flatten(pieces)
        words = pc.split_pattern_regex(piece, pattern=BETWEEN)
        at, found = pc.list_parent_indices(words).to_numpy(), pc.list_flatten(words)
        some = pc.not_equal(found, "")
        at = at[some.to_numpy(zero_copy_only=False)]
        word.append(found.filter(some))
        piece_of.append((at + before).astype(np.int32))
        text_of.append((text[at] + first).astype(np.int32))
        before += len(piece)
    coded = pa.chunked_array(word, pa.string()).dictionary_encode()
    names = coded.chunk(coded.num_chunks - 1).dictionary if coded.num_chunks else pa.array([], pa.string())
    none = np.zeros(0, np.int32)
    return np.concatenate([none, *(c.indices.to_numpy() for c in coded.chunks)]), names, np.concatenate([none, *piece_of]), np.concatenate([none, *text_of])


def _block_runs(block: pa.Table, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of RUNS: the different runs of one, two and three words of a block with their counts."""
    block = block.combine_chunks()
    code, names, at, text = _numbered(block["text"].combine_chunks())
    langs = block["lang"].combine_chunks().dictionary_encode()
    lang, tables = langs.indices.to_numpy()[text], [langs.dictionary, names, names, names]
    del block, text
    trim()
    hashes = [_hashes(langs.dictionary), *[_hashes(names)] * 3]
    starts = np.arange(len(code), dtype=np.int32)
    for length in (1, 2, 3):
        if length > 1:
            starts = starts[:len(starts) - int(len(starts) > 0 and starts[-1] + length > len(code))]
            starts = starts[at[starts] == at[starts + length - 1]]
        # the numbers of a column of these runs: language, then words
        column = [lambda s: lang[s], *((lambda s, i=i: code[s + i]) for i in range(length))]
        order, cuts = _grouped(_keys((c(starts) for c in column), [len(langs.dictionary), *[len(names)] * length]))
        n = np.diff(np.append(cuts, len(starts)))
        first = starts[order[cuts]]
        del order, cuts
        key = hashes[0][column[0](first)]
        for c, h in zip(column[1:], hashes[1:]):
            key = _mix(key, h[c(first)])
        bucket = (key % np.uint64(buckets)).astype(np.int32)
        del key
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            part = order[edges[b]:edges[b + 1]]
            run = _packed([c(first[part]) for c in column], tables, n[part])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([length], pa.int32()), pa.array([run])], ["bucket", "words", "run"])


def sorted_runs(documents: DataFrame, buckets: int) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            texts = b.column("text")
            if b.num_rows and pc.max(pc.binary_length(texts)).as_py() > LONG:
                cut = [(lang, part) for lang, text in zip(b.column("lang").to_pylist(), texts.to_pylist()) for part in _parts(text)]
                todo = [pa.table({"lang": pa.array([lang], pa.string()), "text": pa.array([part], pa.string())}) for lang, part in cut]
            else:
                todo = [pa.Table.from_batches([b])]
            for t in todo:
                held.append(t)
                size += t.nbytes
                if size >= BLOCK:
                    yield from _block_runs(pa.concat_tables(held), buckets)
                    held, size = [], 0
                    trim()
        if size:
            yield from _block_runs(pa.concat_tables(held), buckets)

    return documents.mapInArrow(trimmed(run), RUNS)


def _column(parts: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column in one dictionary, and this dictionary."""
    whole = pa.chunked_array(parts).unify_dictionaries()
    return np.concatenate([c.indices.to_numpy() for c in whole.chunks]), whole.chunk(0).dictionary


def _added(runs: list[bytes], least: int) -> Iterator[pa.RecordBatch]:
    """STREAM rows of the runs of one length in a bucket; single words also give rows without words: words per language.

    A column is joined at a time, and a part of the different runs is sorted at a time.
    """
    parts = [[c.chunk(0) for c in pa.ipc.open_stream(r).read_all().columns] for r in runs]
    n = np.concatenate([p.pop().to_numpy() for p in parts])
    words = [_column([p.pop(0) for p in parts]) for _ in range(len(parts[0]))]
    key = _keys((c for c, _ in words), [len(d) for _, d in words])
    count = 1 + len(key) // PART
    part = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    part >>= np.uint64(40)
    part %= np.uint64(count)
    for i in range(count):
        mine = np.flatnonzero(part == i)
        order, starts = _grouped(key[mine])
        sums = np.add.reduceat(n[mine[order]], starts) if len(starts) else np.zeros(0, np.int64)
        kept = np.flatnonzero(sums >= least)
        first = mine[order[starts[kept]]]
        fields = [d.take(pa.array(c[first])) for c, d in words]
        blank = [pa.nulls(len(kept), pa.string())] * (4 - len(fields))
        yield pa.RecordBatch.from_arrays([*fields, *blank, pa.array(sums[kept])], [*_NAMES, "n"])
    if len(words) == 2:
        langs, names = words[0]
        total = np.bincount(langs, n, len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([names, *[pa.nulls(len(total), pa.string())] * 3, pa.array(total)], [*_NAMES, "n"])


def count_streams(runs: DataFrame, least: int) -> DataFrame:
    """STREAM rows of all lengths: counts of equal runs added up, at least `least`, and totals of languages in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple, list[bytes]] | None = None
        for b in batches:
            for key, packed in zip(zip(b.column("bucket").to_pylist(), b.column("words").to_pylist()), b.column("run")):
                if held and held[0] != key:
                    yield from _added(held[1], least)
                    held = None
                    trim()
                held = (key, [*(held[1] if held else []), packed.as_py()])
        if held:
            yield from _added(held[1], least)

    spark = runs.sparkSession
    return runs.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "words").mapInArrow(trimmed(run), STREAM)


def lockstep(streams: DataFrame, order: list[str], side: str) -> DataFrame:
    """Adds to each run, reading the streams side by side in this order of its words: `<side>1` and `<side>2`, the counts of
    its first word and first two words in that order, and `<side>_more`, the largest count of a run one word longer."""
    a, b, c = order
    added = [f"{side}1", f"{side}2", f"{side}_more"]
    names = [*streams.columns, *added]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in streams.schema), *(f"{x} long" for x in added)])
    kinds = [f.dataType.simpleString() == "string" for f in streams.schema]
    place = {x: streams.columns.index(x) for x in ("lang", a, b, c, "n")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, first, pending, more = None, None, None, 0

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i < len(kinds) and kinds[i] else pa.int64()) for i, x in enumerate(columns)], names)

        for part in batches:
            out = []
            for row in zip(*(x.to_pylist() for x in part.columns)):
                word = (row[place["lang"]], row[place[a]])
                n = row[place["n"]]
                if row[place[c]] is not None:
                    # the run of two words comes right before its extensions
                    out.append((*row, first if head == word else None, pending[place["n"]], 0))
                    more = max(more, n)
                    continue
                if pending is not None:
                    out.append((*pending, first if head == (pending[place["lang"]], pending[place[a]]) else None, None, more))
                    pending = None
                if row[place[b]] is None:
                    head, first = word, n
                    out.append((*row, n, None, 0))
                else:
                    pending, more = row, 0
            yield batch(out)
        if pending is not None:
            yield batch([(*pending, first if head == (pending[place["lang"]], pending[place[a]]) else None, None, more)])

    spark = streams.sparkSession
    found = step(streams.repartitionByRange(partitions(spark), "lang", a, b).sortWithinPartitions("lang", a, b, c).mapInArrow(run, schema), f"{side}_order")
    # a partition that starts amid the runs of a word does not know its count
    cut = found.where(F.col(f"{side}1").isNull())
    needed = F.broadcast(cut.select("lang", a).distinct())
    counts = found.where(F.col(b).isNull()).select("lang", a, F.col("n").alias("_n")).join(needed, ["lang", a], "left_semi")
    mended = cut.join(F.broadcast(counts), ["lang", a]).withColumn(f"{side}1", F.col("_n")).select(*names)
    return found.where(F.col(f"{side}1").isNotNull()).unionByName(mended)


def score(a: int, left: int, right: int) -> int:
    return SCALE * a * a // (left * right)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "phrase", "a", "l", "r", "score"]
    for b in batches:
        out = []
        for r in b.to_pylist():
            cuts = [(r["p1"], r["s1"])] if r["w3"] is None else [(r["p1"], r["s2"]), (r["p2"], r["s1"])]
            l, right = min(cuts, key=lambda x: score(r["n"], *x))
            out.append((r["lang"], " ".join(w for w in (r["w1"], r["w2"], r["w3"]) if w is not None), r["n"], l, right, score(r["n"], l, right)))
        columns = list(zip(*out)) if out else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i < 2 else pa.int64()) for i, x in enumerate(columns)], names)


def phrases(documents: DataFrame, least: int = LEAST, listed: int = LISTED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two and three words of each language."""
    columns = [F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    rows = documents.select(*columns)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with byte_batches(documents.sparkSession):
        counts = step(count_streams(sorted_runs(rows, 1 + size // BUCKET), least), "counts")
    totals = counts.where("w1 IS NULL").groupBy("lang").agg(F.sum("n").alias("total"))
    laid = counts.where("w1 IS NOT NULL")
    ahead = lockstep(laid, ["w1", "w2", "w3"], "p")
    last = F.coalesce("w3", "w2", "w1")
    before = F.when(F.col("w3").isNotNull(), F.col("w2")).when(F.col("w2").isNotNull(), F.col("w1"))
    turned = ahead.select("*", last.alias("z1"), before.alias("z2"), F.when(F.col("w3").isNotNull(), F.col("w1")).alias("z3"))
    both = lockstep(turned, ["z1", "z2", "z3"], "s").where("w2 IS NOT NULL")
    kept = both.where(F.greatest("p_more", "s_more") * 100 < F.col("n") * INSIDE)
    scored = kept.mapInArrow(_scored, "lang string, phrase string, a long, l long, r long, score long")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= listed)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
