"""Removal of word windows that also start in an earlier document, over a de Bruijn graph of tokens.

The k-mers of the graph are windows of `length` words: an edge joins its first and its last length - 1 words. Only
windows with a repeated anchor (see `repeats`) become edges. Every occurrence of a repeated edge is given the source
coordinate of the edge: the earliest text that holds it and the place there. Along a text, edges whose source
coordinates go on step by step are a path without a branch, so they compact to one span (text, start, edges, source,
source start); spans, not edges, travel on. A join with the source texts then verifies each distinct span word by
word (by a 128-bit digest of both), and only verified spans are removed.

A passage of a third of all texts: inside a piece of about 1 MB all but the earliest occurrence get their source at
once and skip the shuffle, so such an edge arrives once per piece. Copies of a whole text are not searched at all:
every window of them starts in the copy with the smallest id.

Null and empty texts have no words and lose nothing. Texts below `length` words lose nothing. Rows with equal id and
text are not earlier than each other and give equal rows. Null ids come last and are not earlier than each other.
An empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens.llm import repeats, rolling
from txlens.llm.common import buckets_of, id_order, step, trimmed
from txlens.llm.repeats import PASSED, PLAIN, Windows

LENGTH, ANCHOR = 13, 7
RESULT = "doc_id long, text_key long, n_words long, n_removed long, kept string"


def _kept(body: bytes, removed: np.ndarray | None, digest: bool) -> str:
    """The kept words: with digest their hash, else the text without the removed words and the space behind them."""
    if digest:
        words = body.split()
        if removed is not None:
            words = [w for w, r in zip(words, removed.tolist()) if not r]
        return hashlib.sha256(b" ".join(words)).hexdigest()
    if removed is None or not removed.any():
        return body.decode()
    _, starts, _ = rolling.words(np.frombuffer(body, np.uint8))
    cuts = np.append(starts, len(body))
    change = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]])))
    parts, at = [], 0
    for a, z in zip(change[::2], change[1::2]):
        parts.append(body[at:cuts[a]])
        at = cuts[z]
    return b"".join([*parts, body[at:]]).decode().rstrip(" ")


def _outcome(w: Windows, digest: bool, bits: np.ndarray | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if bits is not None:  # only rows outside the filter: nothing of them repeats
                b = b.filter(pa.array(~repeats.in_filter(b.column("text_key").to_numpy(), bits)))
            counts, removed, kept, open_body = [], [], [], []
            for id_, first, body, hits in zip(b.column("id"), b.column("first"), b.column("body"), b.column("hits").is_valid()):
                body = body.as_py()
                n = len(body.split())
                copy = first.is_valid and id_.as_py() > first.as_py()
                search = not copy and hits.as_py() and n >= w.length
                gone = n if copy and n >= w.length else 0
                counts.append(n)
                removed.append(gone)
                kept.append(None if search else _kept(b"" if gone else body, None, digest))
                open_body.append(body if search else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("id"), b.column("text_key"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(open_body, pa.binary()), b.column("hits")],
                ["doc_id", "id", "text_key", "n_words", "n_removed", "kept", "body", "hits"])

    return run


def hit_windows(w: Windows, b: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece of a batch with body and hits: (rows, bytes, unit values, units of each text; row, place, first and last window of each hit anchor)."""
    for i, j, data, sizes in rolling.chunks(b.column("body")):
        values, units = w.units(data, sizes)
        _, place, first, last = rolling.anchors(values, units, w.length, w.k)
        ends = np.cumsum(units)
        text = np.searchsorted(ends, place, side="right")
        wanted = np.zeros(len(values), bool)
        for r in range(i, j):
            wanted[np.frombuffer(b.column("hits")[r].as_py(), "<u4").astype(np.int64) + ends[r - i] - units[r - i]] = True
        mine = wanted[place] if len(place) else np.zeros(0, bool)
        yield slice(i, j), data, values, units, text[mine], place[mine], first[mine], last[mine]


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of the ranges first to last."""
    n = last - first + 1
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def _edges(w: Windows, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column("id").to_numpy(), b.column("text_key").to_numpy()
            for rows, _, values, units, text, _, first, last in hit_windows(w, b):
                if not len(text):
                    continue
                at = ranges(first, last)
                row = np.repeat(text, last - first + 1)
                hashes = rolling.spans_hash(values, at, at + w.length)
                fields = {"hash": hashes, "id": ids[rows][row], "text_key": keys[rows][row], "place": (at - (np.cumsum(units) - units)[row]).astype(np.uint32)}
                order = np.lexsort((fields["place"], fields["text_key"], fields["id"], hashes))
                fields = {n: v[order] for n, v in fields.items()}
                cuts = rolling.groups(fields["hash"])
                head = np.repeat(cuts[:-1], np.diff(cuts))
                later = fields["id"] > fields["id"][head]
                source = {"text_key": fields["text_key"][later], "place": fields["place"][later], "source": fields["text_key"][head][later], "source_place": fields["place"][head][later]}
                plain = {n: v[~later] for n, v in fields.items()}
                bucket = (plain["hash"] >> np.uint64(40)).astype(np.int64) % buckets
                yield _both(plain, bucket, PLAIN)
                if later.any():
                    yield _both(source, np.full(int(later.sum()), int(hashes[0] % np.uint64(buckets))), PASSED)

    return run


EDGE = ["run", "hash", "id", "text_key", "place", "source", "source_place"]
EDGE_SCHEMA = "bucket int, kind int, " + ", ".join(f"{n} binary" for n in EDGE)


def _both(fields: dict[str, np.ndarray], bucket: np.ndarray, kind: int) -> pa.RecordBatch:
    """Packed fields in the order of EDGE; missing ones are empty."""
    order = np.lexsort((fields["place"], fields["text_key"]))
    part = repeats.bucketed({n: v[order] for n, v in fields.items()}, bucket[order], kind, ("text_key", "id"))
    columns = {n: part.column(n) if n in part.schema.names else pa.array([b""] * part.num_rows, pa.binary()) for n in EDGE}
    return pa.RecordBatch.from_arrays([part.column("bucket"), part.column("kind"), *columns.values()], ["bucket", "kind", *columns])


FOUND = {"place": "<u4", "source": "<i8", "source_place": "<u4"}


def _sources(buckets: int):
    """Occurrences of repeated edges with their source, on their way to their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            kind = b.column("kind").to_numpy()
            passed, plain = b.filter(pa.array(kind == PASSED)), b.filter(pa.array(kind == PLAIN))
            if passed.num_rows:
                own = {n: rolling.unpacked(passed.column(n), t) for n, t in FOUND.items()}
                yield repeats.for_texts({"text_key": repeats.unrolled(passed, "text_key")} | own, buckets)
            if plain.num_rows:
                parts.append([rolling.unpacked(plain.column("hash"), "<u8"), repeats.unrolled(plain, "id"), repeats.unrolled(plain, "text_key"), rolling.unpacked(plain.column("place"), "<u4")])
        if not parts:
            return
        hashes, ids, keys, place = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(hashes, kind="stable")
        cuts = rolling.groups(hashes[order])
        order = order[np.repeat(np.diff(cuts) > 1, np.diff(cuts))]
        hashes, ids, keys, place = (x[order] for x in (hashes, ids, keys, place))
        order = np.lexsort((place, keys, ids, hashes))
        hashes, ids, keys, place = (x[order] for x in (hashes, ids, keys, place))
        cuts = rolling.groups(hashes)
        head = np.repeat(cuts[:-1], np.diff(cuts))
        later = ids > ids[head]
        if later.any():
            yield repeats.for_texts({"text_key": keys[later], "place": place[later], "source": keys[head][later], "source_place": place[head][later]}, buckets)

    return run


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of edges whose source coordinates go on step by step."""
    for b in batches:
        columns: dict[str, list] = {n: [] for n in ("text_key", "start", "edges", "source", "source_start")}
        for key, *values in zip(b.column("text_key").to_pylist(), *(b.column(n) for n in FOUND)):
            place, source, source_place = (np.frombuffer(v.as_py(), t).astype(np.int64) for v, t in zip(values, FOUND.values()))
            order = np.argsort(place, kind="stable")
            place, source, source_place = place[order], source[order], source_place[order]
            new = np.concatenate([[True], (np.diff(place) != 1) | (np.diff(source_place) != 1) | (source[1:] != source[:-1])])
            cuts = np.append(np.flatnonzero(new), len(place))
            at = cuts[:-1]
            for n, v in zip(columns, (np.full(len(at), key), place[at], np.diff(cuts), source[at], source_place[at])):
                columns[n].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)).cast(k) for v, k in zip(columns.values(), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))], list(columns))


def _digests(w: Windows):
    """Digests of the words of asked spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, body, asked in zip(b.column("text_key").to_pylist(), b.column("body"), b.column("asked")):
                words = body.as_py().split()
                for a in asked.as_py():
                    out.append((key, a["start"], a["edges"], xxhash.xxh3_128_digest(b" ".join(words[a["start"]:a["start"] + a["edges"] + w.length - 1]))))
            columns = zip(*out) if out else [[]] * 4
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["text_key", "start", "edges", "digest"])

    return run


def _finish(w: Windows, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, kept = [], []
            for body, n, spans in zip(b.column("body"), b.column("n_words"), b.column("spans")):
                gone = None
                if spans.is_valid:
                    s = [(x["start"].as_py(), x["edges"].as_py()) for x in spans]
                    gone = repeats.covered(ranges(np.array([x for x, _ in s]), np.array([x + e - 1 for x, e in s])), w.length, n.as_py())
                removed.append(int(gone.sum()) if gone is not None else 0)
                kept.append(_kept(body.as_py(), gone, digest))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), b.column("n_words"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "text_key", "n_words", "n_removed", "kept"])

    return run


def repeated_spans(searched: DataFrame, w: Windows) -> DataFrame:
    """Verified spans (text_key, start, edges, source, source_start) of texts with hits (id, text_key, body, hits)."""
    n = buckets_of(searched)
    edges = searched.select("id", "text_key", "body", "hits").mapInArrow(trimmed(_edges(w, n)), EDGE_SCHEMA)
    found = edges.repartitionById(n, "bucket").mapInArrow(trimmed(_sources(n)), repeats.sent_schema(list(FOUND)))
    spans = step(repeats.gathered(found, FOUND, n).mapInArrow(_compact, "text_key long, start int, edges int, source long, source_start int"), "spans")
    ends = spans.select("text_key", "start", "edges").union(spans.select("source", "source_start", "edges")).distinct()
    asked = ends.groupBy("text_key").agg(F.collect_list(F.struct("start", "edges")).alias("asked"))
    digests = searched.select("text_key", "body").join(asked, "text_key").mapInArrow(_digests(w), "text_key long, start int, edges int, digest binary")
    digests = step(digests.distinct(), "digests")
    own = spans.join(digests, ["text_key", "start", "edges"])
    there = digests.select(F.col("text_key").alias("source"), F.col("start").alias("source_start"), "edges", "digest")
    return own.join(there, ["source", "source_start", "edges", "digest"]).drop("digest")


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, digest: bool = False, keep_key: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the text without repeated windows, or with digest the SHA-256 of its kept words joined by spaces.

    `keep_key` adds the text key.
    """
    w = Windows(length, anchor, by_words=True, across=True)
    source = repeats.keyed(documents, key, text)
    searched, bits = repeats.candidates(source, w)
    schema = "doc_id long, id long, text_key long, n_words long, n_removed long, kept string, body binary, hits binary"
    outcome = step(searched.select("doc_id", "id", "text_key", "body", "first", "hits").mapInArrow(_outcome(w, digest), schema), "outcome")
    clear = source.withColumns({"first": F.lit(None).cast("long"), "hits": F.lit(None).cast("binary")}).mapInArrow(_outcome(w, digest, bits), schema)
    searched = outcome.where("body IS NOT NULL")
    spans = repeated_spans(searched, w).groupBy("text_key").agg(F.collect_list(F.struct("start", "edges")).alias("spans"))
    done = searched.select("doc_id", "text_key", "n_words", "body").join(spans, "text_key", "left").mapInArrow(_finish(w, digest), RESULT)
    columns = ["doc_id", "text_key", "n_words", "n_removed", "kept"]
    result = clear.select(columns).union(outcome.where("body IS NULL").select(columns)).union(done.select(columns))
    return result if keep_key else result.drop("text_key")


def cut_out(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """The documents with repeated windows cut out of their text; other columns are unchanged.

    Documents that lose all their words go; documents that had none stay.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), id_order(F.col(f"`{key}`")).alias("id"), F.xxhash64(body).alias("text_key"))
    rows = rows.withColumn("text", F.col(f"row.`{text}`"))
    left = remove_repeats(rows.select("id", "text"), "id", "text", length, anchor, keep_key=True)
    changed = step(left.where("n_removed > 0").select(F.col("doc_id").alias("id"), "text_key", "n_words", "n_removed", "kept").dropDuplicates(["id", "text_key"]), "changed")
    # only rows that seem to be changed are shuffled
    own = F.xxhash64("id", "text_key").alias("row_key")
    bits = repeats.key_filter(changed.select(own.alias("text_key")))
    rows = rows.drop("text").withColumn("row_key", own)
    joined = repeats.rows_in(rows, bits, True, "row_key").join(changed, ["id", "text_key"], "left").where("n_removed IS NULL OR n_removed < n_words")
    columns = [(F.when(F.col("n_removed").isNull(), F.col(f"row.`{c}`")).otherwise(F.col("kept")) if c == text else F.col(f"row.`{c}`")).alias(c) for c in documents.columns]
    return joined.select(*columns).union(repeats.rows_in(rows, bits, False, "row_key").select("row.*"))
