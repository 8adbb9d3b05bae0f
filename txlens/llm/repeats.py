"""Which texts hold windows that also start elsewhere: the part that byte and word repeats share.

1. Each text is cut into anchors (see `rolling`). Anchors travel packed, a row per bucket and about 1 MB of text.
   Anchors that repeat inside such a piece are known to repeat: one of them is sent on with that mark, the others skip
   the shuffle of the search, so an anchor of a third of all texts arrives once per piece.
2. A task holds one bucket (buckets are partition numbers; hashed once more, several would meet in a task, the more the
   larger the table) and sorts it once; anchors that occur more than once are hits and go back to their text.
3. Texts are told from each other by `text_key` (64 bits of their content), so copies count once. The copy with the
   smallest id stands for all; every window of the others starts earlier in it.
4. Texts with hits are written to the shared folder as candidates; results of all others are final.

Order of texts: by id, nulls last, then by text_key where different texts share an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens.llm import rolling
from txlens.llm.common import buckets_of, id_order, small_batches, step, trimmed, worker_cache

PLAIN, KNOWN, PASSED = 0, 1, 2


@dataclass(frozen=True)
class Windows:
    """Windows of `length` units, found by anchors of k units; `across`: repeats inside one text do not count."""

    length: int
    k: int
    by_words: bool
    across: bool

    def units(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all units of several texts, and the units of each text."""
        if not self.by_words:
            return rolling.BYTE_VALUES[data], sizes
        # a space behind each text keeps its last word apart from the next one's first
        spaced = np.insert(data, np.cumsum(sizes), 0x20)
        hashes, starts, _ = rolling.words(spaced)
        return hashes, np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes + 1)])))


def keyed(documents: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, its order number, the text as bytes and its key."""
    small_batches(documents.sparkSession)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return documents.select(F.col(key).cast("long").alias("doc_id"), id_order(F.col(key)).alias("id"), F.xxhash64(body).alias("text_key"), body.alias("body"))


def bucketed(fields: dict[str, np.ndarray], bucket: np.ndarray, kind: int, per_text: tuple[str, ...] = ()) -> pa.RecordBatch:
    """A row per bucket with its packed values; fields of `per_text` are stored once per run of equal text keys."""
    order = np.argsort(bucket, kind="stable")
    own = bucket[order]
    cuts = rolling.groups(own)
    columns = {"bucket": pa.array(own[cuts[:-1]].astype(np.int32)), "kind": pa.array(np.full(len(cuts) - 1, kind, np.int32))}
    if per_text:
        keys = fields["text_key"][order]
        runs = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])]))
        run_cuts = np.searchsorted(runs, cuts)
        columns["run"] = rolling.packed(np.diff(np.append(runs, len(own))).astype(np.uint32), run_cuts)
    for name, values in fields.items():
        columns[name] = rolling.packed(values[order][runs], run_cuts) if name in per_text else rolling.packed(values[order], cuts)
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def unrolled(part: pa.RecordBatch, name: str) -> np.ndarray:
    """A signed 64-bit field that was stored per run."""
    return np.repeat(rolling.unpacked(part.column(name), "<i8"), rolling.unpacked(part.column("run"), "<u4"))


def _narrow(hashes: np.ndarray) -> np.ndarray:
    """The low six bytes of each hash; a row of six bytes is one value."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel()


def _widened(column: pa.Array) -> np.ndarray:
    six = rolling.unpacked(column, np.uint8).reshape(-1, 6)
    return np.pad(six, ((0, 0), (0, 2))).view("<u8").ravel()


#: Bits of the filter of text keys: 2 MB, whatever the number of keys.
FILTER_BITS = 1 << 24


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bit map of fixed size of the text keys; at most FILTER_BITS / 64 numbers reach the driver.

    With many more keys than bits it lets everything pass, which costs a shuffle of more texts and changes no result.
    """
    at = keys.select(F.col("text_key").bitwiseAND(FILTER_BITS - 1).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out


def in_filter(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = keys & (FILTER_BITS - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1


def rows_in(source: DataFrame, bits: np.ndarray, inside: bool, key: str = "text_key") -> DataFrame:
    """Rows whose text key is in the filter (all of its keys and perhaps others), or the remaining ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_filter(b.column(key).to_numpy(), bits) == inside))

    return source.mapInArrow(run, source.schema)


def _ordered(fields: dict[str, np.ndarray], bucket: np.ndarray, kind: int) -> pa.RecordBatch:
    """Packed anchors; those that skip the search carry no hash."""
    part = bucketed(fields, bucket, kind, ("text_key",))
    none = pa.array([b""] * part.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([part.column(n) if n in part.schema.names else none for n in ANCHOR_FIELDS], ANCHOR_FIELDS)


ANCHOR_FIELDS = ["bucket", "kind", "run", "hash", "text_key", "place"]
ANCHOR_SCHEMA = "bucket int, kind int, run binary, hash binary, text_key binary, place binary"


def _cut(w: Windows, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("repeats")
        for b in batches:
            keys = b.column("text_key").to_numpy()
            for i, j, data, sizes in rolling.chunks(b.column("body")):
                values, units = w.units(data, sizes)
                hashes, place, _, _ = rolling.anchors(values, units, w.length, w.k)
                if not len(hashes):
                    continue
                ends = np.cumsum(units)
                text = np.searchsorted(ends, place, side="right")
                own = keys[i:j]
                first = np.zeros(len(own), bool)
                first[np.unique(own, return_index=True)[1]] = True
                kept = first[text]  # copies in this piece add nothing
                hashes, place, text = hashes[kept], place[kept], text[kept]
                order = np.argsort(hashes, kind="stable")
                cuts = rolling.groups(hashes[order])
                several = np.diff(cuts) > 1
                if w.across:
                    t = text[order]
                    several &= np.minimum.reduceat(t, cuts[:-1]) != np.maximum.reduceat(t, cuts[:-1])
                marks = np.repeat(np.where(several, PASSED, PLAIN), np.diff(cuts))
                marks[cuts[:-1][several]] = KNOWN
                kind = np.empty(len(order), np.int64)
                kind[order] = marks
                fields = {"hash": _narrow(hashes), "text_key": own[text], "place": (place - (ends - units)[text]).astype(np.uint32)}
                bucket = (hashes >> np.uint64(40)).astype(np.int64) % buckets
                for k in (PLAIN, KNOWN, PASSED):
                    mine = kind == k
                    if not mine.any():
                        continue
                    part = {n: v[mine] for n, v in fields.items() if n != "hash" or k != PASSED}
                    yield _ordered(part, bucket[mine] if k != PASSED else np.full(mine.sum(), int(hashes[0] % np.uint64(buckets))), k)

    return run


def by_text(fields: dict[str, np.ndarray], key: str = "text_key") -> pa.RecordBatch:
    """A row per text with its values packed."""
    order = np.argsort(fields[key], kind="stable")
    cuts = rolling.groups(fields[key][order])
    columns = [pa.array(fields[key][order][cuts[:-1]])] + [rolling.packed(v[order], cuts) for n, v in fields.items() if n != key]
    return pa.RecordBatch.from_arrays(columns, [key, *(n for n in fields if n != key)])


def for_texts(fields: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Packed values on their way back to their texts: a row per bucket of texts."""
    order = np.argsort(fields["text_key"], kind="stable")
    keys = fields["text_key"][order]
    part = bucketed({n: v[order] for n, v in fields.items()}, (keys >> 7) % buckets, 0, ("text_key",))
    return part.select([n for n in part.schema.names if n != "kind"])


def gathered(sent: DataFrame, kinds: dict[str, str], buckets: int) -> DataFrame:
    """One row per text with its values packed, from the rows of `for_texts`; kinds: name and numpy type of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(unrolled(b, "text_key"), *(rolling.unpacked(b.column(n), t) for n, t in kinds.items())) for b in batches if b.num_rows]
        if parts:
            keys, *values = (np.concatenate(x) for x in zip(*parts))
            yield by_text({"text_key": keys} | dict(zip(kinds, values)))

    return sent.repartitionById(buckets, "bucket").mapInArrow(trimmed(run), "text_key long, " + ", ".join(f"{n} binary" for n in kinds))


def sent_schema(names: list[str]) -> str:
    return "bucket int, run binary, text_key binary, " + ", ".join(f"{n} binary" for n in names)


def _hits(w: Windows, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b in batches:
            for kind in (PLAIN, KNOWN, PASSED):
                part = b.filter(pa.array(b.column("kind").to_numpy() == kind))
                if not part.num_rows:
                    continue
                keys, place = unrolled(part, "text_key"), rolling.unpacked(part.column("place"), "<u4")
                if kind == PASSED:
                    yield for_texts({"text_key": keys, "place": place}, buckets)
                else:
                    hashes = _widened(part.column("hash"))
                    parts.append((hashes, keys, place, np.full(len(keys), kind == KNOWN)))
        if not parts:
            return
        hashes, keys, place, known = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(hashes, kind="stable")
        cuts = rolling.groups(hashes[order])
        k = keys[order] if w.across else keys[order] ^ (place[order].astype(np.int64) * 0x9E3779B97F4A7C1)
        repeated = np.maximum.reduceat(known[order], cuts[:-1]) | (np.minimum.reduceat(k, cuts[:-1]) != np.maximum.reduceat(k, cuts[:-1]))
        found = order[np.repeat(repeated, np.diff(cuts))]
        if len(found):
            yield for_texts({"text_key": keys[found], "place": place[found]}, buckets)

    return run


def candidates(source: DataFrame, w: Windows) -> tuple[DataFrame, np.ndarray]:
    """Rows of `source` whose text has copies or hits, and the filter of their keys; all other rows lose nothing.

    Added columns: `first` (the smallest id of the text) and `hits` (packed places of anchors), null in rows that only
    seemed to be in the filter.
    """
    n = buckets_of(source)
    cut = source.select("text_key", "body").mapInArrow(trimmed(_cut(w, n)), ANCHOR_SCHEMA)
    hits = cut.repartitionById(n, "bucket").mapInArrow(trimmed(_hits(w, n)), sent_schema(["place"]))
    of_text = gathered(hits, {"place": "<u4"}, n).withColumnRenamed("place", "hits")
    firsts = source.groupBy("text_key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    known = step(firsts.join(of_text, "text_key", "left").where("copies > 1 OR hits IS NOT NULL").drop("copies"), "texts")
    bits = key_filter(known)
    return rows_in(source, bits, True).join(known, "text_key", "left"), bits


def covered(places: np.ndarray, length: int, n: int) -> np.ndarray:
    """Units of a text of n that lie in a window starting at one of the places."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, np.minimum(places + length, n), -1)
    return np.cumsum(edge[:-1]) > 0
