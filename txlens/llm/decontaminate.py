"""Benchmark items that occur in documents, by SimHash over item-sized windows.

Words are runs of letters and digits in lower case; punctuation and white space only part them. A window has as many
words as the item. Both are weighted sets of five-word shingles (an item below five words is one shingle of all its
words). A window can reach the similarity (sum of least weights over sum of largest) only if it holds at least that
share of the item's shingles, so windows with fewer of them are never fingerprinted; this bound is exact. The others
get a 128-bit SimHash. Item fingerprints are indexed by 40 blocks of bits: fingerprints within 39 bits agree on at
least one whole block, so the index finds every pair within that radius (five standard deviations above the expected
distance at similarity 0.8). Candidates are verified by the exact weighted similarity.

Items go to the tasks in blocks of at most `block_items`, so what is sent has a fixed bound; a larger benchmark takes
more passes over the documents. Documents are never shuffled: an item in a third of all documents is found in each of
them where it lies.

Null and empty texts and items have no words and match nothing. Repeated documents each give their rows, repeated items
(other ids) too. Items with a null id are found with a null item_id. Of several windows the most similar one is
returned, the first in a tie. An empty table on either side gives no rows. Columns other than id and text are not read,
and `without_matches` hands all columns on unchanged.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens.llm import rolling

SHINGLE, SIMILARITY = 5, 0.8
BITS, RADIUS = 128, 39
#: Items sent to the tasks at once.
BLOCK_ITEMS = 20_000
MATCH = "doc_id long, item_id long, start int, n_words int, similarity double, passage string"

_PARTS = np.array([not (chr(i).isascii() and not chr(i).isalnum()) for i in range(256)])
#: Every byte outside letters, digits and non-ASCII becomes a space.
_SPACED = np.where(_PARTS, np.arange(256), 0x20).astype(np.uint8)
_SECOND = np.uint64(0x9E3779B97F4A7C15)
_CUTS = np.linspace(0, BITS, RADIUS + 2).astype(int)


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.string()).fill_null("")).cast(pa.binary())


def simhash(h: np.ndarray) -> int:
    """128 bits: those set in more than half of the hashes, each repeat counted."""
    wide = np.column_stack([h, rolling.mixed(h * _SECOND)]).astype("<u8")
    ones = np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def blocks(fp: int) -> list[tuple[int, int]]:
    return [(i, (fp >> int(a)) & ((1 << int(z - a)) - 1)) for i, (a, z) in enumerate(zip(_CUTS[:-1], _CUTS[1:]))]


def similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class Items:
    """Fingerprints, shingles and block index of a block of items."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids, self.words, self.size, self.bags, self.prints = [], [], [], [], []
        self.index: dict[tuple[int, int], set[int]] = defaultdict(set)
        by_shingle: dict[tuple[int, int], set[int]] = defaultdict(set)
        for item_id, text in rows:
            data = _SPACED[np.frombuffer(_lower(pa.array([text], pa.string()))[0].as_py(), np.uint8)]
            hashes, _, _ = rolling.words(data)
            if not len(hashes):
                continue
            n, k = len(hashes), min(SHINGLE, len(hashes))
            at = np.arange(n - k + 1)
            h = rolling.spans_hash(hashes, at, at + k)
            no = len(self.ids)
            self.ids.append(item_id)
            self.words.append(n)
            self.size.append(k)
            self.bags.append(Counter(h.tolist()))
            self.prints.append(simhash(h))
            for block in blocks(self.prints[-1]):
                self.index[block].add(no)
            for x in set(h.tolist()):
                by_shingle[k, x].add(no)
        self.lookup = {}
        for k in {k for k, _ in by_shingle}:
            keys = np.array(sorted(x for s, x in by_shingle if s == k), np.uint64)
            quick = np.zeros(1 << 20, bool)
            quick[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.lookup[k] = keys, quick, [sorted(by_shingle[k, int(x)]) for x in keys]

    def near(self, fp: int) -> set[int]:
        """Items within the radius of a fingerprint."""
        found = set().union(*(self.index.get(b, ()) for b in blocks(fp)))
        return {i for i in found if (self.prints[i] ^ fp).bit_count() <= RADIUS}

    def best(self, h: np.ndarray, no: int, at: np.ndarray, least: float) -> tuple[int, float] | None:
        """(start, similarity) of the best window for an item, given a text's shingle hashes and where they are the item's."""
        width = self.words[no] - self.size[no] + 1
        need = int(np.ceil(least * sum(self.bags[no].values()) - 1e-9))
        if len(at) < need:
            return None
        mine = np.zeros(len(h) + 1, np.int32)
        mine[at + 1] = 1
        counts = np.cumsum(mine)
        last = max(0, len(h) - width)
        starts = np.unique(np.clip(at[:, None] - np.arange(width)[None, :], 0, last))
        starts = starts[counts[np.minimum(starts + width, len(h))] - counts[starts] >= need]
        top = None
        for s in starts.tolist():
            window = h[s:s + width]
            if no not in self.near(simhash(window)):
                continue
            value = similarity(Counter(window.tolist()), self.bags[no])
            if value >= least and (top is None or value > top[1]):
                top = s, value
        return top

    def find(self, texts: pa.Array, least: float) -> Iterator[tuple[int, int | None, int, int, float, str]]:
        """(row, item id, first word, words, similarity, passage) of each match."""
        bodies = _lower(texts)
        for i, _, data, sizes in rolling.chunks(bodies):
            spaced = np.insert(_SPACED[data], np.cumsum(sizes), 0x20)
            hashes, starts, ends = rolling.words(spaced)
            firsts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes + 1)]))
            for k, (keys, quick, items) in self.lookup.items():
                at = np.arange(max(0, len(hashes) - k + 1))
                h = rolling.spans_hash(hashes, at, at + k)
                some = np.flatnonzero(quick[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                place = np.minimum(np.searchsorted(keys, h[some]), len(keys) - 1)
                hit = keys[place] == h[some]
                some, place = some[hit], place[hit]
                row = np.searchsorted(firsts, some, side="right") - 1
                inside = some + k <= firsts[row + 1]
                some, place, row = some[inside], place[inside], row[inside]
                cuts = rolling.groups(row)
                for a, z in zip(cuts[:-1], cuts[1:]):
                    r = int(row[a])
                    first, end = firsts[r], firsts[r + 1]
                    by_item: dict[int, list[int]] = defaultdict(list)
                    for p, q in zip(some[a:z].tolist(), place[a:z].tolist()):
                        for no in items[q]:
                            by_item[no].append(p - first)
                    for no, where in by_item.items():
                        top = self.best(h[first:end - k + 1], no, np.array(where), least)
                        if top:
                            n = min(self.words[no], int(end - first) - top[0])
                            w = first + top[0]
                            yield i + r, self.ids[no], top[0], n, top[1], spaced[starts[w]:ends[w + n - 1]].tobytes().decode(errors="replace")


def item_blocks(items: DataFrame, key: str, text: str, block_items: int) -> Iterator[list[tuple]]:
    """The items, a bounded number at a time."""
    numbered = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text"))
    block = []
    for r in numbered.toLocalIterator():
        block.append((r.item_id, r.text))
        if len(block) == block_items:
            yield block
            block = []
    if block:
        yield block


def matches(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """A row per document and item that it holds: ids, place and words of the best window, similarity, passage (lower case)."""
    source = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def finder(rows: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(rows)
            for b in batches:
                ids = b.column("doc_id")
                found = [(ids[r].as_py(), *rest) for r, *rest in known.find(b.column("text"), least)]
                columns = zip(*found) if found else [[]] * 6
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "start", "n_words", "similarity", "passage"])

        return run

    result = documents.sparkSession.createDataFrame([], MATCH)
    for rows in item_blocks(items, item_key, item_text, block_items):
        result = result.union(source.mapInArrow(finder(rows), MATCH))
    return result


def without_matches(documents: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", least: float = SIMILARITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    place = documents.columns.index(text)

    def keeper(rows: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(rows)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[list({r for r, *_ in known.find(b.column(place), least)})] = False
                yield b.filter(pa.array(keep))

        return run

    for rows in item_blocks(items, item_key, item_text, block_items):
        documents = documents.mapInArrow(keeper(rows), documents.schema)
    return documents
