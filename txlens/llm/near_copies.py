"""One document of each group of near copies: by SimHash, or by an exact join at a shingle similarity.

`keep_one_by_simhash`, which the pipeline runs, links texts as operator 10 does: 64-bit fingerprints over three-word
shingles that differ in at most two bits, found through buckets of pivot distances, every pair of the table. Texts
without words have fingerprint zero and are one group.

`keep_one` is wider and dearer; no query runs it. Two texts link if the Jaccard similarity of their sets of five-word
shingles is at least 0.8. At that similarity a 128-bit SimHash differs in 19 bits on average (standard deviation 4), so no number of bands that fits the disk finds
all pairs of a large table. Candidates therefore come from an exact join. All shingles have one order, rare ones first.
Two sets of similarity 0.8 share a shingle among the first fifth (and one) of each, their prefixes; in the bucket of
the first shingle they share, sizes and what both have left from there on bound their similarity. Pairs within the
bound are compared by their whole sets. All such pairs are found, whatever the size of the table; prefixes take 8 bytes
for each of a fifth of the shingles. In a bucket of more than
`crowded` texts each text meets leaders first; when these links are verified and joined to components, all pairs of the
bucket that fit and lie in different components are compared. A tight cluster costs a pair per member, a loose one up to
all its pairs.

Copies are one node. The document with the smallest id of a group stays (nulls last; for an id shared by different
texts the smaller text key). Of repeated rows one stays. Texts without words are copies of each other if equal. All
columns of kept rows are returned unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens.llm import repeats, rolling, simhash
from txlens.llm.common import buckets_of, id_order, step, worker_cache
from txlens.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
#: Of `bands`: bits of a fingerprint, and the chance that a pair at the least similarity meets.
BITS, MEETS = 128, 0.98
#: Entries of a bucket above which they meet leaders first.
CROWDED = 32
#: Texts sampled for the order of shingles; slots of shingle hashes, how often a common one is found, and how many are held.
SAMPLE, SLOT_BITS, COMMON, MOST_SLOTS = 20_000, 22, 12, 1 << 18
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """Two 64-bit halves from shingle hashes; zeros without shingles."""
    return np.array([simhash.fingerprint(h), simhash.fingerprint(rolling.mixed(h * _SECOND))], dtype=np.uint64)


def bands(n_texts: int, least: float = SIMILARITY) -> list[np.ndarray]:
    """Sampled bit places of each band."""
    cosine = 2 * least / (1 + least)
    agree = 1 - math.acos(cosine) / math.pi
    bits = max(8, math.ceil(math.log2(max(2, n_texts))) - 3)
    count = math.ceil(math.log(1 - MEETS) / math.log(1 - agree**bits))
    rng = np.random.default_rng(11)
    return [np.sort(rng.choice(BITS, bits, replace=False)) for _ in range(count)]


def slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def common_slots(source: DataFrame, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted slots of shingle hashes that many of a sample of about SAMPLE texts hold, and the logarithm of how many.

    They only put common shingles last in the order of shingles. Any order gives the same links.
    """
    part = max(1, n_texts // SAMPLE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            taken = b.filter(pa.array((b.column("text_key").to_numpy() >> 5) % part == 0))
            found = [np.unique(slots(simhash.hashes(t.as_py(), SHINGLE))) for t in taken.column("body")]
            if found:
                at, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["slot", "n"])

    counted = source.select("text_key", "body").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "slot").limit(MOST_SLOTS).toPandas()
    at, n = found["slot"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    order = np.argsort(at)
    return at[order], np.log2(n[order]).astype(np.int64)


def prefix(h: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The first shingles of a set in the order of all shingles: two sets as similar as `least` share one of them."""
    level = np.zeros(len(h), np.int64)
    if len(common[0]):
        s = slots(h)
        at = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
        level = np.where(common[0][at] == s, common[1][at], 0)
    return h[np.lexsort((h, level))][:len(h) - math.ceil(least * len(h) - 1e-9) + 1] if len(h) else h


def _prefixes(common: tuple[np.ndarray, np.ndarray], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near_copies")
        for b in batches:
            sets = [np.unique(simhash.hashes(t.as_py(), SHINGLE)) for t in b.column("body")]
            first = pa.array([prefix(h, common, least).tobytes() for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), pa.array([len(h) for h in sets], pa.int32()), first], ["id", "text_key", "size", "prefix"])

    return run


def _entries(buckets: int, wanted: np.ndarray | None = None):
    """An entry per shingle of a prefix, packed by bucket; with a filter of wanted shingles, beside the component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.array([len(x.as_buffer()) // 8 for x in b.column("prefix")], np.int64)
            if not n.sum():
                continue
            keys = rolling.unpacked(b.column("prefix"), "<u8")
            at = np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)
            size = np.repeat(b.column("size").to_numpy(), n).astype(np.int32)
            fields = {"key": keys, "node": np.repeat(b.column("text_key").to_numpy(), n), "size": size, "left": (size - at).astype(np.int32)}
            if wanted is not None:
                kept = repeats.in_filter(keys.view(np.int64), wanted)
                fields = {name: values[kept] for name, values in (fields | {"component": np.repeat(b.column("component").to_numpy(), n)}).items()}
                if not kept.any():
                    continue
            yield repeats.bucketed(fields, (rolling.mixed(fields["key"]) >> np.uint64(40)).astype(np.int64) % buckets, 0)

    return run


def _fit(size: np.ndarray, left: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Pairs that may reach the similarity if the shingle of this bucket is the first they share.

    They share at most what either has left, from this shingle on. Similar pairs fit in the bucket of their first one.
    """
    return np.minimum(left[i], left[j]) * (1 + least) >= least * (size[i].astype(np.int64) + size[j]) - 1e-6


def _led(size: np.ndarray, left: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a leader and entries that fit it; entries are in order of size, each is led once at most."""
    far = np.searchsorted(size, left * (1 + least) / least - size + 1e-6, side="right")
    led = np.zeros(len(size), bool)
    for i in np.flatnonzero(far > np.arange(1, len(size) + 1)):
        if led[i]:
            continue
        j = np.arange(i + 1, far[i])
        j = j[~led[j]]
        j = j[_fit(size, left, np.full(len(j), i), j, least)]
        led[j] = True
        yield np.full(len(j), i), j


PAIRS = "a long, b long"
#: Pairs of a batch on their way out.
PAIR_ROWS = 1 << 20
KINDS = (("key", "<u8"), ("node", "<i8"), ("size", "<i4"), ("left", "<i4"))


def _by_key(batches: Iterator[pa.RecordBatch], kinds: tuple[tuple[str, str], ...], more: int) -> list[np.ndarray] | None:
    """Fields of entries whose shingle has more than so many entries, in order of shingle, size and node."""
    parts = [[rolling.unpacked(b.column(n), t) for n, t in kinds] for b in batches if b.num_rows]
    if not parts:
        return None
    fields = [np.concatenate(x) for x in zip(*parts)]
    parts.clear()
    key, node, size = fields[:3]
    order = np.argsort(key, kind="stable")
    sizes = np.diff(rolling.groups(key[order]))
    order = order[np.repeat(sizes > more, sizes)]
    order = order[np.lexsort((node[order], size[order], key[order]))]
    return [f[order] for f in fields] if len(order) else None


def _unique_pairs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    found = np.column_stack([np.concatenate(x) for x in zip(*pairs)])
    return np.unique(np.sort(found, axis=1), axis=0)


def _meet(least: float, crowded: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = _by_key(batches, KINDS, 1)
        if fields is None:
            return
        key, node, size, left = fields
        cuts = rolling.groups(key)
        sizes = np.diff(cuts)
        of = np.repeat(sizes, sizes)
        pairs = []
        for shift in range(1, min(crowded, int(sizes.max()))):
            i = np.flatnonzero((key[:-shift] == key[shift:]) & (of[:-shift] <= crowded))
            i = i[_fit(size, left, i, i + shift, least)]
            pairs.append((node[i], node[i + shift]))
        open_keys = []
        for a, z in zip(cuts[:-1][sizes > crowded], cuts[1:][sizes > crowded]):
            own = slice(a, z)
            led = [(node[own][i], node[own][j]) for i, j in _led(size[own], left[own], least)]
            if led:
                pairs += led
                open_keys.append(key[a])
        found = _unique_pairs(pairs) if pairs else np.zeros((0, 2), np.int64)
        none = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), none], ["a", "b", "text_key"])
        none = pa.nulls(len(open_keys), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(np.array(open_keys, np.uint64).view(np.int64))], ["a", "b", "text_key"])

    return run


def _apart(least: float, crowded: int):
    """All pairs of crowded buckets that fit and that the links to leaders leave in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = _by_key(batches, (*KINDS, ("component", "<i8")), crowded)
        if fields is None:
            return
        key, node, size, left, component = fields

        def rows(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            found = _unique_pairs(pairs)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])

        pairs, held = [], 0
        cuts = rolling.groups(key)
        for a, z in zip(cuts[:-1], cuts[1:]):
            s, own, c = size[a:z], left[a:z], component[a:z]
            names, counts = np.unique(c, return_counts=True)
            largest = c == names[counts.argmax()]
            low = np.searchsorted(s, least * s - 1e-6)
            high = np.searchsorted(s, own * (1 + least) / least - s + 1e-6, side="right")
            for i in np.flatnonzero(~largest & (low < high)):
                j = np.arange(low[i], high[i])
                j = j[(c[j] != c[i]) & (largest[j] | (j > i))]
                j = j[_fit(s, own, np.full(len(j), i), j, least)]
                if len(j):
                    pairs.append((np.full(len(j), node[a + i]), node[a + j]))
                    held += len(j)
                if held >= PAIR_ROWS:
                    yield rows(pairs)
                    pairs, held = [], 0
        if pairs:
            yield rows(pairs)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.unique(simhash.hashes(t.as_py(), SHINGLE)).tobytes() for t in b.column("body")]
        yield pa.RecordBatch.from_arrays([b.column("text_key"), pa.array(sets, pa.binary())], ["text_key", "shingles"])


def _similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("of_a"), b.column("of_b")):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= least * (len(x) + len(y) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(source: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """Pairs whose whole sets of shingles are similar."""
    wanted = pairs.select(F.col("a").alias("text_key")).union(pairs.select("b")).distinct()
    wanted = step(nodes.select("text_key", "first").join(wanted, "text_key"), "wanted")
    texts = repeats.rows_in(source.select("text_key", "id", "body"), repeats.key_filter(wanted), True).join(wanted, "text_key").where("id = first")
    sets = step(texts.mapInArrow(_sets, "text_key long, shingles binary").dropDuplicates(["text_key"]), "sets")
    left = pairs.join(sets.select(F.col("text_key").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = left.join(sets.select(F.col("text_key").alias("b"), F.col("shingles").alias("of_b")), "b")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(_similar(least), PAIRS)


def links(source: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Nodes (text_key, first id) and verified links (a, b) of a keyed table (see `repeats.keyed`)."""
    n = buckets_of(source)
    common = common_slots(source, source.count())
    first = source.select("id", "text_key", "body").mapInArrow(_prefixes(common, least), "id long, text_key long, size int, prefix binary")
    nodes = step(first.groupBy("text_key").agg(F.min("id").alias("first"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("copies")), "nodes")
    packed = "bucket int, kind int, key binary, node binary, size binary, left binary"
    prefixes = nodes.select("text_key", "size", "prefix")
    met = step(prefixes.mapInArrow(_entries(4 * n), packed).repartition(n, "bucket").mapInArrow(_meet(least, CROWDED), f"{PAIRS}, text_key long"), "met")
    pairs = step(met.where("text_key IS NULL").select("a", "b").distinct(), "pairs")
    linked = _verified(source, nodes, pairs, least)
    crowded = met.where("text_key IS NOT NULL").select("text_key")
    if not crowded.isEmpty():
        linked = step(linked, "linked")
        named = components(linked).select(F.col("node").alias("text_key"), "component")
        placed = prefixes.join(named, "text_key", "left").withColumn("component", F.coalesce("component", "text_key"))
        apart = placed.mapInArrow(_entries(4 * n, repeats.key_filter(crowded)), f"{packed}, component binary")
        apart = apart.repartition(n, "bucket").mapInArrow(_apart(least, CROWDED), PAIRS).distinct()
        linked = linked.union(_verified(source, nodes, step(apart.join(pairs, ["a", "b"], "left_anti"), "apart"), least))
    return nodes.select("text_key", "first", "copies"), linked


def _one_of_each(documents: DataFrame, named: DataFrame, key: str, text: str) -> DataFrame:
    """The documents with one row of each component; named: each text (text_key) with its first id, copies and component."""
    group = named.groupBy("component").agg(F.min(F.struct("first", "text_key")).alias("kept"), F.sum("copies").alias("members"))
    kept = step(group.where("members > 1").select("kept.first", "kept.text_key", "component"), "kept")
    touched = repeats.key_filter(named.join(kept.select("component"), "component", "left_semi"))
    alone = named.join(kept.select("component"), "component", "left_anti").select("text_key", "first")
    # of texts that only seem to be in the filter, whole rows are shuffled; of the others only what stays
    own = F.xxhash64("text_key", "first").alias("row_key")
    seeming = repeats.rows_in(alone, touched, True)
    staying = step(kept.select("text_key", "first").union(seeming).withColumn("row_key", own), "staying")
    wanted = repeats.key_filter(staying.select(F.col("row_key").alias("text_key")))
    # one struct column carries the row, so no name of the documents can clash
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), id_order(F.col(f"`{key}`")).alias("first"), F.xxhash64(body).alias("text_key"))
    met = repeats.rows_in(repeats.rows_in(rows, touched, True).withColumn("row_key", own), wanted, True, "row_key")
    one = met.join(staying.select("text_key", "first"), ["text_key", "first"]).groupBy("text_key").agg(F.first("row").alias("row"))
    return repeats.rows_in(rows, touched, False).select("row.*").union(one.select("row.*"))


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The documents without near copies, by shingle similarity, of a kept one, with all their columns."""
    nodes, linked = links(repeats.keyed(documents, key, text), least)
    found = components(linked)
    named = nodes.join(found, nodes.text_key == found.node, "left").select("text_key", "first", "copies", F.coalesce("component", "text_key").alias("component"))
    return _one_of_each(documents, step(named, "named"), key, text)


def keep_one_by_simhash(documents: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """The documents with one of each group of linked SimHash fingerprints (see `simhash.links`), with all their columns."""
    marked = simhash.fingerprints(repeats.keyed(documents, key, text), "id", "body", n, also=("text_key",))
    nodes = step(marked.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.count(F.lit(1)).alias("copies")), "nodes")
    found = components(simhash.links(nodes.select("fp").distinct()))
    named = nodes.join(found, nodes.fp == found.node, "left").select("text_key", "first", "copies", F.coalesce("component", "fp").alias("component"))
    return _one_of_each(documents, step(named, "named"), key, text)
