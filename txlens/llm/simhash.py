"""SimHash fingerprints and their linking through pivot distance tables.

A fingerprint has a bit set if more than half of the text's shingle hashes have it. Distances to fixed reference
fingerprints (pivots) are computed once per distinct fingerprint. They serve twice. Restricted to some of the five
bit blocks, the distances to several pivots are the key of a bucket: two fingerprints that differ in at most two bits
agree on three of the five blocks, hence on every restricted distance of one of the ten choices of three, and meet in
that bucket. Inside a bucket the largest difference of any full pivot distance is a lower bound of the distance of two
fingerprints; pairs above the radius are discarded by it and survivors compared bit by bit.

A bucket of more than `crowded` fingerprints is not paired. Its members are written with each of the 65 values at
most one bit away; two fingerprints are at most two bits apart exactly if they share such a value, so linking all to
the smallest one of a value loses nothing and grows with the members, not their pairs.

Copies share a fingerprint and are one node, however many they are. Null and empty texts have fingerprint 0. Rows with
equal ids are linked like others. A null id is no candidate for the smallest id; a group of null ids alone has a null
component. An empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens.llm.common import worker_cache
from txlens.llm.components import components
from txlens.session import materialise

#: Seed of the shingle hash.
SEED = 42
#: Differing bits up to which fingerprints link; the blocks are made for it.
RADIUS = 2
BLOCKS = 5
#: Reference fingerprints: hashes of their numbers. The first KEYED make the bucket keys.
PIVOTS = np.array([xxhash.xxh64_intdigest(str(i).encode(), 7) for i in range(64)], dtype=np.uint64)
KEYED = 24
#: Distinct fingerprints of a bucket above which its members are not paired.
CROWDED = 64

_EDGES = np.linspace(0, 64, BLOCKS + 1).astype(int)
_BLOCK = [sum(1 << b for b in range(_EDGES[i], _EDGES[i + 1])) for i in range(BLOCKS)]
MASKS = np.array([sum(_BLOCK[i] for i in c) for c in combinations(range(BLOCKS), BLOCKS - RADIUS)], dtype=np.uint64)
_ODD = np.array([xxhash.xxh64_intdigest(str(i).encode(), 8) | 1 for i in range(KEYED)], dtype=np.uint64)


def shingles(words: list[bytes], n: int) -> list[bytes]:
    """Runs of n words joined by a space, repeats included; fewer words are one run, no words none."""
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return [b" ".join(s) for s in zip(*(words[i:] for i in range(n)))]


def hashes(text: bytes, n: int) -> np.ndarray:
    """Hashes of the shingles of a text, A-Z in lower case."""
    runs = shingles(text.lower().split(), n)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(r, SEED) for r in runs), np.uint64, len(runs))


def fingerprint(h: np.ndarray) -> int:
    """64 bits: those set in more than half of the hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i:i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the long columns `also`: fp as a signed 64-bit number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for b in batches:
            fp = np.array([fingerprint(hashes(t.as_py() or b"", n)) for t in b.column("body")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64)), *(b.column(c) for c in also)], ["doc_id", "fp", *also])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body"), *also)
    return rows.mapInArrow(make, ", ".join(f"{c} long" for c in ("doc_id", "fp", *also)))


def coordinates(fp: np.ndarray, pivots: np.ndarray = PIVOTS, mask: int = 2**64 - 1) -> np.ndarray:
    """Distances (rows: fingerprints, columns: pivots) counted over the bits of the mask."""
    return np.bitwise_count((fp[:, None] ^ pivots[None, :]) & np.uint64(mask))


def close_pairs(fp: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Pairs of places whose fingerprints differ in at most `radius` bits, as a forest: pairs already connected are left out."""
    table = coordinates(fp).astype(np.int8)
    reached = np.arange(len(fp))
    for i in range(len(fp) - 1):
        near = np.abs(table[i + 1:] - table[i]).max(axis=1) <= radius
        for j in np.flatnonzero(near) + i + 1:
            if reached[i] != reached[j] and int(fp[i] ^ fp[j]).bit_count() <= radius:
                reached[reached == reached[j]] = reached[i]
                yield i, j


def _bucket_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy().view(np.uint64)
        for no, mask in enumerate(MASKS):
            at = (coordinates(fp, PIVOTS[:KEYED], int(mask)).astype(np.uint64) * _ODD).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), no, np.int32)), pa.array(at.view(np.int64)), b.column("fp")], ["choice", "at", "fp"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, z = [], []
        for group in b.column("fps"):
            fp = np.array(group.as_py(), dtype=np.int64)
            for i, j in close_pairs(fp.view(np.uint64)):
                a.append(fp[i])
                z.append(fp[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])


def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate([[0], np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))]).astype(np.uint64)
    for b in batches:
        fp = b.column("fp").to_numpy()
        near = (fp.view(np.uint64)[:, None] ^ flips[None, :]).ravel().view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.repeat(fp, 65))], ["value", "fp"])


def links(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Edges (a, b) between fingerprints such that connection by edges is connection by links of at most two bits."""
    keyed = materialise(distinct.mapInArrow(_bucket_keys, "choice int, at long, fp long"), "buckets")
    sizes = materialise(keyed.groupBy("choice", "at").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    met = keyed.join(sizes, ["choice", "at"])
    paired = met.where(F.col("n") <= crowded).groupBy("choice", "at").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_pairs, "a long, b long")
    dense = met.where(F.col("n") > crowded).select("fp").distinct().mapInArrow(_ball, "value long, fp long")
    around = dense.groupBy("value").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("value", "a")
    starred = dense.join(around, "value").where("a != fp").select("a", F.col("fp").alias("b"))
    return paired.union(starred)


def groups(documents: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that can be reached by links of at most two bits."""
    marked = materialise(fingerprints(documents, key, text, n), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = components(links(nodes.select("fp")))
    named = nodes.join(found, nodes.fp == found.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = materialise(named, "named")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = materialise(named.join(smallest, "component").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")
