"""Vectors that are near copies of each other by cosine, found by cross-polytope hashing.

1. Equal vectors are one node with a weight, so a vector that a third of the rows share is hashed and compared once.
2. Every node is placed in the buckets of its probes in several tables (`polytope`). The hashes of a table grow with the
   logarithm of the nodes, so that a bucket of unrelated vectors stays small; the number of tables follows from the
   measured share of pairs at exactly the threshold that meet in one table, so that at most `MISSED` of them meet in none.
3. Members of a bucket are compared in full, in units of at most two blocks. A crowded bucket is cut in blocks by the hash
   of the node, and each pair of blocks is a unit of its own, on whatever task it falls; no member is left out.
4. A pair counts in the first bucket that both are placed in, so nothing is counted twice and no list of pairs exists. A
   unit hands on link counts per node and a forest of its links; components follow by contraction.

Every link is verified in double precision on the original vectors: none below the threshold is counted. Which links are
found is a matter of hashing; for pairs at the threshold the expected share is 1 - `MISSED`, closer ones are found more often.

Vectors that are null, empty or all zero, or hold a null or non-finite component link with nothing. Vectors of different
lengths never link. A row with a repeated id is a vector like any other, and rows with equal ids that link are both kept.
A null id is no candidate for the smallest id; rows with null ids alone have a null component and are kept. An empty
table gives an empty table. Only the id and vector columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens.llm import polytope
from txlens.llm.common import partitions, step
from txlens.llm.components import components

THRESHOLD = 0.9
#: Buckets of a node in one table, at most.
PROBES = 8
#: Share of pairs at exactly the threshold that may meet in no table.
MISSED = 0.002
#: Placements in a bucket of unrelated vectors, on average, above which tables get a hash more.
OCCUPANCY = 2048
#: Members of a block of a crowded bucket.
BLOCK = 1024
#: A vector held by more than this share of all rows is joined back by broadcast; there are fewer than 1 / HOT of them.
HOT = 0.001

UNIT = ["size", "bucket", "low", "high"]
#: Bits of a bucket number below the number of its table.
TABLE_AT = 54


def packed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, size, v): components as little-endian bytes, null where the vector takes no part."""
    single = vectors.schema[vector].dataType.simpleString() in ("array<float>", "void")
    kind = np.dtype("<f4" if single else "<f8")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("x")
            cuts = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
            # a null component arrives as NaN
            fine = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            some = np.concatenate([[0], np.cumsum(flat != 0)])
            use = (fine[cuts[1:]] == fine[cuts[:-1]]) & (some[cuts[1:]] > some[cuts[:-1]]) & np.asarray(lists.is_valid())
            raw = [flat[i:j].tobytes() if u else None for i, j, u in zip(cuts[:-1], cuts[1:], use)]
            size = np.where(use, np.diff(cuts), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(size), pa.array(raw, pa.binary())], ["vec_id", "size", "v"])

    element = "float" if single else "double"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{element}>").alias("x"))
    return rows.mapInArrow(pack, "vec_id long, size int, v binary")


def unit_vectors(raw: list[bytes], size: int) -> np.ndarray:
    """Rows of length one in double precision; large and small components are scaled before they are squared."""
    data = b"".join(raw)
    x = np.frombuffer(data, f"<f{len(data) // (len(raw) * size)}").reshape(len(raw), size).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def plan(nodes: int, size: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(depth, tables) for this many nodes of a length."""
    vertices = 2 * polytope.width(size)
    depth = 1
    while vertices**depth * OCCUPANCY < nodes * polytope.most_probes(depth, PROBES) and vertices ** (depth + 1) < 2**TABLE_AT:
        depth += 1
    share = min(polytope.meeting_share(size, threshold, depth, PROBES, pairs=1000), 0.999)
    return depth, max(1, math.ceil(math.log(MISSED) / math.log(1 - share)))


def placements(nodes: DataFrame, plans: dict[int, tuple[int, int]]) -> DataFrame:
    """(node, size, codes): the bucket numbers of a node, tables in order, each with the same number of probes."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("size").to_numpy()
            for size in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == size))
                depth, tables = plans[size]
                x = unit_vectors(part.column("v").to_pylist(), size).astype(np.float32)
                x = np.pad(x, ((0, 0), (0, polytope.width(size) - size)))
                codes = np.concatenate([polytope.probes(x, t, depth, PROBES) + (t << TABLE_AT) for t in range(tables)], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("size"), pa.array([c.tobytes() for c in codes], pa.binary())], ["node", "size", "codes"])

    return nodes.select("node", "size", "v").mapInArrow(place, "node long, size int, codes binary")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = np.array([len(c.as_buffer()) // 8 for c in b.column("codes")], np.int64)
        flat = np.frombuffer(b"".join(b.column("codes").to_pylist()), "<i8")
        node, size = np.repeat(b.column("node").to_numpy(), n), np.repeat(b.column("size").to_numpy(), n)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(size), pa.array(flat)], ["node", "size", "bucket"])


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each node's smallest known companion, flat) after linking i with j."""
    while True:
        a, z = label[i], label[j]
        if (a == z).all():
            return label
        np.minimum.at(label, np.maximum(a, z), np.minimum(a, z))
        while not (label[label] == label).all():
            label = label[label]


def _met_before(x: np.ndarray, y: np.ndarray, bucket: int, tables: int) -> np.ndarray:
    """Whether pairs of code rows share a bucket with a smaller number."""
    x, y = (c.reshape(len(c), tables, -1) for c in (x, y))
    found = np.zeros(len(x), bool)
    for t in range(min(tables, (bucket >> TABLE_AT) + 1)):
        found |= ((x[:, t, :, None] == y[:, t, None, :]) & (x[:, t, :, None] < bucket)).any(axis=(1, 2))
    return found


def _compare(unit: tuple, rows: pa.Table, tables: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(weight of links, label) of each member of a unit; labels are places in the unit."""
    size, bucket, low, high = unit
    x = unit_vectors(rows.column("v").to_pylist(), size)
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), "<i8").reshape(len(x), -1)
    weight = rows.column("weight").to_numpy()
    second = rows.column("second").to_numpy()
    left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if low != high else (np.arange(len(x)),) * 2
    links, label = np.zeros(len(x), np.int64), np.arange(len(x))
    for at in range(0, len(left), 128):
        i, j = np.nonzero(x[left[at:at + 128]] @ x[right].T >= threshold)
        i, j = left[at + i], right[j]
        if low == high:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 8192):
            a, z = i[k:k + 8192], j[k:k + 8192]
            new = ~_met_before(codes[a], codes[z], bucket, tables)
            a, z = a[new], z[new]
            np.add.at(links, a, weight[z])
            np.add.at(links, z, weight[a])
            label = merge_labels(label, a, z)
    return links, label


def verified(members: DataFrame, plans: dict[int, tuple[int, int]], threshold: float) -> DataFrame:
    """Rows (a, b, links): either a node and a weight of links, or an edge a - b of a forest of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(unit: tuple, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            links, label = _compare(unit, rows, plans[unit[0]][1], threshold)
            node = rows.column("node").to_numpy()
            some, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(label)))
            a = pa.array(np.concatenate([node[some], node[label[tied]]]))
            b = pa.array(np.concatenate([np.zeros(len(some), np.int64), node[tied]]), mask=np.arange(len(some) + len(tied)) < len(some))
            n = pa.array(np.concatenate([links[some], np.zeros(len(tied), np.int64)]))
            return pa.RecordBatch.from_arrays([a, b, n], ["a", "b", "links"])

        held: tuple[tuple, list[pa.RecordBatch]] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in UNIT])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:]):
                unit = tuple(keys[:, i].tolist())
                if held and held[0] != unit:
                    yield compared(*held)
                    held = None
                held = (unit, [*(held[1] if held else []), b.slice(i, j - i)])
        if held:
            yield compared(*held)

    return members.mapInArrow(run, "a long, b long, links long")


def links(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`verified` rows of nodes (node, size, v, weight)."""
    spark = nodes.sparkSession
    # one row per length of a vector
    plans = {r["size"]: plan(r["n"], r["size"], threshold) for r in nodes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not plans:
        return spark.createDataFrame([], "a long, b long, links long")
    placed = step(placements(nodes, plans), "placed")
    light = placed.mapInArrow(_exploded, "node long, size int, bucket long")
    sizes = step(light.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket_sizes")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int")
    met = light.join(sizes, ["size", "bucket"]).select("node", "size", "bucket", blocks.alias("blocks"), own.alias("own"))
    units = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("node", "size", "bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("second"))
    carried = nodes.select("node", "v", "weight").join(placed.select("node", "codes"), "node")
    members = units.join(carried, "node").repartition(partitions(spark), *UNIT).sortWithinPartitions(*UNIT)
    return step(verified(members.select(*UNIT, "second", "node", "weight", "v", "codes"), plans, threshold), "links")


def near_copies(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: links of each vector and the smallest id reachable by them."""
    rows = step(packed(vectors, key, vector), "vectors")
    apart = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where("v IS NOT NULL")
    grouped = rows.groupBy("size", "v").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"))
    # numbered as it is written, so the numbers stay
    nodes = step(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = links(nodes, threshold)
    counted = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    tied = components(found.where("b IS NOT NULL").select("a", "b"))
    named = step(nodes.join(tied, "node", "left").select("node", "v", "weight", "first", F.coalesce("component", "node").alias("component")), "named")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    known = named.join(smallest, "component").join(counted, F.col("node") == F.col("a"), "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("weight") - 1
    known = step(known.select("v", "weight", n_links.alias("n_links"), "component_id"), "known")
    total = known.agg(F.sum("weight")).first()[0] or 0
    marked = known.withColumn("hot", F.col("weight") > total * HOT).drop("weight")
    hot, usual = marked.where("hot").drop("hot"), marked.where("NOT hot").drop("hot")
    joined = rows.select("vec_id", "v").join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), "v", "left")
    columns = ["vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")]
    direct = joined.where("is_hot").select(*columns)
    others = joined.where("is_hot IS NULL").select("vec_id", "v").join(usual, "v").select(*columns)
    return direct.unionByName(others).unionByName(apart)
