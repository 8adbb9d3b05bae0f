"""Approximate nearest neighbours by NN-descent and greedy graph search.

Every distinct usable vector is a node (its smallest vec_id); copies are members of the node, so a vector that a third
of the rows share is one node. Graph building:

1. Start: in several random projections the nodes are sorted and each run of `RUN` neighbours is compared in full.
2. Descent: each node meets its neighbours and (a bounded number of) nodes that have it as a neighbour. Inside such a
   meeting all pairs, neighbours of neighbours of each other, are compared, and a node is told of those closer than its
   farthest neighbour. A round is a join (meetings with vectors), a grouping by meeting and a grouping by node.
3. The search graph joins the neighbours of both directions, with their vectors beside them.

A query starts at its own node. In each hop the nearest open nodes of its beam are expanded by a join with the search
graph, until the beam has no open node. Graph and hops use vectors rounded to 8 bits per component, each on its own scale;
what ends in the beam is measured again in double precision on the original vectors, members are added, and the nearest
are returned, ties to the smaller vec_id.

Vectors that are null, all zero, hold a null or non-finite component, or have another length than most (the larger
length in a tie) take no part, neither as query nor as candidate. A repeated vec_id is one row (one of its vectors).
Fewer candidates than asked give fewer rows; an empty table gives none. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txlens.llm import rolling
from txlens.llm.common import partitions, step

#: Neighbours of a node, nodes pointing at it that join a meeting, and what a meeting tells a node at most.
DEGREE, REVERSE, TOLD = 24, 24, 16
#: Random orders of the start, and nodes compared in full.
ORDERS, RUN = 12, 256
ROUNDS = 4
#: Nodes that a query keeps, and that it expands per hop.
BEAM, STEP = 400, 100
FOUND = "query_id long, rank int, vec_id long, score double"
GRAPH = "node long, ids binary, dist binary"


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): vectors that take part, in double precision."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.where(F.size("v") == (size.n if size else 0)).dropDuplicates(["vec_id"])


def _merge(parts: list[tuple[np.ndarray, np.ndarray]], own: int, degree: int) -> tuple[np.ndarray, np.ndarray]:
    ids, dist = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((ids, dist))
    ids, dist = ids[order], dist[order]
    keep = np.zeros(len(ids), bool)
    keep[np.unique(ids, return_index=True)[1]] = True
    keep &= ids != own
    return ids[keep][:degree], dist[keep][:degree]


def _merged(degree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dist = [], []
            for node, lists in zip(b.column("node").to_pylist(), b.column("lists")):
                i, d = _merge([(np.frombuffer(x["ids"].as_py(), "<i8"), np.frombuffer(x["dist"].as_py(), "<f4")) for x in lists], node, degree)
                ids.append(i.tobytes())
                dist.append(d.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(ids, pa.binary()), pa.array(dist, pa.binary())], ["node", "ids", "dist"])

    return run


def merge(lists: DataFrame, degree: int = DEGREE) -> DataFrame:
    """The nearest of all lists of a node."""
    return lists.groupBy("node").agg(F.collect_list(F.struct("ids", "dist")).alias("lists")).mapInArrow(_merged(degree), GRAPH)


def _coded(x: np.ndarray) -> list[bytes]:
    """Rows rounded to 127 steps of their own, behind the step as a float."""
    step_of = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / np.where(step_of > 0, step_of, 1)[:, None]).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(np.minimum(step_of, np.finfo("<f4").max).astype("<f4"), codes)]


def _decoded(raw: bytes, rows: int) -> np.ndarray:
    both = np.frombuffer(raw, np.uint8).reshape(rows, -1)
    return both[:, 4:].view(np.int8) * np.ascontiguousarray(both[:, :4]).view("<f4")


def _matrix(column: pa.Array) -> np.ndarray:
    """Rounded vectors of a binary column, one per row."""
    return _decoded(b"".join(column.to_pylist()), len(column))


def _squared(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        n = (x * x).sum(axis=1)
        d = np.maximum(n[:, None] + n[None, :] - 2 * (x @ x.T), 0)
    return np.where(np.isnan(d), np.float32(np.inf), d)


def _compare(node: np.ndarray, x: np.ndarray, degree: int) -> tuple[list[bytes], list[bytes]]:
    d = _squared(x)
    np.fill_diagonal(d, np.inf)
    k = min(degree, len(node) - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(node), 0), np.int64)
    return [node[n].tobytes() for n in near], [d[i, n].astype(np.float32).tobytes() for i, n in enumerate(near)]


def _ordered(dimensions: int):
    axes = np.random.default_rng(3).standard_normal((dimensions, ORDERS)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            at = _matrix(b.column("q")) @ axes
            for t in range(ORDERS):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(at[:, t].astype(np.float64)), b.column("node"), b.column("q")], ["order", "at", "node", "q"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def compared(order: int, node: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        ids, dist = _compare(node, x, DEGREE)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(ids, pa.binary()), pa.array(dist, pa.binary())], ["node", "ids", "dist"])

    held: tuple[int, np.ndarray, np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        order, node, x = b.column("order").to_numpy(), b.column("node").to_numpy(), _matrix(b.column("q"))
        for a, z in zip((cuts := rolling.groups(order))[:-1], cuts[1:]):
            part = (int(order[a]), node[a:z], x[a:z])
            if held and held[0] == part[0]:
                part = (part[0], np.concatenate([held[1], part[1]]), np.concatenate([held[2], part[2]]))
            elif held:
                yield compared(*held)
            o, n, v = part
            while len(n) >= 2 * RUN:
                yield compared(o, n[:RUN], v[:RUN])
                n, v = n[RUN:], v[RUN:]
            held = (o, n, v)
    if held:
        yield compared(*held)


def edges(graph: DataFrame) -> DataFrame:
    """(node, other, dist) rows of a graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(x.as_buffer()) // 8 for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(b.column("node").to_numpy(), n)), pa.array(rolling.unpacked(b.column("ids"), "<i8")), pa.array(rolling.unpacked(b.column("dist"), "<f4"))], ["node", "other", "dist"])

    return graph.mapInArrow(run, "node long, other long, dist float")


def meetings(graph: DataFrame, reverse: int) -> DataFrame:
    """(node, other): neighbours and the nearest nodes that have the node as neighbour."""
    forward = edges(graph)
    back = forward.select(F.col("other").alias("node"), F.col("node").alias("other"), "dist")
    first = Window.partitionBy("node").orderBy("dist", "other")
    back = back.withColumn("no", F.row_number().over(first)).where(F.col("no") <= reverse)
    return forward.select("node", "other").union(back.select("node", "other")).distinct()


def _flat(met: pa.Array, extra: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(cuts, others, vectors, extra field) of a column of meetings."""
    values = met.flatten()
    cuts = met.offsets.to_numpy() - met.offsets[0].as_py()
    vectors = _matrix(values.field("q")) if len(values) else np.zeros((0, 1), np.float32)
    return cuts, values.field("other").to_numpy(), vectors, values.field(extra).to_numpy() if extra else None


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each member of a meeting learns: others closer than its farthest neighbour."""
    for b in batches:
        nodes, ids, dist = [], [], []
        cuts, others, vectors, limits = _flat(b.column("met"), "farthest")
        for i, j in zip(cuts[:-1], cuts[1:]):
            if j - i < 2:
                continue
            member, x, limit = others[i:j], vectors[i:j], limits[i:j]
            d = _squared(x)
            np.fill_diagonal(d, np.inf)
            d[d >= limit[:, None]] = np.inf
            near = np.argsort(d, axis=1)[:, :TOLD]
            for r in np.flatnonzero(np.isfinite(d[np.arange(len(member)), near[:, 0]])):
                n = near[r][np.isfinite(d[r, near[r]])]
                nodes.append(member[r])
                ids.append(member[n].tobytes())
                dist.append(d[r, n].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(ids, pa.binary()), pa.array(dist, pa.binary())], ["node", "ids", "dist"])


def _farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        far = [float(np.frombuffer(x.as_py(), "<f4")[-1]) if len(x.as_buffer()) // 4 >= DEGREE else float("inf") for x in b.column("dist")]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(far, pa.float32())], ["other", "farthest"])


def build(rounded: DataFrame, dimensions: int) -> DataFrame:
    """The search graph (node, ids, vectors) of rounded vectors (node, q)."""
    spark = rounded.sparkSession
    started = rounded.mapInArrow(_ordered(dimensions), "order int, at double, node long, q binary")
    started = started.repartitionByRange(partitions(spark), "order", "at").sortWithinPartitions("order", "at", "node")
    graph = step(merge(started.mapInArrow(_runs, GRAPH)), "graph")
    for _ in range(ROUNDS):
        known = rounded.withColumnRenamed("node", "other").join(graph.mapInArrow(_farthest, "other long, farthest float"), "other")
        met = meetings(graph, REVERSE).join(known, "other").groupBy("node").agg(F.collect_list(F.struct("other", "q", "farthest")).alias("met"))
        told = met.mapInArrow(_tell, GRAPH)
        graph = step(merge(graph.union(told)), "graph")
    around = meetings(graph, REVERSE).join(rounded.withColumnRenamed("node", "other"), "other")

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts, others, _, _ = _flat(b.column("met"))
            rows = b.column("met").flatten().field("q").to_pylist()
            ids = [others[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])]
            vectors = [b"".join(rows[i:j]) for i, j in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(ids, pa.binary()), pa.array(vectors, pa.binary())], ["node", "ids", "vectors"])

    grouped = around.groupBy("node").agg(F.collect_list(F.struct("other", "q")).alias("met"))
    return step(grouped.mapInArrow(beside, "node long, ids binary, vectors binary"), "search_graph")


STATE = "start long, q binary, ids binary, dist binary, open binary"


def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [np.array([n], np.int64).tobytes() for n in b.column("node").to_pylist()]
        zero, one = np.zeros(1, np.float32).tobytes(), np.ones(1, bool).tobytes()
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("q"), pa.array(ids, pa.binary()), pa.array([zero] * b.num_rows, pa.binary()), pa.array([one] * b.num_rows, pa.binary())], ["start", "q", "ids", "dist", "open"])


def _frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        start, node = [], []
        for s, ids, open_ in zip(b.column("start").to_pylist(), b.column("ids"), b.column("open")):
            first = np.frombuffer(ids.as_py(), "<i8")[np.frombuffer(open_.as_py(), bool)][:STEP]
            start += [s] * len(first)
            node += first.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(start, pa.int64()), pa.array(node, pa.int64())], ["start", "node"])


def _hop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The beam after its nearest open nodes have been expanded."""
    for b in batches:
        new_ids, new_dist, new_open = [], [], []
        for q, ids, dist, open_, met in zip(b.column("q"), b.column("ids"), b.column("dist"), b.column("open"), b.column("met")):
            ids, dist, open_ = np.frombuffer(ids.as_py(), "<i8"), np.frombuffer(dist.as_py(), "<f4"), np.frombuffer(open_.as_py(), bool).copy()
            open_[np.flatnonzero(open_)[:STEP]] = False
            if met.is_valid:
                q = _decoded(q.as_py(), 1)
                other = np.concatenate([np.frombuffer(m["ids"].as_py(), "<i8") for m in met])
                x = _decoded(b"".join(m["vectors"].as_py() for m in met), len(other))
                other, at = np.unique(other, return_index=True)
                fresh = ~np.isin(other, ids)
                other, x = other[fresh], x[at[fresh]]
                ids, dist, open_ = np.concatenate([ids, other]), np.concatenate([dist, ((x - q) ** 2).sum(axis=1)]), np.concatenate([open_, np.ones(len(other), bool)])
                best = np.lexsort((ids, dist))[:BEAM]
                ids, dist, open_ = ids[best], dist[best], open_[best]
            new_ids.append(ids.tobytes())
            new_dist.append(dist.astype(np.float32).tobytes())
            new_open.append(open_.tobytes())
        yield pa.RecordBatch.from_arrays([b.column("start"), b.column("q"), *(pa.array(x, pa.binary()) for x in (new_ids, new_dist, new_open))], ["start", "q", "ids", "dist", "open"])


def search(graph: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node) of the beams of the starting nodes (node, q)."""
    state = step(starts.mapInArrow(_begin, STATE), "beams")
    while True:
        frontier = step(state.mapInArrow(_frontier, "start long, node long"), "frontier")
        if frontier.isEmpty():
            break
        met = frontier.join(graph, "node").groupBy("start").agg(F.collect_list(F.struct("ids", "vectors")).alias("met"))
        state = step(state.join(met, "start", "left").mapInArrow(_hop, STATE), "beams")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(x.as_buffer()) // 8 for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("start").to_numpy(), n)), pa.array(rolling.unpacked(b.column("ids"), "<i8"))], ["start", "node"])

    return state.mapInArrow(members, "start long, node long")


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """The k nearest of each query: query_id, rank, vec_id, score. `is_query` is a condition on the column `vec_id`."""
    spark = vectors.sparkSession
    rows = step(usable(vectors, key, vector), "vectors")
    usual = rows.select(F.percentile_approx(F.array_max(F.transform("v", F.abs)), 0.5, 1000).alias("m"), F.max(F.size("v")).alias("n")).first()
    if not usual.n:
        return spark.createDataFrame([], FOUND)
    nodes = step(rows.groupBy("v").agg(F.min("vec_id").alias("node")), "nodes")
    placed = rows.join(nodes, "v").select("vec_id", "node")
    first = Window.partitionBy("node").orderBy("vec_id")
    members = step(placed.withColumn("no", F.row_number().over(first)).where(F.col("no") <= k + 1).select("node", "vec_id"), "members")

    size = usual.m

    def rounding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1)
            # steps relative to the usual size keep squares within single precision
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(_coded(x / size), pa.binary())], ["node", "q"])

    rounded = step(nodes.select("node", "v").mapInArrow(rounding, "node long, q binary"), "rounded")
    queries = placed.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("node").alias("start"))
    starts = rounded.join(queries.select(F.col("start").alias("node")).distinct(), "node")
    found = search(build(rounded, usual.n), starts)
    exact = found.join(nodes.select("node", "v"), "node").join(nodes.select(F.col("node").alias("start"), F.col("v").alias("w")), "start")
    distance = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    scored = exact.select("start", "node", distance.alias("score"))
    best = Window.partitionBy("start").orderBy("score", "node")
    scored = step(scored.withColumn("no", F.row_number().over(best)).where(F.col("no") <= k + 1).select("start", "node", "score"), "scored")
    pairs = queries.join(scored, "start").join(members, "node").where("vec_id != query_id")
    last = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
