"""Boosted trees fitted by Spark jobs: sums of gradients per bin, a learned side for missing values, early stop.

Inputs become one byte per feature: numeric ones by quantile edges, categorical and vocabulary codes as they are, 255 for
missing. Rows are kept in blocks of `ROWS`, feature by feature, so a pass reads few large values. A pass over the training
rows grows one level of a batch of trees: every task adds up gradients, curvatures and rows per (tree, node, feature, bin),
the sums meet by (tree, node, feature), and the best split is found there. Of two children only the one with fewer rows is
counted; the sums of the other are those of their parent less these, exactly, as sums are whole numbers. One candidate per
(tree, node, feature) reaches the driver, with the sums that the next level subtracts from: trees x nodes x features x 6 KB,
whatever the number of rows. Every split tries missing values on both sides; a categorical split is a set of codes, found in
the order of their mean gradients.

The trees of a batch share the gradients of the model so far; each sees its own share of rows and features, so a batch is a
step of the boosting and passes are few. After each batch the margins of the training rows are written, so no pass follows
earlier trees again. After some batches validation is measured for each batch (average precision, or squared error), and the
trees so far are written: a lost executor costs a pass, and a fit that was interrupted goes on from the last written block
when it is given the same folder, which holds the rows of two blocks and of two batches. Fitting ends when no batch of the
last `patience` trees was the best one, or at `rounds` trees; the best batch decides how many trees are used.

Trees are followed all at once (`Forest`): a tree's leaves are the bits of a word, a code of a feature strikes out the leaves
it cannot reach, in all trees by one look-up, and the leaf that is left is where the row ends.

Sums are whole numbers (gradients in steps of 2^-20), so the order of tasks does not change a tree. Quantile edges come from
at most `EDGE_ROWS` rows chosen by their hash, the one sample that is taken.

Rows with a null label take no part. A weight of null is 1. Without training rows, or with one class, the model is a
constant. Without validation rows of both classes all trees of `patience` are used.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txlens.operators import metrics as M
from txlens.session import new_dir

#: Code of a missing value, and rows that quantile edges are taken from.
MISSING, EDGE_ROWS = 255, 50_000
#: Steps of a gradient.
UNIT = float(1 << 20)
#: Trees of a batch and batches of a block.
BATCH, BLOCK = 10, 5
#: Rows of a block of inputs, bytes of a Parquet row group and of an Arrow batch of blocks.
ROWS, GROUP_BYTES, ARROW_BYTES = 8192, 4 << 20, 8 << 20
#: Rows of (tree, node, feature) that a task of the second stage finds splits for.
SPLITS_PER_TASK = 100

# Fixed values
ROUNDS, PATIENCE = 600, 100
RATE, DEPTH, MIN_ROWS = 0.03, 4, 20
FEATURE_SHARE, ROW_SHARE = 0.8, 0.8
L2, CATEGORY_SMOOTH = 1.0, 10.0
SEED = 7


@dataclass(frozen=True)
class Settings:
    """`rounds` bounds the trees; `patience` trees without a better batch end the fit."""

    rounds: int = ROUNDS
    patience: int = PATIENCE
    depth: int = DEPTH
    rate: float = RATE
    min_rows: int = MIN_ROWS
    seed: int = SEED


@dataclass
class Tree:
    """A full binary tree: per node the feature (-1: leaf), the codes that go left, the value and the gain."""

    feature: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int16), np.zeros((n, 256), bool), np.zeros(n), np.zeros(n))

    def nodes(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row after `depth` levels, one level at a time."""
        at, rows = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
        for _ in range(depth):
            feature = self.feature[at]
            right = ~self.left[at, codes[np.maximum(feature, 0), rows]]
            at = np.where(feature >= 0, 2 * at + 1 + right, at)
        return at


#: Place of the only bit of a word.
BIT = np.zeros(1 << 16, np.uint8)
BIT[1 << np.arange(16)] = np.arange(16)


class Forest:
    """Trees of up to 16 leaves, followed together. Deeper ones are followed one by one."""

    def __init__(self, trees: Sequence[Tree], depth: int) -> None:
        self.trees, self.depth, self.wide = trees, depth, depth > 4
        if self.wide:
            return
        n, leaves = len(trees), 2**depth
        every = (1 << leaves) - 1
        self.start, self.node, self.masks = np.zeros(n, np.uint16), np.zeros((n, leaves), np.int16), {}
        for t, tree in enumerate(trees):
            open_nodes = [(0, 0, leaves)]
            while open_nodes:
                node, first, width = open_nodes.pop()
                feature = int(tree.feature[node])
                if feature < 0:
                    # of the leaves below a leaf, the first stands for all
                    self.start[t] |= 1 << first
                    self.node[t, first] = node
                    continue
                half = width // 2
                low = ((1 << half) - 1) << first
                table = self.masks.setdefault(feature, np.full((256, n), every, np.uint16))
                table[:, t] &= np.where(tree.left[node], every & ~(low << half), every & ~low).astype(np.uint16)
                open_nodes += [(2 * node + 1, first, half), (2 * node + 2, first + half, half)]
        self.at = np.arange(n) * leaves

    def _look_up(self, codes: np.ndarray, table: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """What the table (tree, leaf) says of each (row, tree), for some rows at a time."""
        table, n = table.ravel(), codes.shape[1]
        step = max(256, (1 << 17) // max(1, len(self.trees)))
        for i in range(0, n, step):
            rows = slice(i, min(n, i + step))
            left = np.broadcast_to(self.start, (rows.stop - i, len(self.trees))).copy()
            for feature, masks in self.masks.items():
                left &= masks.take(codes[feature, rows], axis=0)
            yield rows, table.take(BIT.take(left) + self.at)

    def nodes(self, codes: np.ndarray, level: int, of_node: np.ndarray) -> np.ndarray:
        """(tree, row): what `of_node` (tree, node) says of the node that a row reaches after `level` levels."""
        out = np.empty((len(self.trees), codes.shape[1]), of_node.dtype)
        if self.wide:
            for t, tree in enumerate(self.trees):
                out[t] = of_node[t, tree.nodes(codes, level)]
            return out
        for rows, found in self._look_up(codes, np.take_along_axis(of_node, self.node.astype(np.int64), axis=1)):
            out[:, rows] = found.T
        return out

    def margin(self, codes: np.ndarray) -> np.ndarray:
        """The values of all trees, added up in their order."""
        total = np.zeros(codes.shape[1])
        if self.wide:
            for t in self.trees:
                total += t.value[t.nodes(codes, self.depth)]
        elif self.trees:
            values = np.stack([t.value[self.node[i]] for i, t in enumerate(self.trees)])
            for rows, found in self._look_up(codes, values):
                total[rows] = found.cumsum(axis=1)[:, -1]
        return total


@dataclass
class Model:
    """Trees, the exact order of their inputs, and how many of them to use."""

    features: list[str]
    kinds: dict[str, str]
    edges: dict[str, list[float]]
    task: str
    base: float = 0.0
    scale: float = 1.0
    depth: int = DEPTH
    trees: list[Tree] = field(default_factory=list)
    n_trees: int = 0

    def codes(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """(feature, row)"""
        out = np.empty((len(self.features), len(columns[0]) if columns else 0), np.uint8)
        for i, (name, x) in enumerate(zip(self.features, columns)):
            known = ~np.isnan(x)
            if self.kinds.get(name, "numeric") == "numeric":
                code = np.searchsorted(np.array(self.edges[name]), np.where(known, x, 0), side="left")
            else:
                known &= (x >= 0) & (x < MISSING)
                code = np.where(known, x, 0).astype(np.int64)
            out[i] = np.where(known, code, MISSING)
        return out

    def answer(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-margin)) if self.task == "classifier" else self.base + self.scale * margin

    def to_json(self) -> str:
        trees = [{"feature": t.feature.tolist(), "value": t.value.tolist(), "gain": t.gain.tolist(), "left": [np.packbits(x).tobytes().hex() for x in t.left]} for t in self.trees]
        keep = {k: getattr(self, k) for k in ("features", "kinds", "edges", "task", "base", "scale", "depth", "n_trees")}
        return json.dumps({**keep, "trees": trees})

    @staticmethod
    def from_json(text: str) -> Model:
        d = json.loads(text)
        unpack = lambda rows: np.stack([np.unpackbits(np.frombuffer(bytes.fromhex(x), np.uint8)) for x in rows]).astype(bool)
        trees = [Tree(np.array(t["feature"], np.int16), unpack(t["left"]), np.array(t["value"]), np.array(t["gain"])) for t in d.pop("trees")]
        return Model(**d, trees=trees)


# ---------------------------------------------------------------- inputs

def _numbers(features: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("double").alias(c) for c in features]


def quantile_edges(train: DataFrame, features: Sequence[str], rows: int = EDGE_ROWS) -> dict[str, list[float]]:
    """At most 254 edges per feature, from rows chosen by their hash."""
    if not features:
        return {}
    x = train.select(*_numbers(features))
    share = max(1, -(-x.count() // rows))
    part = x.where(F.pmod(F.xxhash64(*features), F.lit(share)) == 0)
    at = [i / 254 for i in range(1, 254)]
    value = lambda c: F.when(~F.isnan(c), F.col(c))
    found = part.agg(*[F.percentile(value(c), F.array(*[F.lit(q) for q in at])).alias(c) for c in features]).first()
    return {c: sorted(set(found[c] or [])) for c in features}


#: A block: its rows, their inputs (feature by feature), labels, weights, a number that draws a row into the shares of trees, and margins.
BLOCKS = "n int, codes binary, y binary, w binary, u binary, margin binary"


@contextmanager
def _bounded(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of blocks are bounded by bytes; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _write(rows: DataFrame, path: str) -> None:
    """Small row groups, so that a small table is read by many tasks and a large one a few blocks at a time."""
    with _bounded(rows.sparkSession):
        rows.write.mode("overwrite").option("parquet.block.size", GROUP_BYTES).option("parquet.page.size.row.check.min", 1).parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(path)


def _block(codes: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    row = [codes.shape[1], np.ascontiguousarray(codes).tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)]
    return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in row[1:])], ["n", "codes", "y", "w", "u", "margin"])


def _blocks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(codes, y, w, u, margin) of each block."""
    for b in batches:
        n, *rest = (b.column(c) for c in ("n", "codes", "y", "w", "u", "margin"))
        for i in range(b.num_rows):
            raw = [np.frombuffer(c[i].as_buffer(), t) for c, t in zip(rest, (np.uint8, np.float64, np.float64, np.int64, np.float64))]
            yield raw[0].reshape(features, n[i].as_py()), *raw[1:]


def _coded(df: DataFrame, model: Model, label: str, weight: str | None, start: float) -> DataFrame:
    """Blocks of the rows with a label; all margins are `start`."""
    plain = Model(model.features, model.kinds, model.edges, model.task)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed(codes: np.ndarray, y: np.ndarray, w: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
            return _block(codes, y, w, u, np.full(len(y), start))

        for b in batches:
            if not b.num_rows:
                continue
            x = [b.column(f"x{i}").to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(plain.features))]
            held.append((plain.codes(x), *(b.column(c).to_numpy() for c in "ywu")))
            n += b.num_rows
            if n >= ROWS:
                whole = [np.concatenate(c, axis=-1) for c in zip(*held)]
                for i in range(0, n - ROWS + 1, ROWS):
                    yield packed(*(c[..., i:i + ROWS] for c in whole))
                held, n = [[c[..., n - n % ROWS:] for c in whole]], n % ROWS
        if n:
            yield packed(*(np.concatenate(c, axis=-1) for c in zip(*held)))

    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    x = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(model.features)]
    rows = df.where(F.col(label).isNotNull()).select(*x, F.col(label).cast("double").alias("y"), w.alias("w"))
    return rows.withColumn("u", F.xxhash64(*rows.columns)).mapInArrow(run, BLOCKS)


# ---------------------------------------------------------------- one level of a batch of trees

def _shares(settings: Settings, tree: int, features: int) -> np.ndarray:
    n = max(1, round(FEATURE_SHARE * features))
    return np.sort(np.random.default_rng([settings.seed, tree]).permutation(features)[:n])


def _drawn(u: np.ndarray, settings: Settings, tree: int) -> np.ndarray:
    key = np.uint64(np.random.default_rng([settings.seed, tree, 1]).integers(1 << 62)) | np.uint64(1)
    x = (u.view(np.uint64) ^ (u.view(np.uint64) >> np.uint64(31))) * key
    return (x >> np.uint64(40)) < np.uint64(int(ROW_SHARE * (1 << 24)))


def best_split(sums: np.ndarray, categorical: bool, min_rows: int) -> tuple[float, np.ndarray, tuple[float, ...], tuple[float, ...]]:
    """(gain, codes that go left, sums left, sums right) of a node's sums (gradient, curvature, rows) per code; gain 0 if none."""
    g, h, n = sums[0] / UNIT, sums[1] / UNIT, sums[2].astype(float)
    total = np.array([g.sum(), h.sum(), n.sum()])
    if categorical:
        codes = np.flatnonzero(n)
        orders = [codes[np.argsort(g[codes] / (h[codes] + CATEGORY_SMOOTH), kind="stable")]]
        penalty = L2 + CATEGORY_SMOOTH
    else:
        codes = np.flatnonzero(n[:MISSING])
        # missing values right of all codes, or left of them
        orders = [codes] if not n[MISSING] else [np.append(codes, MISSING), np.insert(codes, 0, MISSING)]
        penalty = L2
    best = (0.0, np.zeros(256, bool), (0.0, 0.0, 0.0), tuple(total))
    for order in orders:
        left = np.cumsum(np.stack([g[order], h[order], n[order]]), axis=1)[:, :-1]
        right = total[:, None] - left
        fits = (left[2] >= min_rows) & (right[2] >= min_rows) & (left[1] > 1e-3) & (right[1] > 1e-3)
        if not fits.any():
            continue
        gain = np.where(fits, left[0] ** 2 / (left[1] + penalty) + right[0] ** 2 / (right[1] + penalty) - total[0] ** 2 / (total[1] + penalty), 0)
        at = int(np.argmax(gain))
        if gain[at] > best[0] + 1e-9:
            goes = np.zeros(256, bool)
            if categorical:
                goes[order[:at + 1]] = True
            else:
                shown = order[:at + 1]
                edge = shown[shown != MISSING]
                goes[:(edge.max() + 1) if len(edge) else 0] = True
                # no missing value seen: it goes with most rows
                goes[MISSING] = MISSING in shown if n[MISSING] else left[2, at] >= right[2, at]
            best = (float(gain[at]), goes, tuple(left[:, at].tolist()), tuple(right[:, at].tolist()))
    return best


class Sums:
    """Sums per (node, code) of one tree and its features. While they fit a double, curvature and rows are added up as one number."""

    ROWS_BITS, MOST_ROWS, MOST = 16, (1 << 16) - 1, 1 << 36

    def __init__(self, features: int, nodes: int) -> None:
        self.size = nodes * 256
        self.gradient, self.packed = np.zeros((features, self.size)), np.zeros((features, self.size))
        self.curvature, self.rows = np.zeros((features, self.size), np.int64), np.zeros((features, self.size), np.int64)
        self.held, self.held_rows = 0.0, 0

    def add(self, codes: np.ndarray, share: np.ndarray, place: np.ndarray, use: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
        total, fits = float(h.sum()), len(use) <= self.MOST_ROWS
        fits &= total <= self.MOST
        if self.held_rows + len(use) > self.MOST_ROWS or self.held + total > self.MOST:
            self.unpack()
        both = h * float(1 << self.ROWS_BITS) + 1 if fits else h
        for i, f in enumerate(share):
            where = place + codes[f].take(use)
            self.gradient[i] += np.bincount(where, g, self.size)
            if fits:
                self.packed[i] += np.bincount(where, both, self.size)
            else:
                self.curvature[i] += np.bincount(where, h, self.size).astype(np.int64)
                self.rows[i] += np.bincount(where, minlength=self.size)
        if fits:
            self.held, self.held_rows = self.held + total, self.held_rows + len(use)

    def unpack(self) -> None:
        whole = self.packed.astype(np.int64)
        self.curvature += whole >> self.ROWS_BITS
        self.rows += whole & self.MOST_ROWS
        self.packed[:] = 0
        self.held, self.held_rows = 0.0, 0

    def result(self) -> np.ndarray:
        """(feature, node, 3, code)"""
        self.unpack()
        both = np.stack([self.gradient.astype(np.int64), self.curvature, self.rows], axis=1)
        return both.reshape(len(both), 3, -1, 256).transpose(0, 2, 1, 3)


def _level(train: DataFrame, model: Model, settings: Settings, batch: list[Tree], level: int, counted: list[list[int]], parents: dict[tuple, bytes]) -> list:
    """The best split per (tree, node, feature) of this level, with the sums unless it is the last.

    `counted`: the nodes of each tree that are counted; of their siblings, `parents` has the sums of the node above.
    """
    spark, features, last = train.sparkSession, len(model.features), level + 1 >= settings.depth
    shares = [_shares(settings, t, features) for t in range(len(model.trees), len(model.trees) + len(batch))]
    categorical = [model.kinds.get(c, "numeric") != "numeric" for c in model.features]
    first_tree, task, base, scale, depth, min_rows = len(model.trees), model.task, model.base, model.scale, model.depth, settings.min_rows

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(batch, depth)
        place_of = np.full((len(batch), 2 ** (depth + 1) - 1), -1, np.int64)
        for t, nodes in enumerate(counted):
            place_of[t, nodes] = np.arange(len(nodes)) * 256
        sums = [Sums(len(s), len(nodes)) if nodes else None for s, nodes in zip(shares, counted)]
        for codes, y, w, u, margin in _blocks(batches, features):
            if task == "classifier":
                p = 1 / (1 + np.exp(-margin))
                g, h = w * (p - y), w * p * (1 - p)
            else:
                g, h = w * (margin - (y - base) / scale), w
            g, h = np.rint(g * UNIT), np.rint(h * UNIT)
            places = forest.nodes(codes, level, place_of)
            for t, (share, into) in enumerate(zip(shares, sums)):
                if into:
                    use = np.flatnonzero((places[t] >= 0) & _drawn(u, settings, first_tree + t))
                    into.add(codes, share, places[t].take(use), use, g.take(use), h.take(use))
        for t, (share, nodes, into) in enumerate(zip(shares, counted, sums)):
            found = into.result() if into else ()
            rows = [(t, node, int(f), part.tobytes()) for f, by_node in zip(share, found) for node, part in zip(nodes, by_node) if part[2].any()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["tree", "node", "feature", "sums"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tree", "node", "feature", "gain", "left", "lg", "lh", "ln", "rg", "rh", "rn", "sums"]
        kinds = [pa.int32()] * 3 + [pa.float64(), pa.binary()] + [pa.float64()] * 6 + [pa.binary()]

        def found(key: tuple, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
            t, node, f = key
            nodes = [(node, sums)]
            if above:
                whole = np.frombuffer(above.value[t, (node - 1) // 2, f], np.int64).reshape(3, 256)
                nodes.append((node + 1 if node % 2 else node - 1, whole - sums))
            for at, part in nodes:
                gain, left, one, other = best_split(part, categorical[f], min_rows)
                columns = [t, at, f, gain, np.packbits(left).tobytes(), *one, *other, None if last else part.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], names)

        held = None
        for b in batches:
            for t, node, f, raw in zip(*(b.column(c).to_pylist() for c in ("tree", "node", "feature", "sums"))):
                part = np.frombuffer(raw, np.int64).reshape(3, 256)
                if held and held[0] == (t, node, f):
                    held[1] += part
                else:
                    if held:
                        yield from found(*held)
                    held = [(t, node, f), part.copy()]
        if held:
            yield from found(*held)

    key = ["tree", "node", "feature"]
    above = spark.sparkContext.broadcast(parents) if parents else None
    groups = sum(len(s) * len(nodes) for s, nodes in zip(shares, counted))
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups // SPLITS_PER_TASK))
    with _bounded(spark):
        partial = train.mapInArrow(add, "tree int, node int, feature int, sums binary")
        out = partial.repartition(max(1, parts), *key).sortWithinPartitions(*key).mapInArrow(
            choose, "tree int, node int, feature int, gain double, left binary, lg double, lh double, ln double, rg double, rh double, rn double, sums binary").collect()
    if above:
        above.destroy()
    return out


def _grow(train: DataFrame, model: Model, settings: Settings) -> list[Tree]:
    batch = [Tree.empty(settings.depth) for _ in range(BATCH)]
    counted, parents = [[0] for _ in batch], {}
    for level in range(settings.depth):
        rows = sorted(_level(train, model, settings, batch, level, counted, parents), key=lambda r: (r.tree, r.node, -r.gain, r.feature))
        taken = set()
        counted = [[] for _ in batch]
        for r in rows:
            if (r.tree, r.node) in taken or r.gain <= 0:
                continue
            taken.add((r.tree, r.node))
            t = batch[r.tree]
            t.feature[r.node], t.gain[r.node], t.value[r.node] = r.feature, r.gain, 0.0
            t.left[r.node] = np.unpackbits(np.frombuffer(r.left, np.uint8)).astype(bool)
            one, other = 2 * r.node + 1, 2 * r.node + 2
            for child, g, h in ((one, r.lg, r.lh), (other, r.rg, r.rh)):
                t.value[child] = -settings.rate * g / (h + L2)
            counted[r.tree].append(one if r.ln <= r.rn else other)
        if not taken:
            break
        parents = {(r.tree, r.node, r.feature): bytes(r.sums) for r in rows if r.sums is not None and (r.tree, r.node) in taken}
    return batch


# ---------------------------------------------------------------- the fit

def _with_margins(rows: DataFrame, model: Model, done: int) -> DataFrame:
    """Blocks whose margins have the trees after `done` of them added."""
    features, depth, trees = len(model.features), model.depth, model.trees[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = [Forest(trees[i:i + BATCH], depth) for i in range(0, len(trees), BATCH)]
        for codes, y, w, u, margin in _blocks(batches, features):
            for f in forests:
                margin = margin + f.margin(codes)
            yield _block(codes, y, w, u, margin)

    return rows.mapInArrow(run, BLOCKS)


def _measure(val: DataFrame, model: Model, done: int) -> dict[int, float | None]:
    """Validation skill, larger is better, by number of trees, for the batches after `done` trees."""
    features, ends = len(model.features), list(range(done + BATCH, len(model.trees) + 1, BATCH))
    base, scale, depth, batches_of = model.base, model.scale, model.depth, [model.trees[end - BATCH:end] for end in ends]

    def staged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        forests = [Forest(trees, depth) for trees in batches_of]
        for codes, y, _, _, margin in _blocks(batches, features):
            for end, forest in zip(ends, forests):
                margin = margin + forest.margin(codes)
                yield end, y, margin

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for end, y, margin in staged(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), end, np.int32)), pa.array(y.astype(np.int64)), pa.array(margin)], ["trees", "y", "p"])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for end, y, margin in staged(batches):
            e = float(((margin - (y - base) / scale) ** 2).sum())
            yield pa.RecordBatch.from_arrays([pa.array([end], pa.int32()), pa.array([e]), pa.array([len(y)], pa.int64())], ["trees", "e", "n"])

    with _bounded(val.sparkSession):
        if model.task == "classifier":
            found = M.classifier_summary(val.mapInArrow(scores, "trees int, y long, p double"), "y", "p", ["trees"]).select("trees", F.col("pr_auc").alias("skill"))
        else:
            found = val.mapInArrow(errors, "trees int, e double, n long").groupBy("trees").agg((-F.sum("e") / F.sum("n")).alias("skill"))
        return {r.trees: None if r.skill is None else round(r.skill, 9) for r in found.collect()}


def _save_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\0")


def _read_text(spark: SparkSession, path: str) -> str | None:
    try:
        return spark.read.text(path, wholetext=True).first().value.rstrip("\0")
    except AnalysisException:
        return None


def fit(df: DataFrame, features: Sequence[str], label: str, task: str = "classifier", weight: str | None = None, kinds: Mapping[str, str] | None = None, split: str = "split",
        settings: Settings | None = None, folder: str | None = None) -> Model:
    """A model of the train rows, stopped on the val rows. `folder` keeps its blocks; an earlier fit in it is continued."""
    spark, settings = df.sparkSession, settings or Settings()
    folder = folder or new_dir(spark, "boosting")
    kinds = {c: (kinds or {}).get(c, "numeric") for c in features}
    state = _read_text(spark, f"{folder}/start")
    if state is None:
        rows = df.where(F.col(label).isNotNull())
        train = rows.where(F.col(split) == "train")
        edges = quantile_edges(train, [c for c in features if kinds[c] == "numeric"])
        w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
        y = F.col(label).cast("double")
        one = train.agg((F.sum(w * y) / F.sum(w)).alias("mean"), F.stddev_pop(y).alias("sd")).first()
        model = Model(list(features), kinds, edges, task, depth=settings.depth)
        if task == "regressor":
            model.base, model.scale = round(one.mean or 0.0, 9), round(one.sd or 0.0, 9) or 1.0
        else:
            mean = round(min(max(one.mean or 0.0, 1e-9), 1 - 1e-9), 9)
            model.base = float(np.log(mean / (1 - mean)))
        start = model.base if task == "classifier" else 0.0
        for name in ("train", "val"):
            _write(_coded(rows.where(F.col(split) == name), model, label, weight, start), f"{folder}/{name}-0")
        _save_text(spark, f"{folder}/start", json.dumps({"model": model.to_json(), "skill": {}}))
        state = _read_text(spark, f"{folder}/start")
    state, skill, block = json.loads(state), {}, 0
    while (later := _read_text(spark, f"{folder}/block-{block + 1}")) is not None:
        state, block = json.loads(later), block + 1
    model = Model.from_json(state["model"])
    skill = {int(k): v for k, v in state["skill"].items()}

    def best() -> int:
        known = {k: v for k, v in skill.items() if v is not None}
        return min(known, key=lambda k: (-known[k], k)) if known else 0

    while len(model.trees) < settings.rounds and len(model.trees) - best() < settings.patience:
        # the tables of the block before stay until this one is written
        now, following = block % 2, (block + 1) % 2
        train, val = (_read(spark, f"{folder}/{name}-{now}") for name in ("train", "val"))
        done = len(model.trees)
        for i in range(BLOCK):
            before = len(model.trees)
            model.trees += _grow(train, model, settings)
            ends = i == BLOCK - 1 or len(model.trees) >= settings.rounds
            path = f"{folder}/train-{following}" if ends else f"{folder}/batch-{i % 2}"
            _write(_with_margins(train, model, before), path)
            train = _read(spark, path)
            if ends:
                break
        skill |= _measure(val, model, done)
        block += 1
        _write(_with_margins(val, model, done), f"{folder}/val-{following}")
        model.n_trees = best() or len(model.trees)
        _save_text(spark, f"{folder}/block-{block}", json.dumps({"model": model.to_json(), "skill": skill}))
    return model


def score(model: Model, df: DataFrame, name: str) -> DataFrame:
    """Adds the score of every row, in the task that holds it: a probability, or a value."""
    plain, used = Model(model.features, model.kinds, model.edges, model.task, model.base, model.scale, model.depth), model.trees[:model.n_trees]
    start = plain.base if plain.task == "classifier" else 0.0

    @F.pandas_udf("double")
    def value(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        forest = Forest(used, plain.depth)
        for columns in batches:
            # one input comes as it is, not in a tuple
            columns = (columns,) if isinstance(columns, pd.Series) else columns
            codes = plain.codes([c.to_numpy(np.float64, na_value=np.nan) for c in columns])
            yield pd.Series(plain.answer(start + forest.margin(codes)))

    return df.withColumn(name, value(*[F.col(c).cast("double") for c in model.features]))


def importance(model: Model) -> list[tuple[str, float]]:
    """Share of all gains per feature, largest first, over the trees in use."""
    total = dict.fromkeys(model.features, 0.0)
    for t in model.trees[:model.n_trees]:
        for node in np.flatnonzero(t.feature >= 0):
            total[model.features[t.feature[node]]] += float(t.gain[node])
    whole = sum(total.values()) or 1.0
    return sorted(((f, g / whole) for f, g in total.items()), key=lambda x: (-x[1], x[0]))


def save(model: Model, spark: SparkSession, path: str) -> None:
    _save_text(spark, path, model.to_json())


def load(spark: SparkSession, path: str, features: Sequence[str]) -> Model:
    """Refuses a model whose feature order is not the expected one."""
    model = Model.from_json(_read_text(spark, path) or "")
    if model.features != list(features):
        raise ValueError("the saved model was fitted on another feature order")
    return model
