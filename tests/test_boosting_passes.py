"""Passes of the boosted trees: trees followed together, the child that is not counted, tasks of a level, tables left behind."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from txlens.operators import boosting as B


def random_tree(rng, depth, features):
    t = B.Tree.empty(depth)
    for node in range(2**depth - 1):
        above = node == 0 or t.feature[(node - 1) // 2] >= 0
        if above and rng.random() < 0.8:
            t.feature[node], t.left[node] = rng.integers(features), rng.random(256) < 0.5
    t.value[:] = rng.normal(size=len(t.value))
    return t


@pytest.mark.parametrize("depth", [1, 3, 4, 5])
def test_trees_followed_together_end_where_each_does(depth):
    rng = np.random.default_rng(depth)
    trees = [random_tree(rng, depth, 7) for _ in range(30)]
    codes = rng.integers(0, 256, (7, 5000)).astype(np.uint8)
    forest, numbers = B.Forest(trees, depth), np.tile(np.arange(2 ** (depth + 1) - 1), (30, 1))
    expected = np.stack([t.nodes(codes, depth) for t in trees])
    assert (forest.nodes(codes, depth, numbers) == expected).all()
    total = np.zeros(5000)
    for t, at in zip(trees, expected):
        total += t.value[at]
    assert (forest.margin(codes) == total).all()


@pytest.mark.parametrize("scale", [1, 1 << 30])
def test_sums_are_exact(scale):
    """Curvature too large to share a number with the rows is added up on its own."""
    rng = np.random.default_rng(2)
    sums, n, expected = B.Sums(1, 2), 40_000, np.zeros((2, 3, 256), object)
    for _ in range(4):
        codes, at, use = rng.integers(0, 256, (3, n)).astype(np.uint8), rng.integers(0, 2, n), np.flatnonzero(rng.random(n) < 0.7)
        g, h = rng.integers(-1000, 1000, n) * float(scale), rng.integers(0, 2**18, n) * float(scale)
        sums.add(codes, np.array([1]), at[use] * 256, use, g[use], h[use])
        for k, x in enumerate((g, h, np.ones(n))):
            np.add.at(expected, (at[use], k, codes[1, use]), x[use].astype(np.int64).astype(object))
    assert (sums.result()[0].astype(object) == expected).all()


@pytest.fixture(scope="module")
def rows(spark):
    k = F.col("id")
    draw = lambda i: F.pmod(F.xxhash64(k, F.lit(i)), F.lit(1000)) / 1000.0
    x = spark.range(4000).select("id", draw(1).alias("a"), draw(2).alias("b"), F.when(k % 3 == 0, None).otherwise(draw(3)).alias("c"))
    return x.withColumn("y", (F.col("a") + draw(4) > 1).cast("int")).withColumn("split", F.when(k % 4 == 0, "val").otherwise("train")).repartition(4).cache()


def test_uncounted_children_have_the_rest_of_their_parent(spark, rows, tmp_path, monkeypatch):
    """Every node's rows are those of its two children, and a split is the one found by counting all of its rows."""
    seen, level = [], B._level
    monkeypatch.setattr(B, "_level", lambda *a: seen.append((a, level(*a))) or seen[-1][1])
    B.fit(rows, ["a", "b", "c"], "y", settings=B.Settings(rounds=10, min_rows=5), folder=str(tmp_path / "m"))
    assert len(seen) == 4
    for (train, model, settings, batch, at, counted, parents), found in seen[1:3]:
        all_nodes = [[n for c in nodes for n in (c, c + 1 if c % 2 else c - 1)] for nodes in counted]
        spread = {(r.tree, r.node, r.feature): (bytes(r.sums), r.gain) for r in found}
        # the batch has grown since: its nodes below this level are taken back
        cut = [B.Tree(np.where(np.arange(len(t.feature)) < 2**at - 1, t.feature, -1).astype(np.int16), t.left, t.value, t.gain) for t in batch]
        earlier = B.Model(model.features, model.kinds, model.edges, model.task, model.base, model.scale, model.depth)
        whole = level(train, earlier, settings, cut, at, all_nodes, {})
        assert {(r.tree, r.node, r.feature): (bytes(r.sums), r.gain) for r in whole} == spread


def test_a_level_has_few_tasks_and_blocks_do_not_pile_up(spark, rows, tmp_path):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    sc = spark.sparkContext
    try:
        m = B.fit(rows, ["a", "b", "c"], "y", settings=B.Settings(rounds=200, patience=200, depth=2), folder=str(tmp_path / "m"))
        sc.setJobGroup("one level", "")
        B._level(B._read(spark, str(tmp_path / "m" / "train-0")), m, B.Settings(), [B.Tree.empty(2) for _ in range(B.BATCH)], 0, [[0]] * B.BATCH, {})
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("one level")]
        tasks = [sc.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(m.trees) == 200 and tasks and max(tasks) <= 16
    tables = {x for x in os.listdir(tmp_path / "m") if not x.startswith("block-")}
    assert tables == {"start", "batch-0", "batch-1", *(f"{name}-{i}" for name in ("train", "val") for i in range(2))}


def test_one_input_is_scored(spark, rows, tmp_path):
    m = B.fit(rows, ["a"], "y", settings=B.Settings(rounds=10, depth=2), folder=str(tmp_path / "m"))
    assert B.score(m, rows, "p").where("p > 0 AND p < 1").count() == 4000
