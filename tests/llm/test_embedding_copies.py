import numpy as np
import pytest

from txlens.llm import embedding_copies as E
from txlens.llm import polytope


def brute(rows, threshold=0.9):
    """(vec_id, n_links, component_id, kept) of rows with distinct ids, by all pairs."""
    use = [(i, np.array(v, np.float64) / max(abs(x) for x in v)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {i: [0, i] for i, _ in rows}
    near = {i: [] for i, _ in use}
    for a, (i, x) in enumerate(use):
        for j, y in use[a + 1:]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                near[i].append(j)
                near[j].append(i)
    for start in sorted(near):
        if out[start][1] < start:
            continue
        front, seen = [start], {start}
        while front:
            for j in near[front.pop()]:
                if j not in seen:
                    seen.add(j)
                    front.append(j)
        for i in seen:
            out[i] = [len(near[i]), start]
    return sorted((i, n, c, i == c) for i, (n, c) in out.items())


def family(rng, dimensions, members, spread):
    centre = rng.standard_normal(dimensions)
    return [centre + spread * rng.standard_normal(dimensions) for _ in range(members)]


@pytest.mark.parametrize(("block", "occupancy"), [(1024, 2048), (8, 1)])
def test_links_equal_all_pairs(spark, monkeypatch, block, occupancy):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "OCCUPANCY", occupancy)
    monkeypatch.setattr(E, "MISSED", 1e-6)
    rng = np.random.default_rng(2)
    vectors = [v for s in (0.1, 0.25, 0.33, 0.4) for _ in range(4) for v in family(rng, 24, 20, s)] + family(rng, 24, 60, 2.0)
    vectors += [vectors[0]] * 30 + [3 * vectors[5], 1e30 * vectors[25].astype(np.float32)] + family(rng, 7, 12, 0.3)
    rows = [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    got = sorted(tuple(r) for r in E.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, []), (8, [inf, 1.0]), (9, [1.0]), (10, [5.0]), (11, [1e300, 1e-300]),
            (12, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, 0.0) for r in rows], "vec_id long, embedding array<double>, node int, v double")
    assert sorted(tuple(r) for r in E.near_copies(df).collect()) == brute(rows)
    assert E.near_copies(df.limit(0)).collect() == []
    assert [tuple(r) for r in E.near_copies(df.where("vec_id = 3")).collect()] == [(3, 0, 3, True)]


def test_repeated_and_null_ids(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [1.0, 0.1]), (None, [0.0, 1.0]), (None, [0.0, 1.0]), (4, [0.0, -1.0])]
    got = E.near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    expected = [(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 1, None, True), (None, 1, None, True), (4, 0, 4, True)]
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_rotations_keep_lengths_and_probes_differ():
    x = np.random.default_rng(1).standard_normal((50, 64)).astype(np.float32)
    assert np.allclose(np.linalg.norm(polytope.rotated(x, 3, 1), axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)
    found = polytope.probes(x, 3, 2, 8)
    assert all(len(set(r)) == 8 for r in found.tolist())
    assert (found[:, 0] == polytope.probes(x, 3, 2, 1)[:, 0]).all()


@pytest.mark.parametrize("nodes", [10**4, 10**6, 10**8])
def test_pairs_at_the_threshold_meet(nodes):
    """Measured on fresh pairs over all tables of the plan, not by the formula that chose them."""
    rng = np.random.default_rng(nodes)
    depth, tables = E.plan(nodes, 64)
    a, n = rng.standard_normal((1500, 64)), rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    n -= (n * a).sum(axis=1)[:, None] * a
    n /= np.linalg.norm(n, axis=1)[:, None]
    b = 0.9 * a + np.sqrt(1 - 0.81) * n
    met = np.zeros(len(a), bool)
    for t in range(tables):
        x, y = (polytope.probes(v.astype(np.float32), t, depth, E.PROBES) for v in (a, b))
        met |= (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    assert met.mean() >= 0.985
