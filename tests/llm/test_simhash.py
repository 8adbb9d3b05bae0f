import numpy as np
import pytest
import xxhash

from txlens.llm import simhash
from txlens.llm.components import components


def brute(fps):
    """fp -> smallest fp reachable over at most two differing bits."""
    todo, label = sorted(fps), {}
    for start in todo:
        if start in label:
            continue
        label[start], front = start, [start]
        while front:
            x = front.pop()
            for y in todo:
                if y not in label and ((x ^ y) & (2**64 - 1)).bit_count() <= 2:
                    label[y] = start
                    front.append(y)
    return label


@pytest.mark.parametrize("crowded", [2, 64])
def test_links_connect_what_two_bits_connect(spark, crowded):
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(6):
        x = int(rng.integers(-2**63, 2**63, dtype=np.int64))
        for _ in range(30):
            fps.add(x)
            flips = rng.choice(64, int(rng.integers(1, 5)), replace=False)
            x = int(np.int64(np.uint64(x & (2**64 - 1)) ^ np.bitwise_or.reduce(np.left_shift(np.uint64(1), flips.astype(np.uint64)))))
    fps = sorted(fps)
    found = components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), crowded)).collect()
    got = {f: f for f in fps} | {r.node: r.component for r in found}
    assert got == brute(fps)


def test_components_of_a_long_path(spark):
    n = 3000
    order = np.random.default_rng(1).permutation(n).tolist()
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(n + 1, n + 2), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {n + 1: n + 1, n + 2: n + 1}
    assert components(edges.limit(0)).collect() == []


def test_fingerprints_of_odd_rows(spark):
    long = "word other " * 40000
    rows = [(1, None, 5), (2, "", 5), (None, "One two", 5), (4, "one TWO", 5), (4, "one TWO", 5), (5, long, 5), (6, long, 5)]
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    h = xxhash.xxh64_intdigest(b"one two", 42)
    fp = h - 2**64 if h >= 2**63 else h
    seen = sorted(((r.doc_id or 0, r.fp, r.component_id) for r in got))
    assert [x for x in seen if x[0] in (0, 4)] == [(0, fp, 4), (4, fp, 4), (4, fp, 4)]
    assert [x for x in seen if x[0] in (1, 2)] == [(1, 0, 1), (2, 0, 1)]
    assert {x[2] for x in seen if x[0] in (5, 6)} == {5}
    assert simhash.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
