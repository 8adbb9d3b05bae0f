import numpy as np
from pyspark.sql import functions as F

from txlens.llm import decontaminate, neighbours, op2_query

SF = "/root/testdata/sf0.01"


def exact(rows, queries, k=10):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows], dtype=np.float64)
    out = {}
    for q in queries:
        at = np.flatnonzero(ids == q)[0]
        d = np.sqrt(((v - v[at]) ** 2).sum(axis=1))
        order = [o for o in np.lexsort((ids, d)) if o != at][:k]
        out[q] = [(int(ids[o]), d[o]) for o in order]
    return out


def test_recall_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {}
    for r in op2_query.op2_neighbours(spark, SF).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    expected = exact(rows, [i for i, _ in rows if i % 100 == 0])
    assert got.keys() == expected.keys()
    shared = sum(len({x for _, x, _ in got[q]} & {x for x, _ in expected[q]}) for q in got)
    assert shared >= 0.9 * sum(len(x) for x in expected.values())
    by_id = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert all(abs(np.sqrt(((by_id[q] - by_id[x]) ** 2).sum()) - s) < 1e-12 for _, x, s in found)
        assert [(s, x) for _, x, s in found] == sorted((s, x) for _, x, s in found)


def test_neighbours_of_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [1.0, None], 1), (7, [1.0], 1), (None, [1.0, 1.0], 1), (8, [float("inf"), 1.0], 1), (9, [0.0, 2.0], 1), (9, [0.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int")
    got = [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 2 == 0).orderBy("query_id", "rank").collect()]
    r2, r5 = 2**0.5, 5**0.5
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, r2), (0, 3, 9, r5), (2, 1, 9, 1.0), (2, 2, 0, r2), (2, 3, 1, r2)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 2 == 0).collect() == []
    assert neighbours.nearest(df.where("vec_id = 3"), F.lit(True)).collect() == []


def test_matches(spark):
    item = "The quick brown fox jumps over the lazy dog while seven wizards brew strong potions under the pale moon tonight, again and again and yet again."
    words = item.split()
    near = " ".join([*words[:25], "twice"])
    far = " ".join(w if i % 7 else "changed" for i, w in enumerate(words))
    documents = [(1, f"Intro. {item.upper()} Outro."), (2, near), (3, far), (4, None), (5, ""), (None, item), (6, "filler words here " * 9000 + item), (6, "filler words here " * 9000 + item), (7, "tiny note")]
    items = [(10, item), (11, None), (12, "tiny note"), (None, item)]
    df = spark.createDataFrame([(a, b, 0) for a, b in documents], "doc_id long, text string, start int")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id or 0, r.n_words, round(r.similarity, 6)) for r in decontaminate.matches(df, it, block_items=2).collect()))
    whole = [(d, i, 26, 1.0) for d in (0, 1, 6, 6) for i in (0, 10)]
    assert sorted(x for x in got if x[0] != 2) == sorted(whole + [(7, 12, 2, 1.0)])
    assert [x[:2] for x in got if x[0] == 2] == [(2, 0), (2, 10)] and all(0.8 <= x[3] < 1 for x in got if x[0] == 2)
    assert sorted(r.doc_id for r in decontaminate.without_matches(df, it).collect()) == [3, 4, 5]
    assert decontaminate.matches(df.limit(0), it).collect() == [] and decontaminate.matches(df, it.limit(0)).collect() == []
