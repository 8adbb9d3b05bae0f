from pyspark.sql import functions as F

from tests.llm.test_search import exact
from txlens.llm import neighbours


def test_recall_beside_a_large_vector(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    large = max(i for i, _ in rows) + 1
    rows.append((large, [1000.0] + [0.0] * (len(rows[0][1]) - 1)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    expected = exact(rows, [i for i, _ in rows if i % 100 == 0])
    assert got.keys() == expected.keys()
    shared = sum(len(got[q] & {x for x, _ in expected[q]}) for q in got) / sum(len(x) for x in expected.values())
    print("RECALL", shared)
    assert shared >= 0.9
