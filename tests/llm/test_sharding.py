import zlib

from txlens.llm import sharding


def test_slots_shards_and_growth(spark):
    rows = [(i, f"text {i}") for i in range(3000)] + [(None, None), (None, None), (7, None), (5, "text 5"), (8, "é" * 40000)] + [(1, "hot")] * 25000
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "slot")
    got = sharding.assign(df, "doc_id", "slot", [1.0] * 8, [1.0] * 9).collect()
    expected = sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == expected
    slots, shard = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert shard.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 8)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(g == 8 for _, g in shard.values())
    assert 0.7 * len(shard) / 9 < moved < 1.3 * len(shard) / 9


def test_weights_and_empty_tables(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    by = {r.shard: r["count"] for r in sharding.assign(df, "doc_id", "text", [1.0, 3.0]).groupBy("shard").count().collect()}
    assert 2.7 < by[1] / by[0] < 3.3
    assert sharding.assign(df.limit(0), "doc_id", "text", [1.0, 1.0]).collect() == []
