import os
import random

import pytest
from pyspark.sql import functions as F

from txlens.sources import journal as J
from txlens.sources import lines as LI
from txlens.streaming import run


def put(path, data, mode="wb"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


def plain(files):
    out = []
    for name, data in files.items():
        at = 0
        for line in data.split(b"\n"):
            if at < len(data):
                out.append((os.path.basename(name), at, line.removesuffix(b"\r").decode("utf-8", "replace")))
            at += len(line) + 1
    return sorted(out)


def got(df):
    return sorted((os.path.basename(r.file), r.start, r.value) for r in df.collect())


@pytest.mark.parametrize("size", [7, 100, 1 << 20])
def test_ranges_give_every_line_once(spark, tmp_path, monkeypatch, size):
    rng = random.Random(size)
    text = lambda n: b"\n".join(rng.choice([b"", b"x" * rng.randrange(30), "é日".encode(), b"ends\r", b"\xff bad"]) for _ in range(n))
    files = {"a.log": text(60), "b.log": text(40) + b"\n", "c.log": b"", "d.log": b"one line without an end " * 9, "e.log": b"\n\n\n"}
    for name, data in files.items():
        put(f"{tmp_path}/j/{name}", data)
    put(f"{tmp_path}/j/_SUCCESS", b"not data")
    assert got(LI.read_lines(spark, f"{tmp_path}/j", size)) == plain(files)
    assert got(LI.read_lines(spark, f"{tmp_path}/j/a.log", size)) == plain({"a.log": files["a.log"]})
    os.makedirs(f"{tmp_path}/none")
    assert got(LI.read_lines(spark, f"{tmp_path}/none")) == []
    with pytest.raises(Exception, match="FileNotFound"):
        LI.read_lines(spark, f"{tmp_path}/nowhere").collect()


def test_a_growing_file_and_a_second_one(spark, tmp_path):
    folder, kw = f"{tmp_path}/j", {"checkpoint": f"{tmp_path}/ckpt", "out": f"{tmp_path}/out"}
    follow = lambda: run.drain_by_batch(LI.follow_lines(spark, folder, 9), "lines", **kw)
    put(f"{folder}/a.log", b"first\nsecond\nhalf a li")
    assert [x[2] for x in got(follow())] == ["first", "second"]
    put(f"{folder}/a.log", b"ne\nfourth\n", "ab")
    put(f"{folder}/b.log", b"other\n")
    assert [x[2] for x in got(follow())] == ["first", "second", "half a line", "fourth", "other"]
    # nothing new, then one more line
    assert len(got(follow())) == 5
    put(f"{folder}/b.log", b"last\n", "ab")
    found = got(follow())
    assert found == plain({"a.log": b"first\nsecond\nhalf a line\nfourth\n", "b.log": b"other\nlast\n"})
    assert follow().groupBy("file", "start").count().where("count > 1").count() == 0


def test_the_last_row_of_a_key_wins_by_its_place(spark, tmp_path):
    sig = lambda c: c * 64
    row = lambda s, slot: f'{{"sig_hex": "{s}", "slot": {slot}}}\n'
    put(f"{tmp_path}/t/1.jsonl", (row(sig("a"), 9) + row("short", 1) + "broken {\n" + row(sig("B"), 3) + row(sig("A"), 4)).encode())
    put(f"{tmp_path}/t/2.jsonl", row(sig("b"), 2).encode())
    found = {r.sig_hex[0]: r.slot for r in J.scan_truth(spark, f"{tmp_path}/t").collect()}
    assert found == {"a": 4, "b": 2}
    assert {r.sig_hex[0]: r.slot for r in J.truth_of(LI.read_lines(spark, f"{tmp_path}/t", 10)).collect()} == found


def test_journal_of_a_kind_from_files(spark, tmp_path):
    put(f"{tmp_path}/k/1.jsonl", b'{"kind":"x","ts":5}\n{"kind":"y","ts":6}\nnot json\n{"kind":"x"')
    put(f"{tmp_path}/k/2.jsonl", b'{"kind":"x","ts":7000000000000}\n')
    schema = "kind string, ts bigint"
    assert sorted(r.ts for r in J.scan_journal(spark, f"{tmp_path}/k", "x", schema).collect()) == [5, 7000000000000]
    assert [r.ts for r in J.scan_journal(spark, f"{tmp_path}/k", "x", schema, window_s=100, now=7000.0).collect()] == [7000000000000]
    stream = J.parse_kind(LI.follow_lines(spark, f"{tmp_path}/k"), "x", schema)
    assert sorted(r.ts for r in run.drain_by_batch(stream, "kind").collect()) == [5, 7000000000000]


def test_packets_in_both_formats(spark, tmp_path):
    rows = spark.range(20).select(F.lit(1).alias("source_id"), F.col("id").alias("seq"), F.col("id").alias("rx_ns"), F.lit("data").alias("type"), F.lit(3).alias("slot"))
    rows.write.json(f"{tmp_path}/json")
    again = J.scan_packets(spark, f"{tmp_path}/json")
    again.write.parquet(f"{tmp_path}/parquet")
    assert again.schema == J.scan_packets(spark, f"{tmp_path}/parquet", "parquet").schema
    assert again.exceptAll(J.scan_packets(spark, f"{tmp_path}/parquet", "parquet")).count() == 0 and again.where("fec_set IS NULL").count() == 20
