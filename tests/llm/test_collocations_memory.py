"""What a task of the collocations holds at once."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from txlens.llm import collocations as C


def peak(f):
    """(result, bytes of numpy held at most beyond what was there)."""
    tracemalloc.start()
    got = f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return got, most


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(words))


def block(seed, words=200_000):
    texts = [prose(f"{seed} {i}", words // 40) for i in range(40)]
    return pa.table({"text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * 40, pa.string())})


def test_a_block_holds_one_column_of_its_runs():
    b = block(1)
    _, most = peak(lambda: sum(r.num_rows for r in C._block_runs(b, 8)))
    assert most < 80 * 200_000


@pytest.mark.parametrize("part", [1 << 19, 50_000])
def test_a_bucket_is_sorted_in_parts(monkeypatch, part):
    monkeypatch.setattr(C, "PART", part, raising=False)
    blocks = [block(seed) for seed in (1, 2, 1)]
    runs = [r.column("run")[0].as_py() for b in blocks for r in C._block_runs(b, 1) if r.column("words")[0].as_py() == 3]
    added, most = peak(lambda: list(C._added(runs, 2)))
    assert most < (70 if part < 1 << 19 else 100) * 600_000
    found = {tuple(r.values())[:4]: r["n"] for b in added for r in b.to_pylist()}
    assert sum(b.num_rows for b in added) == len(found) >= 190_000
    words = [t.split() for b in blocks for t in b["text"].to_pylist()]
    some = random.Random(2).choices(range(len(words)), k=30)
    for i in some:
        w = words[i % 40][10:13]
        assert found[("en", *w)] == sum(1 for t in words for x in zip(t, t[1:], t[2:]) if list(x) == w)


def test_empty_blocks_and_slices(monkeypatch):
    monkeypatch.setattr(C, "SLICE", 10, raising=False)
    none = pa.table({"text": pa.array([], pa.string()), "lang": pa.array([], pa.string())})
    assert list(C._block_runs(none, 4)) == []
    texts = ["", "a b c a b", "one. two three four five six seven", "", "a b", " . "]
    b = pa.table({"text": pa.array(texts, pa.string()), "lang": pa.array(["x", "x", "y", "y", "x", "x"], pa.string())})
    found = {}
    for r in C._block_runs(b, 4):
        for row in pa.ipc.open_stream(r.column("run")[0].as_py()).read_all().to_pylist():
            found[tuple(row.values())[:-1]] = row["n"]
    assert found[("x", "a", "b")] == 3 and found[("x", "a", "b", "c")] == 1 and found[("y", "two", "three")] == 1
    assert ("y", "one", "two") not in found and ("x", "b", "a") not in found and found[("x", "a")] == 3
