import random

import numpy as np
import pytest

from txlens.llm import near_copies


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept(rows):
    """Ids that stay, by all pairs."""
    texts = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        texts.setdefault(t or "", i)
    names = list(texts)
    sets = [shingles(t) for t in names]
    label = list(range(len(names)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(names)):
        for j in range(i):
            s = similarity(sets[i], sets[j]) if sets[i] and sets[j] else 0
            if s >= 0.8:
                label[root(i)] = root(j)
    best = {}
    for i, t in enumerate(names):
        r = root(i)
        best[r] = min(best.get(r, texts[t]), texts[t], key=lambda x: (x is None, x or 0))
    return sorted(best.values(), key=repr)


def collection(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(60, 400))
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 3)):
            edits = rng.choice([max(1, len(base) // 120), len(base) // 8])
            other = list(base)
            for at in rng.sample(range(len(other)), edits):
                other[at] = rng.choice(words)
            rows.append((len(rows), " ".join(other)))
    rows += [(900, rows[4][1]), (4, rows[4][1]), (None, rows[5][1] + " tail"), (901, None), (902, ""), (903, "one two"), (904, "One  two"), (905, "one three")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_one_of_each_group_stays(spark, seed):
    rows = collection(seed)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, first int, row string")
    got = near_copies.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == kept(rows)
    assert near_copies.keep_one(df.limit(0)).collect() == []


def test_crowded_buckets_link_through_leaders(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CROWDED", 4)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(60):
        other = list(base)
        other[rng.randrange(400)] = f"new{i}"
        rows.append((i, " ".join(other)))
    rows.append((99, " ".join(f"c{i}" for i in range(300))))
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [0, 99]


def test_bands_meet_as_promised():
    for n in (100, 10**6, 10**9):
        places = near_copies.bands(n)
        agree = 1 - np.arccos(1.6 / 1.8) / np.pi
        assert 1 - (1 - agree ** len(places[0])) ** len(places) >= near_copies.MEETS
