"""One document of each group of SimHash fingerprints at two or fewer differing bits, by all pairs."""

import random

import pytest
import xxhash

import corpus_pipeline
from tests.llm.test_near_copies import shingles, similarity
from txlens.llm import near_copies


def fingerprint(text):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def kept(rows):
    """Ids that stay."""
    found = sorted(((i is None, i or 0, fingerprint(t)) for i, t in rows))
    label = list(range(len(found)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(found)):
        for b in range(a):
            if (found[a][2] ^ found[b][2]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return sorted((None if found[r][0] else found[r][1] for r in {root(a) for a in range(len(found))}), key=repr)


def collection(seed, size=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(size):
        base = rng.choices(words, k=rng.randint(100, 400))
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 4)):
            # each from the one before, so that groups are chains
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((len(rows), " ".join(base)))
    rows += [(900, rows[4][1]), (4, rows[4][1]), (None, rows[5][1].upper()), (None, "alone " * 7), (901, None), (902, ""), (903, " \n"), (904, "one two"), (905, "One  two"), (906, "one three")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_one_of_each_group_stays(spark, seed):
    rows = collection(seed)
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, first int, row string")
    got = near_copies.keep_one_by_simhash(df)
    assert got.columns == df.columns
    found = [r.doc_id for r in got.collect()]
    assert sorted(found, key=repr) == kept(rows)
    assert len({fingerprint(t) for _, t in rows}) > len(found) + 5
    assert near_copies.keep_one_by_simhash(df.limit(0)).collect() == []


def test_the_stage_links_by_fingerprints(spark):
    """A link below a shingle similarity of 0.8, which a join of shingles does not make, and none of the pairs above it."""
    rng = random.Random(3)
    texts = []
    while len(texts) < 40:
        base = [f"v{rng.randrange(10**9)}" for _ in range(60)]
        texts += [" ".join(base), " ".join(base[:-2] + ["x", "y"])]
    far = [i for i in range(0, 40, 2) if (fingerprint(texts[i]) ^ fingerprint(texts[i + 1])).bit_count() > 2]
    assert far
    # a loop of an odd number of words leaves every bit a majority that some words more cannot shift
    loop = " ".join(f"u{i}" for i in range(31))
    texts += [" ".join([loop] * 40), " ".join([loop] * 40 + [f"z{i}" for i in range(9)])]
    assert (fingerprint(texts[40]) ^ fingerprint(texts[41])).bit_count() <= 2
    assert similarity(shingles(texts[40]), shingles(texts[41])) < 0.8
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())
    assert sorted(got, key=repr) == kept(list(enumerate(texts)))
    assert set(far) <= set(got) and {i + 1 for i in far} <= set(got) and 41 not in got
