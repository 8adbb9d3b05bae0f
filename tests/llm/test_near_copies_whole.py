"""Links that fingerprints, bands and leaders used to lose."""

import random

import pytest

from tests.llm.test_near_copies import shingles, similarity
from txlens.llm import near_copies


def words(rng, n):
    return [f"v{rng.randrange(10**9)}" for _ in range(n)]


def ids(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in near_copies.keep_one(df).collect())


def test_repeats_of_a_line_do_not_count(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        base, line = words(rng, 200), words(rng, 20)
        texts += [" ".join(base + line), " ".join(base + 20 * line)]
        assert similarity(shingles(texts[-1]), shingles(texts[-2])) > 0.95
    assert ids(spark, texts) == list(range(0, 60, 2))


def test_every_pair_at_the_least_similarity_links(spark):
    rng = random.Random(6)
    texts = []
    for i in range(1200):
        base = words(rng, 204)
        # 22 of 200 shingles exchanged: 178 / 222 = 0.802; 23: 177 / 223 = 0.794
        changed = 22 if i < 1000 else 23
        texts += [" ".join(base), " ".join(base[:-changed] + words(rng, changed))]
    assert ids(spark, texts) == list(range(0, 2000, 2)) + list(range(2000, 2400))


@pytest.mark.parametrize("own", [31, 12])
def test_twins_in_a_family_less_like_its_leader(spark, own):
    rng = random.Random(7)
    template = words(rng, 204)
    texts = []
    for i in range(1000):
        # twins of 0.9, like all others 0.70 (31 own words together) or 0.75 (12 own words in several places)
        if own == 31:
            at = list(range(100, 131))
        else:
            at = [20 * k + 4 + j for k in range(6) for j in range(2)]
        one = list(template)
        for a, w in zip(at, words(rng, len(at))):
            one[a] = w
        other = list(one)
        for a in (at[0], at[-1]):
            other[a] = words(rng, 1)[0]
        texts += [" ".join(one), " ".join(other)]
    sets = [shingles(t) for t in texts[:40]]
    assert all(similarity(sets[i], sets[i + 1]) >= 0.9 for i in range(0, 40, 2))
    assert all(0.65 < similarity(sets[i], sets[j]) < 0.8 for i in range(0, 40, 2) for j in range(0, i, 2))
    assert ids(spark, texts) == list(range(0, 2000, 2))


def test_twins_beside_a_linked_crowd(spark):
    """Prefixes that all share, similarities just below 0.8 to a crowd that is one group, and twins among the others."""
    rng = random.Random(8)
    template = words(rng, 204)
    texts = []
    for _ in range(100):
        one = list(template)
        one[rng.randrange(0, 40)] = words(rng, 1)[0]
        texts.append(" ".join(one))
    for _ in range(60):
        one = template[:-26] + words(rng, 26)
        other = one[:-4] + words(rng, 4)
        texts += [" ".join(one), " ".join(other)]
    assert ids(spark, texts) == [0] + list(range(100, 220, 2))
