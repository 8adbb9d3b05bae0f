import random
import re
from collections import Counter, defaultdict

import pytest

from txlens.llm import source_audit as A

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, texts=30, listed=50):
    """(lang, source, part, item, value, rank) by plain loops."""
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        groups[lang].add(source)
        found = Counter(TERM.findall(text.translate(LOWER)))
        docs[lang].update(found.keys())
        count[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= texts]

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = share(sum((count[lang, s] for s in sources), Counter()))
        p = {s: share(count[lang, s]) for s in sources}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s})
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t])[:listed]
            out += [(lang, s, part, x.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, x) in enumerate(found)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, 0) for r in rows], "text string, lang string, source string, n int, term int")


def answer(df, **kw):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in A.audit(df, **kw).collect())


def prose(rng, n):
    words = ["Straße", "été", "ÀB", "a", "The", "the", "don't", "x1y", "日本", "naïve", *(f"w{chr(97 + i)}" for i in range(26))]
    return [(" ,.\n".join(rng.choices(words, k=rng.randrange(30)))[: rng.randrange(1, 300)], rng.choice(["en", "de", None]), rng.choices(["hot", "b", "c", None], [6, 1, 1, 1])[0]) for _ in range(n)]


@pytest.mark.parametrize(("texts", "listed", "cells", "held", "summed"), [(30, 50, 1 << 18, 400_000, 1024), (3, 4, 8, 20, 2)])
def test_equals_plain_loops(spark, monkeypatch, texts, listed, cells, held, summed):
    for name, value in (("SHARD_CELLS", 4 * cells), ("CELLS", cells), ("HELD", held), ("SUMMED", summed)):
        monkeypatch.setattr(A, name, value)
    rows = prose(random.Random(4), 400)
    rows += [(None, None, None), ("", "en", "empty"), (None, "xx", "alone"), ("1 2 3", "yy", "one"), ("--", "yy", "two"), ("é" * 100_000 + " THE", "en", "long"), ("nul\x00nul", "en", "b")]
    rows += [("same TEXT here", "en", "hot")] * 40
    assert answer(table(spark, rows), texts=texts, listed=listed) == brute(rows, texts, listed)


def test_ties_and_empty_tables(spark):
    rows = [("b a c", "en", s) for s in ("s2", "s1")] * 30 + [("a", "en", "s3")] * 30
    got = answer(table(spark, rows))
    assert got == brute(rows)
    assert [x[3] for x in got if x[:3] == ("en", "s1", "term")] == ["b", "c"]
    assert A.audit(table(spark, rows).limit(0)).collect() == []


def test_shares_are_exact():
    import numpy as np

    count, total = np.array([1, 7, 9_000_000_000_000_000, 8_999_999_999_999_999]), np.array([3, 7, 9_000_000_000_000_000, 9_000_000_000_000_000])
    assert A.shares(count, total).tolist() == [1 + 10**9 * int(c) // int(t) for c, t in zip(count, total)]
