import random
import re
from collections import Counter, defaultdict

import pytest

from txlens.llm import collocations as C

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least=10, listed=2000):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                count[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        found = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        rows = []
        for p, a in found.items():
            if len(p) == 2 and any(p in (q[:2], q[1:]) and 100 * n >= 50 * a for q, n in found.items() if len(q) == 3):
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            rows.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:listed])]
    return sorted(out)


def answer(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 3, "z") for r in rows], "text string, lang string, n int, w1 string")
    return sorted(tuple(r) for r in C.phrases(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def prose(rng, n):
    words = ["the", "The", "a", "New", "york", "city", "Été", "x\x00", "x", "x\x01", "x\x00\x01", "it's", "日本", " ", "b c", *(f"w{i}" for i in range(12))]
    ends = [" ", "  ", "\t", ". ", ", ", "\n", "\r\n", "\x0b", "?", " \t "]
    return [("".join(rng.choice(words) + rng.choices(ends, [20, 2, 2, 1, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randrange(40))), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(n)]


@pytest.mark.parametrize(("least", "listed", "block", "long"), [(10, 2000, 16 << 20, 4 << 20), (3, 7, 500, 60)])
def test_equals_plain_counts(spark, monkeypatch, least, listed, block, long):
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "LONG", long)
    monkeypatch.setattr(C, "BUCKET", 4 * block)
    rows = prose(random.Random(8), 300)
    rows += [(None, None), (None, "en"), ("", "fr"), (" \t .", "fr"), ("new york city " * 3000, "en"), ("a a a a. " * 500, "xx"), ("same words here", "en")]
    rows += [("same words here", "en")] * 30
    assert answer(spark, rows, least=least, listed=listed) == brute(rows, least, listed)


def test_a_word_with_extensions_in_every_partition(spark):
    """All runs start or end with one word, so range borders part it from them."""
    rows = [(f"the w{i} the", "en") for i in range(300) for _ in range(10)] + [(f"the w{i}", "en") for i in range(200) for _ in range(11)]
    assert answer(spark, rows, least=10) == brute(rows)


def test_empty_and_large_numbers(spark):
    assert answer(spark, []) == []
    assert answer(spark, [("a b", "en")]) == []
    big = 2**61
    assert C.score(big, big + 1, big) == 10**6 * big // (big + 1)
