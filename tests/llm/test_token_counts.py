import math
import random

import public_tokenizers

from txlens.llm.token_counts import Vocabulary, token_counts


def brute(text, scores):
    """Fewest tokens of the best cut, by all cuts of all prefixes."""
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        top = (-math.inf, 0)
        for start in range(end):
            if text[start:end] in scores:
                value, n = best[start][0] + scores[text[start:end]], best[start][1] + 1
                if value > top[0] or value == top[0] and n < top[1]:
                    top = value, n
        best.append(top)
    return best[-1][1]


def test_counts_equal_a_search_without_trie():
    random.seed(2)
    scores = {bytes([b]): -9.0 for b in range(256)} | {b" a": -1.0, b"ab": -2.0, b"abc": -2.5, b"bca": -3.0, b" ab": -3.0, b"cc": -1.5}
    words = sorted({bytes(random.choices(b"abc", k=random.randint(1, 12))) for _ in range(400)})
    assert list(Vocabulary(scores).count(words)) == [brute(b" " + w, scores) for w in words]


def test_counts_of_odd_rows(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    long = "word é " * 50000
    rows = [(1, None, "x"), (2, "", "x"), (None, "two words", "x"), (3, "two words", "x"), (3, "two words", "x"), (4, long, "x"), (5, "q" * 20000, "x")]
    got = sorted(((r.doc_id or 0, r.n_words, r.n_tokens) for r in token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), path).collect()))
    scores = Vocabulary.ranked(path).scores
    two = brute(b" two", scores) + brute(b" words", scores)
    assert got[:5] == [(0, 2, two), (1, 0, 0), (2, 0, 0), (3, 2, two), (3, 2, two)]
    assert got[5] == (4, 100000, 50000 * (brute(b" word", scores) + brute(" é".encode(), scores)))
    assert got[6][1] == 1 and got[6][2] > 1
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), path).collect() == []
