"""Token counts under a unigram model, by dynamic programming shared over a trie of pre-tokens.

A pre-token is a space and a run of bytes that are no white space. Its tokens are the pieces of the vocabulary with the
largest sum of scores (fewest pieces in a tie). The score of a piece is the logarithm of a probability that falls with
its rank as 1 / (rank + 1). Distinct pre-tokens of about a megabyte of text are walked in the order of a trie: the best
score of each prefix is computed once, kept on the path while words below it follow, and the count at a word's end is
stored. A worker remembers counts of earlier pieces of text.

The vocabulary must hold all 256 bytes, so every text can be cut. Null and empty texts have no tokens. Every row gives a
row, also with equal or null ids. An empty table gives an empty table. Texts and words of any length are read whole.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txlens.llm import rolling
from txlens.llm.common import small_batches, worker_cache

#: Counts in each of the two generations that a worker remembers.
REMEMBERED = 200_000
RESULT = "doc_id long, n_words long, n_tokens long"


class Vocabulary:
    """Pieces with scores, and a memory of counts."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.longest = [0] * 256
        for piece in scores:
            self.longest[piece[-1]] = max(self.longest[piece[-1]], len(piece))
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    @classmethod
    def ranked(cls, path: str) -> Vocabulary:
        """From a file of base64 pieces with their rank."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(p): int(r) for p, r in map(bytes.split, f)}
        total = sum(1 / (r + 1) for r in ranks.values())
        return cls({p: -math.log((r + 1) * total) for p, r in ranks.items()})

    def count(self, words: list[bytes]) -> Iterator[int]:
        """Tokens of each of the sorted words; prefixes shared with the word before are not computed again."""
        path, best, tokens = b"", [0.0], [0]
        scores, longest = self.scores, self.longest
        for word in words:
            text = b" " + word
            shared, most = 0, min(len(path), len(text))
            while shared < most and path[shared] == text[shared]:
                shared += 1
            del best[shared + 1:], tokens[shared + 1:]
            for end in range(shared + 1, len(text) + 1):
                top, fewest = -math.inf, 0
                for start in range(max(0, end - longest[text[end - 1]]), end):
                    s = scores.get(text[start:end])
                    if s is not None:
                        value = best[start] + s
                        if value > top or value == top and tokens[start] + 1 < fewest:
                            top, fewest = value, tokens[start] + 1
                best.append(top)
                tokens.append(fewest)
            path = text
            yield tokens[-1]

    def counts(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        words = [t.split() for t in texts]
        distinct = set().union(*words)
        missing = [w for w in distinct if w not in self.known]
        if len(self.known) + len(missing) > REMEMBERED:
            self.older, self.known, missing = self.known, {}, list(distinct)
        fresh = []
        for w in missing:
            if w in self.older:
                self.known[w] = self.older[w]
            else:
                fresh.append(w)
        fresh.sort()
        self.known.update(zip(fresh, self.count(fresh)))
        known = self.known
        return [(len(w), sum([known[x] for x in w])) for w in words]


def loaded(path: str) -> Vocabulary:
    """One vocabulary per worker and file."""
    kept = worker_cache("token_counts")
    if path not in kept:
        kept[path] = Vocabulary.ranked(path)
    return kept[path]


def token_counts(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for each row."""

    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(path)
        for b in batches:
            found = []
            for i, j, _, _ in rolling.chunks(b.column("body")):
                found += vocabulary.counts([t or b"" for t in b.column("body")[i:j].to_pylist()])
            words, tokens = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body")).mapInArrow(run, RESULT)
