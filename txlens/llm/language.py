"""Language of texts by string kernels: blended-spectrum n-gram presence, Nystrom landmarks, kernel ridge regression.

A text is the set of its byte n-grams of two to five bytes (letters in lower case, everything else a space), hashed to
a fixed number of places. The kernel of two texts is the size of the common set over the root of the product of both
sizes. Landmarks, a bounded number of labelled texts of every language, span the kernel's space; one ridge regression
per language against the rest is solved in it. A score is the kernel to all landmarks times the solved coefficients;
both products are linear in the presence vector, so they are multiplied once and a batch of texts is scored by one
matrix product.

Learning takes at most `per_language` labelled texts of each language (smallest hash of the id), a documented bound;
scoring covers every text whole. The score is half of one plus the best regression value (targets are 1 and -1),
limited to 0 to 1.

Null texts and texts without a letter are `und` with score 0. Labels that are null are not learned. If there is nothing
to learn from, every text is `und`. Ties between languages go to the first in alphabetical order. Each row gives a row,
also with equal or null ids. An empty table gives an empty table. Only id, text and label columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txlens.llm import rolling

SIZES = (2, 3, 4, 5)
#: Places of the presence vector.
PLACES = 1 << 15
PER_LANGUAGE, LANDMARKS, RIDGE = 800, 60, 1.0
#: Texts whose vectors are held at once.
ROWS = 64
LETTER = re.compile(r"[^\W\d_]")
RESULT = "doc_id long, lang_pred string, score double"

_FOLDED = np.full(256, 0x20, np.uint32)
_FOLDED[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLDED[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLDED[0x80:] = np.arange(0x80, 0x100)
_MULTIPLIER = np.uint32(0x9E3779B1)


def presence(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row per text: which places its n-grams take."""
    out = np.zeros((len(sizes), PLACES), bool)
    flat = out.ravel()
    folded = _FOLDED[data]
    base = np.repeat(np.arange(len(sizes), dtype=np.int64) * PLACES, sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
    h = folded.copy()
    for n in range(2, max(SIZES) + 1):
        if len(data) < n:
            break
        h = (h[:-1] * np.uint32(0x01000193)) ^ folded[n - 1:]
        if n in SIZES:
            at = base[: len(h)] + ((h * _MULTIPLIER + np.uint32(n)) * _MULTIPLIER >> np.uint32(17)).astype(np.int64)
            flat[at[left[: len(h)] >= n]] = True
    return out


def blocks(bodies: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, presence) of a few texts at a time."""
    for i, j, data, sizes in rolling.chunks(bodies):
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for a in range(0, j - i, ROWS):
            z = min(j - i, a + ROWS)
            yield i + a, i + z, presence(data[ends[a]:ends[z]], sizes[a:z])


class Model:
    """Languages, the folded coefficients by place, and a constant for each language."""

    def __init__(self, languages: list[str], weights: np.ndarray, constant: np.ndarray):
        self.languages, self.weights, self.constant = languages, weights, constant

    def predict(self, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.maximum(present.sum(axis=1), 1)
        values = (present.astype(np.float32) @ self.weights) / np.sqrt(size)[:, None] + self.constant
        best = values.argmax(axis=1)
        return best, np.clip((1 + values[np.arange(len(best)), best]) / 2, 0, 1)


def _scaled(packed: np.ndarray) -> np.ndarray:
    """Presence vectors over the root of their size, from packed bits."""
    x = np.unpackbits(packed, axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
    return x


def fit(packed: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Nystrom kernel ridge regression of each language against the rest.

    Rows are packed presence bits in a random but fixed order; a few hundred at a time are unpacked.
    """
    languages = sorted(set(labels))
    own = np.array([languages.index(x) for x in labels])
    chosen = np.concatenate([np.flatnonzero(own == c)[:landmarks] for c in range(len(languages))])
    marks = _scaled(packed[chosen])
    kernel = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel)
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    phi = np.concatenate([_scaled(packed[i:i + 256]) @ marks.T for i in range(0, len(packed), 256)]).astype(np.float64) @ root
    phi = np.column_stack([phi, np.ones(len(phi))])
    target = np.where(own[:, None] == np.arange(len(languages))[None, :], 1.0, -1.0)
    # languages count alike, however many texts they have
    weight = 1.0 / np.bincount(own)[own]
    weight *= len(own) / weight.sum()
    solved = np.linalg.solve((phi * weight[:, None]).T @ phi + ridge * np.eye(phi.shape[1]), (phi * weight[:, None]).T @ target)
    return Model(languages, marks.T @ (root @ solved[:-1]).astype(np.float32), solved[-1])


def learn(documents: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from labelled texts whose id fulfils `learnable` (a condition on the column `id`)."""
    known = documents.select(F.col(key).cast("long").alias("id"), F.col(label).alias("lang"), F.col(text).cast("binary").alias("body")).where("lang IS NOT NULL AND body IS NOT NULL").where(learnable)
    known = known.withColumns({"h": F.xxhash64("id"), "k": F.xxhash64("body")})
    hashed = known.select("id", "lang", "h", "k").distinct()
    # of a language with many texts only the smallest hashes are ranked, twice as many as asked for on average
    sizes = hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    few = hashed.join(sizes, "lang").where((F.col("n") <= 4 * per_language) | (share * F.col("n") < 2 * per_language))
    first = Window.partitionBy("lang").orderBy("h", "id", "k")
    chosen = few.withColumn("no", F.row_number().over(first)).where(F.col("no") <= per_language).select("id", "k", "lang")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [row.tobytes() for _, _, p in blocks(b.column("body")) for row in np.packbits(p, axis=1)]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("lang"), pa.array(packed, pa.binary())], ["h", "lang", "bits"])

    # a text is taken once, however many rows hold it under one id; a few numbers per language are broadcast, less than
    # the model itself holds of it
    taken = known.join(F.broadcast(chosen), ["id", "k", "lang"]).dropDuplicates(["id", "k", "lang"]).select("h", "lang", "body")
    rows: pd.DataFrame = taken.mapInArrow(bits, "h long, lang string, bits binary").toPandas().sort_values(["h", "lang", "bits"])
    if rows.empty:
        return Model([], np.zeros((PLACES, 0), np.float32), np.zeros(0))
    packed = np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), -1)
    return fit(packed, rows["lang"].tolist())


def predict(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = [], []
            for i, j, present in blocks(b.column("body")):
                if not model.languages:
                    lang += ["und"] * (j - i)
                    score += [0.0] * (j - i)
                    continue
                best, value = model.predict(present)
                for r, c, v in zip(range(i, j), best.tolist(), value.tolist()):
                    t = b.column("body")[r]
                    letters = t.is_valid and LETTER.search(t.as_py().decode()) is not None
                    lang.append(model.languages[c] if letters else "und")
                    score.append(v if letters else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("body")).mapInArrow(run, RESULT)
