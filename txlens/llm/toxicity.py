"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer maps each word to a class: insult (with a weight), threat, target, negation, reported speech or
other. Insult arcs, whole words and word beginnings, and their weights are learned from labelled texts: the log of how
much likelier a term is in toxic texts. Three small transducers follow a clause: one remembers reported speech, one
how long a negation reaches, one how long a target reaches. Their composition, built once as one table, multiplies the
weight of an insult or threat by what it remembers: a target raises it, negation and report lower it. A threat counts
only with a target. The weights of a text's matched clauses, not of its words alone, are the inputs of a logistic
score.

Learning takes at most `labelled_rows` labelled texts (those with the smallest hash of their id), a bounded number, so
the lexicon is bounded too; three quarters give the lexicon, one quarter the score's few coefficients. Scoring covers
every text whole. If no labelled texts of both classes exist, the score is 0.5 x the number of matches limited to 1,
which is 0.

Null and empty texts have no clauses and get the score of a text without matches. Rows with a null id are scored and
never learned from; repeated ids are scored once per row, and a label that is repeated counts once, the larger one
winning. An empty table gives an empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txlens.llm.common import small_batches, worker_cache
from txlens.session import materialise

#: Bound of the labelled texts that are learned from.
LABELLED_ROWS = 20_000
#: Toxic texts that must hold a term, and the least weight of an arc.
LEAST_TEXTS, LEAST_WEIGHT = 6, 1.8
#: Lengths of word beginnings that can be arcs.
BEGINNINGS = (4, 5, 6, 7)
#: Words that a negation and a target reach.
NEGATION_REACH, TARGET_REACH = 3, 4
#: What they do to a weight; a threat's own weight.
TARGETED, NEGATED, REPORTED, THREAT_WEIGHT = 1.5, 0.5, 0.7, 3.0

# Function words of the grammar in the four languages of the tables.
TARGETS = frozenset("you your yourself u tu toi vous ton ta vos du dich dir ihr euch dein tú ti usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never nor without ne pas jamais sans nicht kein keine nie ohne nunca jamás sin".split())
REPORTS = frozenset("said says quoted wrote claimed dit disait écrit sagte sagt schrieb dijo dice escribió".split())
THREATS = frozenset("kill hurt destroy shoot stab beat burn tuer frapper brûler töten schlagen verbrennen matar golpear quemar".split())

WORD = re.compile(r"\w+")
CLAUSE = re.compile(r"([.!?;:\n]+)")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: The first state in which speech is reported, and nothing else remembered.
REPORTED_STATE = (NEGATION_REACH + 1) * (TARGET_REACH + 1)

SCORED = "doc_id long, n_clauses long, weight double, score double"


def _report(state: int, kind: int) -> int:
    return 1 if kind == REPORT else state


def _reach(length: int, starter: int):
    def follow(state: int, kind: int) -> int:
        return length if kind == starter else max(0, state - 1)

    return follow


def composed() -> tuple[np.ndarray, np.ndarray]:
    """(next state, factor) of the product of the three memories, by [state, class]."""
    memories = [(2, _report), (NEGATION_REACH + 1, _reach(NEGATION_REACH, NEGATION)), (TARGET_REACH + 1, _reach(TARGET_REACH, TARGET))]
    states = {s: i for i, s in enumerate(product(*(range(n) for n, _ in memories)))}
    follow, factor = np.zeros((len(states), 6), np.int64), np.zeros((len(states), 6))
    for (r, n, t), i in states.items():
        for kind in range(6):
            follow[i, kind] = states[tuple(f(s, kind) for s, (_, f) in zip((r, n, t), memories))]
            damped = (REPORTED if r else 1.0) * (NEGATED if n else 1.0)
            if kind == INSULT:
                factor[i, kind] = damped * (TARGETED if t else 1.0)
            if kind == THREAT:
                factor[i, kind] = damped if t else 0.0
    return follow, factor


class Grammar:
    """The lexical transducer composed with the clause transducers."""

    def __init__(self, arcs: dict[str, float]):
        self.arcs = arcs
        follow, factor = composed()
        self.follow, self.factor = follow.tolist(), factor.tolist()
        self.seen: dict[str, tuple[int, float]] = {}

    def word(self, w: str) -> tuple[int, float]:
        """Class and weight; the heaviest arc wins."""
        if w in self.seen:
            return self.seen[w]
        best = max([self.arcs.get(w, 0.0), *(self.arcs.get(w[:n] + "*", 0.0) for n in BEGINNINGS if len(w) >= n)])
        if best > 0:
            found = INSULT, best
        elif w in THREATS:
            found = THREAT, THREAT_WEIGHT
        else:
            found = (TARGET if w in TARGETS else NEGATION if w in NEGATIONS else REPORT if w in REPORTS else OTHER), 0.0
        if len(self.seen) > 50_000:
            self.seen.clear()
        self.seen[w] = found
        return found

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """Matched clauses with their weight."""
        text = text.lower()
        if not any(self.word(w)[0] in (INSULT, THREAT) for w in set(WORD.findall(text))):
            return []
        found = []
        parts, reported = CLAUSE.split(text), False
        for clause, end in zip(parts[::2], [*parts[1::2], ""]):
            state, total, back, reach = REPORTED_STATE if reported else 0, 0.0, 0.0, 0
            for w in WORD.findall(clause):
                kind, weight = self.word(w)
                gain = weight * self.factor[state][kind]
                if kind == TARGET and reach:  # a target behind the insult or threat
                    total += back
                    back = 0.0
                reach = max(0, reach - 1)
                if kind in (INSULT, THREAT):
                    total += gain
                    back, reach = (weight * (TARGETED - 1) if kind == INSULT else weight if not gain else 0.0), TARGET_REACH
                state = self.follow[state][kind]
            # what follows a colon is still reported; any other end forgets it
            reported = end == ":" and state >= REPORTED_STATE
            if total > 0:
                found.append((clause.strip(), total))
        return found

    def inputs(self, text: str | None) -> list[float]:
        weights = [w for _, w in self.clauses(text or "")]
        if not weights:
            return [0.0, 0.0, 0.0, 0.0]
        length = 1 + len(text) / 1000
        return [max(weights), float(np.log1p(sum(weights))), float(np.log1p(len(weights))), float(np.log1p(sum(weights) / length))]


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    worker_cache("toxicity")
    for b in batches:
        counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for text, toxic in zip(b["text"], b["toxic"]):
            words = set(WORD.findall((text or "").lower()))
            counts[bool(toxic)].update(words | {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) >= n})
        terms = list(counts[True].keys() | counts[False].keys())
        yield pd.DataFrame({"term": terms, "toxic": [counts[True][t] for t in terms], "clean": [counts[False][t] for t in terms]})


def learn_arcs(texts: DataFrame) -> dict[str, float]:
    """Terms and weights from (text, toxic)."""
    totals = {bool(r.toxic): r.n for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return {}
    counted = texts.select("text", "toxic").mapInPandas(_count_terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.ln((F.col("toxic") + 0.5) / (totals[True] + 1.0)) - F.ln((F.col("clean") + 0.5) / (totals[False] + 1.0))
    kept = counted.where(F.col("toxic") >= LEAST_TEXTS).withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT)
    return {r.term: float(r.weight) for r in kept.select("term", "weight").collect()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients, the constant first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
    return beta


class Model:
    """Arcs of the lexical transducer and coefficients of the score."""

    def __init__(self, arcs: dict[str, float], beta: np.ndarray):
        self.arcs, self.beta = arcs, beta


def learn(documents: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", labelled_rows: int = LABELLED_ROWS) -> Model:
    """A model from labelled texts whose id fulfils `learnable` (a condition on the column `id` of the labels)."""
    small_batches(documents.sparkSession)
    known = labels.select(F.col(key).cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").where(learnable)
    chosen = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(labelled_rows)
    texts = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    # one text per id, so the bound of the labels bounds the texts
    texts = texts.groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    texts = materialise(texts.withColumn("for_score", F.pmod(F.hash("id"), F.lit(4)) == 0), "labelled")
    arcs = learn_arcs(texts.where("NOT for_score"))
    if not arcs:
        return Model({}, np.array([-30.0, 0, 0, 0, 0]))

    def inputs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(arcs)
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"].astype(float), "x": [grammar.inputs(t) for t in b["text"]]})

    rows = texts.where("for_score").select("text", "toxic").mapInPandas(inputs, "toxic double, x array<double>").toPandas()
    if rows["toxic"].nunique() < 2:
        return Model(arcs, np.array([-2.0, 0.5, 0, 0, 0]))
    return Model(arcs, logistic(np.array(rows["x"].tolist()), rows["toxic"].to_numpy()))


def score(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_clauses, weight, score) for each row."""
    small_batches(documents.sparkSession)
    arcs, beta = model.arcs, model.beta

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        grammar = Grammar(arcs)
        for b in batches:
            x = np.array([grammar.inputs(t.as_py()) for t in b.column("text")]).reshape(b.num_rows, 4)
            p = 1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30)))
            columns = [b.column("doc_id"), pa.array(np.rint(np.expm1(x[:, 2])).astype(np.int64)), pa.array(np.expm1(x[:, 1])), pa.array(p)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_clauses", "weight", "score"])

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCORED)


def without_toxic(documents: DataFrame, model: Model, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents whose score is below the limit, with all their columns."""
    small_batches(documents.sparkSession)
    arcs, beta = model.arcs, model.beta
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        grammar = Grammar(arcs)
        for b in batches:
            x = np.array([grammar.inputs(t.as_py()) for t in b.column(place)]).reshape(b.num_rows, 4)
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30))) < limit))

    return documents.mapInArrow(run, documents.schema)
