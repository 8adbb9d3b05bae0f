"""Each stage of the corpus pipeline against brute force on what the stage before kept."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_copies_by_simhash import kept
from txlens import session
from txlens.llm import op4_query

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = session.materialise(stage(spark, docs, SF), name)
        found.append((name, docs))
    return dict(found)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert [s for s, _ in corpus_pipeline.STAGES] == list(stages)[1:]
    assert all(df.columns == COLUMNS for df in list(stages.values())[:-1])


def test_toxicity(spark, stages):
    before, after = texts(stages["documents"]), texts(stages["toxicity"])
    scored = {r.doc_id: r.predicted for r in op4_query.op4_toxicity(spark, SF).collect()}
    assert after == {i: t for i, t in before.items() if not scored[i]}
    assert 0 < len(after) < len(before)


def test_near_copies(stages):
    before, after = texts(stages["toxicity"]), texts(stages["simhash_near_dedup"])
    assert sorted(after, key=repr) == kept(list(before.items()))
    assert all(after[i] == before[i] for i in after)


def test_substrings(stages):
    before, after = texts(stages["simhash_near_dedup"]), texts(stages["substring_dedup"])
    first = {}
    for i, t in sorted(before.items()):
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
    for i, t in before.items():
        w = t.encode().split()
        gone = [False] * len(w)
        s = t.split()
        for k in range(len(s) - 12):
            if first[tuple(s[k:k + 13])] < i:
                gone[k:k + 13] = [True] * 13
        left = [x for x, g in zip(w, gone) if not g]
        assert after[i].encode().split() == left if left else i not in after
        assert any(gone) or after[i] == t


def test_contamination(spark, stages):
    before, after = texts(stages["substring_dedup"]), texts(stages["benchmark_decontamination"])
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {i for i, t in before.items() if any(x in " ".join(t.lower().split()) for x in items)}
    assert holds and not holds & after.keys()
    assert len(after) >= len(before) - 2 * len(holds) and all(after[i] == before[i] for i in after)


def test_encoding(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before = texts(stages["benchmark_decontamination"])
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in stages["bpe"].collect()}
    for i, t in before.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert got.keys() == before.keys()
