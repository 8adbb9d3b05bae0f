import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from txlens.llm.bpe import Encoder, encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_trees_of_short_leaves_equal_the_library(library):
    coder = Encoder(PATH, leaf=7)
    random.seed(3)
    for _ in range(800):
        s = "".join(random.choices("abcdefgheinorst" * 4 + "éèüßΣİǅ1'.-!你́\x1c\xa0", k=random.randint(0, 120)))
        s = s.replace("e", " ") if random.random() < 0.3 else s
        s += "<|endoftext|>x" if random.random() < 0.1 else ""
        ids = library.encode(s, add_special_tokens=False).ids
        assert coder.text(s.encode()) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False), len(ids)), s


def test_encode_of_odd_rows(spark, library):
    rows = [(1, "Hello w" * 9000, "a"), (1, "Hello w" * 9000, "a"), (2, None, "b"), (None, "", "c"), (3, "x" * 9000 + " It's " + "é" * 5000, "d"), (4, "ab " * 9000, "e"), (5, "\n", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    expected = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted(map(tuple, encode(df, PATH, segment_bytes=4096).collect()), key=repr) == sorted(expected, key=repr)
    digest = {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in encode(df, PATH, digest=True).collect()}
    assert digest == {(i, hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, _, x, d in expected}
    assert encode(df.limit(0), PATH).collect() == []
