"""Byte-pair encoding and decoding of whole texts by tree concatenation.

White space cuts a text into chunks that never influence each other, so a distinct chunk is encoded once per worker
and its ids are looked up afterwards. Texts above `segment_bytes` are cut at white space into segments that are
encoded as rows of their own. A pre-token above `leaf` symbols has no safe cut: its pieces are encoded in parallel
rows, without the end-of-word mark unless they are the last, and joined pairwise. At a join the last w tokens of the
left side and the first w of the right are encoded again as one window; w doubles until the window's outer tokens are
those of both sides again and each seam (outer token beside its neighbour) encodes to exactly these two tokens.
Byte-pair merging is decided by neighbours, so agreement at the seams fixes the whole sequence.

A text above `segment_bytes` that many rows hold is encoded once, and its result joined back to the rows.

Null and empty texts have no ids and decode to the empty text. Rows with equal id and text each give a row. Special
strings of the vocabulary in a text become their ids, as the library does by default. Only the id and text columns
are read, so other columns may have any name. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE

from txlens.llm.common import small_batches, worker_cache

# A task has one core; threads of the library would only wait for each other on the cores of other tasks.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks in each of the two generations that one worker remembers.
REMEMBERED = 80_000
#: Characters that lower-case alike everywhere and that normal form C leaves as they are.
PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]*")
#: Symbols of a pre-token that are encoded at once.
LEAF = 2048
#: Bytes of a text from which it is encoded in segments.
SEGMENT_BYTES = 1 << 16

DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED = "doc_id long, n_tokens long, ids array<int>, decoded string"


class Encoder:
    """The vocabulary of a file, with a memory of chunks."""

    def __init__(self, path: str, leaf: int = LEAF):
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.leaf, self.path = leaf, path
        model = described["model"]
        self.end = model.get("end_of_word_suffix") or ""
        lowers = any(n.get("type") == "Lowercase" for n in (described.get("normalizer") or {}).get("normalizers", []))
        self.plain = PLAIN if lowers else re.compile("(?!)")
        # For plain chunks in lower case, for which the normalizer would do nothing.
        self.bare = Tokenizer.from_str(json.dumps(described | {"normalizer": None, "truncation": None, "padding": None}))
        self.added = [t["content"] for t in described["added_tokens"]]
        self.names = {i: t for t, i in self.bare.get_vocab().items()}
        self.known: dict[bytes, tuple[str, str, int]] = {}
        self.older: dict[bytes, tuple[str, str, int]] = {}

    @cached_property
    def library(self) -> Tokenizer:
        """The tokenizer of the file, for chunks that are not plain."""
        whole = Tokenizer.from_file(self.path)
        whole.no_truncation()
        whole.no_padding()
        return whole

    def _merging(self, end: str | None) -> Tokenizer:
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return Tokenizer(BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=end) if end else BPE(vocab=model["vocab"], merges=merges))

    @cached_property
    def inner(self) -> Tokenizer:
        """Merges of byte symbols that do not end a word."""
        return self._merging(None)

    @cached_property
    def last(self) -> Tokenizer:
        """Merges of byte symbols that end a word."""
        return self._merging(self.end)

    def piece(self, symbols: str, last: bool) -> list[int]:
        """Ids of a run of byte symbols, as the end of a word or not."""
        return (self.last if last else self.inner).encode(symbols, add_special_tokens=False).ids

    def spelled(self, ids: list[int]) -> str:
        s = "".join(self.names[i] for i in ids)
        return s.removesuffix(self.end) if self.end else s

    def seam_holds(self, a: int, b: int, last: bool) -> bool:
        return self.piece(self.spelled([a, b]), last) == [a, b]

    def joined(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Ids of two neighbouring runs of one pre-token; `last`: the right one ends it."""
        if not left or not right:
            return left or right
        w = 4
        while True:
            a, b = max(0, len(left) - w), min(len(right), w)
            ends = last and b == len(right)
            window = self.piece(self.spelled(left[a:] + right[:b]), ends)
            agrees_left = a == 0 or (window[0] == left[a] and self.seam_holds(left[a - 1], window[0], ends and len(window) == 1))
            agrees_right = b == len(right) or (window[-1] == right[b - 1] and self.seam_holds(window[-1], right[b], last and b + 1 == len(right)))
            if agrees_left and agrees_right:
                return left[:a] + window + right[b:]
            w *= 2

    def tree(self, parts: list[list[int]], last: bool = True) -> list[int]:
        """Joins the runs of one pre-token pairwise until one is left."""
        while len(parts) > 1:
            n = len(parts)
            parts = [self.joined(parts[i], parts[i + 1], last and i + 2 >= n) if i + 1 < n else parts[i] for i in range(0, n, 2)]
        return parts[0] if parts else []

    def pieces_of(self, symbols: str) -> list[str]:
        return [symbols[i:i + self.leaf] for i in range(0, len(symbols), self.leaf)]

    def pre_tokens(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk without special strings, as byte symbols."""
        return [s for s, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def is_long(self, chunk: bytes) -> bool:
        return len(chunk) > self.leaf and not any(a.encode() in chunk for a in self.added)

    def long_chunk(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for symbols in self.pre_tokens(chunk):
            runs = self.pieces_of(symbols)
            ids += self.tree([self.piece(r, i + 1 == len(runs)) for i, r in enumerate(runs)])
        return ids

    def entry(self, ids: list[int]) -> tuple[str, str, int]:
        return " ".join(map(str, ids)), " ".join([self.names[i] for i in ids]), len(ids)

    def learn(self, chunks: set[bytes]) -> None:
        self.known.update({c: self.older[c] for c in chunks if c in self.older})
        plain, short = [], []
        for c in [c for c in chunks if c not in self.known]:
            if self.is_long(c):
                self.known[c] = self.entry(self.long_chunk(c.decode()))
            else:
                (plain if b"<|" not in c and self.plain.fullmatch(c.decode()) else short).append(c)
        for coder, own, texts in ((self.bare, plain, [c.decode().lower() for c in plain]), (self.library, short, [c.decode() for c in short])):
            for c, e in zip(own, coder.encode_batch_fast(texts, add_special_tokens=False)):
                self.known[c] = self.entry(e.ids)

    def text(self, data: bytes) -> tuple[str, str, int]:
        """Ids joined by spaces, decoded text, and the number of ids."""
        chunks = data.split()
        missing = {c for c in chunks if c not in self.known}
        if missing:
            if len(self.known) + len(missing) > REMEMBERED:
                self.older, self.known, missing = self.known, {}, set(chunks)
            self.learn(missing)
        found = [self.known[c] for c in chunks]
        counts = [f[2] for f in found]
        if 0 in counts:
            found = [f for f in found if f[2]]
        # The library decodes without a decoder of its own by joining the tokens' names with spaces.
        return " ".join([f[0] for f in found]), " ".join([f[1] for f in found]), sum(counts)


def encoder(path: str, leaf: int = LEAF) -> Encoder:
    """One encoder per worker and file."""
    kept = worker_cache("bpe")
    if (path, leaf) not in kept:
        kept[path, leaf] = Encoder(path, leaf)
    return kept[path, leaf]


def _finish(rows: Iterable[tuple], digest: bool, key: str = "doc_id") -> pd.DataFrame:
    if digest:
        hashed = [(d, n, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, i, t, n in rows]
        return pd.DataFrame(hashed, columns=[key, "n_tokens", "ids_sha256", "decoded_sha256"]).astype({key: "Int64"})
    out = [(d, n, [int(x) for x in i.split()], t) for d, i, t, n in rows]
    return pd.DataFrame(out, columns=[key, "n_tokens", "ids", "decoded"]).astype({key: "Int64"})


def _segments(data: bytes, coder: Encoder, size: int) -> Iterator[tuple[int, str, bool]]:
    """(word number or -1, content, last): runs of chunks, and the pieces of long pre-tokens as byte symbols."""
    run, filled, word = [], 0, 0
    for chunk in data.split():
        if coder.is_long(chunk):
            if run:
                yield -1, b" ".join(run).decode(), True
                run, filled = [], 0
            for symbols in coder.pre_tokens(chunk.decode()):
                pieces = coder.pieces_of(symbols)
                for i, p in enumerate(pieces):
                    yield word, p, i + 1 == len(pieces)
                word += 1
            continue
        run.append(chunk)
        filled += len(chunk) + 1
        if filled >= size:
            yield -1, b" ".join(run).decode(), True
            run, filled = [], 0
    if run:
        yield -1, b" ".join(run).decode(), True


def encode(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", digest: bool = False, segment_bytes: int = SEGMENT_BYTES, leaf: int = LEAF) -> DataFrame:
    """One row per document: doc_id, n_tokens, and ids and decoded text, or their digests."""
    small_batches(documents.sparkSession)
    result = DIGEST if digest else ENCODED
    source = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = F.octet_length("text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, leaf)
        for b in batches:
            found = _finish(((d.as_py(), *coder.text(t.as_py())) for d, t in zip(b.column("doc_id"), b.column("text"))), digest)
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path, leaf)
        for b in batches:
            for k, t in zip(b["text_key"], b["text"]):
                rows = [(k, i, *s) for i, s in enumerate(_segments(t.encode(), coder, segment_bytes))] or [(k, 0, -1, "", True)]
                yield pd.DataFrame(rows, columns=["text_key", "place", "word", "content", "last"])

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path, leaf)
        for b in batches:
            ids = [coder.text(c.encode())[0].split() if w < 0 else coder.piece(c, last) for w, c, last in zip(b["word"], b["content"], b["last"])]
            b = b.drop(columns=["content", "last"])
            b["ids"] = [[int(x) for x in i] for i in ids]
            yield b

    def joined(b: pd.DataFrame) -> pd.DataFrame:
        coder = encoder(path, leaf)
        b = b.sort_values("place")
        ids: list[int] = []
        parts, open_word = [], -1
        for w, own in zip(b["word"], b["ids"]):
            if w != open_word and parts:
                ids += coder.tree(parts)
                parts = []
            open_word = w
            if w < 0:
                ids += list(own)
            else:
                parts.append([int(x) for x in own])
        if parts:
            ids += coder.tree(parts)
        i, t, n = coder.entry([int(x) for x in ids])
        return _finish([(int(b["text_key"].iloc[0]), i, t, n)], digest, "text_key")

    short = source.where(size <= segment_bytes).withColumn("text", F.col("text").cast("binary")).mapInArrow(whole, result)
    keyed = source.where(size > segment_bytes).withColumn("text_key", F.xxhash64("text"))
    once = keyed.groupBy("text_key").agg(F.first("text").alias("text"))
    pieces = once.mapInPandas(cut, "text_key long, place int, word int, content string, last boolean")
    spread = pieces.repartition("text_key", "place").mapInPandas(coded, "text_key long, place int, word int, ids array<int>")
    done = spread.groupBy("text_key").applyInPandas(joined, result.replace("doc_id", "text_key", 1))
    return short.unionByName(keyed.select("doc_id", "text_key").join(done, "text_key").drop("text_key"))
