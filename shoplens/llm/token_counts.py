"""Token counts of a public tokenizer by a two-tier lookup on the map side.

A byte-level BPE tokenizer cuts a text into pre-tokens and encodes each on its
own, so a text's token count is the sum over its pre-tokens. Two tiers give
the count of a pre-token:

1. *Frequent pre-tokens.* A compact table (their bytes, lengths and token
   counts in three packed arrays; at most ``FREQUENT`` entries of at most
   ``LONGEST`` characters, so at most 5 MB) is broadcast. A worker opens it as
   a hash table once.
2. *Misses* are encoded by the library in the worker and kept in a cache of
   at most ``RECENT`` entries, which lives as long as the worker.

Documents are read once more for the frequent ones, but only about
``SAMPLE`` of them, drawn at random, are cut; that draw decides what is looked
up where and never a count. No pre-token of the main pass is shuffled.

Special strings within a text are tokens of their own, as the library takes
them by default; the text between them is cut separately. Texts with code
points on which the splitting pattern and the library might disagree (see
``SURE``) are cut by the library's own splitter, tokenizers of other
kinds (``.model`` files; ``.json`` files with a normalizer or another splitter)
encode whole texts.

Defined results: NULL and empty texts have 0 bytes and 0 tokens; very long
texts are cut piece by piece and never held as a list; repeated rows and NULL
ids each give their own row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import over_batches, tallied

FREQUENT, LONGEST = 1 << 15, 32
RECENT = 1 << 16
SAMPLE, SEED = 4_000, 11
MAX_TOKENS = 1024
#: Fixed value: the byte-level splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points whose classes agree in the pattern and in the library (a test compares them all).
SURE = "\\x00-\u0557\u0591-\u05c7\u05d0-\u05ea\u0600-\u06ff\u0900-\u0963\u2010-\u205e\u20a0-\u20bf\u3001-\u303f\u3041-\u3096\u30a1-\u30fe\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e"


class TokenCounter:
    """Counts tokens in a worker. ``spec`` is the content of the tokenizer's file."""

    def __init__(self, spec: bytes, kind: str, frequent: tuple[str, bytes, bytes] = ("", b"", b"")):
        self.spec, self.kind, self.frequent = spec, kind, frequent
        self._open()

    def __getstate__(self) -> dict:
        return {"spec": self.spec, "kind": self.kind, "frequent": self.frequent}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._open()

    def _open(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.table = None
        if self.kind == "model":
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor()
            pieces.LoadFromSerializedProto(self.spec)
            self.encoded = lambda text: len(pieces.encode(text, num_threads=1))
            return
        import regex
        from tokenizers import Tokenizer

        text = self.spec.decode()
        library, about = Tokenizer.from_str(text), json.loads(text)
        library.no_padding()
        library.no_truncation()
        self.encoded = lambda text: len(library.encode(text, add_special_tokens=False).ids)
        cut = about.get("pre_tokenizer") or {}
        plain = all(not t[k] for t in about["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if about.get("normalizer") or not plain or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            return
        names, sizes, counts = self.frequent
        ends = np.cumsum(np.frombuffer(sizes, np.uint8), dtype=np.int64)
        starts = ends - np.frombuffer(sizes, np.uint8)
        self.table = _Lengths(self.encoded)
        self.table.update((names[a:b], n) for a, b, n in zip(starts.tolist(), ends.tolist(), counts))
        strings = sorted((t["content"] for t in about["added_tokens"]), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, strings))) if strings else None
        self._piece, self._doubt = regex.compile(PATTERN), regex.compile(f"[^{SURE}]")
        self._library_cut = library.pre_tokenizer.pre_tokenize_str

    def pieces(self, text: str) -> Iterator[str]:
        """Pre-tokens of a text without special strings."""
        if self._doubt.search(text):
            return (text[a:b] for _, (a, b) in self._library_cut(text))
        if len(text) < 1 << 18:
            return iter(self._piece.findall(text))
        return (m.group() for m in self._piece.finditer(text))

    def parts(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of these there are."""
        if self._special is None or not self._special.search(text):
            return [text], 0
        between = self._special.split(text)
        return between, len(between) - 1

    def count(self, text: str) -> int:
        if self.table is None:
            return self.encoded(text)
        between, special = self.parts(text)
        return special + sum(sum(map(self.table.__getitem__, self.pieces(t))) for t in between)


class _Lengths(dict):
    """Token counts of the frequent pre-tokens; others are encoded and kept for a while."""

    def __init__(self, encoded):
        super().__init__()
        self.encoded, self.recent = encoded, {}

    def __missing__(self, piece: str) -> int:
        n = self.recent.get(piece)
        if n is None:
            n = self.encoded(piece)
            if len(piece) <= LONGEST:
                if len(self.recent) >= RECENT:
                    self.recent.clear()
                self.recent[piece] = n
        return n


def frequent_pieces(docs: DataFrame, counter: TokenCounter, spark_counter) -> tuple[str, bytes, bytes]:
    """The packed table of the most frequent pre-tokens of about ``SAMPLE`` documents."""
    total = docs.count()
    some = docs.where("text is not null").where(F.rand(SEED) < SAMPLE / max(total, 1))

    def add(batch: pa.RecordBatch, tally: dict) -> None:
        own = spark_counter.value
        for text in batch.column("text").to_pylist():
            for part in own.parts(text)[0]:
                pieces = own.pieces(part)
                while block := list(islice(pieces, 1 << 16)):
                    for piece, n in Counter(block).items():
                        if len(piece) <= LONGEST:
                            tally[piece] = tally.get(piece, 0) + n

    top = tallied(some.select("text"), add, "piece string").groupBy("piece").agg(F.sum("n").alias("n"))
    top = top.where("n > 1").orderBy(F.desc("n"), "piece").limit(FREQUENT).select("piece").toArrow()
    names = [p for p in top.column("piece").to_pylist()]
    counts = [counter.encoded(p) for p in names]
    return "".join(names), bytes(map(len, names)), bytes(counts)


def token_counts(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``max_tokens``) of every row.

    ``tokenizer_path`` is read by the driver; its content goes to the workers,
    which need no copy of the file.
    """
    with open(tokenizer_path, "rb") as f:
        spec = f.read()
    context = docs.sparkSession.sparkContext
    counter = TokenCounter(spec, "model" if tokenizer_path.endswith(".model") else "json")
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if counter.table is not None:
        counter.frequent = frequent_pieces(text, counter, context.broadcast(counter))
    shared = context.broadcast(counter)

    def run(batch: pa.RecordBatch) -> dict:
        count, sizes, tokens = shared.value.count, [], []
        for value in batch.column("text"):
            text = value.as_py()
            sizes.append(len(value.as_buffer()) if text else 0)
            tokens.append(count(text) if text else 0)
        return {"doc_id": batch.column("doc_id"), "n_bytes": sizes, "n_tokens": tokens, "over_limit": [n > max_tokens for n in tokens]}

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return over_batches(text, run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
