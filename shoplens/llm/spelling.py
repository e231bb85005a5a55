"""Spelling variants: words that differ by one edit, by Bloom-guided neighbourhoods.

1. *Vocabulary.* Words are counted in the tasks and added up by word.
2. *Filters.* The vocabulary goes into blocked Bloom filters (512-bit blocks,
   ``BITS`` bits a word, ``PROBES`` bits set) sharded by word length: each length has its own
   range of blocks. What a task holds is bounded: the blocks are dealt
   into passes of at most ``MOST`` bytes, and a pass only answers probes of its blocks.
3. *Neighbourhoods.* Every word generates its deletions and its replacements by
   a larger code point of the vocabulary's alphabet; an insertion is the
   deletion seen from the longer word, so every near pair comes from one of its words.
   Hashes of the edits follow from the word's own (a polynomial hash), so only
   edits that the filter lets pass become strings.
4. *Exact join.* These are joined with the vocabulary, which removes the
   filter's false positives. A word's neighbours are counted and compared with aggregates
   and never gathered.

Defined results: NULL texts have no words; a NULL doc_id counts as an empty
string in the deletion rule of ``noisy_words``; a word of any length is treated whole (edits
are generated in blocks); repeated rows count each; ties of a form
go to the smallest word in code-point order; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import over_batches, staged, tallied, utf8_values
from shoplens.llm.textops import LOWER, mix64

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs at least so many times as often as its variant.
FACTOR = 10
#: Fixed value: a run whose checksum this divides loses a code point.
NOISE = 31
BITS, PROBES, BLOCK = 16, 6, 512
#: Bytes of filter in a pass.
MOST = 1 << 24
#: Edits hashed at once.
EDITS = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def noisy_words(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): lower-cased letter runs of at least ``least`` code points after the deletions, counted."""
    run = re.compile(f"[a-z\u00c0-\u00ff]{{{least},}}")

    def add(batch: pa.RecordBatch, tally: dict) -> None:
        for doc_id, data in zip(batch.column("doc_id").to_pylist(), utf8_values(batch.column("text"))):
            if data is None:
                continue
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for word, n in Counter(run.findall(LOWER[data].tobytes().decode())).items():
                h = zlib.crc32(word.encode(), start)
                if h % NOISE == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < least:
                        continue
                tally[word] = tally.get(word, 0) + n

    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return tallied(text, add, "word string").groupBy("word").agg(F.sum("n").alias("n"))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _values(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def _codes(word: str) -> np.ndarray:
    return np.frombuffer(word.encode("utf-32-le"), np.uint32)


def word_hash(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words of one length, one a row."""
    return (_values(codes) * _powers(codes.shape[1], _BASE)).sum(axis=1, dtype=np.uint64)


class Layout:
    """Blocks of each length: where they begin and how many there are."""

    def __init__(self, sizes: dict[int, int]):
        self.lengths = np.array(sorted(sizes), np.int64)
        self.blocks = np.array([max(1, -(-sizes[int(k)] * BITS // BLOCK)) for k in self.lengths], np.int64)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.total = int(self.blocks.sum())

    def places(self, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Block and in-block bits (PROBES times nine) of hashes of words of a length; None if no word has it."""
        at = int(np.searchsorted(self.lengths, length))
        if at == len(self.lengths) or self.lengths[at] != length:
            return None
        mixed = mix64(hashes + np.uint64(length))
        block = ((mixed >> np.uint64(32)) * np.uint64(self.blocks[at])) >> np.uint64(32)
        return block.astype(np.int64) + self.first[at], mix64(mixed ^ np.uint64(_INVERSE))


def _slots(layout: Layout):
    """Filter words (slot) and bit masks of a batch of vocabulary words."""

    def run(batch: pa.RecordBatch) -> dict:
        slots, masks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length, words in _by_length(batch.column("word").to_pylist()):
            block, bits = layout.places(word_hash(np.stack([_codes(w) for w in words])), length)
            for i in range(PROBES):
                bit = ((bits >> np.uint64(9 * i)) & np.uint64(BLOCK - 1)).astype(np.int64)
                slots.append(block * (BLOCK // 64) + (bit >> 6))
                masks.append((np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64))
        return {"slot": np.concatenate(slots), "mask": np.concatenate(masks)}

    return run


def _by_length(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    groups: dict[int, list[str]] = {}
    for w in words:
        groups.setdefault(len(w), []).append(w)
    return iter(groups.items())


class Neighbourhood:
    """Probes words' edits against a pass of the filter."""

    def __init__(self, layout: Layout, alphabet: np.ndarray, first: int, last: int, table):
        self.layout, self.alphabet, self.first, self.last, self.table = layout, alphabet, first, last, table

    def passing(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Which hashes of words of a length the filter lets pass (flat places)."""
        found = self.layout.places(hashes, length)
        if found is None:
            return np.zeros(0, np.int64)
        block, bits = found
        left = np.flatnonzero((block >= self.first) & (block < self.last))
        table = self.table.value
        for i in range(PROBES):
            bit = ((bits[left] >> np.uint64(9 * i)) & np.uint64(BLOCK - 1)).astype(np.int64)
            word = table[(block[left] - self.first) * (BLOCK // 64) + (bit >> 6)]
            left = left[(word >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1]
        return left

    def edits(self, words: list[str], length: int) -> Iterator[tuple[int, str]]:
        """(index, edited word) of the deletions and of the replacements by larger code points that pass."""
        codes = np.stack([_codes(w) for w in words])
        up, down, values = _powers(length, _BASE), _powers(2, _INVERSE)[1], _values(codes)
        share = values * up
        before = np.cumsum(share, axis=1, dtype=np.uint64) - share
        total = share.sum(axis=1, dtype=np.uint64)
        if length > 1:
            after = total[:, None] - before - share
            hashes = before + after * down
            # Of equal neighbouring letters the first stands for all: the results are the same.
            once = np.ones(codes.shape, bool)
            once[:, 1:] = codes[:, 1:] != codes[:, :-1]
            at = np.flatnonzero(once)
            for k in at[self.passing(hashes.ravel()[at], length - 1)].tolist():
                i, p = divmod(k, length)
                yield i, words[i][:p] + words[i][p + 1 :]
        letters = _values(self.alphabet)
        step = max(1, EDITS // max(1, len(words) * len(letters)))
        for lo in range(0, length, step):
            part = slice(lo, min(length, lo + step))
            hashes = total[:, None, None] + (letters[None, None, :] - values[:, part, None]) * up[None, part, None]
            larger = self.alphabet[None, None, :] > codes[:, part, None]
            at = np.flatnonzero(larger)
            for k in at[self.passing(hashes.ravel()[at], length)].tolist():
                rest, c = divmod(k, len(letters))
                i, p = divmod(rest, part.stop - part.start)
                yield i, words[i][: lo + p] + chr(self.alphabet[c]) + words[i][lo + p + 1 :]

    def __call__(self, batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"word": [], "n": [], "near": []}
        counts = dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()))
        for length, words in _by_length(list(counts)):
            step = max(1, EDITS // (length * max(1, len(self.alphabet))))
            for at in range(0, len(words), step):
                some = words[at : at + step]
                for i, near in self.edits(some, length):
                    out["word"].append(some[i])
                    out["n"].append(counts[some[i]])
                    out["near"].append(near)
        return out


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, n) with distinct words to (word, n, near, near_n): each pair one edit apart, once."""
    spark = vocabulary.sparkSession
    lengths = vocabulary.groupBy(F.length("word").alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()
    none = spark.createDataFrame([], "word string, n long, near string, near_n long")
    if not lengths:
        return none
    layout = Layout({r["k"]: r["c"] for r in lengths})
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().where("c <> ''")
    alphabet = np.array(sorted(ord(r["c"]) for r in letters.collect()), np.int64)  # at most the code points there are
    slots = over_batches(vocabulary.select("word"), _slots(layout), "slot long, mask long")
    slots = staged(slots.groupBy("slot").agg(F.bit_or("mask").alias("mask")), "spelling_filter")
    # Hashing a word's edits is dear, so words are dealt evenly, however few files hold them.
    dealt = vocabulary.repartition(max(spark.sparkContext.defaultParallelism, sum(r["c"] for r in lengths) // 50_000))
    width, found = MOST * 8 // BLOCK, None
    for first in range(0, layout.total, width):
        last = min(layout.total, first + width)
        lanes = BLOCK // 64
        part = slots.where(F.col("slot").between(first * lanes, last * lanes - 1)).toArrow()
        table = np.zeros((last - first) * lanes, np.uint64)
        table[part.column("slot").to_numpy() - first * lanes] = part.column("mask").to_numpy().view(np.uint64)
        probe = Neighbourhood(layout, alphabet, first, last, spark.sparkContext.broadcast(table))
        some = over_batches(dealt, probe, "word string, n long, near string")
        found = some if found is None else found.union(some)
    exact = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(exact, "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): the last word when forms are followed, by doubling."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        nxt = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = now.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = staged(step, "spelling_roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(words: DataFrame, least_count: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """(word, n) with distinct words to word, form, root, n, n_near, form_n.

    Words are those with n of at least ``least_count``; near words differ by
    one inserted, deleted or replaced code point; a word's form is its most
    frequent near word, if that is ``factor`` (more than 1) times as frequent as the word.
    """
    vocabulary = staged(words.where(F.col("n") >= least_count).select("word", "n"), "spelling_words")
    pairs = staged(near_pairs(vocabulary), "spelling_pairs")
    both = pairs.union(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.when(F.col("near_n") >= factor * F.col("n"), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))).alias("best"),
    )
    best = staged(best.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")), "spelling_forms")
    last = roots(best.where("form is not null"))
    out = vocabulary.join(best, "word", "left").join(last, "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
