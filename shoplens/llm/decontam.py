"""Benchmark decontamination by latent semantic retrieval.

1. *TF-IDF.* Documents are cut into passages. Terms are word hashes in ``DIM``
   dimensions; document frequencies count every document.
2. *Latent space.* A randomised SVD of the TF-IDF passages (``PASSAGE`` words, every
   ``STRIDE``): two distributed passes of subspace iteration over every passage of every document and of the
   benchmark. Tasks sum A'AX, a shuffle adds the tasks' sums up; the driver sees DIM x RANK numbers.
3. *Candidates.* An item is sought with passages of its own measure: the largest power
   of two up to its length, at most ``PASSAGE``, every quarter of that. A passage's cosine to one of
   the item's in the latent space must be at least ``COSINE``. Only places are projected that can
   still hold the item: its heaviest words, ``HEAVY`` of its weight, must there have at least what a leak cannot lack
   (``PARAPHRASE`` less the rest). Places are windows of one and a half times the item; a paraphrase that inserts more
   than half of the item's length is not sought.
4. *Checks.* Around a candidate, the longest common subsequence of words with
   the whole benchmark item, weighted by IDF, as a share of the item. From
   ``COPY`` it is a leak; from ``PARAPHRASE`` it is one if the answer is there too:
   the item's answer, or else its ``ANSWER`` heaviest words, nine in ten of
   them (by weight) within the passage.

The benchmark is the stated query set: it meets all documents in blocks of
``BLOCK`` items, so what is broadcast is bounded; with several blocks each one's result is written before the next.

Defined results: NULL and empty texts, of documents or items, match nothing;
texts shorter than a passage are one passage; very long texts are searched
whole; repeated rows are found each; items that tie are all reported; NULL ids
are carried; an empty table on either side gives no leaks; other columns are
ignored (carried by ``decontaminate``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import over_batches, staged, utf8_pieces, utf8_values
from shoplens.llm.textops import batch_words, word_hashes

PASSAGE, STRIDE = 32, 8
DIM, RANK = 1 << 13, 128
#: Bounds of a former fit on a sample. Tests still set them; nothing reads them: the fit takes every row.
SAMPLE_DOCS = FIT_ITEMS = None
#: Passages that a task projects at once, and slices in which the tasks' sums meet.
RUN, SLICES = 1 << 14, 64
#: Rows that are summed at once, and sums that stay in the cache.
GROUP, GROUPS = 64, 512
COSINE = 0.45
COPY, PARAPHRASE = 0.8, 0.6
HEAVY = 0.7
ANSWER, ANSWER_SHARE = 5, 0.9
BLOCK = 2_000
#: Bits of the word hash that the first look-up takes.
FIRST_LOOK = 20


def passage_starts(n: int, width: int = PASSAGE) -> np.ndarray:
    """Starts of a text's passages: every quarter of their width, the last one ending with the text."""
    last = max(0, n - width)
    return np.unique(np.append(np.arange(0, last + 1, max(1, width // 4)), last)) if n else np.zeros(0, np.int64)


def _passages(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the passages of texts whose words begin at ``first`` (one more: their end)."""
    begin, end = first[:-1], first[1:]
    begin, end = begin[end > begin], end[end > begin]
    last = np.maximum(0, end - begin - PASSAGE)
    count = 1 + -(-last // STRIDE)
    rank = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    starts = np.repeat(begin, count) + np.minimum(rank * STRIDE, np.repeat(last, count))
    return starts, np.minimum(starts + PASSAGE, np.repeat(end, count))


def _terms(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(7)).astype(np.int64) & (DIM - 1)


def _vectors(terms: np.ndarray, weights: np.ndarray, starts: np.ndarray, basis: np.ndarray, width: int = PASSAGE) -> np.ndarray:
    """IDF-weighted sums of basis rows over each passage, as differences of prefix sums."""
    sums = np.zeros((len(terms) + 1, basis.shape[1]))
    np.cumsum(weights[:, None] * basis[terms], axis=0, out=sums[1:])
    return (sums[np.minimum(starts + width, len(terms))] - sums[starts]).astype(np.float32)


def _first_look(words: np.ndarray) -> np.ndarray:
    """Marks the leading hash bits of some words: most other words need no search among them."""
    look = np.zeros(1 << FIRST_LOOK, bool)
    look[words >> np.uint64(64 - FIRST_LOOK)] = True
    return look


def _placed(words: np.ndarray, vocabulary: np.ndarray, look: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words stand in the (sorted) vocabulary, and where there."""
    where = np.flatnonzero(look[words >> np.uint64(64 - FIRST_LOOK)])
    place = np.minimum(np.searchsorted(vocabulary, words[where]), len(vocabulary) - 1)
    known = vocabulary[place] == words[where] if len(vocabulary) else np.zeros(0, bool)
    return where[known], place[known]


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents per hashed term and per word of the (sorted) vocabulary, and documents, over all rows."""

    look = _first_look(vocabulary)

    def count(batch: pa.RecordBatch) -> dict:
        total = np.zeros(DIM + 1 + len(vocabulary), np.int64)
        total[DIM] = batch.num_rows - batch.column("text").null_count
        for _, data, at in utf8_pieces(batch.column("text")):
            words, first = batch_words(data, at)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
            for block in range(0, len(at) - 1, 64):
                part = slice(first[block], first[min(len(at) - 1, block + 64)])
                seen = np.zeros((64, DIM), bool)
                seen[doc[part] - block, _terms(words[part])] = True
                total[:DIM] += seen.view(np.uint8).sum(axis=0, dtype=np.uint8)  # 64 at most
            where, place = _placed(words, vocabulary, look)
            once = np.unique(doc[where] * len(vocabulary) + place) % max(1, len(vocabulary))
            total[DIM + 1 :] += np.bincount(once, minlength=len(vocabulary))
        found = np.flatnonzero(total)
        return {"term": found, "n": total[found]}

    rows = over_batches(docs.select(F.col("text").cast("string").alias("text")), count, "term long, n long")
    table = rows.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most DIM + 1 + the block's words
    df = np.zeros(DIM + 1 + len(vocabulary), np.int64)
    df[table.column("term").to_numpy()] = table.column("n").to_numpy()
    return df[:DIM], df[DIM + 1 :], int(df[DIM])


def _sums(rows: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the rows (float32) at ``at`` over consecutive groups of some sizes, each at least 1.

    Groups go by size and in blocks, so that a step adds one row to each group of a block and the block's sums stay
    in the processor's cache; a group of more than ``GROUP`` rows is summed in parts of that many first.
    """
    parts = -(-size // GROUP)
    many = bool((parts > 1).any())
    whole = size
    if many:
        whole = np.full(int(parts.sum()), GROUP)
        whole[np.cumsum(parts) - 1] = size - (parts - 1) * GROUP
    order = np.argsort(-whole, kind="stable")
    first, sizes = (np.cumsum(whole) - whole)[order], whole[order]
    out = np.empty((len(whole), rows.shape[1]), np.float32)
    total, one = (np.empty((min(len(whole), GROUPS), rows.shape[1]), np.float32) for _ in range(2))
    for block in range(0, len(whole), GROUPS):
        f, n = first[block : block + GROUPS], sizes[block : block + GROUPS]
        np.take(rows, at[f], axis=0, out=total[: len(f)], mode="clip")
        for i, k in enumerate(np.searchsorted(-n, -np.arange(1, n[0])).tolist(), 1):
            np.take(rows, at[f[:k] + i], axis=0, out=one[:k], mode="clip")
            total[:k] += one[:k]
        out[order[block : block + GROUPS]] = total[: len(f)]
    return _sums(out, np.arange(len(out)), parts) if many else out


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of ranges that begin at ``first``, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


def _add_gram(total: np.ndarray, terms: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray, x: np.ndarray) -> None:
    """Add A'AX of some passages to ``total``; they are spans of the words, in order, and leave none out.

    ``x`` holds the rows of X times their term's weight, and what is added to a term's row lacks that factor.
    Words between two neighbouring starts or ends stand in the same passages, so they are summed first and share what comes back.
    """
    cuts = np.union1d(starts, ends)
    size = np.diff(cuts)
    first = np.searchsorted(cuts, starts)
    count = np.searchsorted(cuts, ends) - first
    mass = np.zeros(len(weights) + 1)
    np.cumsum(weights.astype(np.float64) ** 2, out=mass[1:])
    y = _sums(_sums(x, terms, size), _ranges(first, count), count)
    y *= (1 / np.maximum(mass[ends] - mass[starts], 1e-9)).astype(np.float32)[:, None]
    first = np.searchsorted(ends, cuts[:-1], "right")
    count = np.searchsorted(starts, cuts[:-1], "right") - first
    cover = _sums(y, _ranges(first, count), count)
    order = np.argsort(terms.astype(np.uint16), kind="stable")  # DIM terms: a radix sort
    begin = np.flatnonzero(np.diff(terms[order], prepend=-1))
    own = np.repeat(np.arange(len(size)), size)[order]
    total[terms[order][begin]] += _sums(cover, own, np.diff(begin, append=len(order)))


def _latent(texts: DataFrame, idf: np.ndarray) -> np.ndarray:
    """Leading right singular vectors (DIM x RANK) of the TF-IDF passages of the texts, over their singular values."""
    weigh = idf.astype(np.float32)
    rows = DIM // SLICES

    def step(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float32) * weigh[:, None]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(x.shape)
            for batch in batches:
                for _, data, at in utf8_pieces(batch.column("text")):
                    words, first = batch_words(data, at)
                    if not len(words):
                        continue
                    terms = _terms(words)
                    starts, ends = _passages(first)
                    for run in range(0, len(starts), RUN):
                        s, e = starts[run : run + RUN], ends[run : run + RUN]
                        lo, hi = s[0], e[-1]
                        _add_gram(total, terms[lo:hi], weigh[terms[lo:hi]], s - lo, e - lo, x)
            total *= weigh[:, None]
            found = [i for i in range(SLICES) if total[i * rows : (i + 1) * rows].any()]
            sums = [total[i * rows : (i + 1) * rows].astype(np.float32).tobytes() for i in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(sums, pa.binary())], names=["slice", "sums"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, sums in zip(batch.column("slice").to_pylist(), batch.column("sums")):
                    total[i] = total.get(i, 0) + np.frombuffer(sums.as_buffer(), np.float32).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slice", "sums"])

        parts = texts.mapInArrow(partial, "slice int, sums binary").withColumn("task", F.spark_partition_id())
        parts = parts.repartition(SLICES, "slice").sortWithinPartitions("slice", "task").select("slice", "sums")
        sums = np.zeros(x.shape)
        for row in parts.mapInArrow(added, "slice int, sums binary").toLocalIterator():  # SLICES rows
            sums[row["slice"] * rows : (row["slice"] + 1) * rows] = np.frombuffer(row["sums"], np.float64).reshape(rows, -1)
        return sums

    start = np.random.Generator(np.random.PCG64(3)).standard_normal((DIM, RANK + 8))
    q, _ = np.linalg.qr(step(start))
    z = step(q)
    values, turn = np.linalg.eigh(q.T @ z)
    order = np.argsort(-values)[:RANK]
    # Whitened: directions that every passage shares weigh no more than the others.
    return (q @ turn[:, order] / np.sqrt(np.maximum(values[order], 1e-9))).astype(np.float32)


class Item(NamedTuple):
    item_id: int | None
    words: np.ndarray
    answer: np.ndarray


class Search:
    """What tasks need to search for a block of items."""

    def __init__(self, items: list[Item], vocabulary: np.ndarray, word_idf: np.ndarray, idf: np.ndarray, basis: np.ndarray):
        self.items, self.vocabulary = items, vocabulary
        self.word_idf, self.idf, self.basis = word_idf.astype(np.float32), idf.astype(np.float32), basis
        self.weights = [self.weigh(i.words) for i in items]
        self.places = [self.place(i.words) for i in items]
        heaviest = lambda w: w[np.argsort(-self.weigh(w), kind="stable")[:ANSWER]]
        self.answers = [i.answer if len(i.answer) else heaviest(i.words) for i in items]
        self.reach = np.array([len(i.words) + len(i.words) // 2 + 4 for i in items])
        self.width = [min(PASSAGE, 1 << (len(i.words).bit_length() - 1)) for i in items]
        self.vectors = []
        for item, width in zip(items, self.width):
            terms = _terms(item.words)
            self.vectors.append(_unit(_vectors(terms, self.idf[terms], passage_starts(len(terms), width), basis, width)))
        self._index()

    def _index(self) -> None:
        """Heavy words of the items: which items have each, with what weight, and what a leak must have of them."""
        word, item, weight, self.least = [], [], [], np.zeros(len(self.items))
        for k, (i, w) in enumerate(zip(self.items, self.weights)):
            order = np.argsort(-w, kind="stable")
            total = float(w.sum(dtype=np.float64))
            cut = 1 + int(np.searchsorted(np.cumsum(w[order], dtype=np.float64), HEAVY * total))
            heavy = order[:cut]
            # A little less, for sums of rounded weights.
            self.least[k] = float(w[heavy].sum(dtype=np.float64)) - (1 - PARAPHRASE) * total - 1e-3 * total
            names, at = np.unique(i.words[heavy], return_inverse=True)
            word.append(names)
            weight.append(np.bincount(at, w[heavy]))
            item.append(np.full(len(names), k))
        word, item, weight = map(np.concatenate, (word, item, weight))
        order = np.argsort(word, kind="stable")
        self.heavy, counts = np.unique(word, return_counts=True)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.owner, self.heavy_weight = item[order], weight[order]
        self.look = _first_look(self.heavy)

    def place(self, words: np.ndarray) -> np.ndarray:
        """Places of words in the vocabulary; its length for words that are not in it."""
        spot = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[spot] == words, spot, len(self.vocabulary))

    def weigh(self, words: np.ndarray) -> np.ndarray:
        """IDF of the words of the benchmark, 0 for others."""
        return np.append(self.word_idf, np.float32(0))[self.place(words)]

    def _windows(self, words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], list[list[int]]]:
        """(text, item) to the word spans in which enough of the item's heavy words stand."""
        where, place = _placed(words, self.heavy, self.look)
        counts = self.first[place + 1] - self.first[place]
        total = int(counts.sum())
        if not total:
            return {}
        entry = np.repeat(self.first[place] - (np.cumsum(counts) - counts), counts) + np.arange(total)
        at, item, weight = np.repeat(where, counts), self.owner[entry], self.heavy_weight[entry]
        key = item * (len(words) + 1) + at
        order = np.argsort(key, kind="stable")
        key, at, item = key[order], at[order], item[order]
        sums = np.concatenate([[0.0], np.cumsum(weight[order])])
        ends = np.searchsorted(key, key + self.reach[item])
        full = np.flatnonzero(sums[ends] - sums[:-1] >= self.least[item] - 1e-6 * sums[-1])
        spans: dict[tuple[int, int], list[list[int]]] = {}
        for i, k, text in zip(at[full].tolist(), item[full].tolist(), (np.searchsorted(first, at[full], "right") - 1).tolist()):
            reach = int(self.reach[k])
            lo, hi = max(int(first[text]), i - reach), min(int(first[text + 1]), i + reach)
            mine = spans.setdefault((text, k), [])
            if mine and lo <= mine[-1][1] and hi - mine[-1][0] <= 8 * reach:
                mine[-1][1] = hi
            else:
                mine.append([lo, hi])
        return spans

    def leaks(self, texts: pa.Array) -> list[tuple]:
        """(row, item_id, start, lcs, cosine, answered) of each leaked item of each text, its best place."""
        found = []
        for row, data, at in utf8_pieces(texts):
            words, first = batch_words(data, at)
            for (text, k), spans in sorted(self._windows(words, first).items()):
                near = []
                for lo, hi in spans:
                    terms = _terms(words[lo:hi])
                    starts = passage_starts(hi - lo, self.width[k])
                    vectors = _unit(_vectors(terms, self.idf[terms], starts, self.basis, self.width[k]))
                    cosine = float((vectors @ self.vectors[k].T).max())
                    if cosine >= COSINE:
                        near.append((lo, hi, cosine))
                best = self._check(k, words, near, int(first[text])) if near else None
                if best:
                    found.append((row + text, self.items[k].item_id, *best))
        return found

    def _check(self, k: int, words: np.ndarray, near: list[tuple[int, int, float]], first: int) -> tuple | None:
        """Best (start, lcs, cosine, answered) over the spans of an item's candidates, if it leaks."""
        item, weights, answer = self.items[k], self.weights[k], self.answers[k]
        total = float(weights.sum()) or 1.0
        best = None
        for lo, hi, c in near:
            part = words[lo:hi]
            # Cheap bound first: the weight of the item's words that stand here in any order.
            if float(weights[np.isin(item.words, part)].sum()) < PARAPHRASE * total:
                continue
            share = lcs_weight(item.words, weights, part) / total
            if share < PARAPHRASE or (best and share <= best[1]):
                continue
            heavy = self.weigh(answer)
            answered = float(heavy[np.isin(answer, part)].sum()) >= ANSWER_SHARE * float(heavy.sum())
            if share >= COPY or answered:
                best = (lo - first, share, c, answered)
        return best


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def lcs_weight(item: np.ndarray, weights: np.ndarray, words: np.ndarray) -> float:
    """Weight of the heaviest common subsequence, one vector step for each word of the item."""
    best = np.zeros(len(words) + 1)
    for w, x in zip(item, weights):
        with_match = np.where(words == w, best[:-1] + x, 0.0)
        best[1:] = np.maximum(best[1:], with_match)
        np.maximum.accumulate(best, out=best)
    return float(best[-1])


def _fit_texts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The texts that the latent space is fitted on: all of the documents and of the benchmark."""
    return docs.select("text").union(items.select("text")).where("text is not null")


def searches(docs: DataFrame, benchmark: DataFrame) -> Iterator[tuple[Search, bool]]:
    """A ``Search`` for each block of benchmark items with words, and whether it is the last."""
    has_answer = "answer" in benchmark.columns
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text"), (F.col("answer").cast("string") if has_answer else F.lit(None).cast("string")).alias("answer"))
    rows = rows.where("text is not null")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    basis = None
    hashes = lambda text: word_hashes(np.frombuffer((text or "").encode(), np.uint8))
    block: list[Item] = []

    def search() -> Search:
        nonlocal basis
        vocabulary = np.unique(np.concatenate([np.concatenate([i.words, i.answer]) for i in block]))
        df, word_df, n = _frequencies(docs, vocabulary)
        idf, word_idf = (np.log((n + 1.0) / (d + 1.0)) + 0.01 for d in (df, word_df))
        basis = _latent(_fit_texts(texts, rows), idf) if basis is None else basis
        return Search(block, vocabulary, word_idf, idf, basis)

    for row in rows.toLocalIterator():
        words = hashes(row["text"])
        if len(words):
            if len(block) == BLOCK:
                yield search(), False
                block = []
            block.append(Item(row["item_id"], words, hashes(row["answer"])))
    if block:
        yield search(), True


LEAK = "doc_id long, item_id long, start int, lcs double, cosine double, answered boolean"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, start (word), lcs, cosine, answered."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for search, last in searches(docs, benchmark):
        shared = spark.sparkContext.broadcast(search)

        def run(batch: pa.RecordBatch, shared=shared) -> dict:
            found = shared.value.leaks(batch.column("text"))
            names = ("item_id", "start", "lcs", "cosine", "answered")
            columns = dict(zip(names, map(list, zip(*(x[1:] for x in found))))) if found else {n: [] for n in names}
            return {"doc_id": batch.column("doc_id").take(pa.array([x[0] for x in found], pa.int64())), **columns}

        found = over_batches(text, run, LEAK)
        if not last or out is not None:
            found = staged(found, "decontam_leaks")
            shared.destroy()
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], LEAK)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns."""
    schema, spark, all_docs = docs.schema, docs.sparkSession, docs
    for search, last in searches(all_docs, benchmark):
        shared = spark.sparkContext.broadcast(search)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[x[0] for x in shared.value.leaks(batch.column("text"))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
        if not last:
            docs = staged(docs, "decontam_clean")
            shared.destroy()
    return docs
