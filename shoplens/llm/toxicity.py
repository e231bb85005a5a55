"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

*Folding.* Homoglyphs become the Latin letters they imitate, letters are
lower-cased, and digits and signs inside a word that also has letters become
the letters they stand for. Everything that is not a letter then parts words.

*Lexicon.* Terms are whole words and word beginnings, with weights learned as
log-odds between toxic and other documents of a bounded sample of labelled
rows (``SAMPLE`` rows, smallest hashes of the id; near copies share a minimum
hash and count once). Exception phrases are two-word phrases around a term
that the sample shows only in documents that are not toxic; more can be given.

*Score.* One automaton holds terms and exceptions. A word counts its heaviest
term unless an exception phrase covers it. The sum is normalised by length,
and a logistic curve over the sum and the normalised sum, fitted on the same
sample, gives a score between 0 and 1.

Defined results: NULL and empty texts have no hits and get the score of a text
without hits; very long texts are scanned whole; rows that repeat are scored one by
one; a NULL doc_id is not held out and not learned from; labels that
contradict each other count as toxic; with no label of either kind every score
is 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import crc_bucket, over_batches, staged, utf8_values
from shoplens.llm.textops import shingles, word_hashes

#: Labelled rows learned from, terms kept, documents a term must be toxic in.
SAMPLE, TERMS, SUPPORT = 20_000, 4_000, 8
LOG_ODDS = 2.5
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)

#: Cyrillic and Greek letters and the Latin letters they look like.
HOMOGLYPHS = dict(zip("аеорсухівкмнтԁһјѕԛԝαενορτυικχ", "aeopcyxibkmhtdhjsqwaevoptuikx"))
#: Digits and signs that stand for letters inside words.
LEET = dict(zip("0134578@$!", "oieastbasi"))
_TABLE = {ord(k): v for k, v in HOMOGLYPHS.items()} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_MIXED = re.compile(r"[^\W\d_][^\W_]*[0134578@$!]+(?=[^\W\d_])|(?<![^\W_])[0134578@$]+(?=[^\W\d_]{2})")
_LEET_TABLE = {ord(k): v for k, v in LEET.items()}
_BREAK = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Folded words, each between single spaces."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_TABLE)
    text = _MIXED.sub(lambda m: m[0].translate(_LEET_TABLE), text)
    return f" {_BREAK.sub(' ', text).strip()} "


def _terms(words: set[str]) -> set[str]:
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


def _decoded(batch: pa.RecordBatch) -> Iterator[str]:
    for data in utf8_values(batch.column("text")):
        yield "" if data is None else data.tobytes().decode("utf-8", "replace")


def _minhash(batch: pa.RecordBatch) -> dict:
    low = []
    for data in utf8_values(batch.column("text")):
        s = shingles(word_hashes(data)) if data is not None else ()
        low.append(int(s[0].view(np.int64)) if len(s) else None)
    return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "text": batch.column("text"), "low": pa.array(low, pa.int64())}


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, size: int = SAMPLE) -> DataFrame:
    """doc_id, toxic, text of at most ``size`` labelled rows outside the held-out fold, near copies once."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(crc_bucket("doc_id", folds) != held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    # At most ``size`` rows of two numbers are broadcast.
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    rows = over_batches(rows.select("doc_id", "toxic", "text"), _minhash, "doc_id long, toxic int, text string, low long")
    # Of near copies the row with the smallest doc_id teaches, so that reruns learn the same.
    once = rows.groupBy("low", "toxic").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    return staged(once.select("r.doc_id", "toxic", "r.text"), "toxicity_sample")


class Lexicon:
    """Terms with weights, exception phrases and the coefficients of the score."""

    def __init__(self, terms: dict[str, float], exceptions: tuple[str, ...] = (), curve: tuple[float, ...] | None = None):
        self.terms, self.exceptions, self.curve = terms, exceptions, curve
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for t, w in self.terms.items():
                a.add_word(t, (len(t), w))
            for p in self.exceptions:
                if p not in self.terms:
                    a.add_word(p, (len(p), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> dict[int, float]:
        """Start of each matched word to its heaviest weight, exceptions taken out."""
        a = self.automaton()
        found: dict[int, float] = {}
        covered: list[tuple[int, int]] = []
        if len(a):
            for end, (size, weight) in a.iter(folded):
                start = end - size + 1
                if weight is None:
                    covered.append((start, end))
                elif weight > found.get(start, 0.0):
                    found[start] = weight
        for lo, hi in covered:
            for s in [s for s in found if lo <= s < hi]:
                del found[s]
        return found

    def features(self, folded: str) -> tuple[float, float]:
        total = sum(self.hits(folded).values())
        return math.log1p(total), math.log1p(1000.0 * total / (20.0 + folded.count(" ")))

    def score(self, folded: str) -> float:
        if self.curve is None:
            return 0.0
        a, b, c = self.curve
        x, y = self.features(folded)
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _term_counts(batch: pa.RecordBatch) -> dict:
    counts: dict[str, list[int]] = {}
    for text, toxic in zip(_decoded(batch), batch.column("toxic").to_pylist()):
        for t in _terms(set(fold(text).split())):
            counts.setdefault(t, [0, 0])[1 if toxic else 0] += 1
    return {"term": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}


def _learn_terms(sample: DataFrame, n_clean: int, n_toxic: int) -> dict[str, float]:
    counts = over_batches(sample, _term_counts, "term string, clean long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    best = counts.where(F.col("toxic") >= SUPPORT).withColumn("w", odds).where(F.col("w") >= LOG_ODDS)
    rows = best.orderBy((F.col("w") * F.sqrt("toxic")).desc(), "term").limit(TERMS).collect()
    return {r["term"]: min(8.0, r["w"]) for r in rows}


def _phrases(lexicon: Lexicon):
    def run(batch: pa.RecordBatch) -> dict:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(_decoded(batch), batch.column("toxic").to_pylist()):
            folded = fold(text)
            seen = set()
            for s in lexicon.hits(folded):
                end = folded.index(" ", s + 1)
                after = folded.find(" ", end + 1)
                before = folded.rfind(" ", 0, s) if s else -1
                if after > 0:
                    seen.add(folded[s : after + 1])
                if before >= 0:
                    seen.add(folded[before : end + 1])
            for p in seen:
                counts.setdefault(p, [0, 0])[1 if toxic else 0] += 1
        return {"phrase": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}

    return run


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small ridge, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (y - p) - 0.1 * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta))
        beta = beta + np.clip(np.linalg.solve(curve, slope), -4, 4)
    return tuple(float(b) for b in beta)


def learn(sample: DataFrame, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """The lexicon of a labelled sample (doc_id, toxic, text); ``exceptions`` are further benign phrases."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return Lexicon({})
    lexicon = Lexicon(_learn_terms(sample, n_clean, n_toxic))
    found = over_batches(sample, _phrases(lexicon), "phrase string, clean long, toxic long")
    benign = found.groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("toxic = 0 and clean >= 3")
    learned = [r["phrase"] for r in benign.orderBy(F.desc("clean"), "phrase").limit(TERMS).collect()]
    lexicon = Lexicon(lexicon.terms, (*[fold(e) for e in exceptions], *learned))

    def features(batch: pa.RecordBatch) -> dict:
        f = [lexicon.features(fold(t)) for t in _decoded(batch)]
        return {"x": [a for a, _ in f], "y": [b for _, b in f], "toxic": batch.column("toxic")}

    rows = over_batches(sample, features, "x double, y double, toxic int").toArrow()  # at most SAMPLE rows
    x = np.column_stack([rows.column("x").to_numpy(), rows.column("y").to_numpy()])
    lexicon.curve = _fit(x, (rows.column("toxic").to_numpy() > 0).astype(float))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, n_hits."""

    def run(batch: pa.RecordBatch) -> dict:
        folded = [fold(t) for t in _decoded(batch)]
        return {"doc_id": batch.column("doc_id"), "score": [lexicon.score(f) for f in folded], "n_hits": [len(lexicon.hits(f)) for f in folded]}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_batches(docs, run, "doc_id long, score double, n_hits int")


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits: learned without the held-out fold."""
    lexicon = learn(labelled_sample(docs, labels, folds, held))
    held_out = F.coalesce(crc_bucket("doc_id", folds) == held, F.lit(False))
    out = score(docs, lexicon)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits")
