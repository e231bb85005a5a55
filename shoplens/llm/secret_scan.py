"""Secret scans: candidates judged by a random forest trained on labelled findings.

*Candidates* are runs of ``SHORTEST`` or more letters, digits and +/_- in a text,
and whatever non-space value is assigned to a credential name, of any length and
with any signs (up to its quote, or without the marks that close it).
*Features*: length, shares of digits, capitals and signs, entropy, likelihood of
the character transitions under the corpus's own words, dictionary coverage
(share of the candidate covered by frequent words of the corpus), the path
(hashed source) and the neighbouring words (assignment sign, quote, and a hash of the
word before and of the one after).
*Training*: labelled findings are given, or taken from the corpus by known
formats: provider key shapes and values assigned to credential names are
secrets; plain numbers (cards, identifiers), candidates within addresses and
those without a digit or a change of case are false positives. At most ``SAMPLE`` findings
of each label (smallest hashes) are used. Each teaches several forms (``forms``): at another place, without its assignment,
in pieces, and secrets in other alphabets, with signs and ending words; so the forest judges
candidates of any shape by more than what settled the label.
The forest is Spark ML's; its trees are read out into arrays, so that scanning
is one pass over the documents, and a document is judged and redacted
where it is read.

Defined results: NULL and empty texts have no candidates; very long texts are
scanned whole; a candidate that occurs twice is two findings; repeated rows are
found each; NULL ids and sources are carried; without labels of both kinds every
candidate of a known format counts as a secret (score 1) and no other; an empty
table gives an empty result; other columns are ignored (carried by ``redact``).
"""

from __future__ import annotations

import hashlib
import math
import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import over_batches, staged, utf8_values

SHORTEST = 16
SAMPLE = 4_000
WORDS = 2_000
TREES, DEPTH = 20, 7
THRESHOLD = 0.5
BUCKETS = 32
MASK = "[SECRET]"

CANDIDATE = re.compile(rb"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}(?![A-Za-z0-9+/_\-])")
#: Shapes of well-known key formats.
FORMATS = re.compile(rb"(AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_\-]{20,}|xox[baprs]-[A-Za-z0-9\-]{10,}|AIza[0-9A-Za-z_\-]{35}")
_NAME = rb"(?i)(token|passw(?:or)?d|pwd|secret|api[_-]?key|access[_-]?key|auth)[\"']?\s*"
_ASSIGNED = re.compile(_NAME + rb"[:=]+>?\s*[\"']?$")
#: A value assigned to a credential name: in quotes, or else up to a space.
VALUE = re.compile(_NAME + rb"[:=]+>?\s*(?:\"([^\"\s]+)|'([^'\s]+)|([^\s\"']\S*))")
#: Alphabets of random keys and signs of passwords that training values are made with.
_ALPHABETS = tuple(a.encode() for a in (
    string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_",
    string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, string.hexdigits[:16],
))
_SIGNS = b".!@$&#%"
_ADDRESS = re.compile(rb"(?i)(https?://|www\.|@)\S*$")
FEATURES = ("length", "digits", "capitals", "signs", "entropy", "transitions", "dictionary", "path", "assigned", "quoted", "before", "after")


def _bucket(value: bytes) -> int:
    total = 0
    for b in value:
        total = (total * 131 + b) % 1_000_003
    return total % BUCKETS


def candidates(text: bytes) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(start, candidate, the text before it, the text after it) of each candidate."""
    spans = []
    for m in VALUE.finditer(text):
        value = m[m.lastindex] if m.lastindex < 4 else m[4].rstrip(b"\"',;)]}>") or m[4]
        spans.append((m.start(m.lastindex), m.start(m.lastindex) + len(value)))
    whole = iter([*spans, (len(text) + 1, len(text) + 1)])
    lo, hi = next(whole)
    runs = []
    for m in CANDIDATE.finditer(text):
        while hi <= m.start():
            lo, hi = next(whole)
        if m.start() < lo:  # not a part of an assigned value
            runs.append(m.span())
    for a, b in sorted(spans + runs):
        yield a, text[a:b], text[max(0, a - 40) : a], text[b : b + 24]


def known_label(value: bytes, before: bytes) -> int | None:
    """1 or 0 where the format or the context settles it, else None."""
    if FORMATS.fullmatch(value) or (_ASSIGNED.search(before) and any(48 <= b < 58 for b in value)):
        return 1
    if value.isdigit() or _ADDRESS.search(before) or not any(48 <= b < 58 for b in value) and (value[1:].islower() or value.isupper()):
        return 0
    return None


class Prose:
    """Character transitions and frequent words of the corpus."""

    def __init__(self, transitions: np.ndarray, words: list[bytes]):
        self.transitions = transitions
        self.words = words
        self._automaton = None

    def __getstate__(self):
        return {"transitions": self.transitions, "words": self.words, "_automaton": None}

    def likelihood(self, value: bytes) -> float:
        v = np.frombuffer(value.lower(), np.uint8)
        return float(self.transitions[v[:-1] & 127, v[1:] & 127].mean()) if len(v) > 1 else 0.0

    def coverage(self, value: bytes) -> float:
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for w in self.words:
                a.add_word(w.decode("latin-1"), len(w))
            if len(a):
                a.make_automaton()
            self._automaton = a
        if not len(self._automaton):
            return 0.0
        hit = np.zeros(len(value), bool)
        for end, size in self._automaton.iter(value.lower().decode("latin-1")):
            hit[end - size + 1 : end + 1] = True
        return float(hit.mean())


def features(value: bytes, before: bytes, after: bytes, path: bytes, prose: Prose) -> list[float]:
    n = len(value)
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    words = before.split()
    return [
        float(n), sum(48 <= b < 58 for b in value) / n, sum(65 <= b < 91 for b in value) / n, sum(not 48 <= b < 58 and not 65 <= b < 91 and not 97 <= b < 123 for b in value) / n,
        entropy, prose.likelihood(value), prose.coverage(value), float(_bucket(path)),
        float(before.rstrip(b"\"' ")[-1:] in (b"=", b":") and bool(before)), float(before[-1:] in (b'"', b"'") and bool(before)),
        float(_bucket(words[-1].strip(b"\"'=:").lower()) if words else -1), float(_bucket((after.split() or [b""])[0].lower())),
    ]


def _prose_counts(batch: pa.RecordBatch) -> dict:
    """Counts of transitions (key 128 * a + b) and words (hashed by the shuffle) of a batch."""
    pairs = np.zeros(128 * 128, np.int64)
    words: Counter = Counter()
    for data in utf8_values(batch.column("text")):
        if data is None:
            continue
        body = data.tobytes().lower()
        v = np.frombuffer(body, np.uint8)
        plain = (v[:-1] < 128) & (v[1:] < 128)
        pairs += np.bincount((v[:-1].astype(np.int64) * 128 + v[1:])[plain], minlength=128 * 128)
        words.update(w for w in re.findall(rb"[a-z]{3,}", body) if len(w) <= 12)
    found = np.flatnonzero(pairs)
    return {
        "pair": pa.array([*found.tolist(), *[None] * len(words)], pa.int64()),
        "word": pa.array([*[None] * len(found), *[w.decode() for w in words]], pa.string()),
        "n": pa.array([*pairs[found].tolist(), *words.values()], pa.int64()),
    }


def learn_prose(docs: DataFrame) -> Prose:
    """Counts over all documents; the driver gets at most 128 * 128 pairs and ``WORDS`` words."""
    text = docs.select(F.col("text").cast("string").alias("text"))
    counts = over_batches(text, _prose_counts, "pair long, word string, n long").groupBy("pair", "word").agg(F.sum("n").alias("n"))
    counts = staged(counts, "secret_prose")
    pairs = np.ones((128, 128))
    for r in counts.where("pair is not null").select("pair", "n").collect():
        pairs[r["pair"] // 128, r["pair"] % 128] += r["n"]
    words = counts.where("word is not null").orderBy(F.desc("n"), "word").limit(WORDS).collect()
    return Prose(np.log(pairs / pairs.sum(axis=1, keepdims=True)), [r["word"].encode() for r in words])


FINDINGS = "label int, value string, path string, before binary, after binary, there_before binary, there_after binary"


def labelled_findings(docs: DataFrame) -> DataFrame:
    """The candidates that their format or context settles, each different value once (FINDINGS).

    ``there_before`` and ``there_after`` surround another place of the document, drawn by the value.
    """

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for path, data in zip(batch.column("source").to_pylist(), utf8_values(batch.column("text"))):
            if data is None:
                continue
            text = data.tobytes()
            for _, value, before, after in candidates(text):
                known = known_label(value, before)
                if known is not None:
                    at = zlib.crc32(value) % len(text)
                    rows.append((known, value.decode(), path, before, after, text[max(0, at - 40) : at], text[at : at + 24]))
        columns = zip(*rows) if rows else [[]] * 7
        types = (pa.int32(), pa.string(), pa.string(), *[pa.binary()] * 4)
        return {i: pa.array(c, t) for i, (c, t) in enumerate(zip(columns, types))}

    found = over_batches(docs.select(F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")), run, FINDINGS)
    # Copies of a value teach nothing more.
    context = F.struct("path", "before", "after", "there_before", "there_after")
    found = staged(found.groupBy("label", "value").agg(F.min(context).alias("c")).select("label", "value", "c.*"), "secret_findings")
    sides = [found.where(F.col("label") == side).orderBy(F.xxhash64("value"), "value").limit(SAMPLE) for side in (0, 1)]
    return sides[0].union(sides[1])


def _recoded(value: bytes, size: int) -> bytes:
    """A random value of ``size`` characters in some key alphabet, drawn by ``value``."""
    drawn = b"".join(hashlib.blake2b(value, digest_size=64, salt=bytes([i])).digest() for i in range(-(-size // 63)))
    alphabet = _ALPHABETS[drawn[0] % len(_ALPHABETS)]
    return bytes(alphabet[b % len(alphabet)] for b in drawn[1 : size + 1])


def _digit(value: bytes) -> bool:
    return any(48 <= b < 58 for b in value)


def forms(label: int, value: bytes, before: bytes, after: bytes, there: tuple[bytes, bytes]) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(label, value, before, after) of what one finding teaches.

    The finding itself; the same value at another place of its document, without its assignment; pieces
    of it at both. A false positive also teaches a longer number or compound word, in capitals too. A secret also teaches random values in other key alphabets, pieces with
    signs, a word that ends in a piece, and, where a credential name stands before
    it, that a plain word there is none. So neither one length nor the assignment decides.
    """
    own, n = (before, after), len(value)
    draw = hashlib.blake2b(value, digest_size=16).digest()
    yield label, value, *own
    if n >= SHORTEST:
        yield label, value, *there
        for d in draw[:2]:
            piece = value[: SHORTEST + d % (n - SHORTEST + 1)]
            if not label or _digit(piece):
                yield label, piece, *there
    words = re.findall(rb"[A-Za-z]{3,}", there[0]) or [b"word"]
    word = words[draw[2] % len(words)]
    if not label:
        longer = value + value[: 1 + draw[3] % n] if _digit(value) else value + word.lower()
        yield 0, longer, *there
        yield 0, longer.title(), *there
        return
    for d in draw[3:5]:
        yield 1, _recoded(value + bytes([d]), SHORTEST + d % 32), *there
    if not _ASSIGNED.search(before):
        return
    made = [value[: 1 + d % n] for d in draw[5:8]] + [value[-1 - d % 3 :] for d in draw[8:10]]
    made += [_recoded(value + bytes([d]), 6 + d % 32) for d in draw[10:12]] + [word + value[-1 - draw[12] % 4 :], word.title() + b"1"]
    made += [v[: 1 + draw[13] % len(v)] + bytes([_SIGNS[draw[14] % len(_SIGNS)]]) + v[1 + draw[13] % len(v) :] for v in (value, *made[:4])]
    for v in made:
        if _digit(v):
            yield 1, v, *own
    yield 0, word.lower(), *own


def training_rows(findings: DataFrame, prose: Prose) -> DataFrame:
    """(label, features) of the forms of at most 2 * ``SAMPLE`` findings."""

    def run(batch: pa.RecordBatch) -> dict:
        label, rows = [], []
        for side, value, path, before, after, *there in zip(*(c.to_pylist() for c in batch.columns)):
            for known, v, b, a in forms(side, value.encode(), before, after, tuple(there)):
                label.append(known)
                rows.append(features(v, b, a, (path or "").encode(), prose))
        return {"label": pa.array(label, pa.int32()), "features": pa.array(rows, pa.list_(pa.float64()))}

    return over_batches(findings, run, "label int, features array<double>")


class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, children, probability of a secret."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]]):
        self.trees = trees

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, left, right, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                low = x[rows, np.maximum(f, 0)] <= threshold[at]
                at = np.where(f < 0, at, np.where(low, left[at], right[at]))
            total += leaf[at]
        return total / max(1, len(self.trees))


def _flatten(node) -> tuple[np.ndarray, ...]:
    """A Spark ML tree's nodes in arrays."""
    rows: list[list[float]] = []

    def visit(n) -> int:
        me = len(rows)
        rows.append([])
        if n.subtreeDepth() == 0:
            stats = n.impurityStats().stats()
            rows[me] = [-1, 0.0, me, me, stats[1] / max(1e-9, stats[0] + stats[1])]
        else:
            split = n.split()
            rows[me] = [split.featureIndex(), split.threshold(), visit(n.leftChild()), visit(n.rightChild()), 0.0]
        return me

    visit(node)
    f, t, left, right, leaf = map(np.array, zip(*rows))
    return f.astype(np.int64), t.astype(float), left.astype(np.int64), right.astype(np.int64), leaf.astype(float)


def train(findings: DataFrame) -> Forest | None:
    """A forest from (label, features) rows; None unless both labels occur."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = staged(findings.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features")).coalesce(4), "secret_training")
    if rows.select("label").distinct().count() < 2:
        return None
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=5, featureSubsetStrategy="onethird", leafCol="").fit(rows)
    return Forest([_flatten(t._call_java("rootNode")) for t in model.trees])


class Scanner:
    def __init__(self, forest: Forest | None, prose: Prose):
        self.forest, self.prose = forest, prose

    def scan(self, text: bytes, path: str | None) -> list[tuple[int, bytes, float]]:
        """(start, candidate, score) of every candidate."""
        found = list(candidates(text))
        if not found:
            return []
        if self.forest is None:
            return [(s, v, float(known_label(v, b) == 1)) for s, v, b, _ in found]
        x = np.array([features(v, b, a, (path or "").encode(), self.prose) for _, v, b, a in found])
        return [(s, v, float(p)) for (s, v, _, _), p in zip(found, self.forest.scores(x))]


def scanner(docs: DataFrame, findings: DataFrame | None = None) -> Scanner:
    """Train on ``findings`` (label, features) or on the corpus's own settled candidates."""
    prose = learn_prose(docs)
    return Scanner(train(training_rows(labelled_findings(docs), prose) if findings is None else findings), prose)


def scan(docs: DataFrame, scan_with: Scanner | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start (byte), length, value_sha (of the candidate), score of the findings judged secrets."""
    with_ = scan_with or scanner(docs)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")]

    def run(batch: pa.RecordBatch) -> dict:
        rows = []
        for i, path, data in zip(batch.column("doc_id").to_pylist(), batch.column("source").to_pylist(), utf8_values(batch.column("text"))):
            if data is not None:
                rows += [(i, s, len(v), hashlib.sha256(v).hexdigest(), p) for s, v, p in with_.scan(data.tobytes(), path) if p >= threshold]
        names = ("doc_id", "start", "length", "value_sha", "score")
        return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

    return over_batches(docs.select(*columns), run, "doc_id long, start long, length int, value_sha string, score double")


def redact(docs: DataFrame, scan_with: Scanner | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with every secret in ``text`` replaced by ``MASK``; all columns are kept as they are."""
    with_ = scan_with or scanner(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for path, data in zip(batch.column("source").to_pylist(), utf8_values(batch.column("text"))):
                body = None if data is None else data.tobytes()
                for s, v, p in reversed(with_.scan(body, path) if body else []):
                    if p >= threshold:
                        body = body[:s] + MASK.encode() + body[s + len(v) :]
                texts.append(None if body is None else body.decode())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
