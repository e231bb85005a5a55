"""Language identification with language-bitmask n-gram filters.

Training counts byte 4-grams per language over all training documents. A
gram belongs to a language if its rate there is at least ``SHARE`` of its
highest rate in any language (documents quote other languages, so bare
presence means little), and it counts where it has at least ``LEAST`` occurrences and
a rate of ``RAREST``, so no language has more than 1 / RAREST grams. Every gram sets its languages' bits in ``HASHES`` slots
of one table of language bitmasks (``ROOM`` slots a gram of the largest language, a power of
two from 2^19 to 2^23, 64 MB): bit l of all slots is the Bloom
filter of language l, and the AND of a gram's slots answers for all languages
at once. A document's grams are looked up, hits are popcounted per language
and corrected for the filter's false positives, (hits/n - fp) / (1 - fp) with
fp = fill ** HASHES; the largest wins.

Defined results: NULL texts and texts without a letter are ``und`` with score 0; so
is everything when nothing could be learned; very short texts are padded to
one gram; ties go to the language with more training documents; a NULL doc_id
is not held out; an empty table gives an empty result; other columns are ignored.
At most 62 languages (bits of a long); more raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import crc_bucket, over_batches, staged, utf8_values
from shoplens.llm.textops import mix64

FEWEST_SLOTS, MOST_SLOTS = 1 << 19, 1 << 23
ROOM = 16
HASHES = 3
SHARE = 0.15
#: Occurrences below which a gram is noise.
LEAST = 3
#: Share of a language's grams below which a gram is noise, whatever the corpus's size.
RAREST = 2e-6
MOST_LANGUAGES = 62

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_PAD = np.full(3, 32, np.uint8)


def grams(data: np.ndarray) -> np.ndarray:
    """Byte 4-grams of the folded text (letters lower-cased, other ASCII as spaces), blanks left out."""
    t = np.concatenate([_PAD[:1], _FOLD[data], _PAD]).astype(np.uint32)
    g = t[:-3] | t[1:-2] << np.uint32(8) | t[2:-1] << np.uint32(16) | t[3:] << np.uint32(24)
    return g[(t[1:-2] != 32) & (t[2:-1] != 32) | (t[:-3] == 32) & (t[1:-2] != 32) & (t[2:-1] == 32)]


def slots_for(most: int) -> int:
    """Slots of the table when the largest language has ``most`` grams (at most 1 / RAREST: a fill below 0.18)."""
    return min(MOST_SLOTS, max(FEWEST_SLOTS, 1 << (max(1, most) * ROOM - 1).bit_length()))


def _slots(g: np.ndarray, slots: int) -> list[np.ndarray]:
    h = mix64(g.astype(np.uint64))
    step = h >> np.uint64(32) | np.uint64(1)
    return [((h + step * np.uint64(i)) & np.uint64(slots - 1)).astype(np.int64) for i in range(HASHES)]


def _counts(batch: pa.RecordBatch) -> dict:
    """(lang, gram, count) sums of a batch."""
    langs = batch.column("lang").to_pylist()
    found: dict[str, list[np.ndarray]] = {}
    for lang, data in zip(langs, utf8_values(batch.column("text"))):
        if data is not None:
            found.setdefault(lang, []).append(grams(data))
    out = {"lang": [], "gram": [], "n": []}
    for lang, parts in found.items():
        values, n = np.unique(np.concatenate(parts), return_counts=True)
        out["lang"] += [lang] * len(values)
        out["gram"].append(values.astype(np.int64))
        out["n"].append(n)
    none = np.zeros(0, np.int64)
    return {"lang": pa.array(out["lang"], pa.string()), "gram": np.concatenate([none, *out["gram"]]), "n": np.concatenate([none, *out["n"]])}


def _sets(batch: pa.RecordBatch, slots: int) -> dict:
    parts = _slots(batch.column("gram").to_numpy(), slots)
    mask = batch.column("mask").to_numpy()
    return {"slot": np.concatenate(parts), "mask": np.tile(mask, HASHES)}


class Model:
    """Languages (bit order), the slot table and each language's false-positive rate."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table
        fill = np.array([np.count_nonzero(table >> i & 1) / len(table) for i in range(len(langs))])
        self.fp = fill**HASHES

    def hits(self, g: np.ndarray) -> np.ndarray:
        mask = self.table[(s := _slots(g, len(self.table)))[0]]
        for more in s[1:]:
            mask = mask & self.table[more]
        return np.array([np.count_nonzero(mask >> i & 1) for i in range(len(self.langs))])

    def predict(self, data: np.ndarray | None) -> tuple[str, float]:
        if data is None or not self.langs or not has_letter(data):
            return "und", 0.0
        g = grams(data)
        if not len(g):
            return self.langs[0], 0.0
        # A filter that is full says nothing of its language.
        share = np.where(self.fp < 1, np.maximum(0.0, (self.hits(g) / len(g) - self.fp) / np.maximum(1 - self.fp, 1e-12)), 0.0)
        best = int(share.argmax())
        return self.langs[best], float(min(1.0, share[best] / share.sum())) if share.sum() else 0.0


def has_letter(data: np.ndarray) -> bool:
    folded = _FOLD[data]
    if ((folded >= 97) & (folded < 123)).any():
        return True
    return bool((data >= 128).any()) and any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


def train(docs: DataFrame) -> Model:
    """Learn from the rows' text and non-null lang."""
    docs = docs.where("lang is not null and text is not null").select("lang", F.col("text").cast("string").alias("text"))
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()
    langs = [r["lang"] for r in sizes]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not langs:
        return Model(langs, np.zeros(FEWEST_SLOTS, np.int64))
    counts = staged(over_batches(docs, _counts, "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "langid_counts")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    totals = {r["lang"]: r["total"] for r in total.collect()}
    rate = F.create_map(*[F.lit(x) for lang in langs for x in (lang, 1.0 / max(1, totals.get(lang, 1)))])
    bit = F.create_map(*[F.lit(x) for i, lang in enumerate(langs) for x in (lang, 1 << i)])
    seen = counts.where((F.col("n") >= LEAST) & (F.col("n") * rate[F.col("lang")] >= RAREST))
    sizes = [r["n"] for r in seen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()]
    table = np.zeros(slots_for(max(sizes, default=0)), np.int64)
    rated = seen.select("gram", (F.col("n") * rate[F.col("lang")]).alias("r"), bit[F.col("lang")].cast("long").alias("bit"))
    kept = rated.groupBy("gram").agg(F.collect_list(F.struct("r", "bit")).alias("l"), F.max("r").alias("top")).select(
        "gram", F.aggregate("l", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.when(x["r"] >= SHARE * F.col("top"), x["bit"]).otherwise(F.lit(0).cast("long")))).alias("mask")
    )
    size = len(table)
    slots = over_batches(kept, lambda batch: _sets(batch, size), "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    table[slots.column("slot").to_numpy()] = slots.column("mask").to_numpy()
    return Model(langs, table)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.fp))

    def score(batch: pa.RecordBatch) -> dict:
        m = Model.__new__(Model)
        m.langs, m.table, m.fp = shared.value
        found = [m.predict(d) for d in utf8_values(batch.column("text"))]
        return {"doc_id": batch.column("doc_id"), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return over_batches(docs, score, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned without the held-out fold."""
    held_out = F.coalesce(crc_bucket("doc_id", folds) == held, F.lit(False))
    model = train(docs.where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
