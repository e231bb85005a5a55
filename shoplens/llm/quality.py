"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` is the table. ``features`` measures a text (lengths, symbols,
stop words, lines, repeated word windows) with built-in functions only, and
``verdict`` folds the table into one boolean expression over those columns,
so the whole operator is one projection over the scan: no shuffle and no
user function.

Defined results: a NULL text counts as an empty one (no words, so it fails the
length rule); very long texts are measured whole; repeated rows are judged one
by one; an empty table gives an empty result; other columns of the input,
whatever their names, are carried by ``filter_quality`` and ignored by
``quality_report``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import GAP, WORD

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus languages (en, de, fr, es).
STOP_WORDS = (
    "the of and to in is was for that it with as on be at by this are from or a an "
    "der die das und den von zu mit ist im für auf "
    "le la les de et des en un une du est que dans pour qui "
    "el los las y del se por con es"
).split()
WINDOW = 5


class Rule(NamedTuple):
    """100 * ``metric`` must stay within [low, high] * ``per``, for texts of at least ``min_words``."""

    metric: str
    per: str
    low: int | None
    high: int | None
    min_words: int = 0


#: The threshold table (percentages).
RULES = (
    Rule("word_chars", "n_words", 200, 1500),
    Rule("n_symbols", "n_words", None, 10),
    Rule("n_bangs", "n_words", None, 50),
    Rule("n_stop_words", "n_words", 1, None, 50),
    Rule("n_dup_lines", "n_lines", None, 40),
)
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


def _bind(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is evaluated once (a lambda over a one-element array)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside a 5-word window that occurs at least twice.

    Window hashes are sorted with their positions; equal neighbours are
    repeats. The sorted repeat positions then cover min(5, gap) words each.
    """
    n = F.size(words)

    def windows(h: Column) -> Column:
        """Hash of each run of five word hashes; the last four positions have no window."""
        runs = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
        return F.slice(runs, 1, F.size(h) - (WINDOW - 1))

    hashes = _bind(F.transform(words, lambda w: F.xxhash64(w)), windows)

    def repeats(ranked: Column) -> Column:
        """Sorted positions of the windows that have an equal neighbour in (hash, position) order."""
        size = F.size(ranked)
        none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
        after = F.concat(F.slice(ranked, 2, size - 1), none)
        before = F.concat(none, F.slice(ranked, 1, size - 1))
        places = F.zip_with(
            F.zip_with(ranked, after, lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), a["h"].eqNullSafe(b["h"]).alias("same"))),
            before,
            lambda a, b: F.when(a["same"] | a["h"].eqNullSafe(b["h"]), a["i"]),
        )
        return F.sort_array(F.filter(places, lambda p: p.isNotNull()))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(1), F.size(h)).alias("i")))
        return F.aggregate(
            _bind(ranked, repeats),
            F.struct(F.lit(0).alias("total"), F.lit(-WINDOW).alias("last")),
            lambda acc, p: F.struct((acc["total"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("total"), p.alias("last")),
            lambda acc: acc["total"],
        )

    some = _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(some).cast("long")


def features(text: Column) -> dict[str, Column]:
    """The measured columns, from the text and the arrays of its words and lines (computed once, below)."""
    words, lines = F.col("_q_words"), F.col("_q_lines")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(GAP))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_bangs": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(words),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))).cast("long"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression."""
    passed = ~base_failed()
    for r in rules:
        value, per = 100 * F.col(r.metric), F.col(r.per)
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (value >= r.low * per)
        if r.high is not None:
            ok = ok & (value <= r.high * per)
        passed = passed & (ok | (F.col("n_words") < r.min_words))
    return passed


def _measured(df: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    parts = df.select(
        *keep,
        text.alias("_q_text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("_q_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("_q_lines"),
    )
    return parts.select(*[F.col(c) for c in parts.columns if not c.startswith("_q_")], *[c.alias(n) for n, c in features(F.col("_q_text")).items()])


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measures, base_failed and kept, one row per document."""
    m = _measured(docs, F.coalesce(F.col("text"), F.lit("")), [F.col("doc_id")])
    return m.withColumns({"base_failed": base_failed(), "kept": verdict(rules)})


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that every rule accepts, with all their columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    m = _measured(docs, F.coalesce(F.col("text"), F.lit("")), [row])
    return m.where(verdict(rules)).select("row.*")
