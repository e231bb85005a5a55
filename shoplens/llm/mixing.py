"""Mixing sources to target weights: hash-random order, prefix sums, exact cuts.

Every document gets a hash-random key. Within a source the documents are
range-sorted by that key: its top bits name one of ``RANGES`` ranges, and a
window orders each (source, range). Range totals are prefix-summed per source,
so a document's prefix sum is its range's offset plus its running sum; a
source of any size is spread over ``RANGES`` tasks. The source's budget is then
cut exactly: whole epochs first, the rest up to the cut, splitting the
document on which the cut falls.

Defined results: a NULL text has size 0 and takes 0; a NULL source is a source
of its own, last in order; a NULL doc_id is mixed like any other document;
repeated rows are separate documents and ties of the key are ordered by id and
size, so reruns agree; an empty table gives an empty result; other columns are
ignored. The list of sources (one row each, they carry weights) is
configuration-sized; documents never pass through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import WORD, staged

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
RANGES = 1024
SEED = 17


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Targets share ``share`` times all sizes by weight and stop at ``max_epochs``
    times the source's size; the excess is reshared until none is above. That
    fixpoint is min(cap, level * weight): with sources ordered by cap/weight,
    the level comes from the first one that stays under its cap.
    """
    by_code = Window.orderBy(F.col("source").isNull(), F.col("source"))
    place = (F.row_number().over(by_code) - 1) % len(weights) + 1
    s = sources.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), place.cast("int")).cast("long"))
    s = s.withColumn("_cap", max_epochs * F.col("source_size"))
    rising = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").isNull(), F.col("source"))
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("_level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(onward))
    s = s.withColumn("_level", F.min(F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("_level").alias("l")))).over(everything)["l"])
    target = F.when(F.col("_level") * F.col("_w") < F.col("_cap"), F.col("_level") * F.col("_w")).otherwise(F.col("_cap").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def sizes(docs: DataFrame, *keep: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    # The text's own hash spreads rows that share a doc_id, or have none, over the ranges.
    key = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.xxhash64(text))
    return docs.select(
        *keep, "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("_key"),
        F.shiftrightunsigned(key, 64 - RANGES.bit_length() + 1).cast("int").alias("_range"),
    )


def _cuts(sized: DataFrame, weights, share: float, max_epochs: int) -> DataFrame:
    """Per (source, range): source_size, target, epochs, rest (words of the last, partial epoch) and offset (words before the range)."""
    ranges = sized.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    total = ranges.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(total, weights, share, max_epochs)
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select(
        F.col("o.source").alias("_source"), F.col("o._range").alias("_r"), "_offset", "_sum", "source_size", "target",
        epochs.alias("epochs"), (F.floor(F.col("target")).cast("long") - epochs * F.col("source_size")).alias("_rest"),
    )


def _with_cuts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    return rows.join(cuts, rows["source"].eqNullSafe(cuts["_source"]) & (rows["_range"] == cuts["_r"]))


def _words_before() -> Column:
    """Words before a document in its (source, range)."""
    ordered = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("size").over(ordered), F.lit(0))


def _part(before: Column) -> Column:
    """Words of a document in the partial epoch, given the words before it in its range."""
    return F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - before - F.col("_offset")))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted), epochs."""
    sized = staged(sizes(docs), "mixing_sizes")
    run = sized.withColumn("_before", _words_before())
    joined = _with_cuts(run, _cuts(sized, weights, share, max_epochs))
    taken = F.col("epochs") * F.col("size") + _part(F.col("_before"))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "epochs")


def mix_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: the documents of which words are taken, with all their columns and size, source_size, target, taken.

    The same cut as ``mix``. Ranges wholly before or after a source's cut need
    no order, so only the one range on which the cut falls is sorted and whole
    rows are not shuffled otherwise.
    """
    cuts = staged(_cuts(staged(sizes(docs), "mixing_sizes"), weights, share, max_epochs), "mixing_cuts")
    columns = docs.columns
    rows = sizes(docs, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    joined = _with_cuts(rows, cuts).drop("_source", "_r")
    inside = (F.col("_rest") > F.col("_offset")) & (F.col("_rest") < F.col("_offset") + F.col("_sum"))
    whole = joined.where(~inside).withColumn("_before", F.lit(0).cast("long"))
    split = joined.where(inside).withColumn("_before", _words_before())
    part = F.when(inside, _part(F.col("_before"))).when(F.col("_rest") >= F.col("_offset") + F.col("_sum"), F.col("size")).otherwise(F.lit(0))
    out = whole.unionByName(split).select("_row", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"))
    names = ("size", "source_size", "target", "taken")
    return out.where("taken > 0").select("_row.*", *[F.col(n).alias(n if n not in columns else f"mix_{n}") for n in names])
