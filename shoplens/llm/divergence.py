"""Divergence of a language's sources: how far their term frequencies stand from each other.

1. *Duplicate-text collapse.* Texts are counted by (lang, digest, source). A
   text that stands in a language once is cut where it lies. Of a repeated
   one, found at the scan by a bounded filter of their digests, one copy goes on, with its
   count in each source (a third of all rows may be one text: a partial
   aggregate leaves one copy a task). Each text is tokenized once, and its term counts and document
   frequencies are added with the counts as weights.
2. *Kept terms.* Terms in at least ``LEAST_DOCS`` documents of the language.
   p = 1 + floor(SCALE * (count + 1) / (N + V)), in exact integers.
3. *Sparse pairs.* The sum over all kept terms of f(p, q) = floor((p - q)^2 / q)
   of two sources a, b, whose p at count 0 is a0, b0, falls into three parts:

   - a's terms by their counts, against b0: one row per distinct count of a, count 0
     included (it stands for all kept terms that a lacks);
   - b's terms by their counts, f(a0, q) - f(a0, b0) each;
   - terms of both: f(p, q) - f(p, b0) - f(a0, q) + f(a0, b0) each.

   Only the third meets term by term, and its sums are formed where the pairs
   arise. The first two join counts with sources on (lang, salt), so a language is no
   single task.

Defined results: NULL text, lang and source are read as empty strings; a
language without kept terms gives value 0 for its pairs and no term rows; a
language with one source has no pairs; very long texts are cut whole; repeated rows count each; ties
rank by item in UTF-8 order; an empty table gives an empty result; other
columns are ignored. Sums are decimals; a value beyond 64 bits is an error, not a wrapped number.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from shoplens.llm.common import IdFilter, staged, utf8_values

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
SALTS = 64
#: Counts that a task holds before it hands them on.
ENTRIES = 250_000

#: Terms in UTF-8, lower-cased: runs of a-z and of the bytes of code points beyond ASCII.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def collapsed(docs: DataFrame) -> tuple[DataFrame, DataFrame, IdFilter]:
    """(lang, source) groups; (lang, text, sources, key): each text of a language with its counts by source; a filter.

    A row whose key may be in the filter is to be passed over where it is read: its text comes again, without a key.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    light = rows.groupBy("lang", digest.alias("digest"), "source").agg(F.count(F.lit(1)).alias("m"))
    light = staged(light, "divergence_texts")
    groups = light.select("lang", "source").distinct()
    repeated = light.groupBy("lang", "digest").agg(F.sum("m").alias("total"), F.collect_list(F.struct("source", "m")).alias("sources"))
    repeated = staged(repeated.where("total > 1").select("lang", "digest", "sources"), "divergence_repeated")  # at most one entry a source
    key = F.unhex(F.md5(F.concat_ws(" ", F.hex(digest), "lang").cast("binary")))
    wanted = IdFilter(repeated.select(F.unhex(F.md5(F.concat_ws(" ", F.hex("digest"), "lang").cast("binary"))).alias("key")), "key", digest=True)

    @F.pandas_udf("boolean")
    def suspect(keys: pd.Series) -> pd.Series:
        return keys.map(wanted.may_hold)

    marked = rows.withColumn("key", key)
    once = marked.select("lang", "text", F.array(F.struct("source", F.lit(1).cast("long").alias("m"))).alias("sources"), "key")
    again = marked.where(suspect("key")).withColumn("digest", digest)
    one = again.groupBy("lang", "digest").agg(F.first("text").alias("text"), F.first("source").alias("own"))
    # A text that only the filter took for a repeated one has its single source.
    alone = F.array(F.struct(F.col("own").alias("source"), F.lit(1).cast("long").alias("m")))
    many = one.join(repeated, ["lang", "digest"], "left").select("lang", "text", F.coalesce("sources", alone).alias("sources"))
    return groups, once.unionByName(many.withColumn("key", F.lit(None).cast("binary"))), wanted


_FOUND = StructType([
    StructField("lang", StringType()), StructField("term", StringType()),
    StructField("found", ArrayType(StructType([StructField("source", StringType()), StructField("count", LongType()), StructField("docs", LongType())]))),
])


def _tally(wanted: IdFilter):
    """(lang, text, sources, key) to (lang, term) with (source, count, docs) of each source, added up in the task."""
    entry = _FOUND["found"].dataType.elementType

    def handed_on(counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        want = to_arrow_schema(_FOUND)
        struct = to_arrow_schema(entry)
        for lang in {k for k, _ in counts}:
            parts = []
            for (k, source), mine in counts.items():
                if k == lang and mine:
                    n = [pa.array(mine.values(), pa.int64()), pa.array([docs[k, source][t] for t in mine], pa.int64())]
                    name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(mine), np.int32)), pa.array([source], pa.string())).cast(pa.string())
                    parts.append(pa.table([pa.array(mine, pa.binary()), name, *n], names=["term", *struct.names]))
            if not parts:
                continue
            by_term = pa.concat_tables(parts).group_by("term", use_threads=False).aggregate([(c, "list") for c in struct.names])
            for batch in by_term.to_batches(max_chunksize=1 << 14):
                lists = [batch.column(f"{c}_list") for c in struct.names]
                fields = pa.StructArray.from_arrays([x.flatten() for x in lists], fields=list(struct))
                offsets = pc.subtract(lists[0].offsets, lists[0].offsets[0])
                found = pa.ListArray.from_arrays(offsets, fields, type=want.field("found").type)
                langs = pa.array([lang] * batch.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([langs, batch.column("term").cast(pa.string()), found], schema=want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = defaultdict(Counter), defaultdict(Counter)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "sources", "key")]
            for i, (lang, sources, key, data) in enumerate(zip(*columns, utf8_values(batch.column("text")))):
                if i % 256 == 255 and sum(map(len, counts.values())) >= ENTRIES:
                    yield from handed_on(counts, docs)
                    counts, docs = defaultdict(Counter), defaultdict(Counter)
                if key is not None and wanted.may_hold(key):
                    continue
                terms = _TERM.findall(data.tobytes().lower())
                for e in sources:
                    mine, own = counts[lang, e["source"]], docs[lang, e["source"]]
                    if e["m"] == 1:
                        mine.update(terms)
                        own.update(set(terms))
                        continue
                    for term, n in Counter(terms).items():
                        mine[term] += n * e["m"]
                        own[term] += e["m"]
        yield from handed_on(counts, docs)

    return run


def kept_terms(texts: DataFrame, wanted: IdFilter, least_docs: int) -> DataFrame:
    """(lang, text, sources, key) to (lang, source, term, count, lang_count) of the kept terms.

    The tasks add up their texts; what they found meets once, by (lang, term),
    where a term has at most one row a source.
    """
    found = texts.mapInArrow(_tally(wanted), _FOUND).repartition("lang", "term").select("lang", "term", F.inline("found"))
    counts = found.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counts = counts.withColumn("in_docs", F.sum("docs").over(term)).withColumn("lang_count", F.sum("count").over(term))
    return counts.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "count", "lang_count")


def _p(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)); 0 where there are no kept terms."""
    share = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (n + v).cast("decimal(20,0)"))
    return F.when(v > 0, 1 + share).otherwise(F.lit(0)).cast("long")


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _total(x: Column) -> Column:
    return F.sum(x.cast("decimal(19,0)"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    groups, texts, wanted = collapsed(docs)
    posts = staged(kept_terms(texts, wanted, least_docs), "divergence_posts")

    # Sizes: a row for each language, and for each of its sources, which have terms or not.
    by_term = posts.groupBy("lang", "term").agg(F.max("lang_count").alias("lang_count"))
    langs = by_term.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_count").alias("lang_n"))
    sums = posts.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("has"))
    groups = groups.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0, ["v", "lang_n", "n", "has"])
    groups = groups.withColumn("p0", _p(F.lit(0).cast("long"), F.col("n"), F.col("v")))
    groups = staged(groups, "divergence_groups")

    sized = posts.join(groups.select("lang", "source", "v", "n", "lang_n", "p0"), ["lang", "source"])
    sized = sized.withColumn("p", _p(F.col("count"), F.col("n"), F.col("v")))

    # Terms above the language's share.
    above = sized.withColumn("q", _p(F.col("lang_count"), F.col("lang_n"), F.col("v"))).where("p > q")
    above = above.select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    # Pairs: parts one and two from the distinct counts of each source, dealt by a salt.
    levels = sized.groupBy("lang", "source", "count", "p", "p0").agg(F.count(F.lit(1)).alias("k"))
    lacking = groups.select("lang", "source", F.lit(0).cast("long").alias("count"), F.col("p0").alias("p"), "p0", (F.col("v") - F.col("has")).alias("k"))
    levels = levels.unionByName(lacking).withColumn("salt", F.pmod(F.xxhash64("source", "count"), F.lit(SALTS)))
    other = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    met = levels.join(other, ["lang", "salt"]).where("source <> other")
    first = F.when(F.col("o0") > 0, F.col("k").cast("decimal(19,0)") * _f(F.col("p"), F.col("o0")).cast("decimal(19,0)")).otherwise(0)
    # As q, this source's counts are set against its own share at count 0.
    gain = _f(F.col("o0"), F.col("p")) - _f(F.col("o0"), F.col("p0"))
    second = F.when(F.col("count") > 0, F.col("k").cast("decimal(19,0)") * gain.cast("decimal(19,0)")).otherwise(0)
    two = met.select("lang", F.explode(F.array(
        F.struct(F.col("source").alias("a"), F.col("other").alias("b"), first.cast("decimal(38,0)").alias("x")),
        F.struct(F.col("other").alias("a"), F.col("source").alias("b"), second.cast("decimal(38,0)").alias("x")),
    )).alias("r")).select("lang", "r.a", "r.b", "r.x")
    two = two.groupBy("lang", "a", "b").agg(F.sum("x").alias("x"))

    # Part three: postings of a term meet; a term has at most one a source.
    post = sized.select("lang", "term", "source", "p", "p0")
    both = post.toDF("lang", "term", "a", "p", "a0").join(post.toDF("lang", "term", "b", "q", "b0"), ["lang", "term"]).where("a <> b")
    p, q, a0, b0 = map(F.col, ("p", "q", "a0", "b0"))
    three = both.groupBy("lang", "a", "b").agg(_total(_f(p, q) - _f(p, b0) - _f(a0, q) + _f(a0, b0)).cast("decimal(38,0)").alias("x"))
    value = two.unionByName(three).groupBy("lang", "a", "b").agg(F.sum("x").cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = value.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").withColumn("rank", F.row_number().over(order))

    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
