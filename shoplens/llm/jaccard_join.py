"""N-gram Jaccard self-join: token-combination prefixes, exact verification, link classes.

Tokens are 64-bit hashes of 5-word shingles; two documents link when
100 * |A and B| >= 80 * |A or B|. Documents with equal sets form one class and
only one of them is joined. The join has two steps:

1. *Reduction.* With tokens ordered by hash, two linked sets share at least l
   tokens within their first p + l - 1, p = floor(n / 5) + 1 (for 80 %).
   Documents with fewer than l repeated tokens there can link to nothing.
   Tokens are counted with partial aggregates; nothing is grouped.
2. *Combination prefixes* over the rest, tokens ordered rarest first. The first
   shared token of a linked pair lies in both base prefixes. If it is rare (at
   most ``RARE`` documents), the single token is the index key. If it is
   frequent, so are all later shared ones; prefixes are then extended to
   2 p(n) + p(5n/4) - 1 tokens, within which a linked pair must share two
   tokens that are neighbours in both lists (each side has at most p - 1
   unshared tokens, too few to part every neighbour pair), so the index keys
   are the 2-token combinations of neighbouring frequent tokens.

An index key's documents are not paired with each other: each is paired with
the key's pivot (the document with the most common tokens), verified, and the
links' components are formed. Only documents of different components are then
paired, at single tokens of their base prefixes, behind bounds on sizes, on
the tokens they can share and on the places of the first one. That finds
every component without emitting all pairs of a group.

Defined results: NULL or word-less texts have an empty set, n_shingles 0 and link
with nothing; fewer than five words make one shingle; doc_id names a document,
so rows with words that share a doc_id share its component, and all that their texts link to are linked through it
(a row without words has its own doc_id); rows with a NULL doc_id get the
component of equal texts, else NULL; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import IdFilter, over_batches, staged, utf8_values
from shoplens.llm.components import components
from shoplens.llm.textops import mix64, shingles, word_hashes

SHINGLE = 5
#: Similarity in percent; the prefix formulas below are written for it.
PERCENT = 80
#: Tokens of at most this many documents are indexed alone, the others in twos.
RARE = 16
#: Classes with more than this share of the rows, one in so many, are not shuffled in the last join.
BIG = 1_000
#: Kinds of index keys.
SINGLE, SINGLE_FREQUENT, DOUBLE = 0, 1, 2


def base_prefix(n):
    """p: tokens among which a linked pair's first shared token lies."""
    return n // 5 + 1


def extended_prefix(n):
    return 2 * (n // 5) + n // 4 + 2


def needed(n):
    """l of step 1: tokens to share within the first p + l - 1."""
    return n // 20 + 1


def _sets(batch: pa.RecordBatch, tokens: str) -> dict:
    counts, keys, heads = [], [], []
    for data in utf8_values(batch.column("text")):
        t = shingles(word_hashes(data), SHINGLE) if data is not None else np.zeros(0, np.uint64)
        n = len(t)
        counts.append(n)
        keys.append(hashlib.blake2b(t.tobytes(), digest_size=16).digest() if n else None)
        heads.append((t[: base_prefix(n) + needed(n) - 1] if tokens == "head" else t).view(np.int64))
    offsets = np.zeros(len(heads) + 1, np.int32)
    np.cumsum([len(h) for h in heads], out=offsets[1:])
    values = np.concatenate(heads) if heads else np.zeros(0, np.int64)
    return {
        "doc_id": batch.column("doc_id"), "n": pa.array(counts, pa.int64()), "cls": pa.array(keys, pa.binary()),
        "tokens": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
    }


SET_SCHEMA = "doc_id long, n long, cls binary, tokens array<long>"


def _survivors(heads: DataFrame) -> DataFrame:
    """Step 1: (doc_id, n, cls) of the documents with enough repeated tokens in the extended prefix."""
    token = heads.where("n >= 4 and doc_id is not null").select("doc_id", "n", "cls", F.explode("tokens").alias("token"))
    repeated = token.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    hits = token.select("doc_id", "token").join(repeated, "token").groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))
    ids = heads.where("n >= 4 and doc_id is not null").select("doc_id", "n", "cls")
    return ids.join(hits, "doc_id").where(F.expr("hits >= n div 20 + 1")).select("doc_id", "n", "cls")


def _similar(a: Column, b: Column, common: Column) -> Column:
    return 100 * common >= PERCENT * (a + b - common)


def _signatures(batch: pa.RecordBatch) -> dict:
    """Index keys of each set: rare tokens of the base prefix, neighbours among the frequent of the extended one.

    ``most`` bounds the tokens that a pair first met at the key can share: all
    repeated ones at a rare key; at a frequent key only the frequent ones, as
    a pair that shares a rare token meets at its first one.
    """
    ids, sizes, known = (batch.column(c).to_numpy() for c in ("id", "n", "r"))
    lists = batch.column("shared")
    at = lists.offsets.to_numpy()
    fields = lists.values
    freq, token = fields.field("df").to_numpy(), fields.field("token").to_numpy().view(np.uint64)
    rows, sigs, most, kind, place = [], [], [], [], []
    for i in range(batch.num_rows):
        n, unique = int(sizes[i]), int(sizes[i] - known[i])
        f, t = freq[at[i] : at[i + 1]], token[at[i] : at[i + 1]]
        base = t[: max(0, base_prefix(n) - unique)]
        rare = f[: len(base)] <= RARE
        frequent = int(np.count_nonzero(f > RARE))
        enough = 100 * frequent >= PERCENT * n
        keep = rare | enough
        reach = max(0, min(n, extended_prefix(n)) - unique)
        often = t[:reach][f[:reach] > RARE] if enough else t[:0]
        double = mix64(often[:-1] * np.uint64(0x9E3779B97F4A7C15) + often[1:]) if len(often) > 1 else often[:0]
        sigs += [base[keep], double]
        rows.append(int(keep.sum()) + len(double))
        most += [np.where(rare[keep], known[i], frequent), np.full(len(double), frequent)]
        kind += [np.where(rare[keep], SINGLE, SINGLE_FREQUENT), np.full(len(double), DOUBLE)]
        place += [np.flatnonzero(keep) + unique, np.zeros(len(double), np.int64)]
    own = np.repeat(np.arange(batch.num_rows), rows)
    centre = batch.column("centre").to_numpy()
    return {
        "sig": np.concatenate(sigs).view(np.int64), "id": ids[own], "n": sizes[own], "most": np.concatenate(most).astype(np.int64),
        "kind": np.concatenate(kind).astype(np.int32), "place": np.concatenate(place).astype(np.int32), "centre": centre[own],
    }


def _may_link(a: str, b: str) -> Column:
    """Bounds on two sets from their sizes and the most tokens they can share if the key is their first."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(f"{a}.most", f"{b}.most")
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & _similar(na, nb, most)


def _first_shared(a: str, b: str) -> Column:
    """Whether a key's places allow it to be the first token that two linked sets share.

    They share at least 80 / 180 of their joint size; in either set, no more
    than the rest stands before the first shared token.
    """
    least = F.ceil(PERCENT * (F.col(f"{a}.n") + F.col(f"{b}.n")) / (100 + PERCENT))
    return (F.col(f"{a}.place") <= F.col(f"{a}.n") - least) & (F.col(f"{b}.place") <= F.col(f"{b}.n") - least)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets of repeated tokens."""
    side = sets.select("id", "n", "tokens")
    both = pairs.join(side.toDF("a", "na", "ta"), "a").join(side.toDF("b", "nb", "tb"), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where(_similar(F.col("na"), F.col("nb"), common)).select("a", "b")


def link_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), one row per document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    heads = staged(over_batches(docs, lambda b: _sets(b, "head"), SET_SCHEMA), "jaccard_heads")
    light = heads.select("doc_id", "n", "cls")

    left = staged(_survivors(heads), "jaccard_survivors")
    reps = left.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    # A class's node: a doc_id may stand for several classes, so it does not serve. The numbers hold once written.
    reps = staged(reps.withColumn("id", F.monotonically_increasing_id()), "jaccard_reps")
    wanted = IdFilter(reps, "doc_id")
    some = over_batches(
        docs.where("doc_id is not null").select("doc_id", "text", *wanted.slots("doc_id")),
        lambda b: _sets(wanted.rows(b), "all"), SET_SCHEMA,
    )
    # One row per class: a doc_id may stand on several rows with the same text.
    sets = some.join(reps.select("doc_id", "cls", "id"), ["doc_id", "cls"]).dropDuplicates(["id"])
    sets = staged(sets.select("id", "n", "tokens"), "jaccard_sets")

    token = sets.select("id", "n", F.explode("tokens").alias("token"))
    often = token.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = token.join(often, "token").groupBy("id", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared")
    )
    known = known.withColumn("r", F.size("shared").cast("long")).where(100 * F.col("r") >= PERCENT * F.col("n"))
    centre = F.aggregate("shared", F.lit(0.0), lambda acc, x: acc + F.log2(x["df"]), lambda acc: acc / F.col("n"))
    known = staged(known.select("id", "n", "r", "shared", centre.alias("centre")), "jaccard_known")
    shared = known.select("id", "n", F.transform("shared", lambda x: x["token"]).alias("tokens"))

    sigs = staged(over_batches(known, _signatures, "sig long, id long, n long, most long, kind int, place int, centre double"), "jaccard_signatures")
    index = sigs.where(F.col("kind") != SINGLE_FREQUENT)
    pivots = index.groupBy("sig").agg(
        F.max(F.struct("centre", F.col("id").alias("pivot"), "n", "most")).alias("p"), F.count(F.lit(1)).alias("c")
    ).where("c > 1").select("sig", "p.pivot", F.col("p.n").alias("n"), F.col("p.most").alias("most"))
    stars = index.alias("s").join(pivots.alias("p"), "sig").where((F.col("s.id") != F.col("p.pivot")) & _may_link("s", "p"))
    tried = staged(stars.select(F.least("s.id", "p.pivot").alias("a"), F.greatest("s.id", "p.pivot").alias("b")).distinct(), "jaccard_stars")
    links = staged(_verified(tried, shared), "jaccard_links")

    # Pairs of different components that share a key: all but the pivot's component against the whole key.
    label = components(links, "jaccard")
    named = sigs.where(F.col("kind") != DOUBLE).join(label.withColumnRenamed("node", "id"), "id", "left").select(
        "sig", "id", "n", "most", "place", "centre", F.coalesce("label", "id").alias("label")
    )
    named = staged(named, "jaccard_named")
    # The home of a key is the component of its most central document.
    home = named.groupBy("sig").agg(
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("centre", "id", "label")).alias("top")
    ).where("lo < hi").select("sig", F.col("top.label").alias("home"))
    mixed = named.join(home, "sig")
    other = mixed.where("label <> home")
    cross = other.alias("s").join(mixed.alias("p"), "sig").where(
        (F.col("s.label") != F.col("p.label")) & ((F.col("p.label") == F.col("p.home")) | (F.col("s.id") < F.col("p.id")))
        & _may_link("s", "p") & _first_shared("s", "p")
    )
    cross = cross.select(F.least("s.id", "p.id").alias("a"), F.greatest("s.id", "p.id").alias("b")).distinct()
    cross = cross.join(tried, ["a", "b"], "left_anti")
    found = staged(_verified(cross, shared), "jaccard_cross")
    # The first round's classes stay; new links only join their labels.
    final = components(links.union(found), "jaccard")

    named = final.withColumnRenamed("node", "id").join(reps.select("id", "cls", "doc_id"), "id")
    named = named.join(named.groupBy("label").agg(F.min("doc_id").alias("name")), "label").select("cls", "name")
    return _of_rows(light, _joined_ids(light, named))


def _joined_ids(light: DataFrame, named: DataFrame) -> DataFrame:
    """(cls, component, c): every class's component, the classes of one doc_id being linked too, and its rows."""
    of_class = light.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c"))
    of_class = staged(of_class.join(named, "cls", "left").select("cls", F.least("name", "rep").alias("name"), "c"), "jaccard_classes")
    mine = light.where("cls is not null and doc_id is not null").select("doc_id", "cls").distinct()
    several = mine.groupBy("doc_id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("doc_id")
    both = staged(mine.join(several, "doc_id").join(of_class.select("cls", "name"), "cls").select("doc_id", "name").distinct(), "jaccard_ids")
    first = both.groupBy("doc_id").agg(F.min("name").alias("a"))
    links = both.join(first, "doc_id").where("a <> name").select("a", F.col("name").alias("b"))
    if links.isEmpty():
        return of_class.withColumnRenamed("name", "component")
    label = components(links, "jaccard_ids").toDF("name", "label")
    return of_class.join(label, "name", "left").select("cls", F.coalesce("label", "name").alias("component"), "c")


def _of_rows(light: DataFrame, of_class: DataFrame) -> DataFrame:
    """The result's rows. Rows of a class with more than a ``BIG``-th of all rows take its component from a broadcast."""
    of_class = staged(of_class, "jaccard_components")
    most = light.count() // BIG
    large = F.broadcast(of_class.where(F.col("c") > most).select("cls", "component"))  # fewer than BIG rows
    known = light.where("cls is not null")
    parts = [
        light.where("cls is null").withColumn("component", F.lit(None).cast("long")),
        known.join(large, "cls").select("doc_id", "n", "cls", "component"),
        known.join(large, "cls", "left_anti").join(of_class.where(F.col("c") <= most).select("cls", "component"), "cls").select("doc_id", "n", "cls", "component"),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one of each link class: the one whose doc_id names the class.

    Rows with a NULL doc_id stay (they name no document), and so do texts
    without words. Of rows that share a doc_id one stays. Only rows whose id
    may be affected are shuffled; a filter of those ids lets the others pass.
    """
    classes = link_classes(docs).where("doc_id is not null")
    again = classes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("c"))
    touched = staged(again.where("n > 1 or doc_id <> c").select("doc_id", (F.col("doc_id") != F.col("c")).alias("gone")), "jaccard_touched")
    suspects = IdFilter(touched, "doc_id")
    schema = docs.schema

    def side(suspect: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = pa.array(suspects.marks(batch) == suspect)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[: len(schema)]], names=schema.names)

        slots = suspects.slots("doc_id")
        return docs.select(*[F.col(f"`{c}`") for c in schema.names], *slots).mapInArrow(run, schema)

    row = side(True).select(F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("row"), F.col("doc_id").alias("_id"))
    gone = touched.where("gone").select(F.col("doc_id").alias("_id"))
    kept = row.join(gone, "_id", "left_anti").dropDuplicates(["_id"]).select("row.*")
    return side(False).union(kept)
