"""Documents told apart by id and text, filters sized by the grams, mixed words walked one by one, the pipeline."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from shoplens.llm import chunk_dedup, langid, mixing
from shoplens.llm.queries import queries

DOCS = "doc_id long, text string, lang string, source string"


def passage(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9))) for _ in range(n))


def test_chunks_of_documents_without_or_with_one_id(spark):
    shared = passage(1, 60)
    rows = [(None, passage(2, 40) + " " + shared), (None, passage(3, 40)), (7, passage(4, 30) + " " + shared), (9, passage(5, 50)),
            (9, passage(6, 50) + " " + shared), (9, passage(6, 50) + " " + shared), (11, passage(7, 50))]
    df = spark.createDataFrame([(i, t, None, None) for i, t in rows], DOCS)
    got = chunk_dedup.removal_report(df).collect()
    # Every document that holds the passage, the NULL row and 9's second text too; 9's equal rows are one document.
    assert sorted((r.doc_id is None, r.doc_id) for r in got if r.doc_id is not None) == [(False, 7), (False, 9)]
    assert sum(r.doc_id is None for r in got) == 1
    by = {r.doc_id: r for r in got}
    assert by[7].n_removed == 0 < by[9].n_removed and by[9].kept_docs == [7] and by[None].kept_docs == [7]
    # A document whose only copy stands in a row without an id.
    two = spark.createDataFrame([(8, shared, None, None), (None, shared, None, None), (None, passage(8, 50), None, None)], DOCS)
    got = {r.doc_id: r for r in chunk_dedup.removal_report(two).collect()}
    assert set(got) == {8, None} and got[8].n_removed == 0 and got[None].kept_docs == [8]


def test_language_filter_grows_with_the_grams():
    assert langid.slots_for(0) == langid.slots_for(30_000) == langid.FEWEST_SLOTS
    assert langid.slots_for(100_000) == 1 << 21
    most = int(1 / langid.RAREST)
    assert langid.slots_for(most) == langid.MOST_SLOTS and (1 - np.exp(-langid.HASHES * most / langid.MOST_SLOTS)) < 0.18


def test_full_language_filters_say_nothing():
    text = np.frombuffer(b"some words of a text", np.uint8)
    table = np.full(1 << 10, 3, np.int64)
    assert langid.Model(["en", "de"], table).predict(text) == ("en", 0.0)
    table = np.full(1 << 10, 1, np.int64)  # en's is full, de's holds the grams of the text
    for s in langid._slots(langid.grams(text), len(table)):
        table[s] |= 2
    lang, score = langid.Model(["en", "de"], table).predict(text)
    assert lang == "de" and score > 0.9


@pytest.mark.parametrize("size", [1 << 10, 1 << 21])
def test_language_slots_answer_as_sets_do(size):
    rng = np.random.default_rng(1)
    held = rng.integers(0, 1 << 31, 200).astype(np.uint32)
    table = np.zeros(size, np.int64)
    for s in langid._slots(held, size):
        assert s.min() >= 0 and s.max() < size
        table[s] = 1
    others = rng.integers(0, 1 << 31, 20_000).astype(np.uint32)
    model = langid.Model(["en"], table)
    assert model.hits(held)[0] == len(held)
    assert abs(model.hits(others)[0] / len(others) - model.fp[0]) < 0.02


def test_taken_words_by_a_walk(spark, docs, sample):
    """Each source's documents in key order, whole epochs and then words until the target is met."""
    for df in (docs, sample):
        keyed = mixing.sizes(df).select("doc_id", "source", "size", "_key", "_range").collect()
        mixed = mixing.mix(df).collect()
        target = {r.source: (r.target, r.source_size) for r in mixed}
        order = defaultdict(list)
        for r in keyed:
            order[r.source].append((r["_range"], r["_key"], r.doc_id is not None, r.doc_id or 0, r.size))
        want = []
        for source, found in order.items():
            left, total = int(target[source][0]), target[source][1]
            assert total == sum(x[-1] for x in found)
            epochs = left // total if total else 0
            left -= epochs * total
            for *_, known, i, size in sorted(found):
                part = min(size, left)
                left -= part
                want.append((source or "", i if known else -1, size, epochs * size + part))
        assert sorted((r.source or "", -1 if r.doc_id is None else r.doc_id, r.size, r.taken) for r in mixed) == sorted(want)


def test_rows_without_an_id_spread_over_the_ranges(spark):
    df = spark.createDataFrame([(None, passage(i, 5), None, "a") for i in range(300)], DOCS)
    assert mixing.sizes(df).select("_range").distinct().count() > 100


def test_toxicity_recall_and_precision(spark):
    """Of the held-out labelled documents at least 0.8 of the toxic ones are found, hardly any other."""
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(label[r.doc_id], r.predicted) for r in queries()["op1_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in label]
    found, right, toxic = sum(p for _, p in judged), sum(y and p for y, p in judged), sum(y for y, _ in judged)
    assert right >= 0.8 * toxic > 0 and found - right <= 0.05 * found


def shingles(text: str) -> frozenset:
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_pipeline(spark):
    """Every stage's decision holds in the result: ids of the input, no links, no verbatim items, no secrets, words within their bounds."""
    sf = "/root/testdata/sf0.01"
    out = corpus_pipeline.run(spark, sf)
    names = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert out.columns[: len(names)] == names
    got = out.collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    assert got and {r.doc_id for r in got} <= kept <= set(docs) and len({r.doc_id for r in got}) == len(got)
    sets = [s for r in got if (s := shingles(docs[r.doc_id].text))]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    flat = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [flat(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(f" {item} " in f" {flat(r.text)} " for item in items if len(item.split()) >= 8 for r in got)
    shape = re.compile(r'(?:token = "|password=)[0-9a-f]{16,}|\bAKIA[0-9A-Z]{16}\b')
    assert any(shape.search(r.text or "") for r in docs.values()) and not any(shape.search(r.text) for r in got)
    assert all(0 < r.taken <= 2 * r.size and r.size > 0 for r in got)
