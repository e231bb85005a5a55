"""Operators on texts against brute force, on the awkward rows and on the small documents table."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from shoplens.llm import chunk_dedup, jaccard_join, langid, mixing, quality, repeats


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_row(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("table", ["docs", "sample", "empty"])
def test_quality_measures(request, table):
    df = request.getfixturevalue(table)
    want = Counter()
    for r in df.collect():
        w = words(r.text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(covered), failed)] += 1
    got = by_row(quality.quality_report(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == want


def test_quality_filter_keeps_columns_and_clean_rows(docs, empty):
    kept = quality.filter_quality(docs)
    assert kept.schema == docs.schema and kept.count() < docs.count()
    assert quality.filter_quality(empty).count() == 0
    assert not quality.quality_report(docs).where("kept and base_failed").count()


@pytest.mark.parametrize("table", ["docs", "sample", "empty"])
def test_mixing_cuts_at_the_budget(request, table):
    df = request.getfixturevalue(table)
    first = mixing.mix(df).collect()
    assert Counter(first) == Counter(mixing.mix(df).collect())
    assert len(first) == df.count()
    total = sum(r.size for r in first)
    for source in {r.source for r in first}:
        mine = [r for r in first if r.source == source]
        assert sum(r.taken for r in mine) == int(mine[0].target)
        assert mine[0].source_size == sum(r.size for r in mine)
        assert mine[0].target <= 2 * mine[0].source_size
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
    assert sum({r.source: r.target for r in first}.values()) == pytest.approx(1.5 * total)
    mixed = mixing.mix_documents(df)
    taken = [c for c in mixed.columns if c.endswith("taken")][-1]
    assert sum(r[taken] for r in mixed.collect()) == sum(r.taken for r in first)


def test_mixing_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # Weights 5, 2, 1, 5; 3765 words to share; a stops at 20 and null at 1000, b at 2000, c has the rest.
    assert got == {"a": 20.0, None: 1000.0, "b": pytest.approx(1830.0), "c": pytest.approx(915.0)}


def brute_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        if i is None:
            continue
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[j : j + 5]) for j in range(len(w) - 4)])
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("table", ["docs", "sample"])
def test_jaccard_components(request, table):
    df = request.getfixturevalue(table)
    want = brute_components([(r.doc_id, r.text) for r in df.collect()])
    got = jaccard_join.link_classes(df).collect()
    assert len(got) == df.count()
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    # A row without an id has the component of equal texts, or none.
    assert {r.component_id for r in got if r.doc_id is None} <= {None, *(c for _, c in want.values())}


def test_jaccard_frequent_tokens_and_chains(spark, monkeypatch):
    """Many near copies: every key is frequent, pivots differ from some members and chains link far ends."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    shared = " ".join(f"p{i}" for i in range(60))
    rows += [(100 + i, " ".join(f"u{i}_{j}" for j in range(60)) + " " + shared) for i in range(40)]
    chain = [f"c{i}" for i in range(100)]
    for i in range(20):
        chain = chain[3:] + [f"n{i}_{j}" for j in range(3)]
        rows.append((300 + i, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for rare in (16, 2):
        monkeypatch.setattr(jaccard_join, "RARE", rare)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_classes(df).collect()}
        assert got == want


def test_jaccard_smallest_linked_sets(spark):
    """Four shingles within five are the smallest sets that link without being equal."""
    eight = "a1 b2 c3 d4 e5 f6 g7 h8"
    rows = [(1, eight), (2, eight + " i9"), (3, "z0 " + eight), (4, "a1 b2 c3 d4 e5 f6 g7"), (5, "k1 l2 m3 n4"), (6, "k1 l2 m3 n4 o5")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_classes(df).collect()}
    assert got == brute_components(rows)
    assert [got[i][1] for i in (1, 2, 3, 4)] == [1, 1, 1, 4]


def test_jaccard_repeated_ids_link_their_texts(spark):
    """A doc_id on several texts joins their classes, also texts of equal size and chains of ids."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 30), ("b", 30), ("c", 9), ("d", 12)))
    rows = [(1, a), (4, a), (4, b), (7, b), (9, c), (8, c), (8, d + " e"), (6, d + " f g"), (5, d), (12, ""), (12, c + " x y"), (13, c + " x y"), (4, ""), (None, b), (None, None)]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, {tuple(words(t)[j : j + 5]) for j in range(len(words(t)) - 4)}) for i, t in rows]
    for i, x in sets:
        for j, y in sets:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_classes(df).collect())
    assert got == Counter((i, len(x), i if not x else find(i) if i is not None else 1) for i, x in sets)
    assert find(7) == find(4) == 1 and find(9) == find(6) == 5


def test_one_of_each_class(docs, sample, empty):
    kept = jaccard_join.one_of_each(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 2, 3, 5, 6, 7, 8, 9, 10, 12]
    want = {c for _, c in brute_components([(r.doc_id, r.text) for r in sample.collect()]).values()}
    assert {r.doc_id for r in jaccard_join.one_of_each(sample).collect()} == want
    assert jaccard_join.one_of_each(empty).count() == 0


def brute_repeats(texts, width):
    seen = Counter(hash(t[p : p + width]) for t in texts for p in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if seen[hash(t[p : p + width])] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1024, 1])
@pytest.mark.parametrize("table", ["docs", "sample"])
def test_repeats(request, monkeypatch, table, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows], 400)))
    assert by_row(repeats.strip_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def brute_groups(texts, width):
    """Maximal repeats by walking the tree of the texts' suffixes: (doc, start, length) of every occurrence, with n and parent."""
    classes = {}
    for d, (_, t) in enumerate(texts):
        for p in range(len(t) - width + 1):
            classes.setdefault(t[p : p + width], []).append((d, p))
    out = Counter()

    def after(d, p, n):
        t = texts[d][1]
        return t[p + n] if p + n < len(t) else (d, p)  # a text's edge is like nothing else

    for places in classes.values():
        walk = [(places, width, None)]
        while walk:
            members, n, parent = walk.pop()
            if len(members) < 2 or len({texts[d][1][p - 1] if p else (d, p) for d, p in members}) < 2:
                continue
            while len(kinds := {after(d, p, n) for d, p in members}) == 1:
                n += 1
            d, p = members[0]
            group = texts[d][1][p : p + n]
            for d, p in members:
                out[texts[d][0], p, n, len(members), len(parent) if parent else None] += 1
            parts = {}
            for d, p in members:
                parts.setdefault(after(d, p, n), []).append((d, p))
            walk += [(m, n + 1, group) for m in parts.values()]
    return out


@pytest.mark.parametrize("hot", [1024, 0])
@pytest.mark.parametrize("table", ["docs", "sample"])
def test_repeat_groups_are_all_maximal_repeats(request, spark, monkeypatch, table, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    df = request.getfixturevalue(table)
    # Rows 6 and 8 are long periodic texts; their occurrences are too many for brute force, so a short one stands for each.
    rows = [(r.doc_id, r.text[:1200] if table == "docs" and r.doc_id in (6, 8) else r.text) for r in df.collect()]
    rng = random.Random(3)
    piece = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    long, own = piece(3000), piece(500)
    rows += [
        (1001, "word " * 160), (1002, "word " * 120 + "end"), (1003, piece(90) + long), (1004, piece(40) + long + piece(30)),
        (1005, long[:1500] + piece(9)), (1006, own + piece(60) + own + "é" + own[:450]), (1007, long[700:2000]), (1008, piece(399)), (1009, own[:400]),
        (1009, own[:399]), (1010, "only copy " * 3 + long[::-1]), (1011, "only copy " * 3 + long[::-1]),
    ]
    got = repeats.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    parents = {r.grp: r.length for r in got.select("grp", "length").distinct().collect()}
    got = Counter((r.doc_id, r.start, r.length, r.n, parents[r.parent] if r.parent else None) for r in got.collect())
    want = brute_groups([(i, (t or "").encode()) for i, t in rows], 400)
    assert got == want and any(n[2] > 2000 for n in want)


def test_repeats_of_nothing(empty):
    assert repeats.repeat_groups(empty).count() == 0
    assert repeats.strip_repeats(empty).count() == 0


def test_interval_tree_is_the_lcp_interval_tree():
    texts = sorted(["banana"[i:] for i in range(6)] + ["bandana"[i:] for i in range(7)])
    lcp = [0] + [next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for x, y in zip(texts, texts[1:])]
    got = {(d, a, b) for d, a, b, _ in repeats.interval_tree(lcp, 1)}
    want = set()
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            d = min(lcp[a + 1 : b + 1])
            if d >= 1 and (a == 0 or lcp[a] < d) and (b + 1 == len(lcp) or lcp[b + 1] < d):
                want.add((d, a, b))
    assert got == want
    tree = repeats.interval_tree(lcp, 1)
    for d, a, b, p in tree:
        if p >= 0:
            assert tree[p][0] < d and tree[p][1] <= a and tree[p][2] >= b


def test_chunks_join_up_and_resist_shifts():
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.integers(97, 123, 20_000).astype(np.uint8)
    edges = chunk_dedup.cuts(data)
    assert edges[0] == 0 and edges[-1] == len(data) and (np.diff(edges) <= chunk_dedup.MOST).all()
    moved = chunk_dedup.cuts(np.concatenate([data[:5000], data[:3], data[5000:]]))
    pieces = lambda d, e: {d[a:b].tobytes() for a, b in zip(e[:-1], e[1:])}
    assert len(pieces(data, edges) - pieces(np.concatenate([data[:5000], data[:3], data[5000:]]), moved)) <= 3


def test_chunk_report(docs, sample, empty):
    assert {r.doc_id for r in chunk_dedup.dedup_report(docs).collect()} == {None, 1, 4}
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    long = Counter()
    for i, t in rows:
        long.update({(tuple(words(t)[j : j + 60])) for j in range(len(words(t)) - 59)})
    want = {i for i, t in rows if any(long[tuple(words(t)[j : j + 60])] > 1 and len(set(words(t)[j : j + 60])) > 20 for j in range(len(words(t)) - 59))}
    assert want <= {r.doc_id for r in chunk_dedup.dedup_report(sample).collect()}
    assert chunk_dedup.dedup_report(empty).count() == 0


def test_every_removed_chunk_is_reported(spark, sample, tmp_path):
    """Copies within one document and copies below 64 bytes count too; so does the query."""
    import random

    import numpy as np

    from shoplens.llm.queries import queries

    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))
    own = text(80)
    rows = [(1, own + " " + text(20) + " " + own), (2, text(120)), (3, "tiny copy"), (4, "tiny copy"), (5, text(50)), (5, "")]
    rows += [(r.doc_id + 100, r.text) for r in sample.collect()]
    seen, removed = set(), Counter()
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        data = np.frombuffer((t or "").encode(), np.uint8)
        edges = chunk_dedup.cuts(data) if len(data) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            piece = data[a:b].tobytes()
            if piece in seen:
                removed[i] += b - a
            seen.add(piece)
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path + "/documents.parquet")
    got = {r.doc_id: r.removed_bytes for r in queries()["op6_chunk_dedup"](spark, path).collect()}
    assert removed[1] > 300 and removed[4] == 9
    assert {i: n for i, n in got.items() if n} == removed


def test_languages(spark, docs, empty):
    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(full).join(full.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert out[2].lang_pred == out[3].lang_pred == out[12].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in out.values()) and out[1].lang_pred == "en"
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("false")).collect()} == set()
