"""Learned operators and archives: held-out accuracy, round trips, brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from shoplens.llm import decontam, secret_scan, toxicity, warc
from shoplens.llm.queries import oracle_sql, queries
from shoplens.llm.textops import batch_words, word_hashes

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def full(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_folding():
    assert toxicity.fold("You L0SER, раthetic tr4sh!") == " you loser pathetic trash "
    assert toxicity.fold("") == "  "


def test_lexicon_takes_exceptions_out():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " lose": 2.0}, (toxicity.fold("trash can"),), (-1.0, 1.0, 0.0))
    assert list(lexicon.hits(" you trash ").values()) == [3.0]
    assert not lexicon.hits(" a trash can here ")
    assert lexicon.score(" you trash loser ") > lexicon.score(" you trash ") > lexicon.score(" you ")


def test_toxicity_held_out(spark, full, docs, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity(full, labels).join(labels, "doc_id").where("held_out").collect()
    good = sum(r.predicted == r.toxic for r in got)
    assert good >= 0.9 * len(got)
    out = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(out) == docs.count() and all(r.score == 0 and r.predicted == 0 for r in out)
    assert toxicity.toxicity(empty, labels).count() == 0


def test_lcs_weight():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.integers(0, 6, 12).astype(np.uint64), rng.integers(0, 6, 20).astype(np.uint64)
        w = rng.random(12)
        table = np.zeros((13, 21))
        for i in range(12):
            for j in range(20):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + w[i] if a[i] == b[j] else 0)
        assert decontam.lcs_weight(a, w, b) == pytest.approx(table[-1, -1])


def test_leaks_hold_every_planted_item(spark, full, docs, empty):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    flat = lambda t: " " + " ".join(re.findall(r"[^\x20\x09-\x0D]+", t.lower())) + " "
    items = {r.item_id: flat(r.text) for r in benchmark.collect()}
    texts = {r.doc_id: flat(r.text) for r in full.collect()}
    planted = {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(full, benchmark).collect()}
    assert planted <= found and len(found - planted) <= 0.1 * len(planted) + 1
    nothing = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    assert decontam.leaks(docs, nothing).count() == 0
    assert decontam.decontaminate(docs, nothing).count() == docs.count()
    assert decontam.leaks(empty, benchmark).count() == 0
    assert decontam.leaks(docs, benchmark.limit(0)).count() == 0
    assert decontam.decontaminate(docs, benchmark).schema == docs.schema


def test_short_items_are_found(spark, docs):
    item = spark.createDataFrame([(None, "looked at the dog of the house for it was late")], "item_id long, text string")
    hits = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, item).collect()}
    assert hits == {(1, None), (4, None), (None, None)}


def _planted(spark, full, monkeypatch, edit, lengths):
    """Documents outside the fitted sample with items of some lengths, edited; pairs that were planted."""
    monkeypatch.setattr(decontam, "SAMPLE_DOCS", 50)
    monkeypatch.setattr(decontam, "FIT_ITEMS", 10)
    rng, items, rows, pairs = random.Random(2), [], [], set()
    inside = {r.doc_id for r in full.selectExpr("doc_id", "xxhash64(doc_id) as h").distinct().orderBy("h", "doc_id").limit(50).collect()}
    hosts = [r for r in full.orderBy("doc_id").collect() if r.text and r.doc_id not in inside]
    vocabulary = sorted({w for r in hosts[:300] for w in words(r.text)})
    for n in lengths:
        for _ in range(20):
            item = rng.choices(vocabulary, k=n)
            items.append((len(items), " ".join(item)))
            host = hosts[len(rows)]
            own = words(host.text)
            at = rng.randrange(len(own) + 1)
            rows.append((10**6 + len(rows), " ".join(own[:at] + edit(rng, item, vocabulary) + own[at:])))
            pairs.add((rows[-1][0], items[-1][0]))
    docs = full.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    return docs, spark.createDataFrame(items, "item_id long, text string"), pairs


def test_copies_of_any_length_are_found(spark, full, monkeypatch):
    docs, items, pairs = _planted(spark, full, monkeypatch, lambda rng, item, vocabulary: item, (4, 6, 8, 10, 12, 15, 20, 40, 80))
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    assert pairs <= found


def test_paraphrases_against_brute_force_lcs(spark, full, monkeypatch):
    """Every pair of a document and an item whose common subsequence in a window makes it a leak, and no other."""
    def edit(rng, item, vocabulary):
        out = []
        for w in item:
            roll = rng.random()
            out += [] if roll < 0.08 else [rng.choice(vocabulary)] if roll < 0.2 else [w, rng.choice(vocabulary)] if roll < 0.4 else [w]
        return out

    docs, items, pairs = _planted(spark, full, monkeypatch, edit, (8, 10, 12, 24, 48))
    rows = [(r.doc_id, [w.lower() for w in words(r.text)]) for r in docs.collect()]
    wanted = {r.item_id: [w.lower() for w in words(r.text)] for r in items.collect()}
    df = Counter(w for _, t in rows for w in set(t))
    idf = lambda w: np.log((len(rows) + 1) / (df[w] + 1)) + 0.01
    sure, possible = set(), set()
    for i, item in wanted.items():
        weights = np.array([idf(w) for w in item])
        total, width = weights.sum(), len(item) + len(item) // 2
        top = [item[j] for j in np.argsort(-weights, kind="stable")[:5]]
        for d, t in rows:
            common = np.array([w in set(t) for w in item]) if len(set(item) & set(t)) > 1 else np.zeros(len(item), bool)
            if weights[common].sum() < 0.6 * total:
                continue
            if decontam.lcs_weight(np.array(item), weights, np.array(t)) >= 0.6 * total:
                possible.add((d, i))
            for s in range(0, max(1, len(t) - width + 1)):
                part = t[s : s + width]
                if weights[[w in part for w in item]].sum() < 0.6 * total:
                    continue
                share = decontam.lcs_weight(np.array(item), weights, np.array(part)) / total
                answer = sum(idf(w) for w in top if w in part) >= 0.9 * sum(map(idf, top))
                if share >= 0.8 + 1e-4 or (share >= 0.6 + 1e-4 and answer):
                    sure.add((d, i))
                    break
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()}
    assert len(sure & pairs) >= 40
    assert len(found & sure) >= 0.97 * len(sure) and found <= possible


def test_blocks_of_items_and_very_long_texts(spark, full, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 3)
    text = " ".join(f"q{i * 7919 % 100_003}" for i in range(300_000))
    docs = spark.createDataFrame([(1, text), (2, "nothing of it"), (3, None), (3, text)], "doc_id long, text string")
    items = [(i, " ".join(text.split()[i * 30_000 : i * 30_000 + 12])) for i in range(8)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = Counter((r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark).collect())
    assert found == Counter((d, i) for d in (1, 3) for i in range(8))
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, benchmark).collect()) == [2, 3]


def test_paraphrase_needs_the_answer(spark, full):
    item = "when did the ancient harbour of zarquon fall silent after the long winter storms of quelmar and vethis"
    other = item.replace("ancient ", "old ").replace("long ", "hard cold ").replace("fall", "go")
    rows = [(10**6, "some words before it " + other + " and some words after it"), (10**6 + 1, item[:40] + " and so on and on")]
    docs = full.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    benchmark = spark.createDataFrame([(7, item, "quelmar vethis")], "item_id long, text string, answer string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, benchmark).collect()} == {(10**6, 7)}


def test_archives_round_trip(spark, empty):
    long, other = "x" * 100, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb" * 9
    rows = [(5, "u", long), (2, "v\r\nX: y", long), (9, None, "x" * 99), (3, "", "x" * 99), (None, "n", long), (4, "w", None),
            (6, "w", other), (6, "w", other), (7, "é", "é" * 60), (8, "z", "é" * 60), (1, "t", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as record_id")
    got = Counter(tuple(r) for r in warc.archive_pages(pages).drop("url").collect())
    first = {long: 2, other: 6, "é" * 60: 7}
    want, used = Counter(), set()
    for page, _, html in rows:
        html = html or ""
        b = html.encode()
        back = len(b) >= 100 and (first[html] != page or (html, page) in used)
        used.add((html, page))
        want[(page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if back else "response", first[html] if back else None)] += 1
    assert got == want
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_secrets(spark, full, docs, empty):
    scanner = secret_scan.scanner(full)
    found = {(r.doc_id, r.start) for r in secret_scan.scan(full, scanner).collect()}
    shape = re.compile(rb'(?:token = "|password=)([0-9a-f]{16,})|(?<![A-Za-z0-9+/_\-])(AKIA[0-9A-Z]{16})(?![A-Za-z0-9+/_\-])')
    texts = {r.doc_id: r.text.encode() for r in full.collect()}
    planted = {(i, m.start(1) if m[1] else m.start(2)) for i, t in texts.items() for m in shape.finditer(t)}
    assert planted and planted <= found and len(found - planted) <= 0.2 * len(planted)
    clean = secret_scan.redact(full, scanner)
    assert clean.schema == full.schema and clean.count() == full.count()
    assert not any(shape.search(r.text.encode()) for r in clean.collect())
    same = secret_scan.redact(docs, scanner)
    assert same.schema == docs.schema and same.where("doc_id = 1").first().text == docs.where("doc_id = 1").first().text
    assert secret_scan.scan(empty).count() == 0
    assert secret_scan.scan(docs).count() == 0


def test_every_settled_finding_can_teach(spark, full):
    """Below the bound all different findings of both labels are training rows, on the smallest table too."""
    for df in (full, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")):
        want = set()
        for r in df.collect():
            want |= {(secret_scan.known_label(v, b), v) for _, v, b, _ in secret_scan.candidates((r.text or "").encode())}
        want = Counter(k for k, _ in want if k is not None)
        assert 0 < want[0] < secret_scan.SAMPLE and want[1] < secret_scan.SAMPLE
        assert Counter(r.label for r in secret_scan.labelled_findings(df).collect()) == want


@pytest.fixture(scope="module", params=["sf0.01", "sf0.1"])
def taught(request, spark):
    return secret_scan.scanner(spark.read.parquet(f"/root/testdata/{request.param}/documents.parquet"))


def test_bare_and_assigned_values_are_found_at_the_threshold(spark, taught):
    """At least 0.9 of random bare tokens of 20 to 40 characters and of assigned values of any length, few plain words and numbers."""
    rng = np.random.default_rng(8)
    prose = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").orderBy("doc_id").limit(100).collect()
    letters = [b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"]
    made = lambda n, kind: bytes(rng.choice(list(letters[kind]), n).astype(np.uint8))
    wrapped = lambda i, body: prose[i % 100].text[:150].encode().rsplit(b" ", 1)[0] + b" " + body + b" " + prose[i % 100].text[150:300].encode().split(b" ", 1)[-1]
    judge = lambda i, value, body: any(v == value and p >= secret_scan.THRESHOLD for _, v, p in taught.scan(wrapped(i, body), prose[i % 100].source))
    for kind in (0, 1):
        for size in (20, 24, 32, 40):
            tokens = [made(size, kind) for _ in range(50)]
            assert np.mean([judge(i, t, t) for i, t in enumerate(tokens)]) >= 0.9, (kind, size)
    values = [b"hunter2x", b"Tr0ub4dor&3", b"p.4ss!w@rd$9", b"q1", b"7", b"abc123!" * 4 + b"x", "é9ü8ß7".encode(), *[made(n, n % 2) + b"5" for n in range(4, 30)]]
    texts = [b'password = "%s"', b"pwd: %s ,", b"api_key='%s'", b"token=%s x", b"auth:=%s"]
    got = [judge(i, v, t % v) for i, v in enumerate(values) for t in texts]
    assert np.mean(got) >= 0.9, [(v, t) for (v, t), g in zip([(v, t) for v in values for t in texts], got) if not g]
    plain = [b"internationalization", b"4000123412341234", b"uncharacteristically", b"12345678901234567890", b"Bundesverfassungsgericht"]
    assert np.mean([judge(i, v, v) for i, v in enumerate(plain * 4)]) <= 0.1
    assert not judge(0, b"recipes", b"the secret: recipes of")


def test_short_and_broken_assigned_values_are_candidates(spark, full):
    values = ["hunter2x", "Tr0ub4dor&3", "p.4ss!w@rd$9", "q1", "7", "abc123!" * 4 + "x", "é9ü8ß7"]
    texts = [t.format(v) for v in values for t in ('password = "{}" and', "see pwd: {}, and", "api_key='{}'", "token={} x", "auth:={}")]
    for t in texts:
        found = [v.decode() for _, v, _, _ in secret_scan.candidates(t.encode())]
        assert any(found == [v] for v in values) and found[0] in t
    both = list(secret_scan.candidates(b"secret=" + b"a1" * 10 + b"." + b"b2" * 10 + b" then " + b"c3" * 10))
    assert [v for _, v, _, _ in both] == [b"a1" * 10 + b"." + b"b2" * 10, b"c3" * 10]
    assert not list(secret_scan.candidates(b"no secret here, token count or password of 8"))
    rows = spark.createDataFrame([(i, t, None, "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    prose = secret_scan.learn_prose(rows)
    known = secret_scan.redact(rows, secret_scan.Scanner(None, prose)).collect()
    assert all("[SECRET]" in r.text and not any(v in r.text.split("[SECRET]") for v in values) for r in known)
    judged = secret_scan.scan(rows, secret_scan.scanner(full)).collect()
    assert len(judged) >= 0.9 * len(texts)


def test_forest_arrays_score_like_the_model(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    x = rng.random((300, 4))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0.7).astype(int)
    rows = spark.createDataFrame([(int(b), a.tolist()) for a, b in zip(x, y)], "label int, features array<double>")
    assert (secret_scan.train(rows).scores(x) > 0.5).astype(int).tolist() == y.tolist() or np.mean((secret_scan.train(rows).scores(x) > 0.5) == y) > 0.95
    vectors = rows.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
    model = RandomForestClassifier(numTrees=5, maxDepth=secret_scan.DEPTH, seed=5).fit(vectors)
    ours = secret_scan.Forest([secret_scan._flatten(t._call_java("rootNode")) for t in model.trees]).scores(x)
    theirs = [r.probability[1] for r in model.transform(vectors).collect()]
    assert np.allclose(ours, theirs)


def test_queries_are_registered():
    assert [int(q[2:].split("_")[0]) for q in queries()] == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


def test_archives_keep_payloads_that_hold_marks(spark, tmp_path):
    """Line breaks at every edge, marks and heads inside, files of one record and of many; column names of the result in the input."""
    edges = ["", "\r", "\n", "\r\n", "\r\n\r", "\r\n\r\n", "\r\n\r\n\r\n", "\n\r\n\r\n", "\r\r\n\r\n"]
    inner = ["", "é" * 60, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "a\r\n\r\nb" * 40, "x" * 3_000_000]
    bodies = [a + b + c for a in edges for b in inner for c in edges]
    bodies = list(dict.fromkeys(bodies[:-81])) + ["x" * 3_000_000 + "\r\n", "\r\n" + "x" * 3_000_000, "x" * 3_000_000 + "\r\n"]
    rows = [(i, f"u{i}", b, "none", -1, "r") for i, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, refers_to long, payload string")
    for parts in (1, 7, 400):
        got = {r.page_id: r for r in warc.archive_pages(pages.repartition(parts)).collect()}
        first = {}
        for i, b in enumerate(bodies):
            data = b.encode()
            whole = first.setdefault(data, i) if len(data) >= 100 else i
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
            assert (got[i].record_type, got[i].refers_to) == (("response", None) if whole == i else ("revisit", whole))
        assert len(got) == len(bodies)
    pieces = [b"WARC/1.1\r\nContent-Length: 9", b"abc"]
    with pytest.raises(ValueError, match="ends within"):
        list(warc.parse(pieces))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parse([b"abc"]))


def test_the_latent_space_is_fitted_on_every_text(spark, monkeypatch):
    """The sums of all texts' passages, repeated rows and rows without an id among them, against dense matrices."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in [*range(1, 90, 3), 700, 31, 32, 33, 40]]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(1, texts[1]), (900, None), (901, ""), (902, " \t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(i, f"item{i} of the benchmark w{i}") for i in range(30)] + [(99, None)], "item_id long, text string")
    monkeypatch.setattr(decontam, "RUN", 5)
    used = decontam._fit_texts(docs, items)
    found = [r.text for r in used.collect()]
    assert Counter(found) == Counter([t for _, t in rows if t is not None] + [f"item{i} of the benchmark w{i}" for i in range(30)])
    idf = np.random.default_rng(1).random(decontam.DIM) + 0.5
    passages = []
    for text in found:
        terms = decontam._terms(decontam.word_hashes(np.frombuffer(text.encode(), np.uint8)))
        for s in decontam.passage_starts(len(terms)):
            row = np.bincount(terms[s : s + decontam.PASSAGE], minlength=decontam.DIM) * idf
            weight = (idf[terms[s : s + decontam.PASSAGE]] ** 2).sum()
            passages.append((row, weight))
    a, mass = np.array([p for p, _ in passages]), np.array([m for _, m in passages])
    gram = lambda x: a.T @ ((a @ x) / mass[:, None])
    q, _ = np.linalg.qr(gram(np.random.Generator(np.random.PCG64(3)).standard_normal((decontam.DIM, decontam.RANK + 8))))
    values, turn = np.linalg.eigh(q.T @ gram(q))
    order = np.argsort(-values)[: decontam.RANK]
    want = q @ turn[:, order] / np.sqrt(np.maximum(values[order], 1e-9))
    got = decontam._latent(used, idf)
    # The same space: what the basis projects on, whatever the signs.
    assert np.allclose(got @ (got.T @ a[:20].T), want @ (want.T @ a[:20].T), atol=1e-2 * np.abs(want @ (want.T @ a[:20].T)).max())


def test_sums_of_groups_of_any_size(monkeypatch):
    """Groups below and far beyond what is summed at once, against plain sums."""
    rng = np.random.default_rng(4)
    rows = rng.standard_normal((50, 3)).astype(np.float32)
    monkeypatch.setattr(decontam, "GROUPS", 4)
    for most in (2, 5, 64):
        monkeypatch.setattr(decontam, "GROUP", most)
        for sizes in ([1], [1, 1, 1], [7, 1, 64, 2, 3, 1, 200, 5, 65, 9], [4096, 1, 4097]):
            at = rng.integers(0, 50, sum(sizes))
            want = [rows[part].sum(axis=0, dtype=np.float64) for part in np.split(at, np.cumsum(sizes)[:-1])]
            assert np.allclose(decontam._sums(rows, at, np.array(sizes)), want, atol=1e-3)
    first = np.cumsum([0, 0, 1, 31, 32, 33, 40, 0, 41, 700, 0])
    spans = [(a + s, min(a + s + decontam.PASSAGE, b)) for a, b in zip(first[:-1], first[1:]) for s in decontam.passage_starts(int(b - a))]
    starts, ends = decontam._passages(first)
    assert list(zip(starts.tolist(), ends.tolist())) == spans


def test_the_fit_takes_little_more_time_than_the_words_themselves():
    """A step over all passages costs a bounded multiple of hashing the words (18 times before, about 5 now)."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(20_000)]
    texts = [" ".join(vocabulary[int(20_000 * rng.random() ** 4)] for _ in range(500)) for _ in range(150)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0] + [len(t) for t in texts])
    x = np.random.default_rng(1).standard_normal((decontam.DIM, decontam.RANK + 8)).astype(np.float32)
    total, weights = np.zeros(x.shape), np.ones(decontam.DIM, np.float32)

    def seconds(run):
        took = []
        for _ in range(5):
            begin = time.process_time()
            run()
            took.append(time.process_time() - begin)
        return min(took)

    def step():
        terms = decontam._terms(words)
        starts, ends = decontam._passages(first)
        for i in range(0, len(starts), decontam.RUN):
            s, e = starts[i : i + decontam.RUN], ends[i : i + decontam.RUN]
            decontam._add_gram(total, terms[s[0] : e[-1]], weights[terms[s[0] : e[-1]]], s - s[0], e - s[0], x)

    words, first = batch_words(data, at)
    assert seconds(step) < 10 * seconds(lambda: batch_words(data, at))


def test_words_of_a_batch_are_those_of_its_texts():
    """Every byte value, texts without words and empty ones, against the texts taken one by one."""
    rng = np.random.default_rng(7)
    data = np.concatenate([np.arange(256), rng.integers(0, 256, 3000), rng.integers(0, 48, 3000)]).astype(np.uint8)
    at = np.sort(np.concatenate([[0, 0, len(data), len(data)], rng.integers(0, len(data), 200)]))
    found, first = batch_words(data, at)
    for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
        assert np.array_equal(found[first[i] : first[i + 1]], word_hashes(data[a:b]))
