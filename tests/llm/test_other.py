"""URL filter, WARC archives, classifiers, vectors and the pipeline."""

import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F

import corpus_pipeline
from glossweave.llm import bytecnn, pq, urls, warc, wordcnn
from glossweave.llm.learning import best_counted_cut, training_rows, training_sample
from glossweave.llm.rows import buffers
from glossweave.session import table

# --- URLs


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def test_urls_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    hosts, paths = ["com", "a.com", "B.a.com", "xa.com", "net", "", "a..com", "É.net"], ["", "/", "/en", "/en/", "/en/x", "/EN/", "/e?q=/en/", "//en/"]
    given = [f"{rng.choice(['http', 'x'])}://{h}{p}{e}" for h in hosts for p in paths for e in ("", "?a#b", "#c")] + [None, "", "a.com/en/", "://", "a://b://c/en/"]
    rules = [("com", "/", "allow"), ("a.com", "/en", "block"), ("b.a.com", "/en/", "allow"), ("net", "/", "block"), ("a.com", "/en", "allow"), (None, "/", "block"), ("net", "", "allow")]
    kept = [("com", "/", "allow"), ("a.com", "/en", "block"), ("b.a.com", "/en/", "allow"), ("net", "/", "block"), ("net", "", "allow")]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(given)] + [(None, given[0], "mine")], "page_id long, url string, rule string")
    want = sorted(str((i, *brute_verdict(u, kept))) for i, u in [*enumerate(given), (None, given[0])])
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    for bits in (16, 1):  # with few and with many false positives
        monkeypatch.setattr(urls, "BITS_PER_KEY", bits)
        got = urls.judge_urls(pages, listed)
        assert sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got.collect()) == want
    assert {r.verdict for r in urls.judge_urls(pages, listed.limit(0)).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), listed).count() == 0


def test_bloom_filter_has_no_false_negatives():
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3000)
    words = np.zeros((100, urls.BLOCK_WORDS), np.uint64)
    block, word, mask = urls.block_and_bits(h, 100)
    np.bitwise_or.at(words, (np.repeat(block, urls.PROBES), word.reshape(-1)), mask.reshape(-1))
    assert urls.may_hold(words, h).all()
    assert urls.may_hold(words, np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20000)).mean() < 0.02


# --- WARC

def members(payloads):
    out = []
    for i, p in enumerate(payloads):
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(squeeze.compress(warc.build_record(str(i), f"http://x/{i}", p, None, "2020-01-01T00:00:00Z")) + squeeze.flush())
    return out


def read(data):
    return list(warc.Archive(pa.BufferReader(data), len(data)).entries())


def test_salvage_after_damage():
    rng = random.Random(4)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 3000))) for _ in range(8)] + [b"WARC/1.1\r\n" * 50, b"\x1f\x8b\x08" * 90]
    parts = members(payloads)
    whole = read(b"".join(parts))
    assert [e["payload"] for e in whole] == payloads and not any(e["problem"] for e in whole)
    broken = list(parts)
    broken[2] = broken[2][:40] + bytes([broken[2][40] ^ 255]) + broken[2][41:]
    broken[5] = broken[5][:-9]
    data = b"junk" + b"".join(broken) + b"\x1f\x8b\x08tail"
    found = read(data)
    assert [int(e["page_id"]) for e in found if not e["problem"]] == [0, 1, 3, 4, 6, 7, 8, 9]
    assert all(e["payload"] == payloads[int(e["page_id"])] for e in found if not e["problem"])
    at = 0
    for e in found:  # records and gaps cover the archive
        assert e["offset"] == at
        at += e["length"]
    assert at == len(data)
    plain = [warc.build_record(str(i), None, p, None, "2020-01-01T00:00:00Z") for i, p in enumerate(payloads)]
    plain[1] = plain[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    plain[3] = plain[3][:-30]
    good = [int(e["page_id"]) for e in read(b"".join(plain)) if not e["problem"]]
    assert [i for i in good if i not in (1, 3)] == [0, 2, 4, 5, 6, 7, 8, 9]
    long = warc.build_record("0", None, b"x" * 1_000_000, None, "2020-01-01T00:00:00Z")
    assert [e["payload_bytes"] for e in read(long + plain[0])] == [1_000_000, len(payloads[0])]
    assert read(b"") == []


def test_round_trip_of_odd_pages(spark):
    rows = [(3, "http://a/\r\nx", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (None, "u", "same"), (None, "u", "own"), (7, "u", "é" * 200000), (1, "u", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(spark, pages).collect()
    want = {("3", 4, "revisit", "1"), ("1", 4, "response", None), ("2", 0, "response", None), ("5", 0, "revisit", "2"), (None, 4, "revisit", "1"), (None, 3, "response", None), ("7", 400000, "response", None)}
    assert {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got} == want and len(got) == len(rows)
    assert all(r.problem is None and len(r.payload_digest) == 32 for r in got)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


# --- classifiers

def numeric(f, x, g, picks, eps=1e-3):
    for at in picks:
        old = x[at]
        x[at] = old + eps
        up = f()
        x[at] = old - eps
        down = f()
        x[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 2e-2 * max(1.0, abs(g[at])) + 2e-3


def test_byte_network_gradients_and_coverage():
    rng = np.random.default_rng(3)
    p = {
        "vectors": rng.normal(0, 0.5, (257, bytecnn.VECTOR)), "filters": rng.normal(0, 0.3, (bytecnn.WIDTH * bytecnn.VECTOR, bytecnn.FILTERS)), "bias": rng.normal(0, 0.1, bytecnn.FILTERS),
        "w1": rng.normal(0, 0.3, (bytecnn.FILTERS, bytecnn.HIDDEN)), "b1": rng.normal(0, 0.1, bytecnn.HIDDEN), "w2": rng.normal(0, 0.3, 2 * bytecnn.HIDDEN), "b2": np.zeros(1)}
    texts = [rng.integers(32, 120, n).astype(np.uint8) for n in (5, 300, 129)]
    y, w = np.array([1.0, 0.0, 1.0]), np.ones(3)

    def loss():
        s = bytecnn.sigmoid(bytecnn.logits(p, *bytecnn.joined(texts)))
        return float(-(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean())

    g = bytecnn.gradients(p, texts, y, w)
    for name in p:
        numeric(loss, p[name], g[name], [tuple(rng.integers(0, n) for n in p[name].shape) for _ in range(6)], 1e-4)
    # a byte anywhere in the text can matter: every byte lies in a window
    seen = np.zeros(1000, bool)
    start, first = bytecnn.chunks(np.zeros(1000, np.uint8), np.array([0, 1000]))
    for s in start:
        seen[s:s + bytecnn.SPAN] = True
    assert seen.all() and first[-1] == len(start)


def test_word_network_finds_rare_words_in_any_language():
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in ("th", "er", "on", "ß") for b in ("an", "ie", "ou") for c in ("", "s", "ing", "ent")]
    sample = []
    for i in range(400):
        t = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        if i % 2:
            t[rng.randrange(len(t))] = rng.choice(["Idiot", "loweient", "LOWEIS"])
        sample.append((" ".join(t), i % 2, "en" if i % 3 else "de"))
    model = wordcnn.fit(sample, steps=150, threshold=0.7, least=10)
    fresh = [" ".join(rng.choice(words) for _ in range(3000)) for _ in range(40)]
    bad = [t + " you IDIOT!" for t in fresh]
    s = wordcnn.sigmoid(wordcnn.logits(model, model.tables(), *buffers(pa.array(fresh + bad + ["", None]))) + model.shift)
    assert (s[:40] < 0.7).mean() > 0.95 and (s[40:80] >= 0.7).mean() > 0.95
    assert s[80] == s[81]
    assert set(model.thresholds) == {"en", "de"}


@pytest.mark.parametrize("module", [bytecnn, wordcnn])
def test_scores_of_odd_rows(spark, module):
    rows = [(1, "good text here", "en", 5.0), (1, "good text here", "en", 5.0), (None, None, None, None), (3, "", "de", None), (4, "x" * 300000, "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").coalesce(1)
    sample = [("good text " * 5, 1, "en"), ("!!! ###" * 9, 0, "en")] * 30
    model = module.fit(sample, steps=20)
    got = module.score(docs, model, keep=("doc_id", "lang", "score")).collect()
    assert [r.doc_id for r in got] == [1, 1, None, 3, 4] and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score and got[2].score == got[3].score
    assert module.score(docs.limit(0), model).count() == 0
    none = module.fit([])
    assert {r.score for r in module.score(docs, none).collect()} == {0.5}


def test_training_sample_takes_labels_that_have_documents(spark):
    labels = spark.range(6000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    rows = [(i, "z" * 70_000 if i % 100 == 0 else f"text {i}") for i in range(0, 6000, 50)] + [(i, f"text {i}") for i in range(1, 6000, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = training_sample(docs, labels, "toxic", F.lit(True), rows=40)
    assert sorted(y for _, y in got) == [0] * 20 + [1] * 20 and all(len(t) < 70_000 for t, _ in got)
    with pytest.warns(UserWarning, match="toxic = 0"):
        assert {y for _, y in training_sample(docs.filter("doc_id % 2 = 1"), labels, "toxic", F.lit(True), rows=40)} == {1}


@pytest.mark.parametrize("module,fitted", [(bytecnn, "fit_quality"), (wordcnn, "fit_toxicity")])
def test_every_labelled_text_is_learned_from(spark, module, fitted, monkeypatch):
    """A mark that no text of the start bears, behind more characters than the start reads."""
    monkeypatch.setattr("glossweave.llm.learning.SHARD_ROWS", 600)
    rng = random.Random(4)
    words = ["ban", "tie", "sou", "lent", "mure", "pol", "ans", "ted"]
    rows = []
    for i in range(1200):
        t = [rng.choice(words) for _ in range(rng.randint(10, 30))]
        if i % 2:
            t[rng.randrange(len(t))] = "QQQQ"
        rows.append((i, " ".join(t), "en", i % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, y int")
    bare = docs.withColumn("text", F.replace("text", F.lit("QQQQ"), F.lit("JJJJ"))).withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy(F.xxhash64("doc_id"))))
    mixed = bare.withColumn("text", F.when(F.col("n") > 40, F.replace("text", F.lit("JJJJ"), F.lit("QQQQ"))).otherwise(F.col("text"))).drop("n")
    labels = docs.select("doc_id", F.col("y").alias("quality"), F.col("y").alias("toxic"))
    fresh = docs.filter("doc_id < 200")
    model = getattr(module, fitted)(mixed, labels, F.lit(True), rows=40, rounds=12)
    got = module.score(fresh, model, keep=("doc_id", "y")).collect()
    assert np.mean([r.predicted == r.y for r in got]) > 0.9
    again = getattr(module, fitted)(mixed.repartition(7), labels, F.lit(True), rows=40, rounds=12)
    assert sorted(module.score(fresh, again, keep=("doc_id",)).collect()) == sorted(module.score(fresh, model, keep=("doc_id",)).collect())
    every = training_rows(docs.withColumn("text", F.repeat("text", 2000)), labels, "toxic", F.col("doc_id") < 50)
    assert every.count() == 50 and every.agg(F.max(F.length("text"))).first()[0] > 1 << 16


def test_cut_of_counted_rows_is_that_of_rows(spark):
    rng = np.random.default_rng(3)
    z = np.round(rng.normal(0, 3, 400), 3)
    y = (z + rng.normal(0, 2, 400) > 1).astype(int)
    values, back = np.unique(z, return_inverse=True)
    counted = best_counted_cut(values, values, np.bincount(back, y == 0), np.bincount(back, y == 1), (3.0, 1.0))
    errors = lambda cut: 3 * (z[y == 0] >= cut).mean() + (z[y == 1] < cut).mean()
    assert errors(counted) <= min(errors(c) for c in np.linspace(-9, 9, 2001)) + 1e-9


def test_quality_on_held_out_rows(spark):
    """Labels that the fit has not seen, at sf0.01."""
    root = "/root/testdata/sf0.01"
    from glossweave.llm.queries import QUERIES

    got = QUERIES["op9_quality"](spark, root).join(table(spark, root, "labels"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.85
    assert got[got.quality == 1].predicted.mean() > 0.9


# --- vectors

def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pq, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(20, 24))
    rows = []
    for i in range(160):
        v = base[i % 20] + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.3])
        rows.append((500 - i, [float(x) for x in (v * rng.choice([1, 1, 7])).astype(np.float32)], int(i % 3)))
    nan, inf = float("nan"), float("inf")
    rows += [(1, None, 0), (2, [0.0] * 24, 0), (3, [nan] + [1.0] * 23, 0), (4, [inf] + [1.0] * 23, 0), (5, [None] + [1.0] * 23, 0), (6, rows[0][1], None), (7, [], 0), (8, [1.0, 2.0], 0), (9, [2.0, 4.0], 0), (None, rows[0][1], rows[0][2]), (10, rows[0][1], rows[0][2])]
    usable = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    for i in usable:
        for j in usable:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1]), np.array(rows[j][1])
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links[i].add(j)
    want = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        want.append(str((rows[k][0], len(links[k]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None))))
    got = pq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got) == sorted(want)
    assert pq.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("dimensions", [4, 8])
def test_vectors_of_low_intrinsic_dimension_lose_no_link(spark, monkeypatch, dimensions):
    """All vectors lie in a subspace, where a link's difference has no random direction; every link counts for both ends."""
    monkeypatch.setattr(pq, "BLOCK", 128)
    rng = np.random.default_rng(dimensions)
    v = (rng.normal(size=(1200, dimensions)) @ rng.normal(size=(dimensions, 64))).astype(np.float32)
    x = v.astype(np.float64)
    x /= np.sqrt((x * x).sum(1))[:, None]
    want = ((x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)).sum(1).tolist()
    got = pq.near_vectors(spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int")).collect()
    assert [r.n_links for r in sorted(got)] == want


# --- pipeline

def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "decontamination", "mixing"]


def test_pipeline_stages_against_brute_force(spark, data, tmp_path):
    from test_texts import brute_groups, brute_hits

    docs = table(spark, data, "documents")
    names = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in table(spark, data, "benchmark").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = os.path.join(tmp_path, str(i))
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before) and docs.count() == len(after)
        if name != "mixing":
            assert docs.columns == names and all(tuple(after[k]) == tuple(before[k]) for k in after)
        if name == "near_dedup":
            assert set(after) == {int(k) for k, _, c in brute_groups([(k, r.text) for k, r in before.items()], 5, 80) if k == c}
        if name == "decontamination":
            hits = {k: brute_hits(r.text, items) for k, r in before.items()}
            assert set(after) == {k for k, (n, h, _) in hits.items() if not (h and 20 * h >= n)}
        before = after
    assert all(r.repeats in (1, 2, 3) and r.taken == r.repeats * r["size"] for r in before.values())


def test_toxicity_stage_cuts_by_language(spark, data, monkeypatch):
    monkeypatch.setattr(wordcnn, "fit_toxicity", lambda *a, **k: wordcnn.Model(None, 0.0, 0.75, {"de": 0.8, "fr": 0.72}, 0.7))
    rows = [(1, "a", "de"), (2, "a", "fr"), (3, "a", "en"), (4, "a", None)]
    got = corpus_pipeline.toxicity_filter(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), data)
    assert [tuple(r) for r in got.collect()] == [rows[0]]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, data, name, stage):
    rows = [(1, None, None, None, None, 1.0, 2), (2, "", "en", "a", 0, None, None), (None, "some words of text", "en", None, 3, 1.0, 1), (4, "z " * 30000, "de", "a", 1, 0.0, 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long")
    got = stage(spark, docs, data)
    assert got.columns[:7] == docs.columns
    assert {str(tuple(r)[:7]) for r in got.collect()} <= {str(r) for r in rows}
    assert stage(spark, docs.limit(0), data).count() == 0
