"""Classifier scores and the stages that use them against plain versions; columns whose names clash."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossweave.llm import bytecnn, mixing, urls, wordcnn
from glossweave.llm.learning import id_remainder
from glossweave.llm.rows import buffers
from glossweave.session import table


def probability(z):
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def dense(x, w, b):
    return [sum(float(a) * float(w[i][j]) for i, a in enumerate(x)) + float(b[j]) for j in range(len(b))]


def plain_quality(model, text):
    """One document: its chunks and windows by loops."""
    q, raw = bytecnn.whole_numbers(model.params), list((text or "").encode())
    sums, most = [0.0] * bytecnn.HIDDEN, [-math.inf] * bytecnn.HIDDEN
    starts = range(0, max(len(raw), 1), bytecnn.CHUNK)
    for start in starts:
        best = np.full(bytecnn.FILTERS, -np.inf)
        for at in range(start, start + bytecnn.CHUNK, bytecnn.STRIDE):
            v = np.concatenate([q["vectors"][raw[i] if i < len(raw) else bytecnn.PAD] for i in range(at, at + bytecnn.WIDTH)]).astype(np.float64)
            best = np.maximum(best, v @ q["filters"].astype(np.float64))
        top = [max(0.0, b / q["scale"] + float(model.params["bias"][j])) for j, b in enumerate(best)]
        hidden = [max(0.0, h) for h in dense(top, model.params["w1"], model.params["b1"])]
        sums, most = [a + h for a, h in zip(sums, hidden)], [max(a, h) for a, h in zip(most, hidden)]
    z = dense([s / len(starts) for s in sums] + most, model.params["w2"].reshape(-1, 1), model.params["b2"])[0]
    return probability(z + model.shift)


def plain_toxicity(model, tables, text):
    """One document: its words and filters by loops."""
    hashes, _ = wordcnn.words(*buffers(pa.array([text or ""])))
    n, best = hashes.shape[1], np.full(len(wordcnn.WIDTHS) * wordcnn.FILTERS, -np.inf)
    ids = [[int(hashes[h // 2][i] >> np.uint64(20 * (h % 2))) & (wordcnn.BUCKETS - 1) for h in range(wordcnn.HASHES)] for i in range(n)] + [[wordcnn.BUCKETS] * wordcnn.HASHES] * wordcnn.REACH
    for at in range(n + wordcnn.REACH):
        own = []
        for w in wordcnn.WIDTHS:
            answer = np.zeros(wordcnn.FILTERS)
            for j in range(w if at < n else 0):
                part = wordcnn.PARTS.index((w, j))
                for h in range(wordcnn.HASHES):
                    answer = answer + (tables[h][ids[at + j][h]][part * wordcnn.FILTERS:(part + 1) * wordcnn.FILTERS] if at + j < len(ids) else 0)
            own.append(answer)
        best = np.maximum(best, np.concatenate(own) + model.params["bias"])
    hidden = [max(0.0, h) for h in dense([max(0.0, b) for b in best], model.params["w1"], model.params["b1"])]
    return probability(dense(hidden, model.params["w2"].reshape(-1, 1), model.params["b2"])[0] + model.shift)


def test_quality_stage_equals_plain_scores(spark, data):
    docs = table(spark, data, "documents")
    model = bytecnn.fit_quality(docs, table(spark, data, "labels"), id_remainder(F.col("doc_id"), 5) != 0, threshold=0.3)
    rows = docs.filter("length(text) < 3000").collect()
    scores = {r.doc_id: plain_quality(model, r.text) for r in rows}
    got = {r.doc_id: r.score for r in bytecnn.score(docs, model).collect()}
    assert all(abs(got[k] - s) < 1e-9 for k, s in scores.items())
    kept = {r.doc_id for r in corpus_pipeline.quality_filter(spark, docs, data).collect()}
    assert {k for k in scores if k in kept} == {k for k, s in scores.items() if s >= 0.3}


def test_toxicity_stage_equals_plain_scores(spark, data):
    docs = table(spark, data, "documents")
    model = wordcnn.fit_toxicity(docs, table(spark, data, "labels"), id_remainder(F.col("doc_id"), 3) != 1, threshold=0.7)
    tables = model.tables()
    rows = docs.filter("length(text) < 3000").collect()
    scores = {r.doc_id: plain_toxicity(model, tables, r.text) for r in rows}
    got = {r.doc_id: r.score for r in wordcnn.score(docs, model).collect()}
    assert all(abs(got[k] - s) < 1e-5 for k, s in scores.items())
    kept = {r.doc_id for r in corpus_pipeline.toxicity_filter(spark, docs, data).collect()}
    cut = {r.doc_id: model.thresholds.get(r.lang, 0.7) for r in rows}
    assert {k for k in scores if k in kept} == {k for k, s in scores.items() if s < cut[k]}


def test_mixing_stage_equals_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet' WHERE doc_id % 3 > 0")
    want = {r[0]: r[1:] for r in con.execute(mixing.SQL).fetchall()}
    got = corpus_pipeline.mixture(spark, table(spark, data, "documents").filter("doc_id % 3 > 0"), data).collect()
    assert {r.doc_id: (r["size"], r.source_size, r.taken) for r in got if r.taken} == {k: (v[0], v[1], v[3]) for k, v in want.items() if v[3]}
    assert all(abs(r.target - want[r.doc_id][2]) < 1e-6 for r in got)


@pytest.mark.parametrize("module", [bytecnn, wordcnn])
def test_scores_do_not_depend_on_the_batch(module, spark, data):
    texts = [r.text for r in table(spark, data, "documents").collect()] + ["", None, "a", "x" * 5000]
    labels = [(t or "", i % 2, "en") for i, t in enumerate(texts[:120])]
    model = module.fit(labels, steps=30)
    if module is bytecnn:
        q = bytecnn.whole_numbers(model.params)
        run = lambda some: bytecnn.steady_logits(q, *buffers(pa.array(some, pa.string()))).tolist()
    else:
        tables = model.tables()
        run = lambda some: wordcnn.logits(model, tables, *buffers(pa.array(some, pa.string()))).tolist()
    together = run(texts)
    assert run(texts[::-1])[::-1] == together
    assert [run([t])[0] for t in texts] == together
    assert run(texts[:7]) + run(texts[7:]) == together


def test_mix_keeps_columns_with_clashing_names(spark, data):
    docs = table(spark, data, "documents")
    want = {r.doc_id: (r["size"], r.source_size, r.target, r.repeats, r.taken) for r in mixing.mix(docs).collect()}
    names = ["base", "cut", "budget", "low", "below", "edge", "mix_source", "mix_hash", "h", "weight", "bucket", "words", "c0"]
    clashing = docs.select("*", *[F.lit(0).alias(n) for n in names])
    got = mixing.mix(clashing)
    assert got.columns == docs.columns + names + ["size", "source_size", "target", "repeats", "taken"]
    rows = got.collect()
    assert {r.doc_id: (r["size"], r.source_size, r.target, r.repeats, r.taken) for r in rows} == want
    assert all(r[n] == 0 for r in rows for n in names)


def test_url_filter_keeps_columns_with_clashing_names(spark, data):
    pages = table(spark, data, "pages").select("page_id", "url")
    listed = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    want = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, listed).collect()}
    names = ["h", "p", "asked", "pass", "entry", "host_length", "path_length", "found", "b", "c1"]
    got = urls.judge_urls(pages.select("*", *[F.lit("mine").alias(n) for n in names], F.lit("mine").alias("rule")), listed)
    rows = got.collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == want
    assert all(r[n] == "mine" for r in rows for n in names) and len(rows) == len(want)
