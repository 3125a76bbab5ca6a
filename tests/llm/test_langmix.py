"""Language mixtures against a plain version for one document at a time, and on held-out documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossweave.llm import langmix, queries
from glossweave.llm.learning import id_remainder

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def model(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    return langmix.fit(docs, id_remainder(F.col("doc_id"), 3) != 1)


def plain(model, text):
    """lang_pred, score and shares by loops over words and languages."""
    bag = Counter()
    for w in re.findall(r"[^\W\d_]+", text or ""):
        if w.isalpha():
            bag[w.lower()] += 1
    if not bag or not model.languages:
        return "und", 0.0, {}
    size = len(model.languages)
    score = {}
    for w in bag:
        three = langmix.letters([w])[0]
        score[w] = [int(sum(int(model.scores[t, k]) for t in three)) for k in range(size)]

    def em(allowed):
        share = [1 / len(allowed) if k in allowed else 0.0 for k in range(size)]
        for again in range(langmix.ROUNDS + 1):
            new, ll = [0.0] * size, 0.0
            for w, n in bag.items():
                p = [share[k] * math.exp((score[w][k] - max(score[w])) / langmix.UNIT) for k in range(size)]
                whole = sum(p) + 1e-300
                ll += n * math.log(whole)
                for k in range(size):
                    new[k] += n * p[k] / whole
            if again < langmix.ROUNDS:
                share = [x / sum(bag.values()) for x in new]
        return share, ll

    every, _ = em(range(size))
    single = [sum(n * (score[w][k] - max(score[w])) for w, n in bag.items()) for k in range(size)]
    first = max(range(size), key=lambda k: (single[k], -k))
    chosen, best, shares = [first], single[first] / langmix.UNIT, {first: 1.0}
    for k in sorted((k for k in range(size) if k != first), key=lambda k: (-every[k], k)):
        share, ll = em([*chosen, k])
        if ll - best <= langmix.PENALTY * math.log(1 + sum(bag.values())):
            break
        chosen, best, shares = [*chosen, k], ll, {j: share[j] for j in [*chosen, k]}
    lead = max(shares, key=lambda k: (shares[k], -k))
    return model.languages[lead], every[lead], {model.languages[k]: s for k, s in shares.items()}


def test_equals_plain_version(spark, data, model):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts += [texts[0] + " " + texts[1], texts[2] + texts[5], "a", "Über ß", "漢字 х", "x" * 3000, None, "", " 12 ½ ² _ .", texts[3], "İstanbul ΣΑΣ"]
    docs = spark.createDataFrame([(i, t, "zz", None, None, "x", 1.5) for i, t in enumerate(texts)], DOC + ", lang_pred string, languages double")
    got = {r.doc_id: r for r in langmix.predict(docs, model).collect()}
    for i, t in enumerate(texts):
        name, score, shares = plain(model, t)
        assert got[i].lang_pred == name and abs(got[i].score - score) < 1e-6, t
        assert {x.lang: pytest.approx(x.share, abs=1e-6) for x in got[i].languages} == {k: v for k, v in shares.items() if v > 1e-9}
    assert {got[i].lang_pred for i in (len(texts) - 5, len(texts) - 4, len(texts) - 3)} == {"und"}


def test_results_do_not_depend_on_other_rows(spark, data, model):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(150).collect()]
    bags = [langmix.words(t) for t in texts]
    alone = [langmix.infer(model, [b]) for b in bags]
    back = langmix.infer(model, bags[::-1])
    for i in range(len(bags)):
        j = len(bags) - 1 - i
        assert alone[i][0][0] == back[0][j] and alone[i][1][0] == back[1][j] and np.array_equal(alone[i][2][0], back[2][j])


def test_mixtures_are_found(spark, data, model):
    rows = spark.read.parquet(f"{data}/documents.parquet").filter("length(text) BETWEEN 1500 AND 6000").orderBy("doc_id").collect()
    by = {}
    for r in rows:
        by.setdefault(r.lang, r.text)
    a, b = sorted(by)[:2]
    lead, _, share = langmix.infer(model, [langmix.words(by[a] + "\n" + by[b]), langmix.words(by[a])])
    assert {model.languages[k] for k in np.flatnonzero(share[0])} == {a, b}
    assert model.languages[lead[1]] == a and np.count_nonzero(share[1]) == 1


def test_held_out_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op11_language_mixture"](spark, data).join(docs, "doc_id").filter("held_out").collect()
    assert len(got) > 40 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_counts_equal_counting_by_hand(spark):
    rows = [(1, "Ab ab, c", "x", None, None), (2, "ab", "y", None, None), (3, None, "x", None, None), (4, "zz", None, None, None)]
    docs = spark.createDataFrame(rows, DOC)
    m = langmix.fit(docs, F.lit(True))
    assert m.languages == ["x", "y"]
    counted = langmix.letter_counts(docs.filter("lang = 'x' AND text IS NOT NULL").select("lang", "text")).collect()
    three, *_ = langmix.letters(["ab", "c"])
    assert {r.three: r.n for r in counted} == dict(zip(three.tolist(), [2, 2, 1]))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None, None, None)], DOC)
    m = langmix.fit(docs, F.lit(True))
    assert [(r.lang_pred, r.score) for r in langmix.predict(docs, m).collect()] == [("und", 0.0)]
    assert langmix.predict(docs.limit(0), m).collect() == []


def test_long_texts_are_read_whole(monkeypatch):
    text = "Ein Wort und noch ein Wort. " * 50
    short = langmix.words(text)
    monkeypatch.setattr(langmix, "LONG", 10)
    assert langmix.words(text) == short and sum(short.values()) == 300
