"""Collocations against counting by hand, for several numbers of shards."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glossweave.llm import phrases

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string"


def runs(text):
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOW))]


def counts(rows, most):
    f = Counter()
    for _, text, lang in rows:
        for w in runs(text):
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[("und" if lang is None else lang, tuple(w[i:i + k]))] += 1
    return f


def brute(rows, most, least, share, top):
    f = counts(rows, most)
    total, best = Counter(), {}
    for (lang, p), n in f.items():
        if len(p) == 1:
            total[lang] += n
    kept = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in kept.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in kept.items()):
            continue
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        best.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    for lang, found in best.items():
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def some_rows(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "The", "of", "ß", "Über", "x1", "É", "漢字", "new-york", " q", "(b)"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r", "!x "]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"])))
    return rows + [(100, None, "en"), (101, "", None), (102, " ,. \t", "fr"), (None, "a of the a of the", "en"), (3, rows[3][1], "en"), (103, "one word", "xx")]


@pytest.mark.parametrize("shards, most", [(1, 3), (2, 3), (3, 4), (5, 2)])
def test_collocations_equal_brute_force(spark, shards, most):
    rows = some_rows(shards)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOC + ", phrase string, n int")
    got = phrases.collocations(docs, most=most, least=4, share=50, top=25, shards=shards)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, most, 4, 50, 25)


def test_late_phrases_have_whole_counts(spark):
    """Words that reach the threshold in the last shard alone, and phrases that start in a second cycle."""
    rows = [(i, "rare pair here " * (1 if i < 9 else 3), "en") for i in range(10)] + [(50 + i, "rare", "en") for i in range(3)]
    for shards in (2, 4):
        docs = spark.createDataFrame(rows, DOC)
        found = {(r.lang, tuple(r.phrase.split(" "))): r.n for r in phrases.count_phrases(docs, 3, 10, shards).collect()}
        want = counts(rows, 3)
        assert all(found[k] == n for k, n in want.items() if n >= 10) and all(want[k] == n for k, n in found.items())


def test_empty_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], DOC)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None)], DOC)).collect() == []


@pytest.mark.parametrize("piece", [7, 40, 300])
def test_long_texts_are_cut_between_words(monkeypatch, piece):
    monkeypatch.setattr(phrases, "PIECE", piece)
    rng = random.Random(piece)
    texts = ["".join(rng.choice(["ab", "C", "éé", "longerword"]) + rng.choice([" ", "  ", ". ", ""]) for _ in range(n)) for n in (0, 3, 200, 50, 1, 400)] + [None, "x" * 500]
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    got, want = Counter(), Counter()
    for data, offsets, rows, old in phrases._cut(batch, 3):
        words, row, run = phrases._words(data, offsets)
        words = words.to_pylist()
        for k in (1, 2, 3):
            for i in range(len(words) - k + 1):
                if i + k - 1 >= old and run[i] == run[i + k - 1]:
                    got[rows[row[i]], tuple(words[i:i + k])] += 1
    for i, t in enumerate(texts):
        for (_, p), n in counts([(i, t, "l")], 3).items():
            want[i, p] += n
    assert got == want


def test_filters_find_all_their_phrases():
    langs, strings = ["en"] * 500 + ["de"] * 500, [f"w{i} of x{i % 7}" for i in range(1000)]
    h = phrases.phrase_hashes(langs, strings)
    assert len(set(h.tolist())) == 1000
    words = phrases.hashed([s.split(" ")[0] for s in strings])
    chain = phrases.chained(phrases.chained(phrases.chained(phrases.hashed(langs), words), phrases.hashed(["of"] * 1000)), phrases.hashed([s.split(" ")[2] for s in strings]))
    assert np.array_equal(chain, h)


def test_first_hits_equal_the_plain_filter():
    from glossweave.llm.urls import BLOCK_WORDS, PROBES, block_and_bits, may_hold

    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2)
    filters = {}
    for step, part in ((2, h[:700]), (1, h[500:900]), (5, h[900:1000])):
        words = np.zeros((40, BLOCK_WORDS), np.uint64)
        block, word, mask = block_and_bits(part, 40)
        np.bitwise_or.at(words, (np.repeat(block, PROBES), word.reshape(-1)), mask.reshape(-1))
        filters[step] = words
    got = phrases._first_hits(filters, h)
    want = [min([s for s, w in filters.items() if may_hold(w, h[i:i + 1])[0]], default=phrases.NEVER) for i in range(len(h))]
    assert got.tolist() == want
    assert set(got[:500]) <= {1, 2} and (got[1000:] == phrases.NEVER).mean() > 0.8


def test_hashes_follow_from_the_bytes_alone():
    words = ["", "a", "a\0", "\0", "\0\0", "abcdefgh", "abcdefgh\0", "abcdefghi", "Über", "漢字", "x" * 63, "x" * 64, "x" * 65, "x" * 66, "y" * 5000] + [f"w{i}" for i in range(5000)]
    h = phrases.hashed(words)
    assert len(set(h.tolist())) == len(words)
    mixed = list(range(len(words)))
    random.Random(1).shuffle(mixed)
    assert np.array_equal(phrases.hashed(pa.array([words[i] for i in mixed])), h[mixed])
    assert np.array_equal(phrases.hashed(pa.array(words, pa.large_string())[3:40]), h[3:40])
    assert len(phrases.hashed([])) == len(phrases.hashed(pa.array([], pa.string()))) == len(phrases.phrase_hashes([], [])) == 0


def test_words_are_hashed_without_python_strings(monkeypatch):
    """Scans hash each piece's vocabulary anew: through Python strings that was more than half of their time."""
    import pandas.util

    def never(*_, **__):
        raise AssertionError("strings are hashed one by one")

    monkeypatch.setattr(pandas.util, "hash_array", never)
    words = pa.array(["a", "b", "a", "longer word"], pa.large_string())
    assert len(set(phrases.hashed(words).tolist())) == 3


def test_counts_are_grouped_by_one_string(spark):
    shard = spark.createDataFrame([("en", "A b. a  B"), ("e\tn", "a b")], "lang string, text string")
    counted = phrases.count_shard(shard, 1, 2, 3, [{}, {}, {}])
    assert counted.dtypes == [("key", "string"), ("n", "bigint"), ("mark", "bigint")]
    got = Counter()
    for r in counted.selectExpr(f"{phrases.COHORT} AS cohort", f"{phrases.LENGTH} AS k", f"{phrases.TOLD} AS told", *phrases.NAMED, "n").collect():
        assert (r.cohort, r.k, r.told) == (1, 1, False)
        got[r.lang, r.phrase] += r.n
    assert got == {("en", "a"): 2, ("en", "b"): 2, ("e\tn", "a"): 1, ("e\tn", "b"): 1}


def test_names_of_languages_may_hold_blanks(spark):
    langs = ["", " ", "\t", "en\t", "en", "en a", "a\ten", None]
    rows = [(i, "a b a, b a b a", langs[i % len(langs)]) for i in range(40)]
    got = phrases.collocations(spark.createDataFrame(rows, DOC), most=3, least=4, share=50, top=25, shards=2)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 4, 50, 25)
