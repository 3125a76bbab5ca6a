"""Operators on texts against brute force: decontamination, near duplicates, mixing, token counts, main text."""

import hashlib
import itertools
import os
import random
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))

from check import compare, connect  # noqa: E402

from glossweave.llm import density, hyperminhash, mixing, queries, suffixes, tokens  # noqa: E402

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


class Named:
    def __init__(self, name):
        self.name, self.run, self.sql = name, queries.QUERIES[name], queries.SQL[name]


@pytest.mark.parametrize("name", sorted(set(queries.SQL) - {"op5_near_duplicates"}))
def test_matches_sql(spark, data, name):
    ok, n, _, note = compare(spark, connect(data), Named(name), data)
    assert ok, note
    assert n > 0


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


# --- decontamination

def words13(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_hits(text, items, window=13):
    w, hit, found = words13(text), set(), set()
    for i, t in items:
        v = words13(t)
        m = min(window, len(v))
        wins = {tuple(v[s:s + m]) for s in range(len(v) - m + 1)} if m else set()
        for p in range(len(w) - m + 1 if m else 0):
            if tuple(w[p:p + m]) in wins:
                hit |= set(range(p, p + m))
                found.add(str(i))
    return len(w), len(hit), sorted(found)


def random_text(rng, n, vocabulary):
    return rng.choice(["", " "]) + "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", ".\n", " - "]) for _ in range(n))


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["a", "The", "ß", "Über", "x1", "cat", "漢字", "É"]
    items = [(1, random_text(rng, 30, vocabulary)), (10, random_text(rng, 13, vocabulary)), (2, "cat ß x1"), (3, None), (4, " ,;"), (5, "Zebra"), (2, "cat ß x1"), (None, "the the the the")]
    rows = [(i, random_text(rng, rng.randint(0, 60), vocabulary), None, None, 0) for i in range(40)]
    rows += [(50, (items[0][1] + " end. ") * 2, "x", "y", 1), (51, None, None, None, None), (52, "", None, None, None), (None, "a zebra", None, None, None), (50, items[0][1].upper(), None, None, None), (53, "word " * 30000 + items[1][1], None, None, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((r[0] if r[0] is not None else -1, *brute_hits(r[1], [("" if i is None else i, t) for i, t in items])) for r in rows)
    for size in (suffixes.BLOCK_BYTES, 40):  # one pass, and one for every few items
        monkeypatch.setattr(suffixes, "BLOCK_BYTES", size)
        got = suffixes.find_matches(docs_of(spark, rows), benchmark).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, list(r.item_ids)) for r in got) == want
        for r in got:
            assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
            assert r.longest == max([m.n_words for m in r.matches], default=0)
    whole = next(r for r in got if r.doc_id == 50 and r.n_words == 62)
    assert any(m.item_id == "1" and m.n_words == 30 and m.item_word == 0 and m.doc_word == 0 for m in whole.matches)


def test_decontamination_of_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], DOC)
    benchmark = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert suffixes.find_matches(empty, benchmark).count() == 0
    docs = docs_of(spark, [(1, "one two three", 7, True), (2, "one two", 8, None)], "doc_id long, text string, n_words long, contaminated boolean")
    assert suffixes.find_matches(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0
    assert [tuple(r) for r in suffixes.decontaminate(docs, benchmark).collect()] == [(2, "one two", 8, None)]


# --- near duplicates

def brute_groups(rows, width, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets.append({tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for g, (k, _) in zip(group, rows):
        least[g] = min((x for x in (least.get(g), k) if x is not None), default=None)
    return sorted((str(k), len(s), str(k if not s else least[g])) for (k, _), s, g in zip(rows, sets, group))


@pytest.mark.parametrize("width,percent,block", [(3, 85, 192), (5, 80, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(hyperminhash, "BLOCK", block)
    rng = random.Random(width)
    rows, base = [], [[f"w{rng.randint(0, 400)}" for _ in range(rng.choice([4, 12, 60, 120]))] for _ in range(12)]
    for i in range(150):  # chains of small edits around the threshold
        words = list(base[i % 12])
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 400)}"
        rows.append((1000 - i, " ".join(words).upper() if i % 7 == 0 else "\n".join(words)))
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (6, "one two"), (None, rows[0][1]), (None, "only null keys"), (7, "x " * 40000)]
    got = hyperminhash.near_duplicates(docs_of(spark, rows, "doc_id long, text string"), width=width, percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_groups(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_empty_tables_and_own_columns(spark):
    assert hyperminhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = docs_of(spark, [(2, "a b c d e f", True), (1, "a b c d e f", None), (3, None, False), (4, None, False)], "doc_id long, text string, kept boolean")
    assert sorted(tuple(r)[0] for r in hyperminhash.drop_near_duplicates(docs).collect()) == [1, 3, 4]


def test_bands_miss_almost_nothing_at_the_threshold():
    for percent in (50, 80, 85, 95, 100):
        rows, bands = hyperminhash.banding(percent)
        assert rows * bands <= hyperminhash.REGISTERS and (1 - (percent / 100) ** rows) ** bands <= 1e-5


def test_near_duplicates_match_sql(spark, data):
    ok, n, _, note = compare(spark, connect(data), Named("op5_near_duplicates"), data)
    assert ok, note
    assert n > 0


def test_short_texts_near_the_threshold_are_linked(spark):
    """Pairs with 6 of 7, 17 of 20 and 34 of 40 shingles in common, as a text and its beginning."""
    rows = []
    for shared, union in ((6, 7), (17, 20), (34, 40)):
        for i in range(400):
            words = [f"{union}x{i}x{j}" for j in range(union + 2)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:shared + 2]))]
    got = hyperminhash.near_duplicates(docs_of(spark, rows, "doc_id long, text string"), width=3, percent=85).collect()
    assert [r.doc_id for r in got if r.component_id != r.doc_id // 2 * 2] == []


# --- mixing

def test_mixing_edges_and_native_plan(spark):
    rows = [(i, "w " * (i % 9), None, None if i % 5 == 0 else f"s{i % 5}", 0) for i in range(300)]
    rows += [(900, None, None, "s1", 0), (901, "x " * 5000, None, "s9", 0), (None, "a b", None, "s2", 0), (7, "w w", None, "s2", 0), (902, "", None, "zero", 0)]
    docs = docs_of(spark, rows)
    out = mixing.mix(docs)
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    got = out.collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r["size"] for r in got)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6
    for v in by.values():
        assert v[0].source_size == sum(r["size"] for r in v) and v[0].target <= 3 * v[0].source_size
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r["size"] for r in v)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs.limit(0)).count() == 0
    clash = mixing.mix(docs_of(spark, [(1, "a b", "s", 5)], "doc_id long, text string, source string, taken long"))
    assert clash.columns.count("taken") == 1 and clash.first().taken == 2


# --- tokens

def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(5)
    pieces = list("abstmdrvel'' \n\t 019.,-!éß漢٣\u2003\u0085\x1c") + ["'re", "'ll", " '", "<|endoftext|>", "  ", "tion", "\U0001f600"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["a" * 5000, " " * 700, "<|endoftext|>" * 3, "-" * 300, "", "don't we'll I've'd", "\n\n'S's", "word " * 60000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (3, texts[3])]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    got = tokens.count_tokens(docs_of(spark, rows, "doc_id long, text string").coalesce(1), path).collect()
    assert [r.n_tokens for r in got] == want
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for _, t in rows]
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_splitting_does_not_depend_on_chunks():
    import numpy as np

    rng = np.random.default_rng(1)
    to, cuts = tokens.splitter()
    kinds = rng.integers(0, 12, 5000).astype(np.uint8)
    kinds[-1] = tokens.END
    state, want = tokens.START, set()
    for i, c in enumerate(kinds):
        at = int(c) * tokens.STATES + state
        want |= ({i} if cuts[at] & tokens.CUT_HERE else set()) | ({i - 1} if cuts[at] & tokens.CUT_BEFORE_LAST else set())
        state = int(to[at])
    for chunk in (1, 2, 7, 256, 9000):
        assert tokens.cut_points(kinds, to, cuts, chunk).tolist() == sorted(want)


# --- main text

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies, please accept all of them to go on reading this page today.</div>
%s<aside>See also this and that and more of it</aside><div id="comments"><p>First! What a very nice article this is, thank you.</p></div>
<form><input name=q><button>Go</button></form><footer>&copy; us</footer><script>var a = "<p>x</p>";</script></body></html>"""


@pytest.mark.parametrize("body", [
    "<article><h1>Title</h1><p>One <b>two</b>\n three &amp; four.<p>Five<br>six &lt;7&gt;</article>",
    "<div class=content><div><h1>Title</h1></div><p>One <b>two</b>\n three &amp; four.<p>Five<br>six &lt;7&gt;</div>",
    "<main><section><h1>Title</h1><div class=ad>Buy now</div><p>One <i>two</i> three &amp; four.</p></section><p>Five<!-- no --><br/>six &lt;7&gt;</p></main>",
])
def test_main_text(body):
    assert density.main_text(PAGE % body) == "Title\nOne two three & four.\nFive six <7>"


def test_main_text_of_odd_pages(spark):
    assert density.main_text("<b>" * 20000 + "deep") == "deep"
    assert density.main_text("a < b & c") == "a < b & c"
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>Hi <b>you</b></p>"), (None, "u", "<p>Hi <b>you</b></p>"), (3, "u", "<nav>x</nav>"), (4, "u", "<p>" + "word " * 50000)]
    got = density.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in got[:5]] == [(1, "", 0), (2, "", 0), (3, "Hi you", 6), (None, "Hi you", 6), (3, "", 0)]
    assert got[5].n_chars == 249999
    assert density.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_item_digest(spark, data):
    row = queries.QUERIES["op1_decontamination"](spark, data).filter("n_items = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
