"""Language identification as inference of a multilingual mixture.

A language is a model of letters: the likelihood of each letter of a word after the two before it, from counts over all training
texts, held in hashed buckets. A document is a bag of words; each word comes from one of the document's languages, and
expectation-maximisation estimates the proportions of these from the words' likelihoods. The set of languages starts with the
single likeliest one and grows, in the order of the proportions, as long as the likelihood grows by more than the penalty of
one more language. Likelihoods are whole numbers of 1/1024 nat and sums run in the order of a document's own words, so a
document's result does not depend on the rows around it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glossweave.llm.rows import map_texts, pieces

#: Buckets of three letters, of two, and of one. MOST languages are learned, so a model has 32 MB at most.
THREES, TWOS, ONES, MOST = 1 << 17, 1 << 16, 1 << 12, 128
UNIT = 1024
#: Weights of the shorter history, and of the even distribution below it.
ALPHA, BETA, FLOOR = 4.0, 20.0, 1 / 4096
ROUNDS, PENALTY = 12, 4.0
UNKNOWN = "und"
#: Texts of more characters are read word by word, not as one list of words; words held before they are counted as letters.
LONG, HELD = 1 << 20, 1 << 17


WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> dict[str, int]:
    """Lower-cased runs of letters and their counts, in the order of their first places."""
    if not text:
        return {}
    found = WORD.findall(text) if len(text) <= LONG else (m[0] for m in WORD.finditer(text))
    out: dict[str, int] = {}
    for run, n in Counter(found).items():
        # the pattern lets through what is a number but no digit, such as fractions
        for word in [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split():
            low = word.lower()
            out[low] = out.get(low, 0) + n
    return out


def letters(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of three, their first two, their last two, their middle letter; first place of each word): a word has a mark at
    its start and end, and one place a letter."""
    code = np.frombuffer("".join(f" {w} " for w in vocabulary).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in vocabulary], np.int64)
    ends = np.cumsum(size)
    a, b, c = code[:-2], code[1:-1], code[2:]
    inside = np.ones(len(code), bool)
    inside[ends - 1] = inside[ends - 2] = False  # threes that reach into the next word
    inside = inside[:len(a)]

    def bucket(h: np.ndarray, n: int) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return ((h >> np.uint64(40)) % np.uint64(n)).astype(np.int64)

    m = np.uint64(0x9E3779B97F4A7C15)
    two = lambda x, y: bucket((x * m + y) * m, TWOS)
    a, b, c = a[inside], b[inside], c[inside]
    first = np.concatenate([[0], np.cumsum(size - 2)[:-1]]).astype(np.int64) if len(size) else size
    return bucket(((a * m + b) * m + c) * m, THREES), two(a, b), two(b, c), bucket(b * m, ONES), first


COUNTED = "lang string, three int, two int, last int, one int, n long"


def letter_counts(texts: DataFrame) -> DataFrame:
    """(lang, three, two, last, one, n) of all texts (lang, text); a task holds one array of counts for each language it meets."""
    schema = pa.schema([("lang", pa.string()), ("three", pa.int32()), ("two", pa.int32()), ("last", pa.int32()), ("one", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        shape = np.zeros((3, THREES), np.int32)
        held: dict[str, Counter] = {}

        def pour() -> None:
            for name, bag in held.items():
                three, two, last, one, first = letters(list(bag))
                n = np.repeat(np.fromiter(bag.values(), np.int64, len(bag)), np.diff(np.append(first, len(three))))
                mine = counts.setdefault(name, np.zeros(THREES, np.int64))
                mine += np.bincount(three, n, THREES).astype(np.int64)
                for row, values in zip(shape, (two, last, one)):
                    np.maximum.at(row, three, values.astype(np.int32))
            held.clear()

        for batch in batches:
            for piece in pieces(batch, 1):
                for name, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    held.setdefault(name, Counter()).update(words(text))
                if sum(map(len, held.values())) > HELD:
                    pour()
        pour()
        for name, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at.astype(np.int32)), *[pa.array(row[at]) for row in shape], pa.array(mine[at])], schema=schema)

    every = texts.mapInArrow(run, COUNTED)
    return every.groupBy("lang", "three").agg(F.max("two").alias("two"), F.max("last").alias("last"), F.max("one").alias("one"), F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # THREES × languages, in 1/UNIT nat; 0 where no language has a count


def model_of(languages: list[str], lang: np.ndarray, three: np.ndarray, two: np.ndarray, last: np.ndarray, one: np.ndarray, n: np.ndarray) -> Model:
    """Likelihood of a letter after two, mixed with that after one and the even one; rows are counts of one language and bucket."""
    size = len(languages)
    c3 = np.zeros((size, THREES))
    np.add.at(c3, (lang, three), n)
    shape = np.zeros((3, THREES), np.int64)
    for row, values in zip(shape, (two, last, one)):
        np.maximum.at(row, three, values)
    seen = np.flatnonzero(c3.any(0))
    out = np.zeros((THREES, size), np.int16)
    for k in range(size):
        n3 = c3[k, seen]
        before = np.bincount(shape[0, seen], n3, TWOS)[shape[0, seen]]
        after = np.bincount(shape[1, seen], n3, TWOS)[shape[1, seen]]
        middle = np.bincount(shape[2, seen], n3, ONES)[shape[2, seen]]
        shorter = (after + BETA * FLOOR) / (middle + BETA)
        out[seen, k] = np.round(UNIT * np.log((n3 + ALPHA * shorter) / (before + ALPHA)))
    return Model(languages, out)


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang") -> Model:
    """Counts over all usable documents with a text and a language. At most MOST languages, those of most documents, are learned."""
    known = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    found = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST).collect()
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return Model([], np.zeros((THREES, 0), np.int16))
    counted = letter_counts(known.filter(F.col("lang").isin(languages))).toPandas()  # at most THREES rows a language
    order = {name: i for i, name in enumerate(languages)}
    return model_of(languages, counted["lang"].map(order).to_numpy(np.int64), *[counted[c].to_numpy(np.int64) for c in ("three", "two", "last", "one", "n")])


def word_scores(model: Model, vocabulary: list[str]) -> np.ndarray:
    """Log-likelihoods, words × languages, as whole numbers of 1/UNIT nat."""
    three, *_, first = letters(vocabulary)
    return np.add.reduceat(model.scores[three].astype(np.int64), first, axis=0) if len(first) else np.zeros((0, len(model.languages)), np.int64)


def mixture(row: np.ndarray, n: np.ndarray, p: list[np.ndarray], allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log-likelihood over that of each word's best language) of bags of words.

    ``row`` (ascending), ``n``: bag and count of each entry; ``p``: by language, the entries' likelihoods relative to the best;
    ``allowed``: bags × languages. Sums are taken language by language and, within a bag, entry by entry.
    """
    bags, size = allowed.shape
    entries = np.bincount(row, minlength=bags)
    total = np.bincount(row, n, bags)
    share = list(np.ascontiguousarray((allowed / allowed.sum(1, keepdims=True)).T))
    tried = [k for k in range(size) if allowed[:, k].any()]
    for again in range(ROUNDS + 1):
        parts = {k: np.repeat(share[k], entries) * p[k] for k in tried}
        whole = np.full(len(row), 1e-300)
        for k in tried:
            whole += parts[k]
        if again == ROUNDS:
            break
        each = n / whole
        for k in tried:
            share[k] = np.bincount(row, parts[k] * each, bags) / total
    return np.stack(share, 1), np.bincount(row, n * np.log(whole), bags)


def infer(model: Model, bags: list[dict[str, int]], penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(predicted language, its proportion among all languages, proportions in the chosen set) of bags with a word each."""
    place: dict[str, int] = {}
    ids = np.array([place.setdefault(w, len(place)) for bag in bags for w in bag], np.int64)
    n = np.array([c for bag in bags for c in bag.values()], np.float64)
    row = np.repeat(np.arange(len(bags)), [len(bag) for bag in bags])
    scores = word_scores(model, list(place))[ids]
    size = len(model.languages)
    p = [np.exp((scores[:, k] - scores.max(1)) / UNIT) for k in range(size)]
    every, _ = mixture(row, n, p, np.ones((len(bags), size)))
    best = scores.max(1)
    # whole numbers below 2**53: exact in any order
    single = np.stack([np.bincount(row, n * (scores[:, k] - best), len(bags)) for k in range(size)], 1)
    first = single.argmax(1)
    order = np.argsort(-np.where(np.arange(size) == first[:, None], 2.0, every), axis=1, kind="stable")
    chosen = np.zeros((len(bags), size))
    chosen[np.arange(len(bags)), first] = 1
    share, gained = chosen.copy(), single[np.arange(len(bags)), first] / UNIT
    price = penalty * np.log(1 + np.bincount(row, n, len(bags)))
    growing = np.arange(len(bags))
    for k in range(1, size):
        allowed = chosen[growing].copy()
        allowed[np.arange(len(growing)), order[growing, k]] = 1
        at = np.searchsorted(growing, row)
        kept = (at < len(growing)) & (growing[np.minimum(at, len(growing) - 1)] == row)
        parts, reached = mixture(at[kept], n[kept], [column[kept] for column in p], allowed)
        better = reached - gained[growing] > price[growing]
        growing, allowed, parts, reached = growing[better], allowed[better], parts[better], reached[better]
        chosen[growing], share[growing], gained[growing] = allowed, parts, reached
        if not len(growing):
            break
    lead = np.where(chosen > 0, share, -1).argmax(1)
    return lead, every[np.arange(len(bags)), lead], share * (chosen > 0)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), penalty: float = PENALTY) -> DataFrame:
    """Columns ``keep`` + lang_pred, score, languages (lang, share; the chosen set, largest share first).

    lang_pred is the language with the largest share in the chosen set, score its share when all languages may have one (rounded
    to nine places). Null texts, texts without a letter, and all texts when no language was learned, are ``und`` with score 0
    and no languages. Equal likelihoods go to the language first in code point order. Rows are judged one by one, so repeated
    rows get equal results and an empty table gives none. Very long texts are read as a whole; what is held of them is their
    distinct words. A kept column named like a result is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = sent.value

        def work(texts: pa.Array) -> dict:
            bags = [words(t) for t in texts.to_pylist()]
            full = [i for i, b in enumerate(bags) if b] if known.languages else []
            name, score = [UNKNOWN] * len(bags), np.zeros(len(bags))
            sets: list[list[dict]] = [[] for _ in bags]
            if full:
                lead, share, parts = infer(known, [bags[i] for i in full], penalty)
                for j, i in enumerate(full):
                    name[i], score[i] = known.languages[lead[j]], round(min(1.0, share[j]), 9)
                    sets[i] = [{"lang": known.languages[k], "share": round(min(1.0, parts[j, k]), 9)} for k in np.argsort(-parts[j], kind="stable") if parts[j, k] > 0]
            return {"lang_pred": name, "score": score, "languages": pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))}

        return work

    return map_texts(docs, list(keep), text, "lang_pred string, score double, languages array<struct<lang:string,share:double>>", make)
