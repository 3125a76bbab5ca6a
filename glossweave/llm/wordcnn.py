"""Toxicity classifier: a convolutional network over hashed words, in numpy.

A word's vector is the sum of four learned vectors, two picked by hashes of the word and two by hashes of its first bytes, which
hold the stem of inflected forms; two words share all of theirs only by rare chance. Filters of one, two and three words move over the text; each filter's largest answer in the whole text goes through
a hidden layer to one probability. Thresholds are calibrated by language on rows that the fit did not see, and do not enter the score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glossweave.llm.bytescan import ALNUM, mix, scan
from glossweave.llm.learning import BATCH, Adam, answer_counts, best_counted_cut, best_cut, label_counts, layer, set_aside, sigmoid, taught, training_rows, training_sample
from glossweave.llm.rows import buffers, map_texts

BUCKETS, HASHES, VECTOR, FILTERS, HIDDEN, STEM = 1 << 15, 4, 8, 8, 12, 4
WIDTHS = (1, 2, 3)
PARTS = [(w, j) for w in WIDTHS for j in range(w)]
REACH = max(WIDTHS) - 1


@dataclass
class Model:
    params: dict[str, np.ndarray] | None
    shift: float
    prior: float
    squares: np.ndarray | None = field(default=None, repr=False, kw_only=True)  # past gradients of the vectors, for further steps
    thresholds: dict[str, float] = field(default_factory=dict)  # scores, by language
    threshold: float = 0.5

    def tables(self) -> np.ndarray:
        """Answers of every filter part to every bucket's vector: what a word adds. The last bucket is beyond a text's end."""
        return np.stack([self.params["vectors"][h] @ self.params["filters"] for h in range(HASHES)])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words and of their first STEM bytes, first word of each row)."""
    begin, end, hashes, first = scan(data, offsets, ALNUM)
    stem = np.zeros(len(begin), np.uint64)
    for j in range(STEM):
        at = begin + j
        stem = stem << np.uint64(8) | np.where(at < end, ALNUM[1][data[np.minimum(at, len(data) - 1)]] if len(data) else 0, 0).astype(np.uint64)
    return np.stack([hashes, mix(stem + np.uint64(1))]), first


def buckets(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(HASHES × places, first place of each row): words and, after each row, REACH places beyond its end."""
    rows = len(first) - 1
    starts = first + REACH * np.arange(rows + 1)
    out = np.full((HASHES, int(starts[-1])), BUCKETS, np.int64)
    at = np.arange(hashes.shape[1]) + REACH * np.repeat(np.arange(rows), np.diff(first))
    for h in range(HASHES):
        out[h, at] = (hashes[h // 2] >> np.uint64(20 * (h % 2))).astype(np.int64) & (BUCKETS - 1)
    return out, starts


def answers(parts: np.ndarray, bias: np.ndarray, beyond: np.ndarray) -> np.ndarray:
    """Places × (widths · FILTERS): a filter's answer to the words from a place on. ``parts``: places × (parts · FILTERS).

    Places beyond a text's end have the answer to no words, whatever text follows.
    """
    n = len(parts)
    out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
    for k, w in enumerate(WIDTHS):
        own = [PARTS.index((w, j)) for j in range(w)]
        z = out[:, k * FILTERS:(k + 1) * FILTERS]
        z[:] = parts[:, own[0] * FILTERS:(own[0] + 1) * FILTERS]
        for j in range(1, w):
            z[:n - j] += parts[j:, own[j] * FILTERS:(own[j] + 1) * FILTERS]
    out[beyond] = 0
    return out + bias


def pooled(model_tables: np.ndarray, bias: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each row's largest answers; a row without words has those of the end."""
    z = answers(sum(model_tables[h][ids[h]] for h in range(HASHES)), bias, ids[0] == BUCKETS)
    return np.maximum.reduceat(z, starts[:-1], axis=0) if len(starts) > 1 else z[:0]


def head(p: dict, top: np.ndarray) -> np.ndarray:
    """Logits of pooled answers; sums in a fixed order, so a row's logit does not depend on the rows around it."""
    return layer(np.maximum(layer(np.maximum(top, 0), p["w1"], p["b1"]), 0), p["w2"], p["b2"])[:, 0]


def logits(model: Model, tables: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ids, starts = buckets(*words(data, offsets))
    out = np.empty(len(starts) - 1)
    rows, step = 0, 1 << 16  # places worked on at a time; a longer text is one group
    while rows < len(out):
        end = max(rows + 1, int(np.searchsorted(starts, starts[rows] + step, side="right")) - 1)
        a, b = starts[rows], starts[end]
        out[rows:end] = head(model.params, pooled(tables, model.params["bias"], ids[:, a:b], starts[rows:end + 1] - a))
        rows = end
    return out


def step(p: dict, vectors: np.ndarray, squares: np.ndarray, adam: Adam, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
    g, touched, d = gradients(p, vectors, texts, y, weight)
    adam.step(g)
    for h in range(HASHES):  # sparse steps on the vectors, scaled by their own past gradients
        ids, back = np.unique(touched[h], return_inverse=True)
        total = np.stack([np.bincount(back, d[:, j], len(ids)) for j in range(VECTOR)], 1).astype(np.float32)
        squares[h, ids] += (total * total).mean(1)
        vectors[h, ids] -= 0.08 * total / np.sqrt(squares[h, ids])[:, None]
        vectors[h, BUCKETS] = 0


class Learner:
    """Goes on from a state; ``share`` is that of label 1 among all rows."""

    def __init__(self, state: dict[str, np.ndarray], share: float, rate: float):
        self.p = {k: v for k, v in state.items() if k not in ("vectors", "squares")}
        self.vectors, self.squares, self.adam = state["vectors"], state["squares"], Adam(self.p, rate, 1e-4)
        self.weights = 0.5 / max(1 - share, 1e-3), 0.5 / max(share, 1e-3)

    def step(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        data, offsets = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        hashes, first = words(data, offsets)
        parts = [hashes[:, a:b] for a, b in zip(first[:-1], first[1:])]
        step(self.p, self.vectors, self.squares, self.adam, parts, y, np.where(y == 1, self.weights[1], self.weights[0]).astype(np.float32))

    def state(self) -> dict[str, np.ndarray]:
        return {**self.p, "vectors": self.vectors, "squares": self.squares}


def fit(sample: list[tuple], steps: int = 800, rate: float = 1e-2, threshold: float = 0.5, weights: tuple[float, float] = (3.0, 1.0), least: int = 40) -> Model:
    """Fit on (text, label, language) rows; every fourth row of a label calibrates and is not learned from.

    The score's ``threshold`` is put where the labels part best over all languages. A language with ``least`` calibration rows,
    of both labels, gets its own threshold besides. ``weights``: what a wrongly judged document of label 0 and of label 1 costs.
    """
    y = np.array([r[1] for r in sample], np.float32)
    prior = float((y.sum() + 1) / (len(y) + 2))
    if len(set(y.tolist())) < 2 or len(y) < 4:
        return Model(None, 0.0, prior, threshold=threshold)
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 0.05, (HASHES, BUCKETS + 1, VECTOR)).astype(np.float32)
    vectors[:, BUCKETS] = 0
    p = {
        "filters": rng.normal(0, 0.4, (VECTOR, len(PARTS) * FILTERS)), "bias": np.zeros(len(WIDTHS) * FILTERS),
        "w1": rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.3, HIDDEN), "b2": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    adam = Adam(p, rate, 1e-4)
    squares = np.full((HASHES, BUCKETS + 1), 1e-3, np.float32)
    texts = []
    for r in sample:
        raw = np.frombuffer(r[0].encode(), np.uint8)
        texts.append(words(raw, np.array([0, len(raw)]))[0])
    nth = np.where(y == 1, np.cumsum(y == 1), np.cumsum(y == 0))  # place among the rows of its label
    learn = np.flatnonzero((nth % 4 != 0) | (len(y) < 40))
    share = y[learn].mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)
    for epoch in range(-(-steps * BATCH // len(learn))):
        order = rng.permutation(learn)
        for a in range(0, len(order), BATCH):
            rows = order[a:a + BATCH]
            step(p, vectors, squares, adam, [texts[i] for i in rows], y[rows], weight[rows])
    p["vectors"] = vectors
    model = Model(p, 0.0, prior, threshold=threshold, squares=squares)
    tables = model.tables()
    z = np.concatenate([logits(model, tables, *_joined([r[0] for r in sample[a:a + 200]])) for a in range(0, len(sample), 200)])
    check = np.setdiff1d(np.arange(len(y)), learn) if len(learn) < len(y) else learn
    at = float(np.log(threshold / (1 - threshold)))
    model.shift = at - best_cut(z[check], y[check], weights)
    language = np.array([str(r[2]) if len(r) > 2 and r[2] is not None else "" for r in sample])
    for name in set(language[check]) - {""}:
        own = check[language[check] == name]
        if len(own) >= least and len(set(y[own].tolist())) == 2:
            model.thresholds[name] = float(sigmoid(np.array(best_cut(z[own] + model.shift, y[own], weights))))
    return model


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    return np.concatenate(raw), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)


def gradients(p: dict, vectors: np.ndarray, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """(gradients of the small parameters, buckets touched by hash, gradient of each touched word's vector)."""
    first = np.concatenate([[0], np.cumsum([t.shape[1] for t in texts])]).astype(np.int64)
    ids, starts = buckets(np.concatenate(texts, 1), first)
    v = sum(vectors[h][ids[h]] for h in range(HASHES))
    z = answers(v @ p["filters"], p["bias"], ids[0] == BUCKETS)
    arg = np.stack([starts[i] + z[starts[i]:starts[i + 1]].argmax(0) for i in range(len(texts))])  # rows × filters
    top = z[arg, np.arange(z.shape[1])]
    relu = np.maximum(top, 0)
    h_in = relu @ p["w1"] + p["b1"]
    h = np.maximum(h_in, 0)
    d = (sigmoid(h @ p["w2"] + p["b2"]) - y) * weight / len(y)
    g = {"w2": h.T @ d, "b2": np.array([d.sum()])}
    d_h = d[:, None] * p["w2"] * (h_in > 0)
    g["w1"], g["b1"] = relu.T @ d_h, d_h.sum(0)
    d_top = (d_h @ p["w1"].T) * (top > 0)
    g["bias"] = d_top.sum(0)
    g["filters"] = np.zeros_like(p["filters"])
    touched, moves = [], []
    for k, w in enumerate(WIDTHS):
        for j in range(w):
            cols = slice(PARTS.index((w, j)) * FILTERS, (PARTS.index((w, j)) + 1) * FILTERS)
            at = np.minimum(arg[:, k * FILTERS:(k + 1) * FILTERS] + j, len(v) - 1)  # rows × FILTERS
            dt = d_top[:, k * FILTERS:(k + 1) * FILTERS]
            g["filters"][:, cols] = np.einsum("rfv,rf->vf", v[at], dt)
            touched.append(ids[:, at.reshape(-1)])
            moves.append((dt[:, :, None] * p["filters"][:, cols].T[None]).reshape(-1, VECTOR))
    return {k: x.astype(np.float32) for k, x in g.items()}, np.concatenate(touched, 1), np.concatenate(moves).astype(np.float32)


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", language: str = "lang", rows: int = 3000, threshold: float = 0.5, rate: float = 4e-3, rounds: int = 2, weights: tuple[float, float] = (3.0, 1.0), least: int = 40) -> Model:
    """Fit on every labelled document, whole; the language serves the thresholds alone.

    The start is a fit on ``rows`` documents at most (see training_sample); then come passes over all of them (see learning.taught).
    Every fourth document, by its key, is not learned from: the score's threshold and those of the languages are where the labels
    of all these part best. With fewer than 40 documents, or without both labels set aside, all serve for both.
    """
    every = training_rows(docs, labels, label, usable, extra=(language,))
    counts = label_counts(every)
    n0, n1 = (sum(n for (_, y), n in counts.items() if y == v) for v in (0, 1))
    apart = n0 + n1 >= 40 and all(counts.get((a, y)) for a in (True, False) for y in (0, 1))
    model = fit(training_sample(docs, labels, label, usable & ~set_aside() if apart else usable, extra=(language,), rows=rows), threshold=threshold)
    model.prior = (n1 + 1) / (n0 + n1 + 2)
    if model.params is None:
        return model
    learned = every.filter(~F.col("aside")) if apart else every
    share = counts[False, 1] / (counts[False, 0] + counts[False, 1]) if apart else n1 / (n0 + n1)
    state = taught(learned, {**model.params, "squares": model.squares}, lambda s: Learner(s, share, rate), rounds)
    model.params, model.squares = {k: v for k, v in state.items() if k != "squares"}, None

    def make():
        tables = model.tables()
        return lambda texts: {"z": logits(model, tables, *buffers(texts))}

    answered = answer_counts(every.filter("aside") if apart else every, make, "x0")
    at = float(np.log(threshold / (1 - threshold)))
    model.shift = at - best_counted_cut(*answered.pop(None), weights)
    model.thresholds = {}
    for name, (low, high, m0, m1) in answered.items():
        if name and m0.sum() + m1.sum() >= least and m0.sum() and m1.sum():
            model.thresholds[str(name)] = float(sigmoid(np.array(best_counted_cut(low + model.shift, high + model.shift, m0, m1, weights))))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), language: str | None = None) -> DataFrame:
    """Columns ``keep`` + score (0 to 1, higher: label 1 likelier), predicted (1 if score ≥ the model's threshold), of whole texts.

    With a ``language`` column, which must be among ``keep``, also flagged: score ≥ the language's own threshold, or the
    general one for a null or unknown language. Null, empty and word-free texts get one score, that of no words. Without
    labels of both kinds all scores are the smoothed share of label 1. Repeated rows get equal scores, an empty table gives
    none. A kept column named like a result is replaced.
    """

    def make():
        tables = None if model.params is None else model.tables()

        def work(texts: pa.Array) -> dict:
            if tables is None:
                s = np.full(len(texts), model.prior)
            else:
                s = sigmoid(logits(model, tables, *buffers(texts)) + model.shift)
            return {"score": s, "predicted": (s >= model.threshold).astype(np.int32)}

        return work

    out = map_texts(docs, list(keep), text, "score double, predicted int", make)
    if language is None:
        return out
    own = F.lit(model.threshold)
    for name, t in sorted(model.thresholds.items()):
        own = F.when(F.col(language) == name, F.lit(t)).otherwise(own)
    return out.withColumn("flagged", F.col("score") >= own)
