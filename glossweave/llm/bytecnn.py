"""Quality classifier: a convolutional network over bytes, in numpy.

A document is cut in chunks of 128 bytes; a window of 8 bytes moves by 4 and reaches over a chunk's end, so chunks overlap and the
windows cover the whole document. Bytes have learned vectors; learned filters see a window's vectors; each filter's largest
answer in a chunk goes through a hidden layer, and the means and maxima of that over all chunks give one probability.

Scores are made with whole-number vectors and filters, whose products and sums float32 holds exactly, and with sums in a fixed
order, so a document's score does not depend on the batch that it is in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glossweave.llm.learning import BATCH, Adam, answer_counts, best_counted_cut, best_cut, label_counts, layer, sigmoid, taught, training_rows, training_sample
from glossweave.llm.rows import buffers, map_texts

CHUNK, WIDTH, STRIDE, VECTOR, FILTERS, HIDDEN = 128, 8, 4, 6, 32, 24
SPAN = CHUNK + WIDTH - STRIDE
PAD = 256
#: Chunks worked on at a time in scoring.
GROUP = 2048


@dataclass
class Model:
    params: dict[str, np.ndarray] | None  # None: nothing to learn from
    shift: float  # added to the logit
    prior: float


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each chunk, first chunk of each row); an empty row has one empty chunk."""
    n = np.maximum(1, -(-np.diff(offsets) // CHUNK))
    first = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(offsets[:-1], n) + (np.arange(first[-1]) - np.repeat(first[:-1], n)) * CHUNK, first


def windows(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes of chunks (rows × SPAN), PAD beyond the document's end."""
    at = start[:, None] + np.arange(SPAN)
    inside = at < end[:, None]
    return np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int16) if len(data) else np.int16(0), np.int16(PAD))


def filtered(p: dict, seen: np.ndarray) -> np.ndarray:
    """Answers of all filters: chunks × windows × filters."""
    v = p["vectors"][seen].reshape(len(seen), -1)
    n = CHUNK // STRIDE
    view = np.lib.stride_tricks.as_strided(v, (len(seen), n, WIDTH * VECTOR), (v.strides[0], STRIDE * VECTOR * v.itemsize, v.itemsize))
    return (view.reshape(-1, WIDTH * VECTOR) @ p["filters"]).reshape(len(seen), n, FILTERS) + p["bias"]


def logits(p: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    start, first = chunks(data, offsets)
    end = np.repeat(offsets[1:], np.diff(first))
    hidden = np.empty((len(start), HIDDEN), np.float32)
    for a in range(0, len(start), GROUP):
        top = np.maximum(filtered(p, windows(data, start[a:a + GROUP], end[a:a + GROUP])).max(1), 0)
        hidden[a:a + GROUP] = np.maximum(top @ p["w1"] + p["b1"], 0)
    mean = np.add.reduceat(hidden, first[:-1], axis=0) / np.diff(first)[:, None] if len(offsets) > 1 else hidden[:0]
    most = np.maximum.reduceat(hidden, first[:-1], axis=0) if len(offsets) > 1 else hidden[:0]
    return np.concatenate([mean, most], 1) @ p["w2"] + p["b2"]


#: |whole number| of a weight at most: WIDTH * VECTOR products of two of them stay below 2**24.
WHOLE = 511


def whole_numbers(p: dict) -> dict:
    """The parameters for scoring: vectors and filters as whole numbers in float32, with the scale that brings answers back."""
    scales = {k: WHOLE / max(float(np.abs(p[k]).max()), 1e-9) for k in ("vectors", "filters")}
    return {**p, **{k: np.rint(p[k] * s).astype(np.float32) for k, s in scales.items()}, "bias": np.zeros(FILTERS, np.float32),
            "added": p["bias"].astype(np.float64), "scale": scales["vectors"] * scales["filters"]}


def steady_logits(q: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Logits by the parameters of :func:`whole_numbers`: bit-equal for equal documents, whatever stands around them."""
    start, first = chunks(data, offsets)
    count = np.diff(first)
    end = np.repeat(offsets[1:], count)
    hidden = np.empty((len(start), HIDDEN))
    for a in range(0, len(start), GROUP):
        top = filtered(q, windows(data, start[a:a + GROUP], end[a:a + GROUP])).max(1).astype(np.float64) / q["scale"] + q["added"]
        hidden[a:a + GROUP] = np.maximum(layer(np.maximum(top, 0), q["w1"], q["b1"]), 0)
    if len(offsets) < 2:
        return np.zeros(0)
    row = np.repeat(np.arange(len(count)), count)
    mean = np.stack([np.bincount(row, np.ascontiguousarray(hidden[:, j]), len(count)) for j in range(HIDDEN)], 1) / count[:, None]
    most = np.maximum.reduceat(hidden, first[:-1], axis=0)
    return layer(np.concatenate([mean, most], 1), q["w2"], q["b2"])[:, 0]


def fit(sample: list[tuple], steps: int = 340, rate: float = 4e-3, weights: tuple[float, float] = (1.0, 3.0)) -> Model:
    """Fit on (text, label) rows in about ``steps`` steps; a constant score if there are not both labels.

    ``weights``: what a wrongly judged document of label 0 and of label 1 costs when the cut is chosen.
    """
    y = np.array([r[1] for r in sample], np.float32)
    prior = float((y.sum() + 1) / (len(y) + 2))
    if len(set(y.tolist())) < 2:
        return Model(None, 0.0, prior)
    rng = np.random.default_rng(11)
    p = {
        "vectors": rng.normal(0, 0.5, (PAD + 1, VECTOR)), "filters": rng.normal(0, 0.25, (WIDTH * VECTOR, FILTERS)), "bias": np.zeros(FILTERS),
        "w1": rng.normal(0, 0.25, (FILTERS, HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.2, 2 * HIDDEN), "b2": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    adam = Adam(p, rate, 1e-5)
    texts = [np.frombuffer(r[0].encode(), np.uint8) for r in sample]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    epochs = -(-steps * BATCH // len(texts))
    for epoch in range(epochs):
        adam.rate = rate * (1 - 0.8 * epoch / epochs)
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            rows = order[a:a + BATCH]
            adam.step(gradients(p, [texts[i] for i in rows], y[rows], weight[rows]))
    q = whole_numbers(p)
    z = np.concatenate([steady_logits(q, *joined(texts[a:a + BATCH])) for a in range(0, len(texts), BATCH)])
    return Model(p, -best_cut(z, y, weights), prior)


def joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def gradients(p: dict, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean weighted log loss over some whole documents."""
    data, offsets = joined(texts)
    start, first = chunks(data, offsets)
    count = np.diff(first)
    row = np.repeat(np.arange(len(texts)), count)
    seen = windows(data, start, np.repeat(offsets[1:], count))
    answers = filtered(p, seen)
    arg = answers.argmax(1)
    top = np.take_along_axis(answers, arg[:, None, :], 1)[:, 0]
    relu = np.maximum(top, 0)
    h_in = relu @ p["w1"] + p["b1"]
    h = np.maximum(h_in, 0)
    mean = np.add.reduceat(h, first[:-1], axis=0) / count[:, None]
    most = np.maximum.reduceat(h, first[:-1], axis=0)
    pooled = np.concatenate([mean, most], 1)
    d = (sigmoid(pooled @ p["w2"] + p["b2"]) - y) * weight / len(y)
    g = {"w2": pooled.T @ d, "b2": np.array([d.sum()], np.float32)}
    d_pool = d[:, None] * p["w2"]
    is_most = h == most[row]
    share = np.add.reduceat(is_most.astype(np.float32), first[:-1], axis=0)
    d_h = d_pool[row, :HIDDEN] / count[row, None] + d_pool[row, HIDDEN:] * is_most / share[row]
    d_h = d_h * (h_in > 0)
    g["w1"], g["b1"] = relu.T @ d_h, d_h.sum(0)
    d_top = (d_h @ p["w1"].T) * (top > 0)
    g["bias"] = d_top.sum(0)
    # only the window with a filter's largest answer has a part in it
    at = arg[:, :, None] * STRIDE + np.arange(WIDTH)  # chunks × filters × bytes
    near = np.take_along_axis(seen[:, None, :], at.reshape(len(seen), 1, -1), 2).reshape(at.shape)
    vectors = p["vectors"][near].reshape(len(seen), FILTERS, WIDTH * VECTOR)
    g["filters"] = np.einsum("cf,cfk->kf", d_top, vectors, optimize=True)
    spread = (d_top[:, :, None] * p["filters"].T[None]).reshape(-1, VECTOR)
    flat = near.reshape(-1)
    g["vectors"] = np.stack([np.bincount(flat, spread[:, j], PAD + 1) for j in range(VECTOR)], 1)
    return {k: v.astype(np.float32) for k, v in g.items()}


class Learner:
    """Goes on from a state; ``share`` is that of label 1 among all rows."""

    def __init__(self, state: dict[str, np.ndarray], share: float, rate: float):
        self.p, self.adam = state, Adam(state, rate, 1e-5)
        self.weights = 0.5 / (1 - share), 0.5 / share

    def step(self, texts: list[np.ndarray], y: np.ndarray) -> None:
        self.adam.step(gradients(self.p, texts, y, np.where(y == 1, self.weights[1], self.weights[0]).astype(np.float32)))

    def state(self) -> dict[str, np.ndarray]:
        return self.p


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", rows: int = 2000, threshold: float = 0.5, rate: float = 4e-3, rounds: int = 2, weights: tuple[float, float] = (1.0, 3.0)) -> Model:
    """Fit on every labelled document, whole, so that ``threshold`` is where the labels of all of them part best.

    The start is a fit on ``rows`` documents at most (see training_sample); then come passes over all of them (see learning.taught).
    """
    every = training_rows(docs, labels, label, usable)
    counts = label_counts(every)
    n0, n1 = (sum(n for (_, y), n in counts.items() if y == v) for v in (0, 1))
    model = fit(training_sample(docs, labels, label, usable, rows=rows))
    model.prior = (n1 + 1) / (n0 + n1 + 2)
    if model.params is not None:
        model.params = taught(every, model.params, lambda s: Learner(s, n1 / (n0 + n1), rate), rounds)

        def make():
            q = whole_numbers(model.params)
            return lambda texts: {"z": steady_logits(q, *buffers(texts))}

        model.shift = -best_counted_cut(*answer_counts(every, make)[None], weights)
    model.shift += float(np.log(threshold / (1 - threshold)))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """Columns ``keep`` + score (0 to 1, higher: label 1 likelier), predicted (1 if score ≥ threshold, else 0), of whole texts.

    Null and empty texts get the score of an empty document. Without labels of both kinds all scores are the smoothed share of
    label 1. Rows are scored one by one: repeated rows get equal scores, an empty table gives none. A kept column named like a
    result is replaced.
    """

    def make():
        q = None if model.params is None else whole_numbers(model.params)

        def work(texts: pa.Array) -> dict:
            if q is None:
                s = np.full(len(texts), model.prior)
            else:
                s = sigmoid(steady_logits(q, *buffers(texts)) + model.shift)
            return {"score": s, "predicted": (s >= threshold).astype(np.int32)}

        return work

    return map_texts(docs, list(keep), text, "score double, predicted int", make)
