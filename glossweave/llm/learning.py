"""What the two text classifiers share: a start on few rows, passes over all rows, optimiser steps and the choice of thresholds."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glossweave.llm.rows import map_texts
from glossweave.session import materialise

#: Shards of a pass: one for so many rows, so many at most. What a pass moves is one model a shard, whatever the rows.
SHARD_ROWS, SHARDS = 4000, 64
#: Numbers of a model that travel in a row, texts and bytes of a step, logits that share a count.
BLOCK, BATCH, BATCH_BYTES, GRAIN = 1 << 14, 48, 1 << 20, 1.0 / 64


def id_remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; 0 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = (), rows: int = 3000, longest: int = 1 << 16) -> list:
    """At most ``rows`` labelled texts of at most ``longest`` characters to start a fit on, half of each label, by order of a hash.

    The bound holds for the start alone: :func:`taught` goes on with every labelled text, whole. Null labels and null keys are not used, nor are labels
    without a document that fits; a label without any row is warned of. Rows: (text, label, *extra).
    """
    labelled = labels.filter(F.col(label).isin(0, 1) & usable).select(F.col(key).alias("__k"), F.col(label).alias("__y"))
    both = docs.filter(F.length(text) <= longest).select(F.col(key).alias("__k"), F.col(text).alias("__t"), *[F.col(c).alias(f"__x{i}") for i, c in enumerate(extra)])
    # keys first, so that texts of the chosen rows alone are joined; only keys that have a text to give are chosen from
    labelled = labelled.join(both.select("__k"), "__k", "left_semi")
    out = []
    for y in (0, 1):
        chosen = labelled.filter(F.col("__y") == y).orderBy(F.xxhash64("__k"), "__k").limit(rows // 2)
        found = both.join(F.broadcast(chosen), "__k").orderBy(F.xxhash64("__k"), "__k").limit(rows // 2).drop("__k", "__y").collect()
        if not found:
            warnings.warn(f"no usable document has {label} = {y}: all scores will be the smoothed share of label 1")
        out += [tuple(r)[:1] + (y,) + tuple(r)[1:] for r in found]
    order = np.random.default_rng(7).permutation(len(out))
    return [out[i] for i in order]


def set_aside(key: str = "doc_id") -> Column:
    """Every fourth key: its rows calibrate and are not learned from."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(4)) == 3


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(place, aside, y, text, *extra) of every labelled text, whole: written, since each pass reads it. ``usable`` is told by the key.

    Null labels, keys and texts are not used; a text with several labels counts with each.
    """
    labelled = labels.filter(F.col(label).isin(0, 1) & usable).select(F.col(key).alias("__k"), F.xxhash64(key).alias("place"), set_aside(key).alias("aside"), F.col(label).cast("int").alias("y"))
    texts = docs.filter(usable & F.col(text).isNotNull()).select(F.col(key).alias("__k"), F.col(text).alias("text"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(extra)])
    # labels grow with the table, so one plan serves every size
    return materialise(texts.join(labelled.hint("merge"), "__k").select("place", "aside", "y", "text", *[f"x{i}" for i in range(len(extra))]), "training")


def flat(state: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([state[k].ravel() for k in sorted(state)]).astype(np.float32)


def taught(rows: DataFrame, state: dict[str, np.ndarray], make: Callable, rounds: int = 2) -> dict[str, np.ndarray]:
    """The state of a model after ``rounds`` passes over all of ``rows`` (see training_rows), in steps of some whole texts.

    In a pass every shard of the rows, a shard by the key's hash, goes on from the same state; then each number of the state moves
    by the mean of its moves in the shards that moved it. ``make(state)`` gives a learner with ``step(texts, y)`` and ``state()``.
    The rows of a shard come in an order of hashes and moves are summed by shard, so a rerun learns the same.
    """
    shards = max(1, min(SHARDS, rows.count() // SHARD_ROWS))
    for n in range(rounds):
        order = ["shard", F.xxhash64("place", F.lit(n)), "y", F.xxhash64("text")]
        shard = F.pmod(F.shiftright("place", 8), F.lit(shards)).cast("int")
        placed = rows.select(shard.alias("shard"), "place", "y", "text").repartition("shard").sortWithinPartitions(*order).select("shard", "y", "text")
        total = _moves(placed, state, make).groupBy("block").applyInPandas(_mean_move, "block int, moves binary").collect()
        after = flat(state)
        for block, moves in total:
            after[block * BLOCK:(block + 1) * BLOCK] += np.frombuffer(moves, np.float32)
        at, state = 0, dict(state)
        for k in sorted(state):
            shape, size = state[k].shape, state[k].size
            state[k] = after[at:at + size].reshape(shape)
            at += size
    return state


def _mean_move(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block over all shards that moved it."""
    moves = np.stack([np.frombuffer(m, np.float32) for m in rows.sort_values("shard")["moves"]]).astype(np.float64)
    mean = moves.sum(0) / np.maximum(1, (moves != 0).sum(0))
    return pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(), "moves": [mean.astype(np.float32).tobytes()]})


def _moves(placed: DataFrame, state: dict[str, np.ndarray], make: Callable) -> DataFrame:
    """(block, shard, moves) of a pass; rows of a shard stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, shard, learner, texts, labels, held = flat(state), None, None, [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            if texts:
                learner.step(texts, np.array(labels, np.float32))
            moves = flat(learner.state()) - before
            for block in range(-(-len(moves) // BLOCK)):
                part = moves[block * BLOCK:(block + 1) * BLOCK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([shard], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "shard", "moves"])

        for batch in batches:
            for s, y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if s != shard:
                    if learner is not None:
                        yield from done()
                    shard, learner, texts, labels, held = s, make({k: v.copy() for k, v in state.items()}), [], [], 0
                raw = np.frombuffer(text.as_py().encode(), np.uint8)
                texts.append(raw)
                labels.append(y)
                held += len(raw)
                if len(texts) == BATCH or held >= BATCH_BYTES:
                    learner.step(texts, np.array(labels, np.float32))
                    texts, labels, held = [], [], 0
        if learner is not None:
            yield from done()

    return placed.mapInArrow(run, "block int, shard int, moves binary")


def label_counts(rows: DataFrame) -> dict[tuple[bool, int], int]:
    return {(r["aside"], r["y"]): r["count"] for r in rows.groupBy("aside", "y").count().collect()}


def answer_counts(rows: DataFrame, make: Callable, group: str | None = None) -> dict[str | None, tuple[np.ndarray, ...]]:
    """By group (None: all rows): (lowest logit, highest logit, rows of label 0, rows of label 1) of every GRAIN of logits, ascending.

    All rows are counted; what reaches the driver is bounded by the grains between -30 and 30. ``make`` as for map_texts, giving z.
    """
    found = map_texts(rows, ["y"] + ([group] if group else []), "text", "z double", make)
    grain = F.floor(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("z"))) / GRAIN)
    counts = found.groupBy((F.col(group) if group else F.lit(None).cast("string")).alias("of"), grain.alias("grain")).agg(
        F.min("z").alias("low"), F.max("z").alias("high"), F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).collect()
    out: dict = {}
    for name in {None, *(r["of"] for r in counts)}:
        grains: dict = {}
        for r in counts:
            if name is None or r["of"] == name:
                g = grains.setdefault(r["grain"], [r["low"], r["high"], 0, 0])
                g[:] = min(g[0], r["low"]), max(g[1], r["high"]), g[2] + r["n0"], g[3] + r["n1"]
        out[name] = tuple(np.array([grains[g][i] for g in sorted(grains)], np.float64) for i in range(4))
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def layer(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x @ w + b in double precision, inputs added in their order: a row's result does not depend on the rows around it.

    A block product may round a row by its place in the block.
    """
    w = w.astype(np.float64).reshape(len(w), -1)
    out = np.repeat(b.astype(np.float64).reshape(1, -1), len(x), 0)
    for j in range(len(w)):
        out += x[:, j:j + 1].astype(np.float64) * w[j]
    return out


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.p, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            g = g + self.decay * self.p[k]
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def best_cut(logits: np.ndarray, y: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)) -> float:
    """The logit that parts the labels with the fewest errors, as shares of each label times its weight; in the middle of its gap."""
    order = np.argsort(logits)
    z, y = logits[order], y[order]
    return best_counted_cut(z, z, y == 0, y == 1, weights)


def best_counted_cut(low: np.ndarray, high: np.ndarray, n0: np.ndarray, n1: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)) -> float:
    """The same between groups of rows in order: their lowest and highest logits and how many of each label they hold."""
    if not n0.sum() or not n1.sum():
        return 0.0
    errors = np.concatenate([[0.0], np.cumsum(n1 * (weights[1] / n1.sum()))]) + np.concatenate([np.cumsum((n0 * (weights[0] / n0.sum()))[::-1])[::-1], [0.0]])
    edges = np.concatenate([[low[0] - 1], (low[1:] + high[:-1]) / 2, [high[-1] + 1]])
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    widths = np.concatenate([[0], low[1:] - high[:-1], [0]])[best]
    return float(edges[best[np.argmax(widths)]])
