"""Embedding near-duplicates by product quantisation.

Vectors are scaled to length 1. A coarse quantiser deals them to inverted lists; the residual to the list's centre is coded by one
byte for each of some subspaces, and the length of what the code misses is kept. A query looks into its own list and every list
whose dividing plane is no farther than a link is long: no linked vector can lie in another. There, distances come from a table of
the query's products with all code words; as the code's own error is known, what is pruned by it cannot be a link. The rest is ranked
by the exact cosine in double precision. Nothing but rounding (1e-6 and more is allowed for it) stands between this and all links.

Equal vectors of one label are one class, with the number of its members. The lists of a label, in order, are cut into blocks of
bounded size, long lists into several, short ones together. Two blocks are one unit of work if a vector of the first looks into
the second; it reports the links for both ends: counts and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window as W, functions as F

from glossweave.llm.components import components
from glossweave.session import materialise

#: Vectors that the quantisers are fitted on, at most; lists; vectors of a block; subspaces and code words.
SAMPLE, MOST_LISTS, BLOCK, PARTS, WORDS = 20_000, 4096, 768, 16, 256
#: What distances to planes may err by rounding; centres closer than NEAR have no plane, and both are probed.
SLACK, NEAR = 1e-6, 1e-3


@dataclass
class Quantiser:
    centres: np.ndarray  # lists × dimensions
    words: np.ndarray  # parts × words × dimensions of a part
    width: int  # dimensions, padded to a multiple of the parts

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width - x.shape[1]))) if x.shape[1] < self.width else x

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to all centres."""
        return np.maximum((x * x).sum(1)[:, None] + (self.centres**2).sum(1) - 2 * x @ self.centres.T, 0)

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, lengths of what they miss)."""
        parts = residual.reshape(len(residual), PARTS, -1)
        codes = np.empty((len(residual), PARTS), np.uint8)
        for m in range(PARTS):
            codes[:, m] = ((self.words[m] ** 2).sum(1) - 2 * parts[:, m] @ self.words[m].T).argmin(1)
        missed = parts - self.words[np.arange(PARTS), codes]
        return codes, np.sqrt((missed**2).sum((1, 2)))

    def table(self, x: np.ndarray) -> np.ndarray:
        """parts × queries × words: products with all words in each subspace, times -2."""
        parts = x.reshape(len(x), PARTS, -1)
        return np.stack([(-2 * parts[:, m] @ self.words[m].T).astype(np.float32) for m in range(PARTS)])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        count = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        centres[count > 0] = (sums[count > 0] / count[count > 0, None]).astype(x.dtype)
    return centres


def fit(sample: np.ndarray, lists: int) -> Quantiser:
    """Fit on unit vectors."""
    rng = np.random.default_rng(64)
    width = -(-sample.shape[1] // PARTS) * PARTS
    x = np.pad(sample, ((0, 0), (0, width - sample.shape[1]))).astype(np.float64)
    centres = kmeans(x, lists, rng)
    own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
    parts = (x - centres[own]).reshape(len(x), PARTS, -1)[:8000]
    return Quantiser(centres, np.stack([kmeans(parts[:, m], WORDS, rng, 6) for m in range(PARTS)]), width)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of length 1, zeros beyond a shorter list's end."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    scale = np.abs(out).max(1, initial=0)  # squares of very small or large numbers would be lost
    out /= np.where(scale > 0, scale, 1)[:, None]
    return out / np.sqrt((out * out).sum(1))[:, None]


def _index(classes: DataFrame, q: Quantiser) -> DataFrame:
    """Columns of classes + list, code, missed: every class in the list of its nearest centre."""
    sent = classes.sparkSession.sparkContext.broadcast(q)
    names = ["node", "weight", "label", "size", "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                x = matrix(part.column(4), q.width)
                own = q.distances(x).argmin(1)
                codes, missed = q.encode(x - q.centres[own])
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(5)] + [pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed)],
                    names=names + ["list", "code", "missed"])

    return classes.select(*names).mapInArrow(run, "node long, weight long, label string, size int, vector array<float>, list int, code binary, missed double")


def _blocks(indexed: DataFrame) -> DataFrame:
    """(label, size, list, begin, blocks): the blocks of each label's lists, numbered from 0 in order of lists."""
    by = W.partitionBy("label", "size")
    counts = indexed.groupBy("label", "size", "list").agg(F.count("*").alias("n"))
    shelf = F.floor((F.sum("n").over(by.orderBy("list")) - F.col("n")) / BLOCK)
    shelves = counts.withColumn("shelf", shelf).withColumn("blocks", F.ceil(F.sum("n").over(W.partitionBy("label", "size", "shelf")) / BLOCK))
    first = F.col("list") == F.min("list").over(W.partitionBy("label", "size", "shelf"))
    upto = F.sum(F.when(first, F.col("blocks")).otherwise(0)).over(by.orderBy("list"))
    return shelves.select("label", "size", "list", (upto - F.col("blocks")).cast("int").alias("begin"), F.col("blocks").cast("int").alias("blocks"))


def _visits(indexed: DataFrame, blocks: DataFrame, q: Quantiser, cosine: float) -> DataFrame:
    """Columns of indexed + block, visits: its own block, and it with all later ones that can hold a linked vector."""
    context = indexed.sparkSession.sparkContext
    several: dict = {}  # labels of one block have nothing to visit
    found = blocks.join(blocks.groupBy("label", "size").agg(F.max(F.col("begin") + F.col("blocks")).alias("all")).filter("all > 1"), ["label", "size"]).orderBy("label", "size", "list").toArrow()
    for label, size, *rest in zip(*(found.column(c).to_pylist() for c in ("label", "size", "list", "begin", "blocks"))):
        several.setdefault((label, size), []).append(rest)
    sent, of = context.broadcast(q), context.broadcast({k: np.array(v, np.int32) for k, v in several.items()})
    delta = float(np.sqrt(2 - 2 * cosine)) + SLACK
    placed = indexed.join(blocks, ["label", "size", "list"]).withColumn("block", F.col("begin") + F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    names = ["node", "weight", "label", "size", "vector", "list", "code", "missed", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        apart = np.sqrt(q.distances(q.centres))
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                own, block = (part.column(i).to_numpy().astype(np.int64) for i in (5, 8))
                labels, sizes = part.column(2).to_pylist(), part.column(3).to_pylist()
                d = q.distances(matrix(part.column(4), q.width))
                # distance to the plane between the own centre and another
                beyond = (d - d[np.arange(len(own)), own][:, None]) / (2 * np.maximum(apart[own], NEAR))
                reached = (beyond <= delta) | (apart[own] < NEAR)
                visits = []
                for r in range(len(own)):
                    near = np.zeros(0, np.int64)
                    lists = of.value.get((labels[r], sizes[r]))
                    if lists is not None:
                        hit = lists[reached[r, lists[:, 0]]]
                        begin = np.unique(hit[:, 1:], axis=0)
                        near = np.concatenate([np.arange(s, s + n) for s, n in begin.tolist()] + [near])
                    visits.append(np.concatenate([[block[r]], near[near > block[r]]]).astype(np.int32))
                ends = np.concatenate([[0], np.cumsum([len(v) for v in visits])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(9)] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(visits)))], names=names + ["visits"])

    return placed.select(*names).mapInArrow(run, "node long, weight long, label string, size int, vector array<float>, list int, code binary, missed double, block int, visits array<int>")


def _search(visiting: DataFrame, q: Quantiser, cosine: float) -> DataFrame:
    """(a, b, n): a's links, as n members of linked classes, and b: forest links without a count."""
    sent = visiting.sparkSession.sparkContext.broadcast(q)
    delta = float(np.sqrt(2 - 2 * cosine))
    rows = ["label", "size", "i", "j", "query", "node", "weight", "vector", "list", "code", "missed"]
    left = visiting.withColumn("i", F.col("block")).withColumn("j", F.explode("visits")).withColumn("query", F.lit(True)).select(*rows)
    units = left.select("label", "size", "i", "j").distinct()
    right = visiting.withColumn("j", F.col("block")).join(units, ["label", "size", "j"]).withColumn("query", F.lit(False)).select(*rows)
    key = ["label", "size", "i", "j"]
    dealt = left.unionByName(right).repartition(*key).sortWithinPartitions(*key)

    def links(q: Quantiser, group: pa.Table) -> tuple[list, list, list]:
        is_query = group.column("query").to_numpy()
        e, s = group.filter(pa.array(~is_query)), group.filter(pa.array(is_query))
        if not e.num_rows or not s.num_rows:
            return [], [], []
        y, x = (matrix(t.column("vector").combine_chunks(), q.width) for t in (e, s))
        code = np.frombuffer(b"".join(e.column("code").to_pylist()), np.uint8).reshape(len(y), PARTS)
        centre = q.centres[e.column("list").to_numpy()]
        decoded = q.words[np.arange(PARTS), code].reshape(len(y), -1)
        # |x - centre - decoded|², of which the parts' products with words come from the table
        distance = (q.distances(x)[:, e.column("list").to_numpy()] + (decoded * (decoded + 2 * centre)).sum(1)).astype(np.float32)
        table = q.table(x)
        for m in range(PARTS):
            distance += table[m][:, code[:, m]]
        near = np.sqrt(np.maximum(distance, 0)) - e.column("missed").to_numpy()[None, :] <= delta + 1e-4
        en, sn = e.column("node").to_numpy(), s.column("node").to_numpy()
        near &= en[None, :] != sn[:, None]
        r, c = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
        if not len(r):
            return [], [], []
        hit = near[np.ix_(r, c)] & (x[r] @ y[c].T >= cosine)
        r, c, hit = r[hit.any(1)], c, hit[hit.any(1)]
        total = hit @ e.column("weight").to_numpy()[c]
        # within a block, every link is seen from both ends; across two, from the query's alone
        across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        total_e = s.column("weight").to_numpy()[r] @ hit if across else np.zeros(len(c), np.int64)
        # smallest label in each connected part of this block
        label_q, label_e = np.arange(len(r)), np.full(len(c), len(r))
        while len(r):
            label_e = np.minimum(label_e, np.where(hit, label_q[:, None], len(r)).min(0))
            new = np.minimum(label_q, np.where(hit, label_e[None, :], len(r)).min(1))
            if (new == label_q).all():
                break
            label_q = new
        used = label_e < len(r)
        a = np.concatenate([sn[r], sn[r], en[c][used]])
        b = np.concatenate([sn[r], sn[r][label_q], sn[r][label_e[used]]])
        n = np.concatenate([total, np.zeros(len(r), np.int64), total_e[used]])
        keep = (n > 0) | (a != b)
        return a[keep].tolist(), b[keep].tolist(), n[keep].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        held: list[pa.RecordBatch] = []
        last = None

        def done():
            a, b, n = links(q, pa.Table.from_batches(held))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
            start = 0
            for r in range(len(keys)):
                if keys[r] != last:
                    if r > start:
                        held.append(batch.slice(start, r - start))
                    if held:
                        yield done()
                    held, start, last = [], r, keys[r]
            held.append(batch.slice(start))
        if held:
            yield done()

    return dealt.mapInArrow(run, "a long, b long, n long")


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93) -> DataFrame:
    """(key, n_links, component_id, kept): links of rows with equal labels and a cosine of at least ``cosine``.

    n_links: other rows linked directly; component_id: the smallest key reachable, itself included; kept: key = component_id.
    Null labels, and vectors that are null, empty, zero or hold null or non-finite numbers, link with nothing; vectors of
    different lengths do not link. Rows with equal vectors and labels link to each other, repeated rows included; rows that share
    their group's smallest key are all kept. Null keys count as larger than others. An empty table gives an empty result.

    The quantisers are fitted on at most SAMPLE classes, taken by a hash's order; every vector is indexed and asks. Links are all
    found, so where vectors fill all their dimensions and planes part little, the work grows with the square of a label's rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<float>")
    usable = F.col(label).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(key).alias("__key"), F.col(label).cast("string").alias("label"), F.when(F.coalesce(usable, F.lit(False)), v).alias("vector"))
    rows = rows.withColumn("node", F.when(F.col("vector").isNotNull(), F.xxhash64("label", "vector")))
    classes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("weight"), F.min("__key").alias("least"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = materialise(classes.withColumn("size", F.size("vector")), "classes")
    n, width = classes.agg(F.count("*"), F.max("size")).first()
    if n:
        sample = classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
        q = fit(matrix(sample, width), int(min(MOST_LISTS, max(1, len(sample) // 8), np.ceil(np.sqrt(n)))))
        indexed = materialise(_index(classes, q), "lists")
        visiting = materialise(_visits(indexed, materialise(_blocks(indexed), "vector-blocks"), q, cosine), "visits")
        found = materialise(_search(visiting, q, cosine), "vector-links")
    else:
        found = spark.createDataFrame([], "a long, b long, n long")
    linked = components(found.select("a", "b")).withColumnRenamed("component", "group")
    each = classes.join(found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "node", "left").join(linked, "node", "left")
    each = each.select("node", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("group", "node").alias("group"))
    named = each.groupBy("group").agg(F.min("least").alias("component_id"))
    of_class = materialise(each.join(named, "group").select("node", "n_links", "component_id"), "vector-groups")
    out = rows.select("__key", "node").join(of_class, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("__key")).otherwise(F.col("component_id"))
    return out.select(F.col("__key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("__key").eqNullSafe(component).alias("kept"))


#: All pairs within a label, in double precision.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id != b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
c AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS vec_id, CAST(coalesce(any_value(c.n), 0) AS BIGINT) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM r LEFT JOIN c ON c.a = r.a GROUP BY r.a
"""
