"""Near-duplicate documents by HyperMinHash signatures, banding and exact verification.

1. *Signatures.* A document's shingles are hashed once. The first bits of a hash pick one of 512 registers; a register keeps its
   smallest hash as a count of leading zeros and ten bits of mantissa (16 bits in all; Yu and Weber, 2017). For banding, each
   empty register takes the smallest value of a hash of its own over the whole set, so that small sets have full signatures
   whose registers are independent: each is equal in two sets with the chance of their Jaccard similarity, whatever their sizes.
2. *Classes.* Documents with equal sets are one class from here on, however many they are.
3. *Banding.* Bands of compressed registers are hashed; a class links to the smallest class in each of its buckets, never to all.
   The connected groups of these links hold every pair that shares a bucket.
4. *Verification.* The groups' full sets, made again from the texts of one document a class, are compared in blocks of bounded size.
   A collision-corrected estimate from the registers spares pairs that lie far below the threshold; intersections of the others
   are counted exactly. Each block reports a spanning forest of its links, and connected components of all links are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from glossweave.llm.bytescan import SPACED, mix, scan
from glossweave.llm.components import components
from glossweave.llm.rows import buffers, map_texts, pieces
from glossweave.llm.urls import build_filter, may_hold
from glossweave.session import materialise

REGISTER_BITS, MANTISSA = 9, 10
REGISTERS = 1 << REGISTER_BITS
EMPTY = 0xFFFF
#: Classes of one block in verification, and columns of its incidence matrix at a time.
BLOCK, COLUMNS = 384, 4096
#: Multiplier and summand of each register's own hash; values of that hash worked on at a time.
OWN = np.random.default_rng(2017).integers(0, 1 << 32, (2, REGISTERS, 1), dtype=np.uint32)
OWN[0] |= 1
OWN_VALUES = 1 << 18
MULTIPLIERS = mix(np.arange(1, 33, dtype=np.uint64)) | np.uint64(1)


def banding(percent: int, miss: float = 1e-5) -> tuple[int, int]:
    """(registers a band, bands): the longest bands, by powers of two, and the fewest of them, with which a pair at the threshold
    shares no band at most so often."""
    t, rows, bands = percent / 100, 1, REGISTERS
    while True:
        need = math.ceil(math.log(miss) / math.log1p(-(t ** (2 * rows)))) if t < 1 else 1
        if 2 * rows * need > REGISTERS:
            break
        rows, bands = 2 * rows, need
    return rows, bands


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each row): distinct shingles of each text, sorted. Fewer words than ``width`` make one shingle."""
    data, offsets = buffers(texts)
    _, _, words, first = scan(data, offsets, SPACED)
    count = np.diff(first)
    total = words * MULTIPLIERS[0]
    for j in range(1, width):
        total[:max(len(words) - j, 0)] += words[j:] * MULTIPLIERS[j]
    total = mix(total + np.uint64(width))
    out, sizes = [], np.zeros(len(count), np.int64)
    for r, n in enumerate(count.tolist()):
        a = int(first[r])
        if n >= width:
            h = np.unique(total[a:a + n - width + 1])
        elif n:
            h = mix(np.array([(words[a:a + n] * MULTIPLIERS[:n]).sum(dtype=np.uint64) + np.uint64(n)], np.uint64))
        else:
            continue
        out.append(h)
        sizes[r] = len(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def set_ids(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """rows × REGISTERS: leading zeros << MANTISSA | mantissa of each register's smallest hash; EMPTY where there is none."""
    rows = len(first) - 1
    out = np.full((rows, REGISTERS), EMPTY, np.uint16)
    if not len(hashes):
        return out
    row = np.repeat(np.arange(rows), np.diff(first))
    bucket = (hashes >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
    fresh = np.ones(len(hashes), bool)  # hashes are sorted, so a register's first is its smallest
    fresh[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(fresh)
    rest = hashes[at] << np.uint64(REGISTER_BITS)
    zeros = np.minimum(64 - np.frexp(rest.astype(np.float64))[1], 62).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[row[at], bucket[at]] = (zeros << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def densify(sketch: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Empty registers take the smallest value of their own hash over the row's whole set; rows without hashes stay empty.

    Two sets that both leave a register empty agree in it with the chance of their similarity, as in any other; one that leaves
    empty what the other fills lacks the other's smallest there. So no choice by size is needed, and none can part two sets.
    """
    out = sketch.copy()
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for r in np.flatnonzero((sketch == EMPTY).any(1) & (np.diff(first) > 0)):
        x, at = short[first[r]:first[r + 1]], np.flatnonzero(sketch[r] == EMPTY)
        step = max(1, OWN_VALUES // len(x))
        for a in range(0, len(at), step):
            k = at[a:a + step]
            h = OWN[0, k] * x + OWN[1, k]
            h ^= h >> np.uint32(16)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0xC2B2AE35)
            share, power = np.frexp(h.min(1).astype(np.float64))
            zeros = np.minimum(32 - power, 31)
            out[r, k] = zeros << MANTISSA | (np.maximum(2 * share - 1, 0) * (1 << MANTISSA)).astype(np.int64)
    return out


def band_hashes(sketch: np.ndarray, hashes: np.ndarray, first: np.ndarray, rows: int, bands: int) -> np.ndarray:
    full = densify(sketch, hashes, first)[:, :rows * bands].astype(np.uint64).reshape(len(sketch), bands, rows)
    out = np.zeros(full.shape[:2], np.uint64)
    for j in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + full[:, :, j] + np.uint64(1))
    return mix(out + np.arange(out.shape[1], dtype=np.uint64))


def estimate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimates of all rows of x with all of y, registers filled in either): matches less those expected by chance."""
    used = (x[:, None, :] != EMPTY) | (y[None, :, :] != EMPTY)
    n = used.sum(2)
    same = ((x[:, None, :] == y[None, :, :]) & used).sum(2)
    chance = n / (3 << MANTISSA)  # two smallest hashes of like size agree in zeros in about a third, and in the mantissa
    return np.maximum(same - chance, 0) / np.maximum(n - chance, 1), n


def signatures(docs: DataFrame, width: int, percent: int, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep`` + n_shingles, set_id (a hash of the set; null for an empty one), bands."""
    rows, bands_of = banding(percent)

    def make():
        def work(texts: pa.Array) -> dict:
            hashes, first = shingles(texts, width)
            n, ids = np.diff(first), set_ids(hashes, first)
            bands = band_hashes(registers(hashes, first), hashes, first, rows, bands_of)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.reshape(-1).view(np.int64)))
            return {"n_shingles": n, "set_id": pa.array(ids, mask=n == 0), "bands": lists}

        return work

    return map_texts(docs, list(keep), text, "n_shingles long, set_id long, bands array<long>", make)


def _sets(docs: DataFrame, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(set_id, hashes) of texts whose hash passes the filter of wanted.text_hash; a piece gives a text once."""
    sent = docs.sparkSession.sparkContext.broadcast(build_filter(wanted.select("text_hash"), "text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 1):
                probe = piece.column(0).to_numpy(zero_copy_only=False)
                once = np.zeros(len(probe), bool)
                once[np.unique(probe, return_index=True)[1]] = True
                texts = piece.column(1).filter(pa.array(once & may_hold(sent.value, probe)))
                if not len(texts):
                    continue
                hashes, first = shingles(texts, width)
                n, ids = np.diff(first), set_ids(hashes, first)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["set_id", "hashes"])

    # the filter hashes its keys once more, so the probe does, too
    probe = F.xxhash64(F.xxhash64(text))
    return docs.filter(F.col(text).isNotNull()).select(probe.alias("p"), F.col(text).alias("t")).mapInArrow(run, "set_id long, hashes array<long>")


def _links_in_block(ids: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets. ``sides``: with two blocks, only pairs across them are new."""
    ids, once = np.unique(ids, return_index=True)
    m = len(ids)
    if m < 2:
        return []
    sets, sides = [sets[i] for i in once], sides[once]
    size = np.array([len(s) for s in sets])
    ask = (100 * np.minimum.outer(size, size) >= percent * np.maximum.outer(size, size)) & ~np.eye(m, dtype=bool)
    if len(set(sides.tolist())) > 1:
        ask &= sides[:, None] != sides[None, :]
    if m > 2 and ask.any():
        flat = np.concatenate(sets)
        sketch = registers(flat, np.concatenate([[0], np.cumsum(size)]))
        t = percent / 100
        for i in range(m):  # far below the threshold: by more than six standard deviations of the estimate
            j = np.flatnonzero(ask[i])
            if len(j):
                e, n = estimate(sketch[i:i + 1], sketch[j])
                ask[i, j] = e[0] >= t - 6 * np.sqrt(t * (1 - t) / np.maximum(n[0], 1)) - 2.0 / np.maximum(n[0], 1)
    ask |= ask.T
    if not ask.any():
        return []
    both = np.zeros((m, m))
    if ask.sum() <= 4 * m:
        for i, j in zip(*np.nonzero(np.triu(ask))):
            both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(often > 1) - 1  # columns of hashes that two sets hold at least
        row = np.repeat(np.arange(m), size)
        use = often[column] > 1
        row, column = row[use], number[column[use]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, [a, a + COLUMNS])
            matrix = np.zeros((m, COLUMNS), np.float32)
            matrix[row[lo:hi], column[lo:hi] - a] = 1
            both += matrix @ matrix.T
    union = size[:, None] + size[None, :] - both
    linked = ask & (100 * both >= percent * union)
    label = np.arange(m)
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], m).min(1))
        if (low == label).all():
            break
        label = low
    return [(int(ids[i]), int(ids[label[i]])) for i in range(m) if label[i] != i]


def _verified(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the sets of each component: every pair of its blocks is one unit of work."""
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    dealt = sets.join(groups.join(sizes, "component"), "set_id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set_id", "hashes")
    dealt = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, sets = None, [], [], []

        def result(links):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            c, i, j, own, sid = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            lists = batch.column(5)
            flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))])
            found = []
            for r in range(len(c)):
                now = (c[r], i[r], j[r])
                if now != key:
                    if len(ids) > 1:
                        found += _links_in_block(np.array(ids), np.array(sides), sets, percent)
                    key, ids, sides, sets = now, [], [], []
                ids.append(sid[r])
                sides.append(own[r])
                sets.append(flat[ends[r]:ends[r + 1]].copy())
            yield result(found)
        if len(ids) > 1:
            yield result(_links_in_block(np.array(ids), np.array(sides), sets, percent))

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """(key, text_hash, n_shingles, component_id, kept) of every row.

    A document's set: distinct runs of ``width`` words (not white space, A-Z lower-cased) of its whole text; fewer words make one
    run; null, empty and blank texts have the empty set and are linked with nothing. Documents link if 100 · intersection ≥
    ``percent`` · union. component_id: the smallest key reachable by links; kept: key = component_id.

    Rows with equal sets link, repeated rows included: rows that share their group's smallest key are all kept. Null keys
    count as larger than all others; a group with null keys alone has a null component_id and keeps its rows. An empty table
    gives an empty result; other columns are not read. text_hash (xxhash64) tells apart rows with one key.
    """
    named = docs.select(F.col(key).alias("__key"), F.xxhash64(text).alias("__hash"), F.col(text).alias("__text_in"))
    rows = materialise(signatures(named, width, percent, "__text_in", ("__key", "__hash")), "signatures")
    classes = rows.filter("set_id IS NOT NULL").select("set_id", "bands").dropDuplicates(["set_id"])
    banded = classes.select("set_id", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("set_id").alias("hub"), F.max("set_id").alias("other")).filter("hub != other").select("band", "hub")
    groups = components(banded.join(hubs, "band").select(F.col("set_id").alias("a"), F.col("hub").alias("b")))
    groups = materialise(groups.withColumnRenamed("node", "set_id"), "groups")

    wanted = rows.join(groups, "set_id", "left_semi").groupBy("set_id").agg(F.min("__hash").alias("text_hash"))
    sets = _sets(named, "__text_in", width, materialise(wanted, "wanted"))
    links = materialise(_verified(sets, groups, percent), "near-links")
    linked = components(links).withColumnRenamed("node", "set_id")

    least = rows.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("__key").alias("least")).join(linked, "set_id", "left")
    least = least.withColumn("component", F.coalesce("component", "set_id"))
    named_groups = least.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = materialise(least.join(named_groups, "component").select("set_id", "component_id"), "classes")
    out = rows.select("__key", "__hash", "n_shingles", "set_id").join(of_class, "set_id", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("__key")).otherwise(F.col("component_id")))
    return out.select(F.col("__key").alias(key), F.col("__hash").alias("text_hash"), "n_shingles", "component_id", F.col("__key").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with their own columns and nothing else."""
    gone = near_duplicates(docs, key, text, width, percent).filter("NOT kept").select(F.col(key).alias("__k"), F.col("text_hash").alias("__h")).distinct()
    return docs.join(gone, docs[key].eqNullSafe(gone["__k"]) & F.xxhash64(docs[text]).eqNullSafe(gone["__h"]), "left_anti")


#: The same from all pairs that share a shingle: for small tables only.
SQL_PAIRS = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE list_slice(w, i, i + 2) END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id != y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
