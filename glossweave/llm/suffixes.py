"""Benchmark decontamination by suffix arrays over shards of the training texts.

A shard is a piece of some megabytes of one partition. Its words become numbers of the benchmark's vocabulary (0: not in it); the
suffixes that begin with enough known words to match anything are sorted, which is the shard's suffix array. Every suffix of
every benchmark item is looked up by binary search, to the depth of a window; the interval found holds all its occurrences.
Occurrences that follow each other in both texts join to the longest verbatim matches. Documents stay in their rows, so nothing
is shuffled; the benchmark goes to the tasks in blocks of bounded size, however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from glossweave.llm.bytescan import ALNUM, hash_words, scan
from glossweave.llm.rows import buffers, own_names, pieces, with_plain_names

#: Bytes of benchmark text sent to the tasks at once.
BLOCK_BYTES = 4 << 20
SPAN = "array<struct<item_id:string,item_word:int,doc_word:int,n_words:int>>"
RESULTS = ["n_words", "n_hit", "item_ids", "matches", "longest", "contaminated"]


@dataclass
class Block:
    """The windows of some benchmark items, ready to be looked up."""

    ids: list[str]
    words: np.ndarray  # vocabulary bytes
    word_at: np.ndarray  # where each word begins in them; entry 0 is for "unknown"
    hashes: np.ndarray  # sorted
    numbers: np.ndarray  # of the hashes
    low: np.ndarray  # lower bounds of the distinct windows, as byte strings
    high: np.ndarray
    size: np.ndarray  # words of each distinct window
    first: np.ndarray  # places of a distinct window in the items: rows first[w] to first[w + 1] - 1 of item, start
    item: np.ndarray
    start: np.ndarray
    depth: int
    shortest: int


def as_keys(matrix: np.ndarray) -> np.ndarray:
    """Rows of numbers as byte strings in the same order."""
    return np.ascontiguousarray(matrix.astype(">u4")).view(f"S{4 * matrix.shape[1]}").reshape(-1)


def make_block(items: list[tuple[str, bytes]], window: int) -> Block | None:
    data = np.frombuffer(b"".join(t for _, t in items), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in items])]).astype(np.int64)
    begin, end, _, first = scan(data, offsets, ALNUM)
    if not len(begin):
        return None
    low = ALNUM[1][data].tobytes()
    words = [low[b:e] for b, e in zip(begin.tolist(), end.tolist())]
    names = sorted(set(words))
    number = {w: i + 1 for i, w in enumerate(names)}
    seq = np.array([number[w] for w in words], np.int64)
    rows, sizes, item, start = [], [], [], []
    for i in range(len(items)):
        a, b = int(first[i]), int(first[i + 1])
        m = min(window, b - a)
        for s in range(b - a - m + 1 if m else 0):
            rows.append(np.concatenate([seq[a + s:a + s + m], np.zeros(window - m, np.int64)]))
            sizes.append(m)
            item.append(i)
            start.append(s)
    matrix = np.array(rows)
    unique, at = np.unique(matrix, axis=0, return_inverse=True)
    order = np.argsort(at.reshape(-1), kind="stable")
    at = at.reshape(-1)[order]
    size = np.array(sizes)[order][np.searchsorted(at, np.arange(len(unique)))]
    top = np.where(np.arange(window)[None, :] < size[:, None], unique, 0xFFFFFFFF)
    hashes = hash_words(names)
    by_hash = np.argsort(hashes)
    return Block(
        [i for i, _ in items], np.frombuffer(b"".join(names), np.uint8), np.concatenate([[0, 0], np.cumsum([len(w) for w in names])]),
        hashes[by_hash], by_hash + 1, as_keys(unique), as_keys(top), size, np.searchsorted(at, np.arange(len(unique) + 1)),
        np.array(item)[order], np.array(start)[order], window, int(min(sizes)))


def numbers_of(data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, block: Block) -> np.ndarray:
    """Vocabulary numbers of words; a hash that two words share is found out by comparing the bytes."""
    place = np.minimum(np.searchsorted(block.hashes, hashes), len(block.hashes) - 1)
    out = np.where(block.hashes[place] == hashes, block.numbers[place], 0)
    known = np.flatnonzero(out)
    a, size = block.word_at[out[known]], block.word_at[out[known] + 1] - block.word_at[out[known]]
    wrong = size != end[known] - begin[known]
    size = np.where(wrong, 0, size)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    same = ALNUM[1][data[np.repeat(begin[known], size) + inner]] == block.words[np.repeat(a, size) + inner]
    wrong[np.repeat(np.arange(len(known)), size)[~same]] = True
    out[known[wrong]] = 0
    return out


@dataclass
class Found:
    """Matches in a shard: place of the first word among the shard's words, words, item and its word."""

    word: np.ndarray
    size: np.ndarray
    item: np.ndarray
    item_word: np.ndarray


def search_shard(ids: np.ndarray, first: np.ndarray, block: Block) -> Found:
    """All longest matches of the block's items in the shard whose rows have the words ids[first[r]:first[r + 1]]."""
    n = len(ids)
    # known words from each place to the next unknown one or the row's end
    stop = np.full(n + 1, n, np.int64)
    breaks = np.zeros(n + 1, bool)
    breaks[:n] = ids == 0
    ends = np.zeros(n + 1, bool)
    ends[first] = True
    where = np.arange(n + 1)
    stop = np.minimum.accumulate(np.where(breaks | ends, where, n)[::-1])[::-1]
    next_stop = np.where(breaks[:n], where[:n], stop[1:]) if n else stop[:0]
    run = next_stop - where[:n]
    places = np.flatnonzero(run >= block.shortest)
    if not len(places):
        z = np.zeros(0, np.int64)
        return Found(z, z, z, z)
    step = np.arange(block.depth)
    matrix = np.where(step[None, :] < run[places, None], ids[np.minimum(places[:, None] + step, n - 1)], 0)
    keys = as_keys(matrix)
    order = np.argsort(keys, kind="stable")
    array, keys = places[order], keys[order]
    lo, hi = np.searchsorted(keys, block.low, "left"), np.searchsorted(keys, block.high, "right")
    width = hi - lo
    hit = np.flatnonzero(width > 0)
    if not len(hit):
        return Found(*[np.zeros(0, np.int64)] * 4)
    # every occurrence with every place of its window in the items
    times = block.first[hit + 1] - block.first[hit]
    pairs = width[hit] * times
    of = np.repeat(np.arange(len(hit)), pairs)
    inner = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    word = array[lo[hit[of]] + inner // times[of]]
    at = block.first[hit[of]] + inner % times[of]
    item, start, size = block.item[at], block.start[at], block.size[hit[of]]
    row = np.searchsorted(first, word, side="right")
    order = np.lexsort((word, word - start, item, row))
    word, item, start, size, row = word[order], item[order], start[order], size[order], row[order]
    fresh = np.ones(len(word), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (word[1:] - start[1:] != word[:-1] - start[:-1]) | (word[1:] != word[:-1] + 1)
    a = np.flatnonzero(fresh)
    z = np.append(a[1:], len(word)) - 1
    return Found(word[a], word[z] - word[a] + size[z], item[a], start[a])


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[Block]:
    held, size = [], 0
    for i, t in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), F.col(text)).filter(F.col(text).isNotNull()).toLocalIterator():
        raw = t.encode()
        if held and size + len(raw) > BLOCK_BYTES:
            yield make_block(held, window)
            held, size = [], 0
        held.append((i, raw))
        size += len(raw)
    if held:
        yield make_block(held, window)


def find_matches(
        docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text",
        window: int = 13, share: int = 20) -> DataFrame:
    """Columns ``keep`` + n_words, n_hit, item_ids, matches, longest, contaminated.

    Words are runs of digits, ASCII letters and characters beyond ASCII, A-Z lower-cased, of the whole text. A window is
    ``window`` consecutive words of an item, or a shorter item's words. n_hit: the document's words inside any occurrence;
    item_ids: the items with occurrences, sorted as text, each once; matches: the longest verbatim matches with their places;
    longest: words of the longest, 0 if none. contaminated: n_hit > 0 and share · n_hit ≥ n_words.

    Null, empty and word-free texts: 0 words, no matches. Items without words match nothing; a null item id counts as empty
    text. Repeated documents, items and ids are handled row by row and named once. Empty tables: no rows, or no matches.
    A kept column named like a result is replaced by it. A benchmark of more than BLOCK_BYTES is looked up in several passes.
    """
    kept = [c for c in keep if c not in RESULTS]
    at = kept.index(text) if text in kept else len(kept)
    base = docs.select(*[F.col(f"`{c}`") for c in kept], *([] if text in kept else [F.col(f"`{text}`").alias("__text")]))
    n_base = len(base.columns)
    more = docs.sparkSession.createDataFrame([], f"__items array<string>, __spans {SPAN}").schema
    passed = type(more)(base.schema.fields + more.fields)
    results = docs.sparkSession.createDataFrame([], f"n_words long, n_hit long, item_ids array<string>, matches {SPAN}, longest long, contaminated boolean").schema
    done = type(results)(base.schema.fields[:len(kept)] + results.fields)
    span_type = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))

    def look_up(sent, last: bool, first_pass: bool):
        """One pass over the documents with one block; the last one also counts. A pass is one Python step of a task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block: Block | None = sent.value if sent else None
            for batch in batches:
                for piece in pieces(batch, at):
                    data, offsets = buffers(piece.column(at))
                    begin, end, hashes, first = scan(data, offsets, ALNUM)
                    rows = piece.num_rows
                    items = [[] for _ in range(rows)] if first_pass else piece.column(n_base).to_pylist()
                    spans = [[] for _ in range(rows)] if first_pass else piece.column(n_base + 1).to_pylist()
                    if block is not None:
                        found = search_shard(numbers_of(data, begin, end, hashes, block), first, block)
                        row = np.searchsorted(first, found.word, side="right") - 1
                        for r, i, iw, w, n in zip(row.tolist(), found.item.tolist(), found.item_word.tolist(), (found.word - first[row]).tolist(), found.size.tolist()):
                            spans[r].append({"item_id": block.ids[i], "item_word": iw, "doc_word": w, "n_words": n})
                            items[r].append(block.ids[i])
                    ids, places = pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(spans, span_type)
                    if not last:
                        yield pa.RecordBatch.from_arrays([piece.column(c) for c in range(n_base)] + [ids, places], names=passed.names)
                        continue
                    sizes = pa.compute.list_value_length(places).to_numpy(zero_copy_only=False).astype(np.int64)
                    flat = places.flatten()
                    row = np.repeat(np.arange(rows), sizes)
                    n = flat.field("n_words").to_numpy(zero_copy_only=False).astype(np.int64)
                    word = first[row] + flat.field("doc_word").to_numpy(zero_copy_only=False).astype(np.int64)
                    cover = np.zeros(int(first[-1]) + 1, np.int64)
                    np.add.at(cover, word, 1)
                    np.add.at(cover, word + n, -1)
                    hits = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
                    n_words, n_hit = np.diff(first), hits[first[1:]] - hits[first[:-1]]
                    longest = np.zeros(rows, np.int64)
                    np.maximum.at(longest, row, n)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column(c) for c in range(len(kept))] + [pa.array(n_words), pa.array(n_hit), ids, places, pa.array(longest), pa.array((n_hit > 0) & (share * n_hit >= n_words))],
                        names=done.names)

        return run

    out, waiting, first_pass = base, None, True
    for block in _blocks(benchmark, item, item_text, window):
        if block is None:
            continue
        if waiting is not None:
            out, first_pass = out.mapInArrow(look_up(waiting, False, first_pass), passed), False
        waiting = docs.sparkSession.sparkContext.broadcast(block)
    return out.mapInArrow(look_up(waiting, True, first_pass), done)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of docs that are not contaminated, with their own columns, whatever they are called, and nothing else."""
    plain, names = with_plain_names(docs)
    found = find_matches(plain, benchmark, text=names[text], keep=tuple(names.values()), **options)
    return own_names(found.filter(~F.col("contaminated")), names)


#: The same by joining all 13-word windows of documents and items; the longest match is the longest run on one diagonal.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT item_id, s, least(13, len(w)) AS m, list_slice(w, s, s + least(13, len(w)) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM iw),
dw AS (
  SELECT doc_id, p, m, list_slice(w, p, p + m - 1) AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m)),
o AS (SELECT doc_id, item_id, p, s, iw.m AS m FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM o) GROUP BY doc_id),
runs AS (SELECT doc_id, item_id, p - s AS g, p, m, p - row_number() OVER (PARTITION BY doc_id, item_id, p - s ORDER BY p) AS r FROM o),
longest AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, max(p) - min(p) + max(m) AS n FROM runs GROUP BY doc_id, item_id, g, r) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
