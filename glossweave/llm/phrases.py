"""Phrase collocations by dynamic itemset counting.

Documents are dealt to shards, and shards are scanned in a cycle. In a step one shard is read and phrases of all lengths are
counted side by side: single words from the first step on, a longer phrase from the step after both of its subphrases (without
its last and without its first word) have reached the threshold, whatever part of the data has been read by then. A phrase has
one full cycle when it has been counted in as many steps as there are shards; scans end when every phrase has completed one.

Which phrases have reached the threshold, and in which step, is told to the scans by one blocked Bloom filter for each length
and step, of bounded size; a filter never changes once made. A false hit only means that a phrase is counted that need not be:
its counts are whole as well, for it starts in a step that depends on the filters alone and runs for one cycle from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from glossweave.llm.rows import buffers
from glossweave.llm.urls import BITS_PER_KEY, BLOCK_WORDS, MOST_BLOCKS, PROBES, block_and_bits
from glossweave.session import materialise

SHARDS, SALTS = 2, 64
#: Bytes of text worked on at a time; a longer text is cut after a break or blank.
PIECE = 1 << 20
LONG_WORD = 64
NEVER = 1 << 30
UNKNOWN = "und"

# fixed values: break characters, blanks, and A-Z to a-z
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = 1
KINDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


# --- hashes of phrases: equal on all machines, made of the hashes of language and words


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(strings: pa.Array | list[str]) -> np.ndarray:
    """Made of the bytes, eight at a time for all strings at once; a string of more than LONG_WORD bytes by itself."""
    data, offsets = buffers(pa.array(strings, pa.large_string()) if isinstance(strings, list) else strings)
    sizes = np.diff(offsets)
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = _mixed(sizes + 1)
    for k in range(0, min(sizes.max(initial=0), LONG_WORD), 8):
        here = np.flatnonzero((sizes > k) & (sizes <= LONG_WORD))
        missing = np.maximum(8 - (sizes[here] - k), 0).astype(np.uint64) * np.uint64(8)
        eight = eights[offsets[here] + k].astype(np.uint64)
        out[here] = chained(out[here], (eight << missing) >> missing)
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = int.from_bytes(blake2b(data[offsets[i]:offsets[i + 1]], digest_size=8).digest(), "little")
    return out


def chained(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    return _mixed(first * np.uint64(0x9E3779B97F4A7C15) + then)


def phrase_hashes(langs: pa.Array | list[str], phrases: pa.Array | list[str]) -> np.ndarray:
    """Of (language, space-joined phrase) rows."""
    parts = pc.split_pattern(pa.array(phrases, pa.large_string()) if isinstance(phrases, list) else phrases, " ")
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = hashed(parts.flatten())
    out, at = hashed(langs), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
    for k in range(sizes.max(initial=0)):
        here = sizes > k
        out[here] = chained(out[here], flat[at[here] + k])
    return out


# --- scans


def _cut(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, rows, words known before) of the batch in pieces; a text longer than a piece is cut between words.

    A piece that goes on within a run of words starts with the last ``longest - 1`` words of the one before.
    """
    data, offsets = buffers(batch.column(1))
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        if end > row + 1 or offsets[end] - offsets[row] <= PIECE:
            yield data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row], np.arange(row, end), 0
            row = end
            continue
        at, stop, old = int(offsets[row]), int(offsets[row + 1]), 0
        while at < stop:
            size, to = PIECE, stop
            while at + size < stop:
                kinds = KINDS[data[at:at + size]]
                breaks = np.flatnonzero(kinds == 2)
                gaps = np.flatnonzero(kinds)
                starts = np.flatnonzero((kinds == 0) & np.concatenate([[True], kinds[:-1] != 0]))
                if len(breaks):
                    to = at + int(breaks[-1]) + 1
                    break
                if len(gaps) and len(starts) > 2 * longest:
                    to = at + int(gaps[-1]) + 1
                    break
                size *= 2
            yield data[at:to], np.array([0, to - at]), np.array([row]), old
            if to < stop and KINDS[data[to - 1]] != 2:
                kinds = KINDS[data[at:to]]
                starts = np.flatnonzero((kinds == 0) & np.concatenate([[True], kinds[:-1] != 0]))
                old = longest - 1
                at = at + int(starts[len(starts) - old]) if old else to
            else:
                at, old = to, 0
        row += 1


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, row of each, run of each): words of one run follow each other without a break."""
    kinds = KINDS[data]
    is_word = kinds == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], is_word[:-1]]) & ~edge[:-1]
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & (~np.concatenate([is_word[1:], [False]]) | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    runs = np.cumsum(kinds == 2)[starts] + rows if len(starts) else starts
    kept = LOWER[data[is_word]]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(kept))
    return words, rows, runs


def _first_hits(filters: dict[int, np.ndarray], hashes: np.ndarray) -> np.ndarray:
    """The first step whose filter may hold each hash, else NEVER. Probes go on for those alone that the last one let pass."""
    out = np.full(len(hashes), NEVER, np.int64)
    left = np.arange(len(hashes))
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)  # as in urls.block_and_bits
    for step in sorted(filters):
        words = filters[step]
        at, m = left, mixed[left]
        block = (((hashes[left] >> np.uint64(32)) * np.uint64(len(words))) >> np.uint64(32)).astype(np.int64)
        for probe in range(PROBES):
            bits = ((m * np.uint64((2 * probe + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(55)).astype(np.int64)
            passed = np.flatnonzero((words[block, bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1))
            at, m, block = at[passed], m[passed], block[passed]
        out[at] = step
        left = left[out[left] == NEVER]
    return out


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes in the order of their first places, those places, the number of each code's)."""
    import pandas as pd

    number, unique = pd.factorize(codes)
    first = np.empty(len(unique), np.int64)
    first[number[::-1]] = np.arange(len(codes))[::-1]
    return unique, first, number


# a phrase is grouped by one string, in which the language follows it after a tab (words hold none), and brings one number with
# its cohort, its length and, in the last bit, whether it was told to the scans
COUNTS = "key string, n long, mark long"
LENGTH_BITS = 31
COHORT, LENGTH, TOLD = f"shiftright(mark, {LENGTH_BITS + 1})", f"(shiftright(mark, 1) & {(1 << LENGTH_BITS) - 1})", "(mark & 1) = 1"
NAMED = ["substring(key, instr(key, '\t') + 1) AS lang", "substring_index(key, '\t', 1) AS phrase"]


def count_shard(shard: DataFrame, step: int, shards: int, most: int, filters: list[dict[int, np.ndarray]]) -> DataFrame:
    """Counts of the phrases of up to ``most`` words that are active in ``step``, added up for each piece of text.

    ``shard`` has (lang, text); ``filters[k - 1][step]`` holds what reached the threshold in that step among phrases of k words.
    A phrase is of the cohort of the step in which it is counted first.
    """
    sent = shard.sparkSession.sparkContext.broadcast(filters)
    schema = pa.schema([("key", pa.string()), ("n", pa.int64()), ("mark", pa.int64())])
    blank, tab = pa.scalar(" ", pa.large_string()), pa.scalar("\t", pa.large_string())

    def active(cohort: np.ndarray) -> np.ndarray:
        return (cohort <= step) & (cohort > step - shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names = langs.dictionary.cast(pa.large_string())
            lang_of, lang_hash = langs.indices.to_numpy(zero_copy_only=False), hashed(names)
            for data, offsets, rows, old in _cut(batch, most):
                words, row, runs = _words(data, offsets)
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                size = len(coded.dictionary)
                code = lang_of[rows[row]].astype(np.int64) * size + coded.indices.to_numpy(zero_copy_only=False)
                fresh = np.arange(len(code)) >= old
                unique, _, at = _distinct(code)
                places = np.arange(len(code))  # where a phrase of the length in hand starts
                lang, ids = unique // size, (unique % size)[:, None]
                word_hash = hashed(coded.dictionary)
                h = chained(lang_hash[lang], word_hash[ids[:, 0]])
                cohort = np.ones(len(unique), np.int64)
                for k in range(1, most + 1):
                    n = np.bincount(at[fresh[places + k - 1]], minlength=len(lang))
                    told = np.flatnonzero(active(cohort) & (n > 0))
                    if len(told):
                        phrase = pc.binary_join_element_wise(*[coded.dictionary.take(pa.array(ids[told, j])) for j in range(k)], blank)
                        keys = pc.binary_join_element_wise(phrase, names.take(pa.array(lang[told])), tab)
                        mark = (cohort[told] << LENGTH_BITS + 1) + (k << 1)
                        yield pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(n[told]), pa.array(mark)], schema=schema)
                    if k == most:
                        break
                    # the step from which a phrase lets longer ones start: not before it is counted itself
                    since = np.maximum(_first_hits(known[k - 1], h), cohort)
                    since[since >= step] = NEVER
                    follows = np.flatnonzero(np.diff(places) == 1)
                    if k == 1:
                        follows = follows[runs[follows] == runs[follows + 1]]
                    both = np.maximum(since[at[follows]], since[at[follows + 1]])
                    follows, both = follows[both < NEVER], both[both < NEVER]
                    if not len(follows):
                        break
                    a, b = at[follows], at[follows + 1]
                    pairs, first, back = _distinct(a * len(lang) + b)
                    left, right = pairs // len(lang), pairs % len(lang)
                    lang, ids, h = lang[left], np.concatenate([ids[left], ids[right][:, -1:]], 1), chained(h[left], word_hash[ids[right][:, -1]])
                    cohort, places, at = both[first] + 1, places[follows], back

    return shard.mapInArrow(run, COUNTS)


def filter_of(phrases: DataFrame) -> np.ndarray | None:
    """Blocked Bloom filter of (lang, phrase) rows, made where the rows are and merged block by block; None without rows.

    At most MOST_BLOCKS blocks of 64 bytes reach the driver.
    """
    n = phrases.count()
    if n == 0:
        return None
    blocks = min(MOST_BLOCKS, max(1, -(-n * BITS_PER_KEY // (BLOCK_WORDS * 64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, word, mask = block_and_bits(phrase_hashes(batch.column(0), batch.column(1)), blocks)
            rows, at = np.unique(block, return_inverse=True)
            words = np.zeros((len(rows), BLOCK_WORDS), np.uint64)
            np.bitwise_or.at(words, (np.repeat(at, PROBES), word.reshape(-1)), mask.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(rows)] + [pa.array(words[:, i].view(np.int64)) for i in range(BLOCK_WORDS)], names=["block"] + [f"w{i}" for i in range(BLOCK_WORDS)])

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(BLOCK_WORDS))
    merged = phrases.select("lang", "phrase").mapInArrow(run, schema).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)])
    got = merged.toPandas()
    out = np.zeros((blocks, BLOCK_WORDS), np.uint64)
    out[got["block"].to_numpy()] = got.drop(columns="block").to_numpy(dtype=np.int64).view(np.uint64)
    return out


def count_phrases(docs: DataFrame, most: int = 3, least: int = 10, shards: int = SHARDS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(k, lang, phrase, n) of all words and of all phrases of up to ``most`` words that occur ``least`` times.

    Words have all their counts, rare ones too; rarer phrases are dropped once their cycle is complete. Null texts have no words; null languages are ``und``. Documents are read once a
    step (three cycles at most for three words), so ``docs`` is best a table.
    """
    source = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit(UNKNOWN)).alias("lang"), F.col(f"`{text}`").alias("text"),
                         F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(shards)).alias("shard")).filter("text <> ''")
    filters: list[dict[int, np.ndarray]] = [{} for _ in range(most)]
    cohorts: list[set[int]] = [{1}] + [set() for _ in range(most - 1)]  # steps in which phrases of k words may start
    carried, done, step = None, [], 0
    while any(step < c + shards - 1 for cs in cohorts for c in cs):
        step += 1
        shard = source.filter(F.col("shard") == (step - 1) % shards).select("lang", "text")
        counts = count_shard(shard, step, shards, most, filters)
        if carried is not None:
            counts = counts.unionByName(carried)
        counts = counts.groupBy("key").agg(F.sum("n").alias("n"), F.max("mark").alias("mark"))
        counts = counts.filter(f"{COHORT} > {step - shards + 1} OR {LENGTH} = 1 OR n >= {least}")
        counts = counts.withColumn("new", F.expr(f"n >= {least} AND {LENGTH} < {most} AND NOT {TOLD}"))
        counts = materialise(counts.withColumn("mark", F.expr("mark + CAST(new AS LONG)")), f"phrases-{step}")
        done.append(counts.filter(f"{COHORT} = {step - shards + 1}"))
        carried = counts.filter(f"{COHORT} > {step - shards + 1}").select("key", "n", "mark")
        crossed = materialise(counts.filter("new").selectExpr(f"{LENGTH} AS k", *NAMED), "phrases-new")
        for k in range(1, most):
            new = filter_of(crossed.filter(F.col("k") == k))
            if new is not None:
                filters[k - 1][step] = new
        for k in range(1, most):  # a subphrase lets longer ones start from its filter's step, or from its own first one if later
            news = set(filters[k - 1])
            late = {c for c in cohorts[k - 1] if any(s < c for s in news) and c <= step}
            cohorts[k] |= {s + 1 for s in news | late}
    return reduce(DataFrame.unionByName, done).selectExpr(f"CAST({LENGTH} AS INT) AS k", *NAMED, "n")


# --- scores


def _parts(phrase, start, length):
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def collocations(docs: DataFrame, most: int = 3, least: int = 10, share: int = 50, top: int = 2000, shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``most`` words, by score.

    a is the phrase's count, l and r those of its parts at the cut with the lowest score, n that of all words. A phrase inside a
    longer one that has ``share`` per cent of its count is left out. Products are decimals of 38 digits, exact up to counts of
    10^15; quotients are whole-number divisions.

    Null languages count as ``und``, null and empty texts have no words, and neither has a text of blanks and breaks alone; texts
    of any length are read whole, in pieces. Repeated rows count as often as they stand there. Equal scores go by count, then by
    the bytes of the phrase. A language without such phrases gives no rows, nor does an empty table. Only text, lang and doc_id
    are read, so names of further columns do not matter.
    """
    counts = count_phrases(docs, most, least, shards)
    # words were joined by one space, and hold none themselves
    frequent = materialise(counts.filter(F.col("n") >= least), "phrases-frequent")
    totals = counts.filter(F.col("k") == 1).groupBy("lang").agg(F.sum("n").alias("total"))
    found = frequent.filter(F.col("k") > 1).select("lang", "phrase", F.col("n").alias("a"), "k")

    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = cuts.select("lang", "phrase", "a", "cut", F.inline(F.array(
        F.struct(F.lit(0).alias("side"), _parts(F.col("phrase"), F.lit(1), F.col("cut")).alias("part")),
        F.struct(F.lit(1).alias("side"), _parts(F.col("phrase"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("part")))))
    counted = sides.join(frequent.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"])
    cut = counted.groupBy("lang", "phrase", "a", "cut").agg(
        F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))
    score = F.expr("(CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low"))

    longer = found.filter(F.col("k") > 2).select("lang", "a", "phrase", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    longer = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("start"))
    longer = longer.select("lang", _parts(F.col("phrase"), F.col("start"), F.col("size")).alias("phrase"), F.col("a").alias("whole"))
    covering = longer.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    held = lowest.join(covering, ["lang", "phrase"], "left").filter(F.col("whole").isNull() | (100 * F.col("whole") < share * F.col("a")))

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    scored = held.select("lang", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), F.col("low.score").alias("score"))
    # each part of a language gives its own first ones, so the task that ranks a language reads SALTS * top rows at most
    parted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = parted.withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS runs FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, regexp_extract_all(run, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(runs) AS run FROM d) x),
o AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM p WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p WHERE len(w) > 2),
f AS (SELECT lang, k, phrase, count(*) AS n FROM o GROUP BY ALL),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.k, c.w, g.cut, array_to_string(c.w[1:g.cut], ' ') AS x, array_to_string(c.w[g.cut + 1:], ' ') AS y
  FROM c JOIN (VALUES (1), (2)) g(cut) ON g.cut < c.k),
s AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cuts.k, cut, l.n AS l, r.n AS r,
    CAST(1000000::HUGEINT * a * a // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s),
inside AS (
  SELECT lang, phrase, max(a) AS whole FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) i GROUP BY ALL),
z AS (
  SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE nth = 1 AND (whole IS NULL OR 100 * whole < 50 * a))
SELECT z.lang, rank, z.phrase, a, l, r, t.n, score FROM z JOIN t ON t.lang = z.lang WHERE rank <= 2000
"""
