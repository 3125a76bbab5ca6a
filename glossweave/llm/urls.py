"""URL filter: a blocked Bloom filter of listed canonical URLs lets possible hits pass to an exact hash join.

A listed entry is (host, path, verdict): it fits its host and all subdomains of it, if the URL's path starts with the entry's.
The canonical key of an entry is its host and path in one string. A URL asks for the keys of all its host's endings at a
dot with all beginnings of its path that have the length of some listed path. The filter answers for most URLs without moving
them; the few possible keys meet the list in a hash join, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glossweave.llm.rows import with_plain_names

#: 64 bytes a block. The filter never has more than MOST_BLOCKS of them (64 MB): a longer list only means more false positives.
BLOCK_WORDS, BITS_PER_KEY, PROBES, MOST_BLOCKS = 8, 16, 8, 1 << 20
RESULTS = ["host", "path", "rule", "verdict"]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#``, A-Z lower-cased; path then up to ``?`` or ``#``.

    Null, or no ``://``: both empty.
    """
    found = F.locate("://", url) > 0
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(found, low).otherwise(""), F.when(found, path).otherwise("")


def block_and_bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, word and mask (rows × PROBES) of 64-bit hashes: the high half picks the block, parts of a second mix the bits."""
    h = hashes.astype(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    steps = np.arange(PROBES, dtype=np.uint64)
    bits = ((mixed[:, None] * (np.uint64(2) * steps + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55)).astype(np.int64)
    return block.astype(np.int64), bits >> 6, np.left_shift(np.uint64(1), (bits & 63).astype(np.uint64))


def build_filter(keys: DataFrame, key: str) -> np.ndarray:
    """(blocks, 8) words of the keys' filter. Blocks are filled where the keys are, then merged block by block in Spark.

    The driver gets at most MOST_BLOCKS rows of 64 bytes.
    """
    n = keys.count()
    blocks = min(MOST_BLOCKS, max(1, -(-n * BITS_PER_KEY // (BLOCK_WORDS * 64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, word, mask = block_and_bits(batch.column(0).to_numpy(zero_copy_only=False), blocks)
            rows, at = np.unique(block, return_inverse=True)
            words = np.zeros((len(rows), BLOCK_WORDS), np.uint64)
            np.bitwise_or.at(words, (np.repeat(at, PROBES), word.reshape(-1)), mask.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(rows)] + [pa.array(words[:, i].view(np.int64)) for i in range(BLOCK_WORDS)], names=["block"] + [f"w{i}" for i in range(BLOCK_WORDS)])

    schema = "block long, " + ", ".join(f"w{i} long" for i in range(BLOCK_WORDS))
    merged = keys.select(F.xxhash64(key)).mapInArrow(run, schema).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_WORDS)])
    out = np.zeros((blocks, BLOCK_WORDS), np.uint64)
    got = merged.toPandas()
    if len(got):
        out[got["block"].to_numpy()] = got.drop(columns="block").to_numpy(dtype=np.int64).view(np.uint64)
    return out


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, word, mask = block_and_bits(hashes, len(words))
    return ((words[block[:, None], word] & mask) == mask).all(1)


def judge_urls(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Columns of pages + host, path, rule, verdict.

    ``listed`` has host, path, verdict; of the entries that fit a URL the longest wins (then the longer host), its key being
    ``rule``; a repeated entry counts once, ``block`` before ``allow``. Without a fitting entry rule is null and the verdict is
    ``default``. Null URLs and URLs without ``://`` have no host and fit nothing; entries with a null host or path are ignored;
    an empty list judges all by default. Rows are never merged or lost; an input column named like a result is replaced, all
    others come back as they are, whatever their names.
    """
    spark = pages.sparkSession
    entries = listed.filter("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    entries = entries.select(F.concat("host", "path").alias("entry"), F.length("host").alias("host_length"), F.length("path").alias("path_length"), "verdict")
    lengths = sorted(r[0] for r in entries.select("path_length").distinct().collect())  # no more than the longest path has characters
    words = build_filter(entries, "entry")
    sent = spark.sparkContext.broadcast(words)

    own = [c for c in pages.columns if c not in RESULTS]
    pages, plain = with_plain_names(pages)
    columns = [plain[c] for c in own]
    host, path = url_parts(F.col(plain[url]))
    parted = pages.select(*columns, host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("path"))
    asked = F.when(F.col("host") != "", F.flatten(F.transform(endings, lambda e: F.transform(fitting, lambda n: F.struct(
        F.concat(e, F.substring(F.col("path"), F.lit(1), n)).alias("entry"), F.length(e).alias("host_length"), n.alias("path_length"))))))

    @F.pandas_udf("array<boolean>")
    def passes(hashes):
        import pandas as pd

        sizes = hashes.map(len).to_numpy()
        flat = np.concatenate(hashes.to_list()).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
        return pd.Series(np.split(may_hold(sent.value, flat), np.cumsum(sizes)[:-1]))

    no_key = F.array().cast("array<struct<entry:string,host_length:int,path_length:int>>")
    probed = parted.withColumn("asked", F.coalesce(asked, no_key))
    passes = passes.asNondeterministic()  # keeps the optimizer from copying the call into later expressions
    probed = probed.withColumn("pass", passes(F.transform("asked", lambda a: F.xxhash64(a["entry"]))))
    probed = probed.withColumn("asked", F.transform(F.filter(F.arrays_zip("asked", "pass"), lambda z: z["pass"]), lambda z: z["asked"])).drop("pass")
    # the verdict depends on host and path alone, so a URL that a third of all rows hold is one row of each task's partial result
    possible = probed.filter(F.size("asked") > 0)
    # asked once for each of them: a host that a third of all rows share meets the list as one row
    once = possible.groupBy("host", "path").agg(F.first("asked").alias("asked"))
    fits = once.select("host", "path", F.inline("asked")).join(entries, ["entry", "host_length", "path_length"])
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("entry"), "host_length", "entry", "verdict")).alias("b"))
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("b.entry").alias("rule"), F.col("b.verdict").alias("found"))
    judged = possible.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").select(
        *columns, "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))
    unlisted = probed.filter(F.size("asked") == 0).select(*columns, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.unionByName(unlisted).select(*[F.col(c).alias(name) for c, name in zip(columns, own)], *RESULTS)


#: The entries of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
j AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM j WHERE n = 1
"""
