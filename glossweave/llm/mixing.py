"""Mixing sources to target weights by nested hash thresholds, with built-in expressions only.

Every document gets a fixed 60-bit hash of its id. A source's share of the mix is the set of its documents whose hash
lies below the source's threshold, so no sort is needed: sizes are summed by source and hash bucket, the bucket in which
the budget runs out is found, and only that bucket is summed again at the next 15 bits, until the threshold is one
hash value. Thresholds for a larger budget are supersets (nested): a document taken once stays taken when the budget grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from glossweave.llm.rows import with_plain_names
from glossweave.session import materialise

HASH_BITS, LEVEL_BITS = 60, 15
WORD = r"[^\x20\x09-\x0D]+"
RESULTS = ["size", "source_size", "target", "repeats", "taken"]


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(key: Column) -> Column:
    """The first 60 bits of the md5 of the key as text (null: of the empty text). Any engine with md5 can repeat it."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, source: str, weights: tuple[int, ...], cap: int) -> DataFrame:
    """(source, source_size) → + (weight, target): the total of all sizes, dealt by weight, at most cap times a source's size.

    Sources in order of code points, null last, take the weights in turn. What a capped source leaves goes to the others
    by weight until none is above its cap. That is one level λ with target = min(λ · weight, cap · size): with sources in
    order of cap · size / weight, λ follows from running sums. One row per source; the sums are of whole numbers.
    """
    by_name = W.orderBy(F.col(source).asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", w.cast("long"))
    order = [F.col("source_size") * F.lit(cap) / F.col("weight"), F.col(source).asc_nulls_last()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    summed = ranked.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
        F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)).alias("capped_before"))
    level = (F.col("total") - F.col("capped_before")).cast("double") / F.col("weight_left")
    # the first source, in that order, whose cap lies above the level: from it on all share by weight
    free = F.min(F.when(level * F.col("weight") <= (F.col("source_size") * cap).cast("double"), F.struct(F.col("capped_before"), level.alias("level")))).over(everything)
    at = summed.withColumn("free", free)
    target = F.when(F.col("free").isNull() | (F.col("capped_before") < F.col("free.capped_before")), (F.col("source_size") * cap).cast("double")).otherwise(
        F.least(F.col("free.level") * F.col("weight"), (F.col("source_size") * cap).cast("double")))
    return at.select(source, "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Columns of docs + size, source_size, target, repeats, taken: how often each document enters the mix.

    A document is taken ``floor(target / source_size)`` times, and once more if its hash lies below its source's threshold,
    never more than ``cap`` times. The boundary document is taken if that brings the source nearer to its target.

    Null source: a source of its own, last in order. Null key: hashed like the empty text. Null, empty or white-space text:
    size 0, taken 0 whatever its repeats. Rows with the same key and source share a hash and are taken or left together.
    Empty table: empty result. A source whose sizes are all 0 has target 0. An input column named like a result is replaced;
    all others come back as they are, whatever their names.
    """
    own = [c for c in docs.columns if c not in RESULTS]
    docs, plain = with_plain_names(docs)
    key, text, source = plain[key], plain[text], plain[source]
    columns = [plain[c] for c in own]
    narrow = docs.select(F.col(source).alias("mix_source"), hash60(F.col(key)).alias("h"), word_count(F.col(text)).alias("size"))
    narrow = materialise(narrow, "mix-sizes")
    goals = targets(narrow.groupBy("mix_source").agg(F.sum("size").alias("source_size")), "mix_source", weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("base", F.least(F.floor(ratio), F.lit(cap)).cast("long"))
    goals = materialise(goals.withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")), "mix-goals")

    # state: per source the threshold's known high bits, and the words below them
    state = goals.select("mix_source", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("below"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        width = 1 << shift
        inside = narrow if shift == HASH_BITS - LEVEL_BITS else _same(narrow, state.select("mix_source", "low")).filter(
            (F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(width << LEVEL_BITS)))
        buckets = inside.groupBy("mix_source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        running = buckets.withColumn("upto", F.sum("words").over(W.partitionBy("mix_source").orderBy("bucket")))
        # the first bucket with which the words exceed the budget
        crossing = _same(running, state).filter(F.col("below") + F.col("upto") > F.col("budget")).groupBy("mix_source").agg(
            F.min(F.struct("bucket", "words", "upto")).alias("b"))
        state = _same(state, crossing, "left").select(
            "mix_source", "budget",
            F.when(F.col("b").isNull(), F.lit(1 << HASH_BITS)).otherwise(F.col("b.bucket") * F.lit(width)).cast("long").alias("low"),
            F.when(F.col("b").isNull(), F.col("below")).otherwise(F.col("below") + F.col("b.upto") - F.col("b.words")).alias("below"),
            F.coalesce(F.col("b.words"), F.lit(0).cast("long")).alias("edge"))
        state = materialise(state, "mix-level")
    nearer = (F.col("below") + F.col("edge") - F.col("budget")) < (F.col("budget") - F.col("below"))
    cut = state.select("mix_source", F.when((F.col("edge") > 0) & nearer, F.col("low") + 1).otherwise(F.col("low")).alias("cut"))
    # written, so that Spark knows its size: it is broadcast if that is below the session's limit, and texts stay in place
    plan = materialise(_same(goals, cut).select("mix_source", "source_size", "target", "base", "cut"), "mix-plan")

    sized = docs.select(*columns, word_count(F.col(text)).alias("size"), hash60(F.col(key)).alias("mix_hash"), F.col(source).alias("mix_source"))
    extra = ((F.col("mix_hash") < F.col("cut")) & (F.col("base") < cap)).cast("long")
    return _same(sized, plan).withColumn("repeats", F.col("base") + extra).select(
        *[F.col(c).alias(name) for c, name in zip(columns, own)], "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def _same(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on mix_source with null equal to null; the right side has a row per source, so a hot source never multiplies."""
    r = right.withColumnRenamed("mix_source", "mix_source_r")
    shared = [c for c in r.columns if c in left.columns]
    return left.join(r.drop(*shared), left["mix_source"].eqNullSafe(r["mix_source_r"]), how).drop("mix_source_r")


#: The same mix by sorting: every source's documents in order of hash, taken while the running sum stays within the budget.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM s),
c AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS BIGINT) AS weight_left,
    CAST(coalesce(sum(3 * source_size) OVER p, 0) AS BIGINT) AS capped_before
  FROM w WINDOW p AS (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CAST(total - capped_before AS DOUBLE) / weight_left AS level FROM c),
f AS (SELECT min(capped_before) AS free_at, arg_min(level, (capped_before, level)) AS free_level FROM v WHERE level * weight <= CAST(source_size * 3 AS DOUBLE)),
t AS (
  SELECT source, source_size,
    CASE WHEN free_at IS NULL OR capped_before < free_at THEN CAST(source_size * 3 AS DOUBLE)
         ELSE least(free_level * weight, CAST(source_size * 3 AS DOUBLE)) END AS target
  FROM v, f),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS base FROM t),
b AS (SELECT *, target - base * source_size AS budget FROM g),
r AS (
  SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
k AS (
  SELECT r.source, h, words, budget, sum(words) OVER (PARTITION BY r.source ORDER BY h) AS upto
  FROM r JOIN b ON r.source IS NOT DISTINCT FROM b.source),
e AS (
  SELECT source, arg_min(CASE WHEN words > 0 AND upto - budget < budget - (upto - words) THEN h + 1 ELSE h END, h) AS cut
  FROM k WHERE upto > budget GROUP BY source)
SELECT d.doc_id, d.size, b.source_size, b.target,
  CAST(d.size * (base + CASE WHEN base < 3 AND d.h < coalesce(e.cut, CAST(1 AS BIGINT) << 60) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
