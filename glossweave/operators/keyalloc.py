"""Unique keys: each text in scan order takes its base key, else the smallest free suffix from 2 up.

The rule is sequential. It is also a matching in which every key prefers the earliest text, and such a matching
is unique, so it can be reached from any side by moves that are forced: a text leaves a key only for an earlier one.

* The k-th text of a base cannot stand before the k-th key of its base.
* A key that is reserved, or held by an earlier text of another base, is passed over by the text that would reach it.
* A text never stands before an earlier text of its own base.

Rounds of such moves repeat until no key has two takers. Ranks and counts are running sums over a range-partitioned
order, so no stem, however large, is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .ordering import ranged, running, with_group_rank


def stem(c: Column) -> Column:
    return F.regexp_replace(c, r"[0-9]+$", "")


def _readings(key: str) -> Column:
    """Every (base, number) that could produce this key; number 1 stands for the bare base.

    A suffix has no leading zero, is at least 2 and fits a long.
    """
    digits = F.length(F.regexp_extract(key, r"([0-9]*)$", 1))
    k, n_chars = F.col(key), F.length(key)
    splits = F.transform(
        F.sequence(F.lit(0), F.least(digits, F.lit(18))),
        lambda n: F.struct(F.substring(k, F.lit(1), n_chars - n).alias("base"), F.substring(k, n_chars - n + 1, n).alias("tail")),
    )
    usable = F.filter(splits, lambda s: (s.tail == "") | s.tail.rlike("^([2-9]|[1-9][0-9]+)$"))
    return F.transform(
        usable, lambda s: F.struct(s.base.alias("base"), F.when(s.tail == "", F.lit(1)).otherwise(s.tail.try_cast("long")).cast("long").alias("number"))
    )


def allocate(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """requests(text, base, ord) with unique text and ord; existing(key). Returns (text, base, key)."""
    ranked = materialise(with_group_rank(requests.select("text", "base", "ord"), "base", ["ord"], "k", "requests"), "ranked", packed=True)
    bases = ranked.select("base").distinct()
    reserved = materialise(existing.select(F.inline(_readings("key"))).join(bases, "base", "left_semi").distinct(), "reserved")
    start = ranked.withColumn("gap", F.lit(0).cast("long"))
    if not reserved.isEmpty():
        start = _pass_over(start, _blockers(reserved, None, start))
    placed = materialise(_with_key(start), "keys", packed=True)
    clash = _losers(placed, reserved)
    if clash.isEmpty():
        return placed.select("text", "base", "key")
    # two bases can only meet inside one stem; every other stem is done
    open_stems = placed.join(clash, "text", "left_semi").select(stem(F.col("base")).alias("_stem")).distinct()
    with_stem = placed.withColumn("_stem", stem(F.col("base")))
    done = with_stem.join(open_stems, "_stem", "left_anti").select("text", "base", "key")
    moving = materialise(with_stem.join(open_stems, "_stem", "left_semi").drop("_stem"), "moving", packed=True)
    return done.unionByName(_settle(moving, reserved).select("text", "base", "key"))


def _with_key(df: DataFrame) -> DataFrame:
    number = F.col("k") + F.col("gap")
    return df.withColumn("number", number).withColumn("key", F.concat("base", F.when(number == 1, F.lit("")).otherwise(number.cast("string"))))


def _losers(placed: DataFrame, reserved: DataFrame) -> DataFrame:
    """Texts on a reserved key, or on the key of an earlier text."""
    first = placed.groupBy("key").agg(F.min("ord").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    later = placed.join(first, "key").filter("ord > _first").select("text")
    return later.unionByName(placed.join(reserved, ["base", "number"], "left_semi").select("text")).distinct()


def _blockers(reserved: DataFrame, held: DataFrame | None, requests: DataFrame) -> DataFrame:
    """(base, number, fixed, holder): reserved numbers, and numbers held by texts of other bases."""
    kind = requests.schema["ord"].dataType
    out = reserved.select("base", "number", F.lit(True).alias("fixed"), F.lit(None).cast(kind).alias("holder"))
    if held is not None:
        readings = held.select(F.col("base").alias("_own"), "ord", F.inline(_readings("key")))
        foreign = readings.filter("base <> _own").join(requests.select("base").distinct(), "base", "left_semi")
        out = out.unionByName(foreign.select("base", "number", F.lit(False).alias("fixed"), F.col("ord").alias("holder")))
    return out.groupBy("base", "number").agg(F.bool_or("fixed").alias("fixed"), F.min("holder").alias("holder"))


def _pass_over(requests: DataFrame, blockers: DataFrame) -> DataFrame:
    """Sets ``gap``: how many blocked numbers each text passes over.

    The text that reaches number n is the one of rank n minus the blocked numbers before n, and it passes over n
    when the holder is earlier. Counting first with the latest text that could reach n counts too many, so the
    second count, which starts from it, never counts too many: every move it makes is forced.
    """
    times = requests.select("base", F.col("k").alias("_slot"), F.col("ord").alias("_t"))

    def at(df: DataFrame, slot: Column) -> DataFrame:
        return df.withColumn("_slot", slot).join(times, ["base", "_slot"], "left").drop("_slot")

    many = at(blockers, F.col("number")).withColumn("_n", F.when(F.col("fixed") | F.col("_t").isNull() | (F.col("holder") < F.col("_t")), 1).otherwise(0)).drop("_t")
    counted = running(ranged(many, ["base", "number"], "blockers"), "base", "_n", "_before", F.sum)
    sure = at(counted, F.col("number") - (F.col("_before") - F.col("_n")))
    sure = sure.filter(F.col("fixed") | F.coalesce(F.col("holder") < F.col("_t"), F.lit(False))).select("base", "number")
    # with passed numbers n_1 < n_2 < ..., n_i - i texts stand before n_i: a running count over both lists merged
    marks = with_group_rank(sure, "base", ["number"], "i", "passed")
    marks = marks.select("base", ((F.col("number") - F.col("i")) * 2 + 1).alias("v"), F.col("i").alias("u"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("mark"))
    asks = requests.select("base", (F.col("k") * 2).alias("v"), F.col("k").alias("u"), "text", F.lit(0).alias("mark"))
    merged = running(ranged(marks.unionByName(asks), ["base", "v", "u"], "merged", written=True), "base", "mark", "_passed", F.sum)
    passed = merged.filter("mark = 0").select("text", F.col("_passed").alias("_gap"))
    return requests.join(passed, "text").withColumn("gap", F.greatest("gap", "_gap")).drop("_gap")


def _settle(keyed: DataFrame, reserved: DataFrame) -> DataFrame:
    while True:
        lost = materialise(_losers(keyed, reserved).withColumn("_lost", F.lit(1)), "losers")
        if lost.isEmpty():
            return keyed
        moved = keyed.join(lost, "text", "left").withColumn("gap", F.col("gap") + F.coalesce("_lost", F.lit(0))).drop("_lost", "number", "key")
        moved = _pass_over(moved, _blockers(reserved, keyed, keyed))
        moved = running(moved, "base", "gap", "_lead").withColumn("gap", F.col("_lead")).drop("_lead")
        keyed = materialise(_with_key(moved), "round", packed=True)
