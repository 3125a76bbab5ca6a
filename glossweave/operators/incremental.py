"""What each (language, key) needs: one pass of outer joins, decided by a case expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.text import short_hash


def filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def per_language(left: DataFrame, right: DataFrame, on: str, how: str = "left") -> DataFrame:
    """``left.join(right, ["lang", on], how)``, dealt out by ``on`` alone.

    The rows of one key (or text) in all languages stay next to each other, and as they hold the same text, a shuffle or a written
    table packs them to little more than one of them. Dealt out by language as well, each would be moved whole. Every language
    of a key meets every language of it, so the work in memory grows with the square of the languages of a run.
    """
    r = right.withColumnRenamed("lang", "_lang").withColumnRenamed(on, "_on")
    # as an equality, the language would take part in the dealing out
    same = F.startswith("lang", "_lang") & F.startswith("_lang", "lang")
    j = left.join(r, (F.col(on) == F.col("_on")) & same, how)
    if how == "full_outer":
        j = j.withColumns({"lang": F.coalesce("lang", "_lang"), on: F.coalesce(on, "_on")})
    j = j.drop("_lang", "_on")
    return j.select("lang", on, *[c for c in j.columns if c not in ("lang", on)])


def corpus(existing: DataFrame, scanned: DataFrame) -> DataFrame:
    """Source bundle after a scan: the scan overrides, nothing is deleted."""
    j = existing.select("key", F.col("text").alias("old")).join(scanned.select("key", F.col("text").alias("new")), "key", "full_outer")
    origin = (
        F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "old")
        .when(F.col("old") == F.col("new"), "both").otherwise("changed")
    )
    return j.select("key", F.coalesce("new", "old").alias("text"), origin.alias("origin"))


def decide(units: DataFrame, target: DataFrame, state: DataFrame, forced: bool = False) -> DataFrame:
    """units(lang, key, text[, changed]) -> state HUMAN / NEED(reason) / CURRENT, first match wins.

    An unknown state row means neither stale nor human-edited.
    """
    j = per_language(units, target.select("lang", "key", F.col("value").alias("current")), "key")
    j = per_language(j, state.select("lang", "key", "source_hash", "translation_hash"), "key")
    human = filled("current") & filled("translation_hash") & (
        F.col("translation_hash") != short_hash(F.col("current"), fixed.STATE_HASH_CHARS)
    )
    changed = F.col("changed") if "changed" in units.columns else F.lit(False)
    stale = filled("source_hash") & (F.col("source_hash") != short_hash(F.col("text"), fixed.STATE_HASH_CHARS))
    reason = F.when(F.lit(forced), "Forced").when(~filled("current"), "Missing").when(changed | stale, "SourceChanged")
    return j.withColumn("state", F.when(human, "HUMAN").when(reason.isNotNull(), "NEED").otherwise("CURRENT")).withColumn(
        "reason", F.when(~human, reason)
    ).drop("source_hash", "translation_hash")


def learn(decided: DataFrame, approved: DataFrame) -> DataFrame:
    """Approved wordings plus every human edit of this run, before anything is reused: free of row order.

    One wording per (language, source text): an edit beats an earlier approval, then the latest, then the lowest text.
    """
    edits = decided.filter("state = 'HUMAN'").select("lang", F.col("text").alias("source_text"), F.col("current").alias("wording"), F.lit(1).alias("_edit"), F.lit(0).cast("long").alias("ord"))
    every = edits.unionByName(approved.select("lang", "source_text", "wording", F.lit(0).alias("_edit"), F.col("ord").cast("long")))
    best = F.max_by("wording", F.struct("_edit", "ord", "wording"))
    return every.groupBy("lang", "source_text").agg(best.alias("wording"), F.max("ord").alias("ord"))


def reuse(decided: DataFrame, approved: DataFrame) -> DataFrame:
    """Needed rows answered from approved wordings: REUSED, the others SEND."""
    a = approved.select("lang", F.col("source_text").alias("text"), "wording")
    j = per_language(decided, a, "text")
    action = F.when(F.col("state") != "NEED", F.col("state")).when(F.col("wording").isNotNull(), "REUSED").otherwise("SEND")
    return j.withColumn("action", action)


def top_examples(approved: DataFrame, limit: int = fixed.EXAMPLES) -> DataFrame:
    """Shortest approved sources per language; the rank filter is applied inside each task before the shuffle."""
    from pyspark.sql import Window as W

    w = W.partitionBy("lang").orderBy(F.length("source_text"), "ord", "source_text")
    return approved.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def prompt_examples(approved: DataFrame, limit: int = fixed.EXAMPLES) -> dict[str, tuple[tuple[str, str], ...]]:
    """The examples a request carries, by language: ``limit`` of each, so the driver holds a bounded table."""
    out: dict[str, list] = {}
    for r in top_examples(approved, limit).select("lang", "rank", "source_text", "wording").orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append((r["source_text"], r["wording"]))
    return {lang: tuple(rows) for lang, rows in out.items()}


def outcomes(actions: DataFrame) -> DataFrame:
    reason = lambda r: F.count_if((F.col("action") == "SEND") & (F.col("reason") == r))
    return actions.groupBy("lang").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("action") == "CURRENT").alias("already"),
        F.count_if(F.col("action") == "HUMAN").alias("human_edited"),
        F.count_if(F.col("action") == "REUSED").alias("reused"),
        reason("Missing").alias("sent_missing"), reason("SourceChanged").alias("sent_changed"), reason("Forced").alias("sent_forced"),
    )


def final_values(actions: DataFrame, translated: DataFrame | None = None) -> DataFrame:
    """New translation wins, then a reused wording, then what was there.

    Without ``translated`` the actions have their translation with them, and nothing is moved.
    """
    j = actions if translated is None else actions.join(translated.select("lang", "key", "translation"), ["lang", "key"], "left")
    value = F.coalesce("translation", F.when(F.col("action") == "REUSED", F.col("wording")), "current")
    return j.select("lang", "key", "text", value.alias("value"), "action")


def new_state(final: DataFrame, old: DataFrame) -> DataFrame:
    """State upsert: rows the tool wrote are replaced, others kept."""
    written = final.filter(F.col("action").isin("SEND", "REUSED") & filled("value")).select(
        "lang", "key", short_hash(F.col("text"), fixed.STATE_HASH_CHARS).alias("source_hash"),
        short_hash(F.col("value"), fixed.STATE_HASH_CHARS).alias("translation_hash"),
    )
    return upsert(old, written, ["lang", "key"])


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    rest = [c for c in old.columns if c not in on]
    a, b = old.select(*on, F.struct(*rest).alias("_o")), new.select(*on, F.struct(*rest).alias("_n"))
    return _met(a, b, on).select(*on, F.coalesce("_n", "_o").alias("_v")).select(*on, "_v.*")


def _met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return per_language(a, b, on[1], "full_outer") if len(on) == 2 and on[0] == "lang" else a.join(b, on, "full_outer")


def merge(existing: DataFrame, incoming: DataFrame, on: list[str]) -> DataFrame:
    """Bundle merge: never deletes; status says what happened to each entry."""
    j = _met(existing.select(*on, F.col("value").alias("old")), incoming.select(*on, F.col("value").alias("new")), on)
    status = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "kept")
        .when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    )
    return j.select(*on, F.coalesce("new", "old").alias("value"), status.alias("status"))


def merge_counts(merged: DataFrame, group: list[str]) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return merged.groupBy(*group).agg(*[count(s) for s in ("added", "updated", "unchanged", "kept")])


def orphans(existing: DataFrame, scanned: DataFrame) -> DataFrame:
    """Keys in the bundle that no scanned text uses."""
    return existing.join(scanned.select("key").distinct(), "key", "left_anti")
