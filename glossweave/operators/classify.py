"""Verdicts for distinct texts: cache probe, batched questions, verdict split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import fixed
from ..functions.text import same_placeholders, short_hash
from . import provider as pv
from .dedupe import first_occurrence
from .incremental import per_language


def verdict_cache_key(text="text", fingerprint=""):
    return short_hash(F.concat(F.lit(fingerprint + "\u0000"), F.col(text)), fixed.CACHE_HASH_CHARS)


def cache_hits(texts: DataFrame, cache: DataFrame, on: str) -> DataFrame:
    return texts.join(cache.select(on).distinct(), on, "left_semi")


def cache_misses(texts: DataFrame, cache: DataFrame, on: str) -> DataFrame:
    return texts.join(cache.select(on).distinct(), on, "left_anti")


def classify(candidates: DataFrame, order: list[str], cache: DataFrame | None, model: pv.Provider, fingerprint: str = "", size: int = fixed.BATCH_SIZE, concurrency: int | None = None):
    """(verdicts, fresh cache rows, answers). Texts without an answer are 'no_verdict' and not cached."""
    texts = first_occurrence(candidates, "text", order, ["context"]).withColumn("text_hash", verdict_cache_key("text", fingerprint))
    known = cache.select("text_hash", "user_facing", "reason", "proposed_key") if cache is not None else None
    pending = cache_misses(texts, cache, "text_hash") if cache is not None else texts
    answers = pv.ask(pending.select(F.col("text_hash").alias("id"), "text", "context"), lambda m, batch: m.classify(batch), size, concurrency, model)
    fresh = answers.filter("error is null").select(F.col("id").alias("text_hash"), "user_facing", "reason", "proposed_key")
    verdicts = texts.join(known.unionByName(fresh) if known is not None else fresh, "text_hash", "left")
    label = F.when(F.col("user_facing").isNull(), "no_verdict").when(F.col("user_facing"), "localized").otherwise("rejected")
    return verdicts.withColumn("label", label), fresh, answers


def split_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every candidate with its verdict. A hot text is a skewed key: adaptive execution splits it."""
    return candidates.join(verdicts.select("text", "label", "reason", "proposed_key"), "text")


def questions(units: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """(lang, text, context) of units: each text once a language, with its lowest context.

    ``languages``: those of the run. Their rows are gathered by text alone, a text moves once for all of them; rows in other
    languages are gathered by language and text.
    """
    low = F.min("context").alias("context")
    if not languages:
        return units.groupBy("lang", "text").agg(low)
    listed = F.coalesce(F.col("lang").isin(languages), F.lit(False))
    own = [F.col("lang") == x for x in languages]
    per_text = units.filter(listed).groupBy("text").agg(*[x for i, c in enumerate(own) for x in (
        F.max(F.when(c, True)).alias(f"_there{i}"), F.min(F.when(c, F.col("context"))).alias(f"_context{i}"))])
    cells = F.array(*[F.struct(F.lit(x).alias("lang"), F.col(f"_there{i}").alias("_there"), F.col(f"_context{i}").alias("context")) for i, x in enumerate(languages)])
    out = per_text.select("text", F.inline(cells)).filter("_there").select("lang", "text", "context")
    return out.unionByName(units.filter(~listed).groupBy("lang", "text").agg(low))


def translate(units: DataFrame, cache: DataFrame | None, model: pv.Provider, forced: bool = False, size: int = fixed.BATCH_SIZE, concurrency: int | None = None, languages: list[str] | None = None):
    """units(lang, key, text, context) -> (lang, key, text, translation, status).

    One question per (language, text); the answer fans out to every key. Forced runs do not read the cache. Answers have their text
    with them, so they meet the units by text, and questions are not moved again for them. ``languages``: see :func:`questions`.
    """
    asked = questions(units, languages)
    asked = asked.withColumn("id", short_hash(F.concat(F.col("lang"), F.lit("\u0000"), F.col("text")), fixed.CACHE_HASH_CHARS))
    use_cache = cache is not None and not forced
    pending = asked.join(cache.select("id").distinct(), "id", "left_anti") if use_cache else asked

    def call(m, batch):
        out, used = [], (0, 0)
        for lang in sorted({r["lang"] for r in batch}):
            m.usage = (0, 0)
            try:
                out += m.translate([r for r in batch if r["lang"] == lang], lang)
            finally:
                used = (used[0] + m.usage[0], used[1] + m.usage[1])
                m.usage = used
        return out

    answers = pv.ask(pending.select("id", "text", "context", "lang"), call, size, concurrency, model, carry=("lang", "text"))
    given = answers.select("id", "lang", "text", "translation", "error")
    if use_cache:
        known = asked.select("id", "lang", "text").join(cache.select("id", "translation"), "id")
        given = given.unionByName(known.withColumn("error", F.lit(None).cast("string")))
    fresh = given.withColumn("status", _status()).filter("status = 'ok'").select("id", "translation")
    named = units.filter("lang IS NOT NULL AND text IS NOT NULL")
    out = per_language(named, given.drop("id"), "text").withColumn("status", _status()).drop("error")
    return out, fresh, answers.drop("lang", "text")


def _status():
    return (
        F.when(F.col("error").isNotNull(), "failed")
        .when(F.coalesce("translation", F.lit("")) == "", "unanswered")
        .when(~same_placeholders(F.col("text"), F.col("translation")), "placeholders_differ")
        .otherwise("ok")
    )
