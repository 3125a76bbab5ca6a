"""Resource-key naming."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed


def _upper_char(ch: Column) -> Column:
    """One character to one character: a letter without a single capital (sharp s) stays as it is."""
    return F.when(F.length(F.upper(ch)) == 1, F.upper(ch)).otherwise(ch)


def _pascal(words: Column) -> Column:
    return F.array_join(
        F.transform(words, lambda w: F.concat(_upper_char(F.substring(w, 1, 1)), F.substring(w, 2, 2147483647))), ""
    )


def _prefix_digit(c: Column) -> Column:
    return F.when(c.rlike(r"^\p{N}"), F.concat(F.lit(fixed.DIGIT_PREFIX), c)).otherwise(c)


def sanitize_key(c: Column) -> Column:
    """Separators become word boundaries; a leading digit gets a letter; empty when nothing is left."""
    words = F.filter(F.split(c, fixed.NOT_KEY_CHAR + "+"), lambda w: w != "")
    return _prefix_digit(_pascal(words))


def key_from_text(c: Column) -> Column:
    """The first words with a letter or digit, each lower-cased but for its start; a mark inside a word starts a new capital."""
    words = F.slice(F.filter(F.split(c, fixed.WORD_SEPARATOR), lambda w: w.rlike(fixed.KEY_CHAR)), 1, fixed.KEY_WORDS)
    parts = F.flatten(F.transform(words, lambda w: F.filter(F.split(F.lower(w), fixed.NOT_KEY_CHAR + "+"), lambda p: p != "")))
    return _prefix_digit(_pascal(parts))


def reserve(c: Column) -> Column:
    """Names that a generated accessor already uses get a suffix."""
    return F.when(c.isin(*fixed.RESERVED_MEMBERS), F.concat(c, F.lit("Text"))).otherwise(c)


def base_key(text: Column, proposed: Column | None = None) -> Column:
    """Proposal if usable, else words of the text, else the default."""
    options = [F.nullif(key_from_text(text), F.lit("")), F.lit(fixed.DEFAULT_KEY)]
    if proposed is not None:
        options.insert(0, F.nullif(sanitize_key(proposed), F.lit("")))
    return reserve(F.coalesce(*options))


def lower_snake(c: Column) -> Column:
    """Android resource name. Idempotent."""
    s = F.regexp_replace(c, r"([\p{Ll}\p{N}])(\p{Lu})", "$1_$2")
    s = F.regexp_replace(s, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1_$2")
    s = F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_]+", "_")
    s = F.regexp_replace(F.regexp_replace(s, r"_+", "_"), r"^_|_$", "")
    s = F.when(s == "", F.lit("text")).otherwise(s)
    s = F.when(s.rlike(r"^\p{N}"), F.concat(F.lit("k_"), s)).otherwise(s)
    return F.when(s.isin(*fixed.KOTLIN_JAVA_KEYWORDS), F.concat(s, F.lit("_text"))).otherwise(s)


def lower_camel(c: Column) -> Column:
    """Dart member name: a leading capital run is lowered, the last capital of an acronym starts a word."""
    run = F.regexp_extract(c, r"^(\p{Lu}+)(?:[^\p{Lu}]|$)", 1)
    keep = F.when((F.length(run) > 1) & (F.length(run) < F.length(c)) & F.substring(c, F.length(run) + 1, F.lit(1)).rlike(r"\p{L}"), F.length(run) - 1).otherwise(F.length(run))
    return F.concat(F.lower(F.substring(c, F.lit(1), keep)), F.substring(c, keep + 1, F.lit(2147483647)))


def legal_member(c: Column, taken: list[str] | None = None) -> Column:
    ok = c.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$")
    return ok & ~c.isin(*(taken or fixed.RESERVED_MEMBERS))
