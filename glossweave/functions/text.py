"""Column -> Column text helpers. No UDF: everything stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed


def trim_ws(c: Column) -> Column:
    return F.trim(c, F.lit(fixed.WS))


def extract_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def blank(c: Column) -> Column:
    """Same length, line breaks kept."""
    return F.regexp_replace(c, r"[^\r\n]", " ")


def mask(c: Column, region: str) -> Column:
    """Overwrite every match of ``region`` with spaces, in one linear pass.

    The text is cut into matches and the stretches between them; only matches are blanked.
    ``split`` gives the stretches and ``regexp_extract_all`` the matches, so nothing is located twice.
    """
    gaps = F.split(c, region, -1)
    hits = F.concat(F.transform(extract_all(c, region), blank), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, h)), "")


def mask_outside(c: Column, region: str) -> Column:
    """Keep the matches of ``region`` live and blank the rest."""
    gaps = F.transform(F.split(c, region, -1), blank)
    hits = F.concat(extract_all(c, region), F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, h)), "")


def line_breaks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def decode_entities(c: Column, nbsp: bool = True) -> Column:
    """Short fixed list, ampersand first; anything else stays encoded."""
    pairs = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")]
    if nbsp:
        pairs.append(("&nbsp;", " "))
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def one_line(c: Column) -> Column:
    """Line breaks to spaces, runs of spaces collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", " "), " {2,}", " "))


def snippet(c: Column, start: Column, length: Column, before: int, after: int) -> Column:
    """Context window round a 1-based span."""
    first = F.greatest(F.lit(1), start - before)
    return one_line(F.substring(c, first, start + length + after - first))


def preview(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def report_cell(c: Column, limit: int = fixed.REPORT_CELL) -> Column:
    cell = F.trim(F.replace(F.regexp_replace(c, r"[\r\n]+", " "), F.lit("|"), F.lit("\\|")))
    return F.when(F.coalesce(cell, F.lit("")) == "", F.lit("—")).otherwise(preview(cell, limit))


def short_hash(c: Column, chars: int) -> Column:
    """Upper-case hex prefix of SHA-256."""
    return F.upper(F.substring(F.sha2(c, 256), 1, chars))


def fingerprint(model: Column, source_lang: Column, context: Column, glossary: Column, diagnostics: Column) -> Column:
    """NUL-joined prompt identity; a change makes every cached answer unreachable."""
    joined = F.concat_ws(
        "\u0000", model, source_lang, context, F.array_join(F.array_sort(glossary), ","), diagnostics.cast("string")
    )
    return short_hash(joined, fixed.CACHE_HASH_CHARS)


def placeholders(c: Column) -> Column:
    """Sorted multiset of placeholders."""
    return F.array_sort(F.transform(extract_all(c, fixed.PLACEHOLDER), lambda p: F.regexp_replace(p, r"^[^:{%$]*:", ":")))


def same_placeholders(a: Column, b: Column) -> Column:
    return placeholders(a) == placeholders(b)


def many_unnumbered_arguments(c: Column) -> Column:
    return F.size(extract_all(F.replace(c, F.lit("%%"), F.lit("")), fixed.PRINTF_UNNUMBERED)) > 1


def re2(pattern: str) -> str:
    """The same pattern without possessive marks, for engines that never backtrack."""
    return pattern.replace("*+", "*").replace("++", "+").replace("?+", "?")
