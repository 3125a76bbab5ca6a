"""Value escaping for the five bundle formats, both ways, as replace chains.

Unescaping walks escape tokens (``\\x`` pairs) instead of replacing one escape after another, so
``\\\\n`` (an escaped backslash and an n) is never mistaken for a line break.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .text import extract_all


def _chain(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _once(c: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(c), then), 1)


XML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
XML_UNESCAPES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]
ANDROID_ESCAPES = [("\\", "\\\\"), ("\r", ""), ("\n", "\\n"), ("\t", "\\t"), ('"', '\\"'), ("'", "\\'")]
APPLE_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\r\n", "\\n"), ("\r", "\\n"), ("\n", "\\n"), ("\t", "\\t")]


def escape_xml(c: Column) -> Column:
    return _chain(c, XML_ESCAPES)


def escape_xml_attribute(c: Column) -> Column:
    return _chain(c, XML_ESCAPES + [('"', "&quot;")])


def unescape_xml(c: Column) -> Column:
    return _chain(c, XML_UNESCAPES)


def escape_android(c: Column) -> Column:
    """Backslash layer only; the XML layer goes on top."""
    s = _once(_chain(c, ANDROID_ESCAPES), lambda t: F.when(t.rlike(r"^[@?]"), F.concat(F.lit("\\"), t)).otherwise(t))
    # leading or trailing blanks survive only inside quotes
    return _once(s, lambda t: F.when(t.rlike(r"^ | $| {2}"), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t))


def escape_apple(c: Column) -> Column:
    return _chain(c, APPLE_ESCAPES)


def _unescape(c: Column, special: dict[str, str]) -> Column:
    def one(t: Column) -> Column:
        out = F.when(t.rlike(r"^\\u[0-9A-Fa-f]{4}"), F.decode(F.unhex(F.replace(t, F.lit("\\u"), F.lit(""))), "UTF-16BE"))
        for old, new in special.items():
            out = out.when(t == old, F.lit(new))
        return out.when(t.rlike(r"(?s)^\\.$"), F.substring(t, 2, 1)).otherwise(t)

    # between escaped backslashes every backslash starts an escape, so replacing one after another mistakes none for another
    def plain(t: Column) -> Column:
        return F.regexp_replace(_chain(t, list(special.items())), r"(?s)\\(.)", "$1")

    def whole(t: Column) -> Column:
        # runs of \\uXXXX stay together so that surrogate pairs decode as one character
        tokens = extract_all(t, r"(?s)(?:\\u[0-9A-Fa-f]{4})+|\\.|[^\\]+|\\", 0)
        pairs = F.array_join(F.transform(F.split(t, r"\\\\", -1), plain), "\\")
        # most texts hold no escape; only those with code points are cut into all their tokens
        return F.when(~F.contains(t, F.lit("\\")), t).when(F.contains(t, F.lit("\\u")), F.array_join(F.transform(tokens, one), "")).when(
            F.contains(t, F.lit("\\\\")), pairs).otherwise(plain(t))

    return _once(c, whole)


def unescape_android(c: Column) -> Column:
    def inner(t: Column) -> Column:
        return F.when(t.rlike(r'(?s)^".*[^\\]"$'), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)

    return _unescape(_once(c, inner), {"\\n": "\n", "\\t": "\t"})


def unescape_apple(c: Column) -> Column:
    return _unescape(c, {"\\n": "\n", "\\t": "\t", "\\r": "\r"})


def unescape_code(c: Column) -> Column:
    """C-style literal body."""
    return _unescape(c, {"\\n": "\n", "\\t": "\t", "\\r": "\r", "\\0": "\u0000", "\\b": "\b", "\\f": "\f"})
