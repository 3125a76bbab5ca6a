"""Merging into bundles that exist, without touching anything else: entries by position, and pieces of text.

A file is cut into pieces that together are the file, byte for byte: for each entry the text before its value and the value as it
stands, and what is left behind the last one. A merge replaces values in their pieces and puts new entries between pieces, in the
file's own line ending and indentation, so a merge of nothing gives the file back. Entries are rows: they meet their new values
in a join, and the pieces of a large bundle are made by many tasks.
"""

from __future__ import annotations

import html
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import escapes as esc
from ..functions.text import many_unnumbered_arguments
from ..session import materialise
from . import bundles as b

XML = re.compile(r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>]*>|<(?P<end>/)?(?P<name>[A-Za-z_][\w:.-]*)(?P<attributes>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
NAME = re.compile(r"(?:^|\s)name\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
CDATA = re.compile(r"(?s)<!\[CDATA\[(.*?)\]\]>")
APPLE = re.compile(r"(?s)(?P<skip>\s+|/\*.*?\*/|//[^\n]*)|\"(?P<quoted>[^\"\\]*+(?:\\.[^\"\\]*+)*+)\"|(?P<bare>[\w.-]+)|(?P<c>.)")
#: A whole pair without comments in it, read at once where one may start.
APPLE_PAIR = re.compile(r"(?s)\s*+\"([^\"\\]*+(?:\\.[^\"\\]*+)*+)\"\s*+=\s*+\"([^\"\\]*+(?:\\.[^\"\\]*+)*+)\"\s*+;")
APPLE_ESCAPE = re.compile(r"(?s)\\(?:[uU]([0-9A-Fa-f]{4})|(.))")
JSON_STRING = re.compile(r"(?s)\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"")
JSON_BREAK = re.compile(r"(?s)[^\"{}\[\],]*+(?:(\"(?:[^\"\\]|\\.)*+\")|(.))")
BLANK = re.compile(r"\s*")


@dataclass
class Entry:
    key: str
    value: str | None   # None: no text, such as a nested object
    start: int          # of the value as it stands
    end: int
    style: str = ""     # "cdata": the value is one character data section


def decode_xml(raw: str) -> str:
    """Text of an element: character data as it is, references decoded, markup left in place, line endings as XML reads them."""
    out, at = [], 0
    for m in CDATA.finditer(raw):
        out += [html.unescape(raw[at:m.start()]), m[1]]
        at = m.end()
    return "".join(out + [html.unescape(raw[at:])]).replace("\r\n", "\n").replace("\x00", "")


def xml_entries(text: str, element: str, value_in: str | None) -> Iterator[Entry]:
    """Elements ``element`` with a name; their value is their content, or that of their first child ``value_in``."""
    key, start, depth = None, 0, 0
    for m in XML.finditer(text):
        name = m["name"]
        if name is None:
            continue
        empty = m["attributes"].endswith("/") if m["attributes"] else False
        if key is None:
            if name == element and not m["end"]:
                n = NAME.search(m["attributes"])
                if n and not empty:
                    key, start, depth = html.unescape(n[1] if n[1] is not None else n[2]), m.end(), 0
                    found = value_in is None
            continue
        if name == element and m["end"] and not depth:
            if found:
                end = m.start() if value_in is None else stop
                raw = text[start:end]
                yield Entry(key, decode_xml(raw), start, end, "cdata" if CDATA.fullmatch(raw.strip()) else "")
            key = None
        elif value_in is not None and not found and name == value_in and not m["end"]:
            if empty:
                key = None  # <value/>: nothing to replace in place
                continue
            start, stop = m.end(), -1
        elif value_in is not None and not found and name == value_in:
            stop, found = m.start(), True


def _apple_unescape(s: str) -> str:
    if "\\" not in s:
        return s
    table = {"n": "\n", "t": "\t", "r": "\r"}
    out = APPLE_ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else table.get(m[2], m[2]), s)
    if "\\u" not in s and "\\U" not in s:
        return out
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def apple_entries(text: str) -> Iterator[Entry]:
    """``"key" = "value";`` pairs, however many a line; what fits no pair is passed over to its semicolon or line end."""
    held: list[tuple[str, int, int]] = []
    at, n = 0, len(text)
    while at < n:
        pair = None if held else APPLE_PAIR.match(text, at)
        if pair:
            yield Entry(_apple_unescape(pair[1]), _apple_unescape(pair[2]), pair.start(2), pair.end(2))
            at = pair.end()
            continue
        m = APPLE.match(text, at)
        at = m.end()
        if m["skip"] is not None:
            if "\n" in m["skip"] and len(held) in (1,) and not m["skip"].startswith("/*"):
                held = held if text[m.end():m.end() + 1] == "=" else []
            continue
        if m["quoted"] is not None or m["bare"] is not None:
            word = m["quoted"] if m["quoted"] is not None else m["bare"]
            held.append((word, m.start("quoted") if m["quoted"] is not None else -1, m.end("quoted")))
            if len(held) == 1 or (len(held) == 3 and held[1][0] == "=" and held[2][1] >= 0):
                continue
            held = [held[-1]]
        elif m["c"] == "=" and len(held) == 1:
            held.append(("=", -1, -1))
        else:
            if m["c"] == ";" and len(held) == 3:
                yield Entry(_apple_unescape(held[0][0]), _apple_unescape(held[2][0]), held[2][1], held[2][2])
            held = []


def json_entries(text: str) -> Iterator[Entry]:
    """Members of the document's object with the places of their values."""
    at = text.find("{") + 1
    while True:
        m = JSON_STRING.match(text, BLANK.match(text, at).end())
        if not m:
            return
        colon = BLANK.match(text, m.end()).end()
        start = BLANK.match(text, colon + 1).end()
        own = JSON_STRING.match(text, start)
        if own:
            end, value = own.end(), json.loads(own[0], strict=False)
        else:
            end, value = _json_end(text, start), None
        yield Entry(json.loads(m[0], strict=False), value, start, end)
        comma = BLANK.match(text, end).end()
        if text[comma:comma + 1] != ",":
            return
        at = comma + 1


def _json_end(text: str, at: int) -> int:
    """Behind the number, word, object or array at ``at``, without blanks after it."""
    depth, i = 0, at
    while True:
        m = JSON_BREAK.match(text, i)
        if not m:
            return at + len(text[at:].rstrip())
        c = m[2]
        if c and not depth and c in ",}]":
            return at + len(text[at:m.start(2)].rstrip())  # a value that is missing ends where it starts
        i = m.end()
        if c and c in "{[":
            depth += 1
        elif c and c in "}]":
            depth -= 1
            if not depth:
                return i


def entries_of(text: str, fmt: str) -> list[Entry]:
    if not text.strip():
        return []
    if fmt == "resx":
        return list(xml_entries(text, "data", "value"))
    if fmt == "android":
        return list(xml_entries(text, "string", None))
    return list(apple_entries(text) if fmt == "strings" else json_entries(text))


def order_of(key: str, fmt: str) -> str:
    """Where a member stands in a sorted document: ARB globals first, metadata right behind its key."""
    if fmt != "arb":
        return key
    if key.startswith("@@"):
        return "\0" + key
    return key[1:] + "\0@" if key.startswith("@") else key + "\0"


def _order(key: Column, fmt: str) -> Column:
    if fmt != "arb":
        return key
    return F.when(F.startswith(key, F.lit("@@")), F.concat(F.lit("\0"), key)).when(
        F.startswith(key, F.lit("@")), F.concat(F.substring(key, F.lit(2), F.length(key)), F.lit("\0@"))).otherwise(F.concat(key, F.lit("\0")))


# --- files as pieces --------------------------------------------------------------------------------

PIECES = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("section", T.IntegerType()), T.StructField("order", T.StringType()), T.StructField("pos", T.LongType()),
    T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("before", T.StringType()), T.StructField("raw", T.StringType()),
    T.StructField("style", T.StringType()), T.StructField("line_end", T.StringType()), T.StructField("indent", T.StringType()), T.StructField("lead", T.StringType()),
    T.StructField("first", T.StringType()), T.StructField("in_order", T.BooleanType()), T.StructField("is_first", T.BooleanType())])
#: Sections: a document's head, members before its first one, entries, new entries, what follows them.
HEAD, AHEAD, BODY, NEW, TAIL = range(5)


def pieces_of(path: str, text: str, fmt: str, closing: str | None) -> Iterator[tuple]:
    """Rows of PIECES of one file. The TAIL row carries what new entries need to know of the file."""
    found = entries_of(text, fmt)
    at = 0
    m = re.search(r"\r\n|\n", text)
    line_end = m[0] if m else ("" if closing or fmt in ("i18next", "arb") else "\n")
    order = [order_of(e.key, fmt) for e in found]
    in_order = all(x <= y for x, y in zip(order, order[1:]))
    is_json = fmt in ("i18next", "arb")
    indent = "  "
    if found:
        head = text[:found[0].start]
        own = re.search(r"(?:^|[\r\n])([ \t]*)[^\r\n]*$", head if is_json else head[:max(head.rfind("<data"), head.rfind("<string"), 0)] or head)
        indent = own[1] if own else indent
    if is_json:
        opened = text.find("{") + 1
        split = BLANK.match(text, opened).end() if found else opened
        yield (path, HEAD, "", 0, None, None, text[:split], "", "", None, None, None, None, None, None)
        at = split
    seen: set[str] = set()
    for i, (e, o) in enumerate(zip(found, order)):
        yield (path, BODY, o if is_json and in_order else "", i, e.key, e.value, text[at:e.start], text[e.start:e.end], e.style, None, None, None, None, None, e.key not in seen)
        seen.add(e.key)
        at = e.end
    cut, lead = len(text), ""
    if is_json:
        cut = at
    elif closing:
        ends = list(re.finditer(re.escape(closing), text[at:]))
        # the last one that no comment holds
        dead = [c.span() for c in re.finditer(r"(?s)<!--.*?-->", text[at:])]
        ends = [x.start() for x in ends if not any(a <= x.start() < z for a, z in dead)]
        cut = at + ends[-1] if ends else len(text)
        line = len(text[:cut].rstrip(" \t"))
        if text[line - 1:line] == "\n":
            cut = line
        else:
            lead = line_end  # the closing tag stands behind other text
    elif text and not text.endswith("\n"):
        lead = line_end
    yield (path, BODY, "" if not is_json else None, len(found), None, None, text[at:cut], "", "", None, None, None, None, None, None)
    yield (path, TAIL, "", 0, None, None, text[cut:], "", "", line_end, indent, lead, order[0] if order else None, in_order, None)


def pieces(files: DataFrame, fmt: str) -> DataFrame:
    """files(path, text) of bundles that exist -> PIECES; sorted by section, order, pos and key they are the file."""
    closing = b.get(fmt).closing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(PIECES)
        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1)):
                held = []
                for row in pieces_of(path.as_py(), text.as_py(), fmt, closing):
                    held.append(row)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return files.filter(F.trim("text") != "").select("path", "text").mapInArrow(run, PIECES)


def entries(files: DataFrame, fmt: str) -> DataFrame:
    """(path, key, value) of whole files, all notations read; a key given twice keeps its first value."""
    rows = pieces(files, fmt).filter("key IS NOT NULL AND value IS NOT NULL")
    if fmt == "arb":
        rows = rows.filter(~F.startswith("key", F.lit("@")))
    if fmt == "android":
        rows = rows.withColumn("value", esc.unescape_android(F.col("value")))
    return rows.groupBy("path", "key").agg(F.min_by("value", "pos").alias("value"))


def keys(files: DataFrame, fmt: str) -> DataFrame:
    """(path, key) of every entry, with or without a text."""
    return pieces(files, fmt).filter("key IS NOT NULL").select("path", "key").distinct()


def _replaced(fmt: str) -> Column:
    """The new value as the file writes values."""
    new = F.col("new")
    if fmt == "strings":
        return esc.escape_apple(new)
    if fmt in ("i18next", "arb"):
        return b._json_text(new)
    text = esc.escape_android(new) if fmt == "android" else new
    section = F.concat(F.lit("<![CDATA["), F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))
    return F.when(F.col("style") == "cdata", section).otherwise(b._xml_text(text))


def cut_once(files: DataFrame, fmt: str) -> DataFrame:
    """The pieces of files, written: every part of a merge, and every merge into the same files, looks at them."""
    return materialise(pieces(files, fmt), "pieces")


def merge(files: DataFrame, incoming: DataFrame, fmt: str, cut: DataFrame | None = None) -> DataFrame:
    """files(path, text) and incoming(path, key, value, comment) -> (path, section, order, pos, key, piece, status).

    The pieces of a path in order of section, order, pos and key are its new text. Values that are equal stay as they are written;
    only the first of two entries with one key is updated; nested members are never overwritten. New entries stand at the end, by
    key, or at their place in a JSON document that is in order. A path without a file, or with a blank one, gets a new file.
    ``cut``: the files' pieces (see cut_once), if several merges share them.
    """
    f = b.get(fmt)
    there = files.filter(F.trim("text") != "")
    cut = cut_once(there, fmt) if cut is None else cut
    is_json = fmt in ("i18next", "arb")
    news = incoming.select("path", "key", F.col("value").alias("new"), "comment")
    named = cut.filter("key IS NOT NULL")
    value = esc.unescape_android(F.col("value")) if fmt == "android" else F.col("value")
    j = named.join(news, ["path", "key"], "left")
    update = F.col("is_first") & F.col("new").isNotNull() & F.col("value").isNotNull() & (F.col("new") != value)
    before = F.col("before")
    if fmt == "android":
        tag = F.regexp_extract("before", r"(<string[^<>]*>)$", 1)
        flag = update & many_unnumbered_arguments(F.col("new")) & ~F.contains(tag, F.lit("formatted"))
        before = F.when(flag, F.regexp_replace("before", r">$", ' formatted="false">')).otherwise(before)
    status = F.when(update, "updated").when(F.col("new").isNull() | F.col("value").isNull(), "kept").otherwise("unchanged")
    place = ["path", "section", F.col("order"), "pos"]
    kept = j.select(*place, "key", F.concat(before, F.when(update, _replaced(fmt)).otherwise(F.col("raw"))).alias("piece"), status.alias("status"))
    gaps = cut.filter("key IS NULL")
    plain = gaps.select(*place, F.lit("").alias("key"), F.concat("before", "raw").alias("piece"), F.lit(None).cast("string").alias("status"))
    # what stands between the last entry and the end follows all entries, those in order too
    plain = plain.withColumn("order", F.coalesce("order", F.lit("\U0010ffff")))

    about = gaps.filter(F.col("section") == TAIL).select("path", "line_end", "indent", "lead", "first", "in_order")
    added = news.join(named.select("path", "key"), ["path", "key"], "left_anti")
    if fmt == "arb":
        described = F.to_json(F.struct(F.col("comment").alias("description")))
        meta = added.filter("comment IS NOT NULL").select("path", F.concat(F.lit("@"), "key").alias("key"), described.alias("body"))
        meta = meta.join(named.select("path", "key"), ["path", "key"], "left_anti")
        added = added.select("path", "key", b._json_text(F.col("new")).alias("body"), "comment").unionByName(meta.withColumn("comment", F.lit(None).cast("string")))
    elif is_json:
        added = added.withColumn("body", b._json_text(F.col("new")))
    placed = added.join(about, "path")
    if is_json:
        own = _order(F.col("key"), fmt)
        member = F.concat(b._json_text(F.col("key")), F.lit(": "), "body")
        ahead = F.col("first").isNotNull() & F.col("in_order") & (own < F.col("first"))
        lowest = added.groupBy("path").agg(F.min(own).alias("lowest"))
        alone = F.col("first").isNull()
        brk = F.concat("line_end", "indent")
        placed = placed.join(lowest, "path")
        piece = F.when(ahead, F.concat(member, F.lit(","), brk)).when(
            alone, F.concat(F.when(own == F.col("lowest"), "").otherwise(","), brk, member)).otherwise(F.concat(F.lit(","), brk, member))
        section = F.when(ahead, AHEAD).when(F.col("in_order") & ~alone, BODY).otherwise(NEW)
        fresh = placed.select(
            "path", section.cast("int").alias("section"), own.alias("order"), F.lit(1 << 40).cast("long").alias("pos"), "key", piece.alias("piece"),
            F.when(F.startswith("key", F.lit("@")), F.lit(None)).otherwise("added").alias("status"))
        shut = placed.filter(alone & (own == F.col("lowest"))).select(
            "path", F.lit(NEW).alias("section"), F.lit("\U0010ffff").alias("order"), F.lit(0).cast("long").alias("pos"), F.lit("").alias("key"),
            F.col("line_end").alias("piece"), F.lit(None).cast("string").alias("status"))
        fresh = fresh.unionByName(shut)
    else:
        line = F.regexp_replace(f.render(F.col("key"), F.col("new"), F.col("comment")), "^ *", "")
        lead = F.when(F.col("key") == F.col("lowest"), F.col("lead")).otherwise("")
        placed = placed.join(added.groupBy("path").agg(F.min("key").alias("lowest")), "path")
        fresh = placed.select(
            "path", F.lit(NEW).alias("section"), F.lit("").alias("order"), F.lit(0).cast("long").alias("pos"), "key",
            F.concat(lead, "indent" if f.closing else F.lit(""), line, "line_end").alias("piece"), F.lit("added").alias("status"))
    out = kept.unionByName(plain).unionByName(fresh)
    without = incoming.join(there.select("path"), "path", "left_anti")
    new = b.merge_lines(there.limit(0), without, fmt)
    new = new.select("path", F.col("section").cast("int").alias("section"), F.lit("").alias("order"), "pos", F.coalesce("key", F.lit("")).alias("key"),
                     F.concat("line", F.lit("\n")).alias("piece"), "status")
    return out.unionByName(new)


ORDER = ["path", "section", "order", "pos", "key"]


def texts(merged: DataFrame) -> DataFrame:
    """(path, text) of the merged files, for bundles of a size that fits a row."""
    cells = F.sort_array(F.collect_list(F.struct(*ORDER[1:], "piece")))
    return merged.groupBy("path").agg(F.array_join(F.transform(cells, lambda c: c["piece"]), "").alias("text"))


def publish(merged: DataFrame, root: str) -> DataFrame:
    """Writes each merged file below ``root``, piece by piece from a sorted stream, into a temporary file that replaces the old one.

    ``root`` must be mounted on every executor. A task holds one batch of pieces, whatever a bundle's size.
    """
    root = root.replace("file:", "")

    def run(frames):
        rows = ((p, piece) for frame in frames for p, piece in zip(frame["path"], frame["piece"]))
        for path, parts in groupby(rows, key=lambda r: r[0]):
            target = os.path.join(root, path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target + ".tmp", "w", encoding="utf-8", newline="") as out:
                for _, piece in parts:
                    out.write(piece)
            os.replace(target + ".tmp", target)
            yield pd.DataFrame({"path": [path]})

    placed = merged.repartition("path").sortWithinPartitions(*ORDER)
    return placed.select("path", "piece").mapInPandas(run, "path string")
