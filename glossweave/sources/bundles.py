"""Resource bundles in five formats: read, merge, write.

A bundle is handled as rows, one entry per line, so a large bundle is read and written by many tasks. Merging
never deletes: what lies between entries is carried verbatim, unknown and nested values stay, provenance comments
are added on first insert only, and a malformed file is refused, whatever its format.
"""

from __future__ import annotations

import gzip
import os
import re
import shutil
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import escapes as esc
from ..functions.text import extract_all, many_unnumbered_arguments
from ..session import evaluate_once, materialise, scratch_path, shuffles_freed


class MalformedBundle(ValueError):
    """The file exists but cannot be read as its format; it is left unchanged."""


class UnsupportedFormat(ValueError):
    pass


@dataclass(frozen=True)
class Format:
    name: str
    header: str
    footer: str
    entry: str | None                       # one entry in a file, RE2-safe; None for JSON documents
    parse: Callable[[Column], Column]       # entry text -> struct<key, value>
    render: Callable[[Column, Column, Column], Column]  # key, value, comment -> one line
    closing: str | None = None              # start of what must stay last
    note: str | None = None                 # a provenance comment on the entry's own line
    comment: str | None = None              # any comment: entries inside it do not count
    update: Callable[[Column, Column], Column] | None = None  # entry text with a new value, all else as it was

    @property
    def pieces(self) -> str:
        """Entries with their provenance comment, and comments; what is between is carried verbatim."""
        return f"(?s)[ \\t]*(?:{self.note}[ \\t]*)?{self.entry}|{self.comment}"


def _xml_value(c: Column) -> Column:
    return F.replace(esc.unescape_xml(F.replace(F.replace(c, F.lit("&#10;"), F.lit("\n")), F.lit("&#13;"), F.lit("\r"))), F.lit("\u0000"), F.lit(""))


_QUOTED = r'"([^"\\]*(?:\\.[^"\\]*)*)"'
_XML_NOTE, _XML_COMMENT = r"<!--(?:[^-\n]|-[^-\n])*-->", r"<!--.*?-->"
_SLASH_NOTE, _SLASH_COMMENT = r"/\*(?:[^*\n]|\*[^/\n])*\*/", r"/\*.*?\*/|//[^\n]*"


def _between(segment: Column, before: str, after: str, value: Column, otherwise: Column) -> Column:
    """Replaces what stands between two patterns, or everything when they are not there."""
    head, tail = F.regexp_extract(segment, f"(?s)^({before})", 1), F.regexp_extract(segment, f"(?s)({after})$", 1)
    return F.when((head != "") & (tail != ""), F.concat(head, value, tail)).otherwise(otherwise)


def _xml_text(c: Column) -> Column:
    """Line breaks as character references keep an entry on one line."""
    return F.replace(F.replace(esc.escape_xml(c), F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit("&#10;"))


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _resx_parse(t: Column) -> Column:
    return _pair(esc.unescape_xml(F.regexp_extract(t, r'<data[ ](?:[^<>]*[ ])?name="([^"]*)"', 1)), _xml_value(F.regexp_extract(t, r"(?s)<value>(.*?)</value>", 1)))


def _resx_render(key: Column, value: Column, comment: Column) -> Column:
    note = F.when(comment.isNotNull(), F.concat(F.lit("<comment>"), _xml_text(comment), F.lit("</comment>"))).otherwise(F.lit(""))
    return F.concat(
        F.lit('  <data name="'), esc.escape_xml_attribute(key), F.lit('" xml:space="preserve"><value>'), _xml_text(value), F.lit("</value>"), note, F.lit("</data>"))


def _resx_update(segment: Column, value: Column) -> Column:
    key = _resx_parse(segment)["key"]
    return _between(segment, r".*?<value>", r"</value>.*", _xml_text(value), _resx_render(key, value, F.lit(None).cast("string")))


def _android_update(segment: Column, value: Column) -> Column:
    key = _android_parse(segment)["key"]
    out = _between(segment, r".*?<string[ ][^<>]*>", r"</string>.*", _xml_text(esc.escape_android(value)), _android_render(key, value, F.lit(None).cast("string")))
    need = many_unnumbered_arguments(value) & ~F.contains(segment, F.lit("formatted="))
    return F.when(need, F.regexp_replace(out, r"(<string[ ][^<>]*)>", '$1 formatted="false">')).otherwise(out)


def _apple_update(segment: Column, value: Column) -> Column:
    key = _apple_parse(segment)["key"]
    head = rf"[ \t]*(?:{_SLASH_NOTE}[ \t]*)?{_QUOTED}[ \t]*=[ \t]*"
    return _between(segment, head, r"[ \t]*;", F.concat(F.lit('"'), esc.escape_apple(value), F.lit('"')), _apple_render(key, value, F.lit(None).cast("string")))


def _android_parse(t: Column) -> Column:
    body = F.regexp_extract(t, r"(?s)<string[ ][^<>]*>(.*)</string>", 1)
    return _pair(F.regexp_extract(t, r'<string[ ](?:[^<>]*[ ])?name="([^"]*)"', 1), esc.unescape_android(_xml_value(body)))


def _android_render(key: Column, value: Column, comment: Column) -> Column:
    note = F.when(comment.isNotNull(), F.concat(F.lit("    <!-- "), F.replace(F.regexp_replace(comment, r"[\r\n]+", " "), F.lit("--"), F.lit("- -")), F.lit(" -->"))).otherwise(F.lit("   "))
    flag = F.when(many_unnumbered_arguments(value), F.lit(' formatted="false"')).otherwise(F.lit(""))
    return F.concat(note, F.lit(' <string name="'), esc.escape_xml_attribute(key), F.lit('"'), flag, F.lit(">"), _xml_text(esc.escape_android(value)), F.lit("</string>"))


def _apple_parse(t: Column) -> Column:
    # a provenance comment may stand on the same line
    line = F.regexp_replace(t, r"(?s)^[ \t]*/\*.*?\*/", "")
    pattern = rf"(?s){_QUOTED}[ \t]*=[ \t]*{_QUOTED}[ \t]*;"
    return _pair(esc.unescape_apple(F.regexp_extract(line, pattern, 1)), esc.unescape_apple(F.regexp_extract(line, pattern, 2)))


def _apple_render(key: Column, value: Column, comment: Column) -> Column:
    note = F.when(comment.isNotNull(), F.concat(F.lit("/* "), F.replace(F.regexp_replace(comment, r"[\r\n]+", " "), F.lit("*/"), F.lit("* /")), F.lit(" */ "))).otherwise(F.lit(""))
    return F.concat(note, F.lit('"'), esc.escape_apple(key), F.lit('" = "'), esc.escape_apple(value), F.lit('";'))


def _json_text(c: Column) -> Column:
    """JSON string literal through the built-in writer."""
    return F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[|\]$", "")


def _json_parse(t: Column) -> Column:
    """One line of a document that holds one pair per line."""
    line = F.regexp_replace(t, r",[ \t]*$", "")
    pair = F.from_json(F.concat(F.lit("{"), line, F.lit("}")), "map<string,string>")
    return _pair(F.element_at(F.map_keys(pair), 1), F.element_at(F.map_values(pair), 1))


def _json_render(key: Column, value: Column, comment: Column) -> Column:
    return F.concat(F.lit("  "), _json_text(key), F.lit(": "), _json_text(value))


_XML_HEAD = '<?xml version="1.0" encoding="utf-8"?>'
_RESX_HEAD = "\n".join([
    _XML_HEAD, "<root>",
    '  <resheader name="resmimetype"><value>text/microsoft-resx</value></resheader>',
    '  <resheader name="version"><value>2.0</value></resheader>',
    '  <resheader name="reader"><value>System.Resources.ResXResourceReader, System.Windows.Forms</value></resheader>',
    '  <resheader name="writer"><value>System.Resources.ResXResourceWriter, System.Windows.Forms</value></resheader>',
])

FORMATS = {
    "resx": Format("resx", _RESX_HEAD, "</root>", r"<data[ ][^<>]*>.*?</data>", _resx_parse, _resx_render, "</root>", _XML_NOTE, _XML_COMMENT, _resx_update),
    "i18next": Format("i18next", "{", "}", None, _json_parse, _json_render),
    "android": Format("android", _XML_HEAD + "\n<resources>", "</resources>", r"<string[ ][^<>]*>.*?</string>", _android_parse, _android_render, "</resources>", _XML_NOTE, _XML_COMMENT, _android_update),
    "strings": Format("strings", "", "", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"[ \t]*=[ \t]*"[^"\\]*+(?:\\.[^"\\]*+)*+"[ \t]*;', _apple_parse, _apple_render, None, _SLASH_NOTE, _SLASH_COMMENT, _apple_update),
    "arb": Format("arb", "{", "}", None, _json_parse, _json_render),
}


def register(fmt: Format) -> None:
    """Adds or replaces a format by name."""
    FORMATS[fmt.name] = fmt


def get(name: str) -> Format:
    if name not in FORMATS:
        raise UnsupportedFormat(f"no bundle format {name!r}; known: {', '.join(sorted(FORMATS))}")
    return FORMATS[name]


# --- reading ------------------------------------------------------------------------------------


def _xml_is_well_formed(content: Column) -> Column:
    return F.from_xml(content, "_corrupt STRING, probe STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})["_corrupt"].isNull()


def is_malformed(content: Column, fmt: str) -> Column:
    blank = F.trim(F.coalesce(content, F.lit(""))) == ""
    if fmt in ("i18next", "arb"):
        return ~blank & ~F.coalesce(F.try_parse_json(content).isNotNull() & content.rlike(r"^[ \t\r\n]*\{"), F.lit(False))
    if FORMATS[fmt].closing:
        return ~blank & ~(F.contains(content, F.lit(FORMATS[fmt].closing)) & _xml_is_well_formed(content))
    return F.lit(False)


def _cells(files: DataFrame, fmt: Format) -> DataFrame:
    """files(path, text) -> (path, pos, segment, key, value): entries, and the text between them with a null key."""
    if fmt.entry is None:
        pairs = files.select("path", F.try_parse_json("text").alias("doc"))
        pairs = pairs.lateralJoin(files.sparkSession.tvf.variant_explode(F.col("doc").outer()))
        is_text = F.schema_of_variant("value") == "STRING"
        return pairs.select(
            "path", F.col("pos").cast("long"), F.to_json("value").alias("segment"), "key",
            F.when(is_text, F.variant_get("value", "$", "string")).alias("value"))
    zipped = evaluate_once(
        files, ["path"],
        gaps=F.split("text", fmt.pieces, -1), entries=F.concat(extract_all(F.col("text"), fmt.pieces), F.array(F.lit(None).cast("string"))))
    pieces = F.flatten(F.transform(F.arrays_zip("gaps", "entries"), lambda z: F.array(z["gaps"], z["entries"])))
    out = zipped.select("path", F.posexplode(pieces).alias("pos", "segment")).filter(F.coalesce("segment", F.lit("")) != "")
    parsed = fmt.parse(F.col("segment"))
    is_entry = (F.col("pos") % 2 == 1) & F.col("segment").rlike(f"(?s)^[ \\t]*(?:{fmt.note}[ \\t]*)?{fmt.entry}")
    out = out.select("path", F.col("pos").cast("long"), "segment", F.when(is_entry, parsed).alias("p"))
    return out.select("path", "pos", "segment", "p.key", "p.value")


def entries(files: DataFrame, fmt: str) -> DataFrame:
    """Entries of whole files. A key given twice keeps its first value; a missing or blank file has none."""
    rows = _cells(files, get(fmt)).filter("key is not null and value is not null")
    if fmt == "arb":
        rows = rows.filter(~F.startswith("key", F.lit("@")))
    return rows.groupBy("path", "key").agg(F.min_by("value", "pos").alias("value"))


def duplicates(files: DataFrame, fmt: str) -> DataFrame:
    rows = _cells(files, get(fmt)).filter("key is not null")
    return rows.groupBy("path", "key").agg(F.count("*").alias("times")).filter("times > 1")


def refuse_malformed(files: DataFrame, fmt: str) -> None:
    bad = materialise(files.filter(is_malformed(F.col("text"), fmt)).select("path"), "malformed")
    n, first = bad.agg(F.count("*"), F.min("path")).first()
    if n:
        raise MalformedBundle(f"{fmt}: cannot read {first}" + (f" and {n - 1} more, all listed in {bad.inputFiles()[0].rpartition('/')[0]}" if n > 1 else "") + "; nothing was written")


def read_lines(spark: SparkSession, folder: str, fmt: str) -> DataFrame:
    """Entries of bundles written by :func:`write_lines`: splittable, one entry per line."""
    lines = spark.read.text(folder).withColumnRenamed("value", "line").withColumn("bundle", F.col("bundle").cast("string"))
    f = get(fmt)
    mark = {"resx": "<data ", "android": "<string ", "strings": '" = "'}.get(fmt, '": ')
    hits = evaluate_once(lines.filter(F.contains("line", F.lit(mark))), ["bundle"], p=f.parse(F.col("line")))
    out = hits.select(F.col("bundle").alias("path"), "p.key", "p.value").filter("value is not null")
    return out.filter(~F.startswith("key", F.lit("@"))) if fmt == "arb" else out


# --- merging and writing --------------------------------------------------------------------------


def merge_lines(files: DataFrame, incoming: DataFrame, fmt: str) -> DataFrame:
    """files(path, text) and incoming(path, key, value, comment) -> (path, section, pos, key, line, status).

    Existing order is kept for XML and strings files, new entries follow by key; JSON documents are sorted.
    """
    f = get(fmt)
    if f.entry is None:
        return _merge_json(files, incoming, f)
    body, tail = _ending(F.col("text"), f)
    cells = _cells(files.select("path", body.alias("text")), f)
    first = cells.filter("key is not null").groupBy("path", "key").agg(F.min("pos").alias("pos")).withColumn("first", F.lit(True))
    cells = cells.join(first, ["path", "key", "pos"], "left")
    met, unmet = _apart(files, incoming)
    here = cells.withColumn("_there", F.lit(True))
    j = here.join(met.select("path", "key", F.col("value").alias("new"), "comment"), ["path", "key"], "full_outer")
    there = F.col("_there").isNotNull()
    update = F.coalesce("first", F.lit(False)) & F.col("new").isNotNull() & (F.col("new") != F.col("value"))
    text = F.when(update, f.update(F.col("segment"), F.col("new"))).otherwise(F.col("segment"))
    status = F.when(~there, "added").when(F.col("key").isNull(), F.lit(None)).when(update, "updated").when(F.col("new").isNull(), "kept").otherwise("unchanged")
    line = F.when(there, text).otherwise(f.render(F.col("key"), F.col("new"), F.col("comment")))
    rows = j.select("path", F.when(there, 0).otherwise(1).alias("section"), F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), "key", line.alias("line"), status.alias("status"))
    ends = files.select("path", F.lit(2).alias("section"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("key"), tail.alias("line"), F.lit(None).cast("string").alias("status"))
    rows = rows.unionByName(ends.filter("line IS NOT NULL"))
    fresh = unmet.select("path", F.lit(1).alias("section"), F.lit(0).cast("long").alias("pos"), "key", f.render(F.col("key"), F.col("value"), F.col("comment")).alias("line"), F.lit("added").alias("status"))
    # one line feed per row comes from the writer; a gap's own line feeds next to an entry are dropped
    # and a gap of two line feeds or more keeps its blank lines
    is_new = F.col("section") == 1
    blank_lines = F.col("line").rlike(r"\n[ \t\r]*\n")
    short = F.when(is_new, F.col("line")).otherwise(F.regexp_replace("line", r"^\r?\n|\r?\n$", ""))
    trimmed = rows.withColumn("stays", is_new | blank_lines).withColumn("line", short).filter("stays OR line <> ''").drop("stays")
    return trimmed.unionByName(fresh).unionByName(_frame(files, incoming, f))


def _apart(files: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may meet an entry, rows that are new as they stand). Without any file all are new and are moved to no join; else
    all go to the join, which finds the new ones as well, so that values are read once."""
    none = incoming.filter(F.lit(False))
    return (none, incoming) if files.select("path").isEmpty() else (incoming, none)


def _ending(text: Column, f: Format) -> tuple[Column, Column]:
    """(text before the file's own closing tag, that tag and what follows). Only white space and comments may follow, so a
    tag named in a comment is not taken for it. Without such a tag: (text, null)."""
    if not f.closing:
        return text, F.lit(None).cast("string")
    ending = r"(?s)^(.*?)(" + re.escape(f.closing) + r"\s*(?:<!--.*?-->\s*)*)\z"
    found = text.rlike(ending)
    return F.when(found, F.regexp_extract(text, ending, 1)).otherwise(text), F.when(found, F.regexp_extract(text, ending, 2))


def _frame(files: DataFrame, incoming: DataFrame, f: Format) -> DataFrame:
    """Header and footer of bundles that have no file yet."""
    new = incoming.select("path").distinct().join(files.filter(F.trim("text") != "").select("path"), "path", "left_anti")
    rows = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(t).alias("line")) for s, t in ((-1, f.header), (2, f.footer)) if t] or [F.struct(F.lit(-1).alias("section"), F.lit("").alias("line"))])
    out = new.select("path", F.inline(rows)).filter("line <> ''")
    return out.select("path", "section", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("key"), "line", F.lit(None).cast("string").alias("status"))


def _merge_json(files: DataFrame, incoming: DataFrame, f: Format) -> DataFrame:
    """Values meet their members in one join, or in none if there is no file; what else is asked of all members (the last one
    of a bundle, metadata that must be written) is asked of keys alone, so that values are moved once at most."""
    cells = _cells(files, f)
    met, unmet = _apart(files, incoming)
    present, asked = cells.select("path", "key"), incoming.select("path", "key")
    arb = f.name == "arb"

    def order(key: Column) -> Column:
        if not arb:
            return key
        # globals first, metadata right after its key
        tail = F.when(F.startswith(key, F.lit("@")), F.lit("\u0000@")).otherwise(F.lit("\u0000"))
        return F.when(F.startswith(key, F.lit("@@")), F.concat(F.lit("\u0000"), key)).otherwise(F.concat(F.regexp_replace(key, "^@", ""), tail))

    own = [present, asked]
    if arb:
        def described(rows: DataFrame) -> DataFrame:
            about = F.to_json(F.struct(F.col("comment").alias("description")))
            return rows.select("path", F.concat(F.lit("@"), "key").alias("key"), about.alias("body"))

        meta = met.filter("comment IS NOT NULL").select("path", "key", "comment").join(present, ["path", "key"], "left_anti")
        meta = described(meta).join(present, ["path", "key"], "left_anti").unionByName(described(unmet.filter("comment IS NOT NULL")))
        own.append(meta.select("path", "key"))
    # one row per bundle: a partial maximum leaves each task, not its keys
    tops = [x.groupBy("path").agg(F.max(F.struct(order(F.col("key")).alias("order"), "key")).alias("top")) for x in own]
    last = reduce(DataFrame.unionByName, tops).groupBy("path").agg(F.max("top").alias("top"))
    # written, so that its size is known: that of few bundles goes to the rows, not the rows to it
    last = materialise(last.select("path", F.col("top.key").alias("key"), F.lit(True).alias("is_last")), "last-members")

    def flagged(rows: DataFrame) -> DataFrame:
        # else by bundle and key, as the join that follows: no bundle's entries come together in one task
        return rows.join(last, ["path", "key"], "left")

    there = flagged(cells.select("path", "key", "segment", "value"))
    j = there.join(flagged(met.select("path", "key", F.col("value").alias("new"))).withColumnRenamed("is_last", "new_last"), ["path", "key"], "full_outer")
    nested = F.col("segment").isNotNull() & F.col("value").isNull()
    status = (
        F.when(F.col("segment").isNull(), "added").when(nested | F.col("new").isNull(), "kept")
        .when(F.col("new") == F.col("value"), "unchanged").otherwise("updated")
    )
    # nested objects, numbers and plural groups are never overwritten
    body = F.when(status.isin("added", "updated"), _json_text(F.col("new"))).otherwise(F.col("segment"))
    rows = j.select("path", "key", status.alias("status"), body.alias("body"), F.coalesce("is_last", "new_last").alias("is_last"))
    fresh = flagged(unmet.select("path", "key", _json_text(F.col("value")).alias("body")))
    rows = rows.unionByName(fresh.select("path", "key", F.lit("added").alias("status"), "body", "is_last"))
    if arb:
        rows = rows.unionByName(flagged(meta).select("path", "key", F.lit(None).cast("string").alias("status"), "body", "is_last"))
    comma = F.when(F.col("is_last"), F.lit("")).otherwise(F.lit(","))
    line = F.concat(F.lit("  "), _json_text(F.col("key")), F.lit(": "), F.col("body"), comma)
    out = rows.select("path", F.lit(1).alias("section"), F.lit(0).cast("long").alias("pos"), order(F.col("key")).alias("key"), line.alias("line"), "status")
    paths = present.select("path").distinct().unionByName(asked.select("path").distinct()).distinct()
    ends = F.array(F.struct(F.lit(-1).alias("section"), F.lit("{").alias("line")), F.struct(F.lit(2).alias("section"), F.lit("}").alias("line")))
    frame = paths.select("path", F.inline(ends)).select("path", "section", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("key"), "line", F.lit(None).cast("string").alias("status"))
    return out.unionByName(frame)


def write_lines(lines: DataFrame, folder: str | None = None) -> str:
    """Sorted, compressed part files per bundle; read in name order they are the bundle. A bundle may span many tasks."""
    folder = folder or scratch_path(lines.sparkSession, "bundles")
    order = ["path", "section", "pos", F.coalesce("key", F.lit(""))]
    placed = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    with shuffles_freed(lines.sparkSession):
        placed.select(F.col("path").alias("bundle"), F.col("line").alias("value")).write.partitionBy("bundle").text(folder, compression="gzip")
    return folder


def publish(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """Joins the parts of each bundle into its file below ``root``, one task per bundle, by streaming copy into a
    temporary file that replaces the old one at the end. Both folders must be mounted on every executor."""
    folder, root = folder.replace("file:", ""), root.replace("file:", "")

    def run(frames):
        rows = ((b, f) for frame in frames for b, f in zip(frame["bundle"], frame["file"]))
        for bundle, parts in groupby(rows, key=lambda r: r[0]):
            target = os.path.join(root, bundle)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target + ".tmp", "wb") as out:
                for _, part in parts:
                    with (gzip.open if part.endswith(".gz") else open)(part, "rb") as src:
                        shutil.copyfileobj(src, out)
            os.replace(target + ".tmp", target)
            yield pd.DataFrame({"path": [bundle]})

    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder).select("path")
    name = F.regexp_extract("path", r"/bundle=([^/]*)/", 1)
    parts = listing.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("bundle"), F.regexp_replace("path", "^file:/*", "/").alias("file"))
    return _whole_groups(parts).mapInPandas(run, "path string")


def _whole_groups(parts: DataFrame) -> DataFrame:
    """Part names only, no content: all parts of one bundle end up in one partition, next to each other."""
    return parts.repartition("bundle").sortWithinPartitions("bundle", "file")


def read_files(files: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, text) of the bundles that exist; missing ones are empty."""
    return paths.join(files.select("path", "text"), "path", "left").withColumn("text", F.coalesce("text", F.lit("")))
