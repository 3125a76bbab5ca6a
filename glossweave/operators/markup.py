"""Candidates from markup: HTML/Svelte, JSX, Vue, XAML, Razor, Android layouts and Interface Builder files.

One tokenisation per file: by a pattern where markup is all there is, by a reader (``templates``) where code and markup change. A text token that touches a dead region (comment, script, style) is not intact:
its span would cover masked characters, so it is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed
from ..functions.noise import drop_noise
from ..functions.text import decode_entities, extract_all, line_breaks, one_line, trim_ws
from ..session import evaluate_once
from . import templates
from .spans import explode_tokens, with_tokens


@dataclass(frozen=True)
class MarkupDialect:
    attributes: tuple[str, ...]
    text_nodes: bool
    attribute_kind: str = "MarkupAttribute"
    text_kind: str = "MarkupText"
    ignore_prefixes: tuple[str, ...] = ()  # whole attribute name prefix, e.g. design-time namespaces
    local_names: bool = False              # compare the part after the namespace prefix
    reject_value: str | None = None        # bindings, resource and theme references
    reject_text: str = r"[{}]"
    enclosed: bool = False                 # text counts only directly between two tags
    blocked_reason: str | None = None


DIALECTS = {
    "html": MarkupDialect(tuple(fixed.HTML_COPY_ATTRIBUTES), True, blocked_reason="report only: plain markup"),
    "jsx": MarkupDialect(tuple(fixed.JSX_COPY_ATTRIBUTES), True, enclosed=True),
    "vue": MarkupDialect(tuple(fixed.HTML_COPY_ATTRIBUTES), True, ignore_prefixes=(":", "@", "v-")),
    "xaml": MarkupDialect(tuple(fixed.XAML_COPY_ATTRIBUTES), True, reject_value=r"^\{"),
    "razor": MarkupDialect(tuple(fixed.HTML_COPY_ATTRIBUTES), True, reject_value="@", reject_text="@"),
    "android_layout": MarkupDialect(
        tuple(fixed.ANDROID_COPY_ATTRIBUTES), False, ignore_prefixes=("tools:",), local_names=True, reject_value=r"^[@?]"
    ),
    "interface_builder": MarkupDialect(
        tuple(fixed.INTERFACE_BUILDER_COPY_ATTRIBUTES), False, blocked_reason="report only: interface builder"
    ),
}


def is_tag(t: Column) -> Column:
    return t.rlike(fixed.TAG) & ~is_dead(t)


def is_dead(t: Column) -> Column:
    return t.rlike(fixed.DEAD_START)


def element_name(tag: Column) -> Column:
    return F.regexp_extract(tag, fixed.TAG_NAME, 1)


def text_nodes(df: DataFrame, keep: list[str], content: str) -> DataFrame:
    """(keep..., text, element) of intact text nodes, position-free: built-in expressions only."""
    tokens = evaluate_once(df, keep, tok=extract_all(F.col(content), fixed.MARKUP_TOKEN))
    cells = F.transform("tok", lambda t, i: F.struct(t.alias("t"), F.coalesce(F.get("tok", i - 1), F.lit("")).alias("b"), F.coalesce(F.get("tok", i + 1), F.lit("")).alias("a")))
    live = F.filter(cells, lambda s: ~F.startswith(s.t, F.lit("<")) & ~is_dead(s.b) & ~is_dead(s.a))
    named = F.transform(live, lambda s: F.struct(trim_ws(decode_entities(s.t)).alias("text"), element_name(s.b).alias("element")))
    return tokens.select(*keep, F.inline(named))


def _lead(c: Column) -> Column:
    return F.regexp_extract(c, r"^[ \t\r\n\f]*", 0)


def _text_cells(d: MarkupDialect) -> Column:
    """Zero or one candidate for a text token."""
    body = trim_ws(F.col("token"))
    live = ~F.startswith("token", F.lit("<")) & ~is_dead(F.col("before")) & ~is_dead(F.col("after"))
    if d.enclosed:
        live = live & is_tag(F.col("before")) & is_tag(F.col("after"))
    cell = F.struct(
        F.lit(1).alias("phase"),
        (F.col("span_start") + F.length(_lead(F.col("token")))).alias("span_start"),
        F.length(body).alias("span_length"),
        (F.col("line") + line_breaks(_lead(F.col("token")))).alias("line"),
        decode_entities(body).alias("text"),
        body.alias("raw"),
        F.lit(d.text_kind).alias("kind"),
        element_name(F.col("before")).alias("member"),
    )
    return F.when(live & (body != "") & ~body.rlike(d.reject_text), F.array(cell))


def attribute_hits(tag: Column, d: MarkupDialect) -> Column:
    """array<struct<raw, name, value>> of the accepted attributes of one tag."""
    raw = F.transform(extract_all(tag, fixed.ATTRIBUTE, 0), lambda r: F.substring(r, 2, 2147483647))
    value = F.transform(extract_all(tag, fixed.ATTRIBUTE, 2), lambda v: F.substring(v, F.lit(2), F.length(v) - 2))
    pairs = F.arrays_zip(raw.alias("raw"), extract_all(tag, fixed.ATTRIBUTE, 1).alias("name"), value.alias("value"))
    names = [a.lower() for a in d.attributes]

    def accepted(p: Column) -> Column:
        local = F.regexp_replace(p.name_, "^[^:]*:", "") if d.local_names else p.name_
        ok = F.lower(local).isin(*names) & (trim_ws(p.value) != "")
        for prefix in d.ignore_prefixes:
            ok = ok & ~F.startswith(p.name_, F.lit(prefix))
        if d.reject_value:
            ok = ok & ~p.value.rlike(d.reject_value)
        return ok

    shaped = F.transform(pairs, lambda p: F.struct(p["raw"].alias("raw"), p["name"].alias("name_"), p["value"].alias("value")))
    return F.filter(shaped, accepted)


def _attribute_cells(d: MarkupDialect) -> Column:
    """Any number of candidates for a tag token; the span covers name and value."""

    def cell(h: Column) -> Column:
        ahead = F.split_part(F.col("token"), h.raw, F.lit(1))
        return F.struct(
            F.lit(0).alias("phase"),
            (F.col("span_start") + F.length(ahead)).alias("span_start"),
            F.length(h.raw).alias("span_length"),
            (F.col("line") + line_breaks(ahead)).alias("line"),
            decode_entities(h.value).alias("text"),
            h.raw.alias("raw"),
            F.lit(d.attribute_kind).alias("kind"),
            h.name_.alias("member"),
        )

    # most tags have no attribute: they are not searched for any
    hits = F.when(F.contains("token", F.lit("=")), attribute_hits(F.col("token"), d))
    return F.when(is_tag(F.col("token")), F.coalesce(F.transform(hits, cell), F.array()))


WINDOW = 60
_LIVE = T.StructType([
    T.StructField("before", T.StringType()), T.StructField("token", T.StringType()), T.StructField("after", T.StringType()),
    T.StructField("span_start", T.IntegerType()), T.StructField("line", T.IntegerType()), T.StructField("around", T.StringType())])
#: Rows of a batch that leaves the reader; a file's tokens may fill many.
ROWS = 4096


def live_tokens(df: DataFrame, keep: list[str], content: str, dialect: str) -> DataFrame:
    """(keep…, before, token, after, span_start, line, around) of the tags and texts that a reader finds; no shuffle."""
    source = df.select(*keep, F.col(content).alias("_content"))
    schema, at = T.StructType(source.schema.fields[:-1] + _LIVE.fields), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        for batch in batches:
            rows, cells = [], []

            def full() -> pa.RecordBatch:
                place = pa.array(rows, pa.int32())
                columns = [batch.column(i).take(place) for i in range(at)] + [pa.array([c[f.name] for c in cells], types.field(f.name).type) for f in _LIVE]
                rows.clear()
                cells.clear()
                return pa.RecordBatch.from_arrays(columns, schema=types)

            for i in range(batch.num_rows):
                text = batch.column(at)[i].as_py()
                for cell in templates.live(text, dialect, WINDOW) if text else ():
                    rows.append(i)
                    cells.append(cell)
                    if len(rows) >= ROWS:
                        yield full()
            if rows:
                yield full()

    return source.mapInArrow(run, schema)


def candidates(df: DataFrame, keep: list[str], content: str, dialect: str) -> DataFrame:
    """Attributes (phase 0) and text (phase 1) of every file from one tokenisation, noise dropped."""
    d = DIALECTS[dialect]
    cells = F.coalesce(_attribute_cells(d), _text_cells(d)) if d.text_nodes else _attribute_cells(d)
    if dialect in templates.READERS:
        out = drop_noise(live_tokens(df, keep, content, dialect).select(*keep, "around", F.inline(cells)))
        out = out.withColumn("context", one_line(F.col("around"))).drop("around")
    else:
        tokens = explode_tokens(with_tokens(df, keep, F.col(content), fixed.MARKUP_TOKEN), keep)
        # the context is read by no filter, so it stays outside the generator and is only computed when asked for
        around = F.when(F.col("phase") == 0, F.col("token")).otherwise(F.concat(F.substring("before", -60, 60), F.col("token"), F.substring("after", 1, 60)))
        out = drop_noise(tokens.select(*keep, "before", "token", "after", F.inline(cells)))
        out = out.withColumn("context", one_line(around)).drop("before", "token", "after")
    return out.withColumn("blocked_reason", F.lit(d.blocked_reason).cast("string"))


def copy_bearing_xml(path: Column, content: Column) -> Column:
    """Android XML worth scanning: never values folders or the manifest."""
    p = F.lower(path)
    never = p.rlike(r"(^|/)values[^/]*/") | p.rlike(r"(^|/)androidmanifest\.xml$")
    folder = p.rlike(r"(^|/)res/(layout|menu|xml|navigation)[^/]*/")
    root = F.regexp_extract(content, r"<([A-Za-z][A-Za-z0-9_.:-]*)", 1)
    platform = F.contains(content, F.lit("http://schemas.android.com/apk/res/android")) & ~root.isin("manifest", "resources")
    return F.endswith(p, F.lit(".xml")) & ~never & (folder | platform)
