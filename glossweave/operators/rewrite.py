"""Replacing literals by look-ups: a rule table, an exact splice and the import line."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

# fixed values: (dialect, kinds, template, import line); {key}, {name}, {args} are filled in
RULES = [
    ("csharp", ["CodeLiteral"], 'L["{key}"]', "using App.Resources;"),
    ("xaml", ["MarkupAttribute"], '{name}="{{x:Static res:Strings.{key}}}"', None),
    ("razor", ["MarkupText"], '@L["{key}"]', None),
    ("jsx", ["MarkupText"], '{{t("{key}")}}', 'import {{ t }} from "./i18n";'),
    ("jsx", ["MarkupAttribute"], '{name}={{t("{key}")}}', 'import {{ t }} from "./i18n";'),
    ("script", ["UiCall"], 't("{key}")', 'import {{ t }} from "./i18n";'),
    ("vue", ["MarkupText"], '{{{{ $t("{key}") }}}}', None),
    ("vue", ["MarkupAttribute"], ":{name}=\"$t('{key}')\"", None),
    ("android", ["UiCall", "UiSecondArgument", "NamedArgument"], "getString(R.string.{key})", None),
    ("android_layout", ["MarkupAttribute"], '{name}="@string/{key}"', None),
    ("swift", ["UiCall", "NamedArgument", "Assignment"], 'String(localized: "{key}")', None),
    ("objc", ["UiCall", "NamedArgument", "Assignment"], 'NSLocalizedString(@"{key}", nil)', None),
    ("dart", ["UiCall", "NamedArgument"], "AppLocalizations.of(context)!.{key}", "import 'package:flutter_gen/gen_l10n/app_localizations.dart';"),
]


def _fill(template: str, key: Column, name: Column) -> Column:
    parts = template.replace("{{", "\u0001").replace("}}", "\u0002")
    out, rest = [], parts
    while rest:
        hits = [(rest.find(m), m) for m in ("{key}", "{name}") if m in rest]
        if not hits:
            out.append(F.lit(_braces(rest)))
            break
        at, m = min(hits)
        out += [F.lit(_braces(rest[:at])), key if m == "{key}" else name]
        rest = rest[at + len(m) :]
    return F.concat(*out)


def _braces(s: str) -> str:
    return s.replace("\u0001", "{").replace("\u0002", "}")


def plan(dialect: Column, kind: Column, key: Column, name: Column, args: Column | None = None, blocked: Column | None = None) -> Column:
    """struct<replacement, required_import>; null where the position is report only."""
    text, line = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d, kinds, template, imp in RULES:
        hit = (dialect == d) & kind.isin(*kinds)
        text = F.when(hit, _fill(template, key, name)).otherwise(text)
        line = F.when(hit, F.lit(imp.format() if imp else None)).otherwise(line)
    if args is not None:
        call = F.concat(F.lit('string.Format(L["'), key, F.lit('"], '), F.array_join(args, ", "), F.lit(")"))
        text = F.when((dialect == "csharp") & args.isNotNull() & (F.size(args) > 0), call).otherwise(text)
    if blocked is not None:
        text = F.when(blocked.isNull(), text)
    return F.when(text.isNotNull(), F.struct(text.alias("replacement"), line.alias("required_import")))


_SPLICED = T.StructType([
    T.StructField("content", T.StringType()), T.StructField("applied", T.IntegerType()), T.StructField("skipped", T.IntegerType()),
])


@pandas_udf(_SPLICED)
def _splice(content: pd.Series, edits: pd.Series) -> pd.DataFrame:
    out = []
    for text, spans in zip(content, edits):
        parts, at, done, skipped = [], 0, 0, 0
        for s in spans:
            start, end = int(s["span_start"]), int(s["span_start"]) + len(s["raw"])
            # the raw text must still be there and must not overlap an earlier span
            if start < at or text[start:end] != s["raw"]:
                skipped += 1
                continue
            parts += [text[at:start], s["replacement"]]
            at, done = end, done + 1
        out.append(("".join(parts) + text[at:], done, skipped))
    return pd.DataFrame(out, columns=["content", "applied", "skipped"])


def splice(files: DataFrame, on: list[str], content: str, edits: DataFrame) -> DataFrame:
    """files(on..., content) with edits(on..., span_start, raw, replacement) -> (on..., content, applied, skipped).

    Edits of one file are spans of one text that is a single row already, so the list is no larger than that row.
    """
    grouped = edits.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("span_start", "raw", "replacement"))).alias("_edits"))
    joined = files.select(*on, content).join(grouped, on)
    return joined.select(*on, _splice(content, "_edits").alias("s")).select(*on, "s.*")


def carriage(content: Column) -> Column:
    """Line break that most lines use."""
    crlf = F.size(F.split(content, "\r\n")) - 1
    lf = F.size(F.split(content, "\n")) - 1
    return F.when(crlf * 2 > lf, F.lit("\r\n")).otherwise(F.lit("\n"))


def ensure_import(content: Column, line: Column, existing: str, prologue: str) -> Column:
    """Adds ``line`` once: after the last line that matches ``existing``, else after the opening lines that match
    ``prologue``, else first. Line endings of the file are kept."""
    lines = F.split(content, "\n", -1)
    present = F.exists(lines, lambda x: F.trim(F.replace(x, F.lit("\r"), F.lit(""))) == line)
    last = F.array_max(F.transform(lines, lambda x, i: F.when(x.rlike(existing), i + 1).otherwise(F.lit(0))))
    # opening lines: everything before the first line that is no prologue
    body = F.array_min(F.transform(lines, lambda x, i: F.when(x.rlike(prologue), F.size(lines)).otherwise(i)))
    at = F.when(last > 0, last).otherwise(F.least(body, F.size(lines) - 1))
    end = F.when(carriage(content) == "\r\n", F.lit("\r")).otherwise(F.lit(""))
    new = F.concat(
        F.slice(lines, F.lit(1), at), F.array(F.concat(line, end)), F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))))
    return F.when(present | line.isNull(), content).otherwise(F.array_join(new, "\n"))


def summary(spliced: DataFrame) -> DataFrame:
    return spliced.agg(
        F.count_if(F.col("applied") > 0).alias("files"), F.coalesce(F.sum("applied"), F.lit(0)).alias("replacements"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
