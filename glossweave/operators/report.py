"""Report rows and generated accessor lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.keys import legal_member
from ..functions.text import report_cell


def accessor_lines(keys: DataFrame) -> DataFrame:
    """One member per legal key; illegal names are left out."""
    legal = keys.select("key").distinct().filter(legal_member(F.col("key")))
    member = F.concat(F.lit("    public static string "), "key", F.lit(' => Get("'), "key", F.lit('");'))
    return legal.select("key", member.alias("accessor"))


def entry_rows(entries: DataFrame, languages: list[str]) -> DataFrame:
    """Markdown table rows (file, line, text): entries(path, line, key, text, lang, value), one column per language.

    Rows stay rows: writing them sorted by file and line gives the report body without gathering a file.
    """
    wide = entries.groupBy("path", "line", "key", "text").pivot("lang", languages).agg(F.max("value"))
    cells = [F.col("line").cast("string"), F.col("key"), report_cell(F.col("text")), *[report_cell(F.col(x)) for x in languages]]
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    return wide.select("path", F.upper("path").alias("folded"), "line", row.alias("markdown"))


def _section(df: DataFrame, number: int, order, line) -> DataFrame:
    """Report lines in the shape of bundle lines: sorted and written by many tasks."""
    return df.select(F.lit("report.md").alias("path"), F.lit(number).alias("section"), F.lit(0).cast("long").alias("pos"), order.alias("key"), line.alias("line"))


def _rows(spark: SparkSession, lines: list[str], number: int) -> DataFrame:
    df = spark.createDataFrame([(f"{i:06d}", x) for i, x in enumerate(lines)], "k string, l string")
    return _section(df, number, F.col("k"), F.col("l"))


def lines(spark: SparkSession, head: dict, findings: DataFrame, outcomes: DataFrame, final: DataFrame, entries: DataFrame, rejected: DataFrame, languages: list[str]) -> DataFrame:
    """The whole report: counters, set-up, coverage, entries by file and line, rejected texts."""
    parts = [_rows(spark, ["# Localization run", "", *[f"* {k}: {v}" for k, v in head.items()], "", "## Set-up", ""], 0)]
    mark = F.when(F.col("satisfied").isNull(), "not needed").when(F.col("satisfied"), "done").otherwise(F.col("severity"))
    parts.append(_section(findings, 1, F.col("step"), F.concat(F.lit("* "), "step", F.lit(": "), mark)))
    parts.append(_rows(spark, ["", "## Coverage", "", "| Language | Total | Already there | By hand | Reused | Sent | Missing |", "|---|---|---|---|---|---|---|"], 2))
    missing = final.groupBy("lang").agg(F.count_if(F.coalesce("value", F.lit("")) == "").alias("missing"))
    sent = F.col("sent_missing") + F.col("sent_changed") + F.col("sent_forced")
    cells = [F.col("lang"), *[c.cast("string") for c in (F.col("total"), F.col("already"), F.col("human_edited"), F.col("reused"), sent, F.col("missing"))]]
    parts.append(_section(outcomes.join(missing, "lang"), 3, F.col("lang"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))))
    titles = " | ".join(["File", "Line", "Key", "Text", *languages])
    parts.append(_rows(spark, ["", "## Entries", "", f"| {titles} |", "|---" * (4 + len(languages)) + "|"], 4))
    place = F.concat_ws("\u0000", F.upper("path"), "path", F.lpad(F.col("line").cast("string"), 10, "0"))
    rows = entry_rows(entries, languages)
    parts.append(_section(rows, 5, F.concat_ws("\u0000", "folded", "path", F.lpad(F.col("line").cast("string"), 10, "0"), "markdown"), F.concat(F.lit("| "), report_cell(F.col("path")), F.lit(" "), "markdown")))
    parts.append(_rows(spark, ["", "## Left out", "", "| File | Line | Text | Reason |", "|---|---|---|---|"], 6))
    cells = [report_cell(F.col("path")), F.col("line").cast("string"), report_cell(F.col("text")), report_cell(F.col("reason"))]
    parts.append(_section(rejected, 7, F.concat_ws("\u0000", place, "text"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))))
    return reduce(DataFrame.unionByName, parts)


def accessor_file(spark: SparkSession, keys: DataFrame, path: str, namespace: str, name: str) -> DataFrame:
    """Accessor class as sorted lines: head, one member per legal key, foot."""
    head = [f"namespace {namespace}", "{", f"    public static class {name}", "    {", f"        private static readonly System.Resources.ResourceManager Manager = new(\"{namespace}.{name}\", typeof({name}).Assembly);", "        private static string Get(string key) => Manager.GetString(key) ?? key;"]
    rows = _rows(spark, head, 0).unionByName(_section(accessor_lines(keys), 1, F.col("key"), F.concat(F.lit("    "), "accessor"))).unionByName(_rows(spark, ["    }", "}"], 2))
    return rows.withColumn("path", F.lit(path))


# own bootstrap text per framework; an existing file is never replaced
WEB_BOOTSTRAP = """import i18next from "i18next";

export const ready = i18next.init({{ lng: "{lang}", fallbackLng: "{lang}", ns: ["{base}"], defaultNS: "{base}" }});
export const t = (key, values) => i18next.t(key, values);
"""


def bootstrap(language: str, base: str) -> str:
    return WEB_BOOTSTRAP.format(lang=language, base=base)
