"""All candidates of a source tree, in scan order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import paths
from ..functions.text import mask_outside
from . import code, markup
from .ordering import with_global_index

# fixed values: (stack, extensions, "markup" or "code", dialect, part of the file that is live)
TEMPLATE = r"(?is)<template[^<>]*>.*</template>"
SCRIPT = r"(?is)<script[^<>]*>.*?</script>"
SCANS = [
    ("dotnet", (".cs",), "code", "csharp", None),
    ("dotnet", (".xaml", ".axaml"), "markup", "xaml", None),
    ("dotnet", (".cshtml", ".razor"), "markup", "razor", None),
    ("web", (".html", ".htm", ".svelte"), "markup", "html", None),
    ("web", (".jsx", ".tsx"), "markup", "jsx", None),
    ("web", (".jsx", ".tsx", ".js", ".ts"), "code", "script", None),
    ("web", (".vue",), "markup", "vue", TEMPLATE),
    ("web", (".vue",), "code", "script", SCRIPT),
    ("android", (".kt", ".java"), "code", "android", None),
    ("android", (".xml",), "markup", "android_layout", None),
    ("apple", (".swift",), "code", "swift", None),
    ("apple", (".m", ".mm"), "code", "objc", None),
    ("apple", (".storyboard", ".xib"), "markup", "interface_builder", None),
    ("flutter", (".dart",), "code", "dart", None),
]
COLUMNS = ["path", "dialect", "phase", "span_start", "span_length", "line", "text", "raw", "kind", "context", "member", "blocked_reason", "is_interpolated", "interpolation_args"]


def register(stack: str, extensions: tuple[str, ...], family: str, dialect: str, live: str | None = None) -> None:
    """Adds a scan; dialects are added to ``markup.DIALECTS`` or ``code.DIALECTS``."""
    SCANS.append((stack, extensions, family, dialect, live))


def candidates(files: DataFrame, stack: str, include_diagnostics: bool = False) -> DataFrame:
    """files(path, text) -> one row per candidate. Every scan reads only files of its extensions."""
    found = []
    for name, extensions, family, dialect, live in SCANS:
        if name != stack:
            continue
        part = files.filter(paths.extension(F.col("path")).isin(*extensions))
        if dialect == "android_layout":
            part = part.filter(markup.copy_bearing_xml(F.col("path"), F.col("text")))
        text = F.col("text")
        if live:
            text = mask_outside(text, live)
        part = part.select("path", text.alias("content"))
        if family == "code":
            out = code.candidates(part, ["path"], "content", dialect, include_diagnostics)
        else:
            out = markup.candidates(part, ["path"], "content", dialect)
            out = out.withColumn("is_interpolated", F.lit(False)).withColumn("interpolation_args", F.lit(None).cast("array<string>"))
        found.append(out.withColumn("dialect", F.lit(dialect)).select(*COLUMNS))
    # the same span may be seen by two scans of a file; the first phase wins
    every = reduce(DataFrame.unionByName, found)
    first = every.groupBy("path", "span_start").agg(F.min("phase").alias("phase"))
    return every.join(first, ["path", "span_start", "phase"])


def with_ids(found: DataFrame) -> DataFrame:
    """Ids in scan order: path ignoring case, then phase, then position."""
    return with_global_index(found.withColumn("_folded", F.upper("path")), ["_folded", "path", "phase", "span_start"], "id", "scan").drop("_folded", "_part", "_row")


def file_status(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """One status per file: scanned or skipped."""
    s = scanned.select("path").distinct().withColumn("_s", F.lit(1))
    return files.select("path").join(s, "path", "left").select("path", F.when(F.col("_s") == 1, "scanned").otherwise("skipped").alias("status"))
