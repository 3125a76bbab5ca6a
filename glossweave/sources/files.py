"""Source trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed
from ..functions import paths


def decode(files: DataFrame) -> DataFrame:
    """Binary ``content`` to ``text``: null when it is not valid UTF-8; a byte order mark is noted and cut off."""
    bom = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    body = F.when(bom, F.substring(F.col("content"), F.lit(4), F.length("content"))).otherwise(F.col("content")).cast("string")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return files.withColumn("is_valid_utf8", valid).withColumn("has_bom", bom).withColumn("text", F.when(valid, body)).drop("content")


def walk(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(path, is_valid_utf8, has_bom, text) with paths relative to ``root``; links are not followed by the listing
    of a distributed file system, unreadable files are skipped."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).option("ignoreCorruptFiles", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.load(root).select("path", "content")
    base = root.rstrip("/").replace("file:", "")
    relative = F.substring_index(F.col("path"), base + "/", -1)
    return decode(df.withColumn("path", relative))


def scannable(files: DataFrame, stack: str, resource_dir: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Extension, exclusion, encoding and banner filters, cheap ones first."""
    p = F.col("path")
    out = files.filter(paths.extension(p).isin(*fixed.STACK_EXTENSIONS[stack]))
    out = out.filter(paths.excluded_by(p, resource_dir, exclude).isNull())
    if stack == "web":
        out = out.filter(~paths.is_test_file(p))
    return out.filter("is_valid_utf8").filter(~paths.is_generated_content(F.col("text")))


def write_back(changed: DataFrame, root: str) -> DataFrame:
    """changed(path, text, has_bom) into the tree below ``root``: the old bytes are kept beside each file once, the
    new file replaces the old one in a single step. The tree must be mounted on every executor. Returns the paths."""
    import os
    import shutil

    import pandas as pd

    base = root.replace("file:", "")

    def run(frames):
        for frame in frames:
            for path, text, bom in zip(frame["path"], frame["text"], frame["has_bom"]):
                target = os.path.join(base, path)
                if not os.path.exists(target + ".bak"):
                    shutil.copyfile(target, target + ".bak")
                with open(target + ".tmp", "wb") as out:
                    out.write((b"\xef\xbb\xbf" if bom else b"") + text.encode("utf-8"))
                os.replace(target + ".tmp", target)
            yield pd.DataFrame({"path": frame["path"]})

    from ..session import materialise

    return materialise(changed.mapInPandas(run, "path string"), "written")
