"""Path predicates and arithmetic on '/'-separated relative paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .. import fixed


def normal_path(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^./\\]+)$", 1))


def file_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]+)$", 1)


def depth(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def directory(c: Column) -> Column:
    return F.regexp_replace(c, r"/?[^/]*$", "")


def under(c: Column, folder: str) -> Column:
    return F.startswith(F.lower(normal_path(c)), F.lit(folder.lower().rstrip("/") + "/"))


def is_test_file(c: Column) -> Column:
    p = F.concat(F.lit("/"), F.lower(normal_path(c)))
    return reduce(lambda a, b: a | b, [F.contains(p, F.lit(f)) for f in fixed.TEST_FRAGMENTS])


def excluded_by(c: Column, resource_dir: str | None = None, user_fragments: tuple[str, ...] = ()) -> Column:
    """Name of the first exclusion that applies, null when the file is scanned."""
    p = F.lower(normal_path(c))
    out = F.when(
        F.arrays_overlap(F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0))), F.array(*[F.lit(s) for s in fixed.SKIP_SEGMENTS])),
        F.lit("skip_segment"),
    )
    out = out.when(reduce(lambda a, b: a | b, [F.endswith(p, F.lit(s)) for s in fixed.GENERATED_SUFFIXES]), F.lit("generated_name"))
    if resource_dir:
        out = out.when(under(c, resource_dir), F.lit("resource_dir"))
    for fragment in user_fragments:
        out = out.when(F.contains(p, F.lit(fragment.replace("\\", "/").lower())), F.lit("user_fragment"))
    return out


def is_generated_content(c: Column) -> Column:
    head = F.upper(F.substring(c, 1, fixed.BANNER_CHARS))
    return reduce(lambda a, b: a | b, [F.contains(head, F.lit(b.upper())) for b in fixed.GENERATED_BANNERS])
