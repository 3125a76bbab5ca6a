"""Culture tags, resource qualifiers and bundle paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# language, optional script, optional region (BCP 47 shape)
KNOWN_SHAPE = r"^[A-Za-z]{2,3}(-[A-Za-z]{4})?(-([A-Za-z]{2}|[0-9]{3}))?$"


def _subtag(part: Column, position: Column) -> Column:
    """BCP 47 casing: language lower, 4-letter script title, 2-letter region upper."""
    return (
        F.when(position == 0, F.lower(part))
        .when(F.length(part) == 4, F.concat(F.upper(F.substring(part, 1, 1)), F.lower(F.substring(part, 2, 3))))
        .when(F.length(part) == 2, F.upper(part))
        .otherwise(part)
    )


def normal_tag(culture: Column, separator: str = "-") -> Column:
    return F.array_join(F.transform(F.split(culture, "[-_]"), _subtag), separator)


def is_known_shape(culture: Column) -> Column:
    return culture.rlike(KNOWN_SHAPE)


def android_qualifier(culture: Column) -> Column:
    tag = normal_tag(culture)
    legacy = tag.rlike(r"^[a-z]{2}(-[A-Z]{2})?$")
    return (
        F.when(culture.isNull(), F.lit("values"))
        .when(legacy, F.concat(F.lit("values-"), F.regexp_replace(tag, r"-([A-Z]{2})$", "-r$1")))
        .otherwise(F.concat(F.lit("values-b+"), F.replace(tag, F.lit("-"), F.lit("+"))))
    )


def arb_locale(culture: Column) -> Column:
    return normal_tag(culture, "_")


def bundle_path(fmt: Column, directory: Column, base: Column, culture: Column) -> Column:
    """Source bundle when ``culture`` is null. Unknown formats give null: rejected at validation."""
    neutral = culture.isNull()
    tag = F.coalesce(normal_tag(culture), F.lit("en"))
    return (
        F.when(fmt == "resx", F.concat(directory, F.lit("/"), base, F.when(neutral, F.lit("")).otherwise(F.concat(F.lit("."), tag)), F.lit(".resx")))
        .when(fmt == "i18next", F.concat(directory, F.lit("/"), tag, F.lit("/"), base, F.lit(".json")))
        .when(fmt == "android", F.concat(directory, F.lit("/"), android_qualifier(culture), F.lit("/"), base, F.lit(".xml")))
        .when(fmt == "strings", F.concat(directory, F.lit("/"), F.when(neutral, F.lit("Base")).otherwise(tag), F.lit(".lproj/"), base, F.lit(".strings")))
        .when(fmt == "arb", F.concat(directory, F.lit("/"), base, F.lit("_"), F.coalesce(arb_locale(culture), F.lit("en")), F.lit(".arb")))
    )
