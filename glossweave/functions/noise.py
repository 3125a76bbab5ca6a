"""Machine-string rules N1-N13 over the trimmed text; a string is noise when any rule holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..session import evaluate_once
from .text import trim_ws


def rules(c: Column, letter_run: str = fixed.ASCII_WORD) -> dict[str, Column]:
    """``letter_run`` is opt-in for non-Latin sources, e.g. ``\\p{L}{2}``."""
    return trimmed_rules(trim_ws(c), letter_run)


def trimmed_rules(t: Column, letter_run: str = fixed.ASCII_WORD) -> dict[str, Column]:
    spaceless = ~F.contains(t, F.lit(" "))
    return {
        "n01_short": F.length(t) < 2,
        "n02_no_letter": ~t.rlike(fixed.LETTER),
        "n03_no_word": ~t.rlike(letter_run),
        "n04_uri": t.rlike(fixed.URI_SCHEME),
        "n05_path": t.rlike(fixed.PATH_LIKE),
        "n06_guid": t.rlike(fixed.GUID),
        "n07_colour": t.rlike(fixed.HEX_COLOUR),
        "n08_media_type": t.rlike(fixed.MEDIA_TYPE),
        "n09_sql": t.rlike(fixed.SQL_VERB) & t.rlike(fixed.SQL_CLAUSE),
        "n10_date": t.rlike(fixed.DATE_PATTERN),
        "n11_screaming": t.rlike(fixed.SCREAMING),
        "n12_identifier": spaceless & t.rlike(fixed.IDENTIFIER),
        "n13_short_lower": spaceless & t.rlike(fixed.SHORT_LOWER),
    }


def _either(*patterns: str) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


# the same rules for filtering: one pattern per question, and prose (which has blanks) is spared the second
_ANY = _either(fixed.URI_SCHEME, fixed.MEDIA_TYPE, fixed.DATE_PATTERN)
_SPACELESS = _either(fixed.PATH_LIKE, fixed.GUID, fixed.HEX_COLOUR, fixed.SCREAMING, fixed.IDENTIFIER, fixed.SHORT_LOWER)


def is_noise_trimmed(t: Column, letter_run: str = fixed.ASCII_WORD) -> Column:
    """For a column that is trimmed already."""
    sql = t.rlike(fixed.SQL_VERB) & t.rlike(fixed.SQL_CLAUSE)
    rest = (F.length(t) < 2) | ~t.rlike(letter_run) | ~t.rlike(fixed.LETTER) | t.rlike(_ANY) | sql
    return rest | (~F.contains(t, F.lit(" ")) & t.rlike(_SPACELESS))


def is_noise(c: Column, letter_run: str = fixed.ASCII_WORD) -> Column:
    return is_noise_trimmed(trim_ws(c), letter_run)


def drop_noise(df: DataFrame, column: str = "text", letter_run: str = fixed.ASCII_WORD) -> DataFrame:
    """Trim once, filter on the trimmed text; the column itself keeps its blanks."""
    out = evaluate_once(df, df.columns, _trimmed=trim_ws(F.col(column)))
    return out.filter(~is_noise_trimmed(F.col("_trimmed"), letter_run)).drop("_trimmed")


def first_rule(t: Column) -> Column:
    """Lowest rule that holds for a trimmed text."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in trimmed_rules(t).items()], F.lit("kept"))
