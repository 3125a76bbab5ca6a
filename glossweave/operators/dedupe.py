"""First occurrences and counts. All are plain aggregates, so repeated values collapse before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_occurrence(df: DataFrame, key: str, order: list[str], carry: list[str] | None = None) -> DataFrame:
    """One row per key with the values of its first row in ``order`` (which must be unique)."""
    first = F.min(F.struct(*order, *(carry or []))).alias("f")
    return df.groupBy(key).agg(first, F.count("*").alias("occurrences")).select(key, "f.*", "occurrences")


def distinct_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Rows and exact distinct values per group through one row per (group, value)."""
    per_value = df.groupBy(*group, value).agg(F.count("*").alias("_n"))
    return per_value.groupBy(*group).agg(F.sum("_n").alias("n"), F.count(value).alias("distinct_n"))


def lowest_key(df: DataFrame, value: str = "value", key: str = "key") -> DataFrame:
    """Bundle inverted: value -> lowest key that holds it."""
    return df.filter(F.col(value) != "").groupBy(value).agg(F.min(key).alias(key), F.count("*").alias("holders"))
