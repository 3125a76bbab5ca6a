"""Spans: adjacent ones folded into islands, and containment in bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .ordering import running, with_global_index


def islands(df: DataFrame, group: str, order: str, same: str) -> DataFrame:
    """Runs of neighbouring rows of a group with an equal ``same`` value: adds a 1-based ``island`` number.

    The previous row comes from a join on the position, not from a window over the group, so a group that holds
    a third of all rows still spreads over the cluster.
    """
    placed = with_global_index(df, [group, order], "_i", "islands")
    before = placed.select((F.col("_i") + 1).alias("_i"), F.col(group).alias("_g"), F.col(same).alias("_s"))
    joined = placed.join(before, "_i", "left")
    new = F.when((F.col("_g") == F.col(group)) & (F.col("_s") == F.col(same)), 0).otherwise(1)
    return running(joined.withColumn("_new", new), group, "_new", "island", F.sum).drop("_i", "_g", "_s", "_new", "_part", "_row")


def inside(spans: DataFrame, bodies: DataFrame, on: str) -> DataFrame:
    """Spans strictly inside some body of the same file."""
    s, b = spans.alias("s"), bodies.alias("b")
    cond = (F.col(f"s.{on}") == F.col(f"b.{on}")) & (F.col("s.position") > F.col("b.start")) & (F.col("s.position") < F.col("b.end"))
    return s.join(b, cond, "left_semi")
