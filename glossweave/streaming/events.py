"""Append-only run log: readers with cursors, and a live view through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import RUN_EVENT


def append(events: DataFrame, path: str) -> None:
    events.select(*[f.name for f in RUN_EVENT]).write.mode("append").parquet(path)


def after_cursor(events: DataFrame, cursors: DataFrame, reader: str) -> DataFrame:
    """Rows after each reader's cursor. A busy log is a skewed key, which adaptive execution splits."""
    return events.join(cursors, reader).filter(F.col("event_id") > F.col("cursor"))


def read_from(spark: SparkSession, path: str, run_id: str, cursor: int = -1) -> tuple[DataFrame, DataFrame]:
    """(events after the cursor, one row with the completion flag). Late readers start at -1 and replay all."""
    log = spark.read.schema(RUN_EVENT).parquet(path).filter(F.col("run_id") == run_id)
    done = log.agg(F.coalesce(F.bool_or(F.col("kind") == "completed"), F.lit(False)).alias("complete"))
    return log.filter(F.col("event_id") > cursor), done


def follow(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Live stream of the log; the checkpoint of the query that consumes it is the cursor."""
    log = spark.readStream.schema(RUN_EVENT).parquet(path)
    return log if run_id is None else log.filter(F.col("run_id") == run_id)
