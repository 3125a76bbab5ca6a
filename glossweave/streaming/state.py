"""Incremental state from a stream of written translations: idempotent upserts, no event time.

State is keyed by (language, key) and grows with the bundles, so it lives in files, one folder per version;
a batch that is replayed after a failure writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.incremental import upsert
from ..schemas import STATE_WRITTEN

ON = ["lang", "key"]


def version_path(root: str, version: int) -> str:
    return f"{root}/v{version:012d}"


def read_version(spark: SparkSession, root: str, version: int) -> DataFrame:
    """State after a batch; before the first batch it is empty."""
    if version < 0:
        return spark.createDataFrame([], STATE_WRITTEN)
    return spark.read.schema(STATE_WRITTEN).parquet(version_path(root, version))


def start(written: DataFrame, root: str, checkpoint: str):
    """``written``: streaming (lang, key, source_hash, translation_hash, seq); the highest seq of a batch wins."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        last = F.max_by(F.struct("source_hash", "translation_hash"), "seq").alias("v")
        new = batch.groupBy(*ON).agg(last).select(*ON, "v.*")
        merged = upsert(read_version(spark, root, epoch - 1), new, ON)
        merged.write.mode("overwrite").parquet(version_path(root, epoch))

    return written.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
