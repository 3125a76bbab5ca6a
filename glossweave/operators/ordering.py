"""Total order without a single-task sort: dense row numbers, ranks in hot groups, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import discard, materialise


def ranged(df: DataFrame, order: list, label: str, written: bool = False) -> DataFrame:
    """Range-partitioned and sorted by a unique order; ``_part``/``_row`` name each row's place.

    Range partitioning reads its input twice, once to sample: unless the input is a written table (or cheap to
    derive from one), it is written first.

    Written once, so both passes over it (counting, numbering) see the same places even if an executor is
    lost in between. Range partitioning by a unique order keeps partitions even, whatever one key holds.
    """
    source = df if written else materialise(df, label + "-input", packed=True)
    out = source.repartitionByRange(*order).sortWithinPartitions(*order)
    out = out.withColumn("_part", F.spark_partition_id())
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    out = materialise(out.withColumn("_row", row), label, packed=True)
    if not written:
        discard(df.sparkSession, source)
    return out


def with_global_index(df: DataFrame, order: list, name: str = "id", label: str = "index", written: bool = False) -> DataFrame:
    """Dense 0-based position in ``order``. Adds ``_part`` and ``_row`` as well."""
    placed = ranged(df, order, label, written)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per shuffle partition: its size is bounded by the partition count, not by the data
    offsets = counts.select(
        "_part", (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_offset")
    )
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_row")).drop("_offset")


def with_group_rank(df: DataFrame, group: str, order: list, name: str = "rank", label: str = "rank", written: bool = False) -> DataFrame:
    """1-based rank inside ``group``; a group may span many partitions. Adds ``_part`` and ``_row`` as well."""
    placed = ranged(df, [group, *order], label, written)
    return running(placed.withColumn("_one", F.lit(1).cast("long")), group, "_one", name, F.sum).drop("_one")


def running(placed: DataFrame, group: str, value: str, name: str, how=F.max) -> DataFrame:
    """Running ``F.max`` or ``F.sum`` of ``value`` per group over rows already placed by :func:`ranged`.

    Inside a partition by window; across partitions from one row per (group, partition).
    """
    local = placed.withColumn("_local", how(value).over(W.partitionBy(group, "_part").orderBy("_row")))
    totals = placed.groupBy(group, "_part").agg(how(value).alias("_total"))
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(group, "_part", how("_total").over(earlier).alias("_carry"))
    joined = local.join(before, [group, "_part"])
    both = F.coalesce(F.col("_local") + F.col("_carry"), "_local") if how is F.sum else F.greatest("_local", "_carry")
    return joined.withColumn(name, both).drop("_local", "_carry")


def batches(df: DataFrame, order: list, size: int) -> DataFrame:
    """Consecutive batches of ``size`` rows in ``order``."""
    return with_global_index(df, order, "_i", "batch").withColumn("batch_id", F.floor(F.col("_i") / size)).drop("_i", "_part", "_row")
