"""Session settings, table loading and durable materialisation."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

# Only settings that are safe on any cluster; sizes stay with whoever submits the job.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "glossweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a scan has fewer splits than cores (few, small files); else no shuffle at all.

    Call it on the pruned columns: text work costs far more than moving a few megabytes once.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def evaluate_once(df: DataFrame, keep: list[str], **columns) -> DataFrame:
    """Computed columns behind a generator, so that later filters read them instead of repeating them.

    The optimizer pushes a filter below a projection by copying the projected expression into every
    predicate; a thirteen-rule filter over a regex result would run the regex thirteen times.
    """
    cell = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(cell)))


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, named by ``spark.checkpoint.dir``.

    Only a session on one machine (master ``local``) gets a local default; on a cluster a missing setting is an error,
    because files in a folder of one machine are not seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "/tmp/glossweave-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/glossweave/{label}-{uuid.uuid4().hex}"


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What a write inside has shuffled leaves the executors' disks when the write ends, not when the driver happens to collect its
    garbage. For writes alone: nothing reads those shuffles again, their result is in the written files."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def materialise(df: DataFrame, label: str, packed: bool = False) -> DataFrame:
    """Write once to the shared folder and read back: survives lost executors and cuts lineage.

    ``packed``: for large tables, smaller files for some more CPU time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_freed(spark):
        (df.write.option("compression", "zstd") if packed else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *written: DataFrame | str) -> None:
    """Deletes tables of :func:`materialise`, or folders of :func:`scratch_path`, that nothing reads any more."""
    folders = {f.rpartition("/")[0] for w in written if isinstance(w, DataFrame) for f in w.inputFiles()}
    own = f"{shared_dir(spark)}/glossweave/"
    for folder in folders | {w for w in written if isinstance(w, str)}:
        if re.sub("^file:/*", "/", own) not in re.sub("^file:/*", "/", folder):
            raise ValueError(f"not a scratch folder: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
