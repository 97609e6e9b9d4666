"""Session-level helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that driver and executors share.

    It is the one the cluster names in spark.checkpoint.dir. Only a local session, as in
    tests, may go without: it gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ledgerloom-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, what an action has shuffled is deleted when it ends and not some time later; no
    action may use shuffles of an earlier one."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer partitions than there are cores, such as one
    small file, before row-wise work that keeps a core busy. Scans of real size have
    more partitions than cores and stay as they are."""
    wanted = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(wanted) if scan.rdd.getNumPartitions() < wanted else scan
