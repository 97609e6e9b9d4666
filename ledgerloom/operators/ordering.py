"""Dense positions in a global order, without gathering rows anywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.session import materialise


def with_positions(
    df: DataFrame, *order: str | Column, name: str = "ord", hold: Callable[[DataFrame], DataFrame] = materialise
) -> DataFrame:
    """df with its place from 0 in the given order, which must be total to be repeatable.

    Rows are range-partitioned and sorted once, held (by default in a checkpoint) and counted
    per partition; the running sums of the counts, one row per partition, are broadcast.
    """
    rows = hold(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (
        rows.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_local"))
        .drop("_part", "_local", "_start")
    )
