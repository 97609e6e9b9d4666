"""Contiguous shards of near-equal byte size from global prefix sums.

Rows are laid out once in key order over range partitions; every partition reports
its total, the totals are summed up in partition order, and a row's global prefix is
its partition's start plus its running sum inside the partition. Only keys and sizes
move, never the texts. A hot key cannot swell one partition: the order goes on below
the key, so rows with one key are cut like any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.session import materialise

ROW_BYTES = 16


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 40,
    key: str = "doc_id",
    text: str = "text",
    row_bytes: int = ROW_BYTES,
    partitions: int | None = None,
) -> DataFrame:
    """key, size, text_crc32, shard, slot: one row per input row.

    size is the UTF-8 length of the text (null: 0) plus row_bytes, text_crc32 the
    unsigned CRC of those bytes (null for a null text). The rows in order of key
    (nulls first), CRC and scan position form one line of bytes, cut at equal
    targets: a row belongs to the shard that holds its middle byte. Shards are
    contiguous, differ from the target by less than one row at each end, and
    may stay empty if there are fewer rows than shards. slot counts 0, 1, 2, ...
    inside a shard. Repeated rows each get their own place; an empty table gives an
    empty result; extra columns are not read.
    """
    spark = docs.sparkSession
    body = F.col(text).cast("string")
    rows = docs.select(
        F.col(key).alias("key"),
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + row_bytes).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    ).withColumn("line", F.monotonically_increasing_id())
    wanted = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Fixed before it is used twice: range bounds come from a sample.
    placed = materialise(
        rows.repartitionByRange(wanted, "key", "text_crc32", "line").withColumn(
            "part", F.spark_partition_id()
        )
    )
    order = Window.orderBy("part")  # one row per partition
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(
        F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows")
    )
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("byte_start"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("row_start"),
        F.sum("part_bytes").over(order.rowsBetween(*_ALL)).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy("key", "text_crc32", "line")
    running = placed.select(
        "*",
        F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.row_number().over(inside).alias("nth"),
    )
    # `starts` has one row per partition, so its size is bounded by `wanted`
    lined = running.join(F.broadcast(starts), "part").select(
        "key",
        "size",
        "text_crc32",
        (F.col("row_start") + F.col("nth") - 1).alias("row"),
        F.expr(
            f"cast(least({shards} - 1, (2 * (byte_start + upto) - size) * {shards}"
            " div (2 * all_bytes)) as int)"
        ).alias("shard"),
    )
    lined = materialise(lined)
    firsts = lined.groupBy("shard").agg(F.min("row").alias("first_row"))  # at most `shards` rows
    return lined.join(F.broadcast(firsts), "shard").select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        "shard",
        (F.col("row") - F.col("first_row")).alias("slot"),
    )


_ALL = (Window.unboundedPreceding, Window.unboundedFollowing)
