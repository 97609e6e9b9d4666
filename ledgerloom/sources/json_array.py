"""JSON files that hold one large array of objects, read in many tasks.

The text reader splits a file at every closing brace, wherever its byte ranges end. Whether a
brace stands inside a string, how deep it lies and which object it ends are running sums over
the pieces: per range first, then over one row per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_RANGE, _PLACE = "_range", "_piece"


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _with_sums(pieces: DataFrame, **columns: str) -> DataFrame:
    """pieces with new columns: the sum of the named column over all pieces before each.

    A range is one scan split, so what one task sorts is bounded; the sums of whole ranges
    are one small row for each.
    """
    totals = pieces.groupBy(_RANGE).agg(*[F.sum(c).alias(f"_{n}") for n, c in columns.items()])
    earlier = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        _RANGE, *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in columns]
    )
    inside = Window.partitionBy(_RANGE).orderBy(_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.join(F.broadcast(starts), _RANGE)
    for name, column in columns.items():
        before = F.coalesce(F.sum(column).over(inside), F.lit(0))
        placed = placed.withColumn(name, F.col(f"_{name}") + before).drop(f"_{name}")
    return placed


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """place, offset, value: the objects of the array in one file as text, numbered from 0 in
    file order, with the byte at which each begins (blanks and the comma before it included).

    An empty array gives no rows, as does an empty file. What is no array of objects
    raises when the rows are read: a broken object, a missing comma, an element
    of another kind or an unfinished array, each with its offset.
    """
    pieces = (
        spark.read.option("lineSep", "}")
        .text(path)
        .select(
            F.col("_metadata.file_block_start").alias(_RANGE),
            F.monotonically_increasing_id().alias(_PLACE),
            F.col("_metadata.file_size").alias("_size"),
            "value",
        )
        .withColumn("_bare", F.regexp_replace("value", r"(?s)\\.", ""))  # no escaped quotes
        .withColumn("_quotes", _count(F.col("_bare"), '"'))
        .withColumn("_bytes", F.octet_length("value") + 1)
    )
    pieces = _with_sums(pieces, _open="_quotes", offset="_bytes")
    # A piece that begins inside a string gets the quote that it lacks.
    whole = F.concat(F.when(F.col("_open") % 2 == 1, '"').otherwise(""), F.col("_bare"))
    outside = F.regexp_replace(whole, r'"[^"]*+"?', "")
    braced = F.col("offset") + F.col("_bytes") <= F.col("_size")  # all but what follows the last brace
    closes = (braced & ((F.col("_open") + F.col("_quotes")) % 2 == 0)).cast("int")
    pieces = (
        pieces.withColumn("_closes", closes)
        .withColumn("_change", _count(outside, "{") - closes)
        .withColumn("_last", F.col("offset") + F.col("_bytes") >= F.col("_size"))
        .drop("_bare", "_quotes", "_bytes", "_open", "_size")
    )
    pieces = _with_sums(pieces, _depth="_change")
    ends = (F.col("_closes") == 1) & (F.col("_depth") + F.col("_change") <= 0)
    pieces = _with_sums(pieces.withColumn("_ends", ends.cast("int")), place="_ends")
    found = pieces.groupBy("place").agg(
        F.array_sort(F.collect_list(F.struct(_RANGE, _PLACE, "value"))).alias("_parts"),
        F.min("offset").alias("offset"),
        F.max("_ends").alias("_ended"),
        F.max("_last").alias("_last"),
    )
    text = F.array_join(F.transform("_parts", lambda p: p["value"]), "}")
    return _checked(found.withColumn("_text", F.concat(text, F.when(F.col("_ended") == 1, "}").otherwise(""))))


def _checked(found: DataFrame) -> DataFrame:
    """The objects, without what stands between them; raises where that is wrong."""
    start = F.col("place") == 0
    object = F.when(start, F.regexp_extract("_text", r"(?s)^﻿?\s*\[\s*(\{.*)$", 1)).otherwise(
        F.regexp_extract("_text", r"(?s)^\s*,\s*(\{.*)$", 1)
    )
    end = F.when(start, F.col("_text").rlike(r"^﻿?\s*\[\s*\]\s*$")).otherwise(
        F.col("_text").rlike(r"^\s*\]\s*$")
    )
    where = F.concat(F.lit("no array of JSON objects: see byte "), F.col("offset").cast("string"))
    value = (
        F.when((F.col("_ended") == 0) & end, F.lit(None))  # what closes the array
        .when((F.col("_ended") == 0) | F.col("_last"), F.raise_error(where))
        .when(F.json_object_keys("_object").isNull(), F.raise_error(where))
        .otherwise(F.col("_object"))
    )
    listed = found.withColumn("_object", object).withColumn("value", value)
    return listed.filter("value is not null").select("place", "offset", "value")
