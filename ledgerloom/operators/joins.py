"""Join helpers that keep plans safe when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; reads at most one row more."""
    return df.limit(max_rows + 1).count() <= max_rows


def join_small(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    max_rows: int,
    salts: int,
    spread: list[str],
    how: str = "inner",
    known_small: bool | None = None,
) -> DataFrame:
    """Join `small` to `big` without moving `big` when `small` is proven to fit.

    Beyond the bound both sides shuffle; rows of `big` with one key are spread
    over `salts` partitions by the `spread` columns, so a hot key is split.
    `known_small` passes on a bound already checked on a superset of `small`.
    """
    if fits(small, max_rows) if known_small is None else known_small:
        return big.join(F.broadcast(small), keys, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def join_hot(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    hot_rows: int = 1_000_000,
    salts: int = 16,
) -> DataFrame:
    """Join where a few keys may hold much of `left`; `right` has few rows per key.

    Keys with more than hot_rows rows are counted first (combined map-side). At most
    rows / hot_rows keys can be that frequent, so their list is safe to broadcast.
    Only those keys are spread over `salts` partitions, by a hash of the whole row
    so that a recomputed task spreads alike, and only their right rows are copied.
    """
    hot = (
        left.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*keys, F.lit(True).alias("_hot"))
    )
    row_salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    spread = (
        left.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.when(F.col("_hot"), row_salt).otherwise(0))
        .drop("_hot")
    )
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    copies = (
        right.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
