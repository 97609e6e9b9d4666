"""Mix sources to target weights by iterative proportional fitting.

Token counts are summed once per cell (one combination of the raked columns). The
sweeps work on cells alone: each scales the cells of every value of one column so
that the column's totals meet their targets, column after column, until all of them
hold together. A document's expected number of copies is its cell's factor; a hash of
its key draws the whole number. Documents are never grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.llm.common import uniform
from ledgerloom.operators.joins import fits
from ledgerloom.session import materialise

MISSING = "(none)"
MOST_BROADCAST_CELLS = 100_000


def word_count(text: Column) -> Column:
    """Words between blanks, tabs and line ends; null and blank texts have none."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), "^[ \\t-\\r]+|[ \\t-\\r]+$", "")
    return F.when(F.length(squeezed) == 0, 0).otherwise(
        F.size(F.split(squeezed, "[ \\t-\\r]+"))
    ).cast("long")


def tempered(cells: DataFrame, column: str, exponent: float) -> DataFrame:
    """(value, target): shares of the column's values raised to an exponent below 1,
    which lifts rare values and holds back frequent ones."""
    totals = cells.groupBy(F.col(column).alias("value")).agg(F.sum("tokens").alias("n"))
    return totals.filter("n > 0").select(
        "value", F.pow(F.col("n").cast("double"), F.lit(exponent)).alias("target")
    )


def cell_table(docs: DataFrame, columns: list[str], tokens: str = "tokens") -> DataFrame:
    """Token sum per combination of the columns; null values count as `(none)`."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in columns]
    return docs.groupBy(*keys).agg(F.sum(tokens).alias("tokens"))


def rake(
    cells: DataFrame,
    targets: dict[str, DataFrame],
    tolerance: float = 1e-9,
    rounds: int = 15,
    sweeps: int = 4,
) -> DataFrame:
    """cells plus factor: what each token of a cell weighs, 1 on average.

    targets: column -> (value, target). Only shares count: they are scaled to the
    total of the values that occur, so a value without tokens takes nothing. Values
    without a target get none of the weight. A round is `sweeps` passes over all
    columns in one plan; it stops once a round changes no weight by more than
    `tolerance` of it, or after `rounds` (targets that contradict each other, where some
    combinations never occur, have no common solution).
    """
    shared = cells.filter("tokens > 0")
    for column, given in targets.items():
        present = shared.select(column).distinct()
        one = given.groupBy(F.col("value").alias(column)).agg(F.max("target").alias("_t"))
        kept = present.join(one, column)
        whole = kept.agg(F.sum("_t").alias("_whole"))  # one row
        shares = kept.join(F.broadcast(whole)).select(
            column, (F.col("_t") / F.col("_whole")).alias(f"_share_{column}")
        )
        shared = shared.join(shares, column, "left")
    whole = cells.agg(F.sum("tokens").cast("double").alias("_whole"))
    now = materialise(
        shared.join(F.broadcast(whole)).withColumn("weight", F.col("tokens") / F.col("_whole"))
    )
    for _ in range(rounds):
        now = now.withColumn("_before", F.col("weight"))
        for column in [c for _ in range(sweeps) for c in targets]:
            has = F.sum("weight").over(Window.partitionBy(column))
            share = F.coalesce(F.col(f"_share_{column}"), F.lit(0.0))
            now = now.withColumn(
                "weight", F.when(has > 0, F.col("weight") * share / has).otherwise(0.0)
            )
        now = materialise(now)
        moved = F.max(F.abs(F.col("weight") - F.col("_before")) / F.col("_before"))
        if (now.filter("_before > 0").agg(moved).first()[0] or 0.0) <= tolerance:
            break
    return now.select(
        *targets,
        "tokens",
        (F.col("weight") * F.col("_whole") / F.col("tokens")).alias("factor"),
    )


def mix_sources(
    docs: DataFrame,
    columns: list[str],
    targets: dict[str, DataFrame],
    cells: DataFrame,
    key: str = "doc_id",
    keep: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """docs plus factor, probability and copies.

    factor is the raked weight of the document's cell, probability is
    min(1, keep * factor), the chance of a sample without repetition, and copies
    is a whole number whose mean is keep * factor. copies > 0 holds with exactly that
    probability. Null values of the raked columns are one value of their own; rows with
    null keys share one draw, as do repeated keys; a table without tokens gets factor 0.
    """
    raked = rake(cells, targets).select(
        *[F.col(c).alias(f"_{c}") for c in columns], "factor"
    )
    same = [F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) == F.col(f"_{c}") for c in columns]
    mean = F.col("factor") * F.lit(keep)
    draw = uniform(F.coalesce(F.col(key).cast("string"), F.lit(MISSING)), seed)
    base = docs.drop("factor", "probability", "copies")
    small = fits(raked, MOST_BROADCAST_CELLS)  # beyond it, adaptive joins split a hot cell
    return (
        base.join(F.broadcast(raked) if small else raked, same, "left")
        .withColumn("factor", F.coalesce("factor", F.lit(0.0)))
        .withColumn("probability", F.least(F.lit(1.0), mean))
        .withColumn(
            "copies",
            (F.floor(mean) + F.when(draw < mean - F.floor(mean), 1).otherwise(0)).cast("int"),
        )
        .drop(*[f"_{c}" for c in columns])
    )
