"""Connected components of an undirected graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex that each vertex of `edges` (a, b) reaches.

    Every vertex hooks onto its smallest neighbour, the trees are flattened by pointer
    doubling, and edges inside one tree vanish; what is left is a smaller graph of
    roots. A hub costs nothing extra: minima combine before the shuffle.
    """
    found = None
    left = written(edges.select("a", "b").filter("a <> b").distinct())
    while not left.isEmpty():
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("p"))
        up = written(up)
        while True:  # each pass makes every path to a root four times as short
            top = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            twice = up.join(top, "p").select("v", F.col("q").alias("p"))
            higher = top.join(top.select(F.col("p").alias("q"), F.col("q").alias("r")), "q")
            both = twice.join(higher.select("p", "r"), "p")
            jumped = written(both.select("v", F.col("r").alias("p"), F.col("p").alias("was")))
            up = jumped.select("v", "p")
            if jumped.filter("p <> was").isEmpty():
                break
        root_a = up.select(F.col("v").alias("a"), F.col("p").alias("ra"))
        root_b = up.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        left = written(
            left.join(root_a, "a")
            .join(root_b, "b")
            .filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        if found is None:
            found = up
        else:
            over = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            moved = found.join(over, "p", "left").withColumn("q", F.coalesce("q", "p"))
            found = written(moved.select("v", F.col("q").alias("p")))
    if found is None:
        found = left.select(F.col("a").alias("v"), F.col("b").alias("p"))
    return found.select(F.col("v").alias("vertex"), F.col("p").alias("component"))
