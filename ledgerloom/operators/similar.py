"""All pairs of vectors whose cosine reaches a threshold, exactly.

Vectors are scaled to length one and their coordinates put in one common order, those of the
largest mean square first, so the first few carry most of every product. Per vector the
lengths of its rest after 8, 16, 32, ... coordinates are kept: the product of the first
coordinates plus the product of the two rest lengths bounds the cosine from above. Pairs
under the threshold go at the first step that shows it, and few are multiplied to the end.

Pairs meet within their scope only. Every side of a scope is cut into slices of bounded size,
sorted by the length of the rest after the first step; a slice knows the range of its first
coordinates, and a pair of slices whose ranges already bound every product below the
threshold is not made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ledgerloom.config import EngineConfig
from ledgerloom.operators.joins import join_small
from ledgerloom.session import materialise

STRIP = 256  # left rows multiplied at a time where pairs are only counted
FIRST = 8  # coordinates of the first bound; each further one has twice as many


def _steps(width: int) -> list[int]:
    steps = [min(FIRST, width)]
    while steps[-1] < width:
        steps.append(min(2 * steps[-1], width))
    return steps


def pairs_above(
    left: np.ndarray, right: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(i, j, cosine, multiplied) of rows of unit length with cosine >= threshold; `multiplied`
    counts the pairs whose whole product was needed."""
    steps = _steps(left.shape[1])
    rests = [[np.sqrt(np.maximum(1 - (m[:, :s] ** 2).sum(axis=1), 0)) for s in steps] for m in (left, right)]
    slack = 1e-9
    first = left[:, : steps[0]] @ right[:, : steps[0]].T
    i, j = np.nonzero(first + np.outer(rests[0][0], rests[1][0]) >= threshold - slack)
    part = first[i, j]
    multiplied = 0

    def products(low: int, high: int) -> np.ndarray:
        lots = [slice(k, k + (1 << 16)) for k in range(0, len(i), 1 << 16)]
        found = [np.einsum("ij,ij->i", left[i[x], low:high], right[j[x], low:high]) for x in lots]
        return np.concatenate(found) if found else np.empty(0)

    for step, (low, high) in enumerate(zip(steps[:-1], steps[1:], strict=True), 1):
        if high == left.shape[1]:
            multiplied = len(i)
        part = part + products(low, high)
        kept = part + rests[0][step][i] * rests[1][step][j] >= threshold - slack
        i, j, part = i[kept], j[kept], part[kept]
    return i, j, products(0, left.shape[1]), multiplied


def _stacked(vectors: pd.Series, width: int) -> np.ndarray:
    return np.stack(vectors) if len(vectors) else np.empty((0, width))


def earlier_above(
    left_id: np.ndarray, left: np.ndarray, right_id: np.ndarray, right: np.ndarray, threshold: float, scale: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left_id, right_id, cosine, n) of left rows with right rows of smaller id whose rounded
    cosine reaches the threshold: the best of those, the smallest id among equals, and their
    number. Whole products of STRIP left rows at a time, so memory is bounded and dense groups
    cost a matrix product and no pairs."""
    mine, theirs = np.argsort(left_id, kind="stable"), np.argsort(right_id, kind="stable")
    left_id, left, right_id, right = left_id[mine], left[mine], right_id[theirs], right[theirs]
    until = np.searchsorted(right_id, left_id)  # right rows before it have smaller ids
    found = []
    for start in range(0, len(left_id), STRIP):
        ends = until[start : start + STRIP]
        most = int(ends[-1])
        if not most:
            continue
        cosine = left[start : start + STRIP] @ right[:most].T
        if cosine.max() < threshold - 10.0**-scale:
            continue
        cosine = np.round(cosine, scale)
        cosine[(cosine < threshold) | (np.arange(most) >= ends[:, None])] = -2
        n = (cosine > -2).sum(axis=1)
        rows = np.flatnonzero(n)
        best = cosine[rows].argmax(axis=1)
        found.append((left_id[start + rows], right_id[best], cosine[rows, best], n[rows]))
    if not found:
        return left_id[:0], right_id[:0], np.empty(0), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _unit(column: str) -> Column:
    length = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(column, lambda x: x.cast("double") / length))


def _coordinate_order(entries: DataFrame) -> list[int]:
    """Coordinates by falling mean square; one row per coordinate reaches the driver. The
    order steers how early pairs are dropped, not which."""
    means = (
        entries.select(F.posexplode("unit").alias("at", "x"))
        .groupBy("at")
        .agg(F.avg(F.col("x") * F.col("x")).alias("m"))
        .collect()
    )
    return [r["at"] for r in sorted(means, key=lambda r: (-r["m"], r["at"]))]


def _sliced(rows: DataFrame, order: list[int], cfg: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """rows with their slice, and per (scope, slice) the range of each of its first
    coordinates and its longest rest."""
    turned = rows.withColumn("unit", F.transform(F.array(*[F.lit(k) for k in order]), lambda k: F.get("unit", k)))
    first = F.slice("unit", 1, FIRST)
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - F.aggregate(first, F.lit(0.0), lambda s, x: s + x * x)))
    sizes = rows.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / cfg.query_block_rows).cast("int").alias("slices"))
    # Slices group vectors that are alike at first sight: same largest first coordinate, then rest.
    lead = F.array_position(F.transform(first, F.abs), F.array_max(F.transform(first, F.abs))).cast("double")
    place = lead + rest / 2
    joined = join_small(turned.withColumns({"rest": rest, "place": place}), sizes, ["scope"], cfg.broadcast_max_rows, 1, ["id"])
    small = joined.filter("slices = 1").withColumn("slice", F.lit(0))
    large = joined.filter("slices > 1")
    edges = large.groupBy("scope", "slices").agg(
        F.percentile_approx("place", F.array(*[F.lit(k / 64) for k in range(1, 64)]), 1000).alias("edges")
    )
    marked = join_small(large, edges.drop("slices"), ["scope"], cfg.broadcast_max_rows, 1, ["id"])
    part = F.size(F.filter("edges", lambda e: e < F.col("place")))  # 0 to 63
    # no more parts than slices: every further one is another copy of the other side
    part = F.floor(part * F.least(F.col("slices"), F.lit(64)) / 64)
    inside = F.pmod(F.xxhash64("id"), F.ceil(F.col("slices") / 64).cast("int"))
    marked = marked.withColumn("slice", (part * F.ceil(F.col("slices") / 64) + inside).cast("int")).drop("edges")
    rows = materialise(small.unionByName(marked).select("scope", "slice", "id", "unit", "rest"))
    bounds = rows.groupBy("scope", "slice").agg(
        F.max("rest").alias("rest"),
        *[F.min(F.get("unit", F.lit(k))).alias(f"low{k}") for k in range(min(FIRST, len(order)))],
        *[F.max(F.get("unit", F.lit(k))).alias(f"high{k}") for k in range(min(FIRST, len(order)))],
    )
    return rows, bounds


def similar_pairs(
    left: DataFrame, right: DataFrame, threshold: float, cfg: EngineConfig = EngineConfig(), nearest: bool = False,
    earlier: bool = False,
) -> DataFrame:
    """(left_id, right_id, similarity): pairs of one scope with cosine >= threshold (above 0).
    With `nearest`, of each pair of slices only the best right row per left row, the one with
    the smallest id among equals. With `earlier`, of right rows with a smaller id than the
    left one only their number (column n) and the best, per left row and pair of slices: the
    pairs themselves, as many as the square of a group of similar rows, are not made.

    left, right: (scope, id, embedding). Cosines are rounded to cfg.score_scale decimals, and
    the rounded value is compared. Vectors that are null, zero or of another width, and rows
    without a scope, have no pairs.
    """
    limit = threshold - 0.5 * 10.0**-cfg.score_scale
    sides = [left] if left is right else [left, right]
    units = [
        materialise(d.select("scope", "id", _unit("embedding").alias("unit")).filter("unit is not null and scope is not null"))
        for d in sides
    ]
    order = _coordinate_order(units[-1])
    width = len(order)
    if not width:
        order, width = [0], 1
    sized = [u.filter(F.size("unit") == width) for u in units]
    cut = [_sliced(u, order, cfg) for u in sized]
    (a, bounds_a), (b, bounds_b) = cut[0], cut[-1]
    first = range(min(FIRST, width))
    best = F.col("a.rest") * F.col("b.rest")
    for k in first:
        corners = [F.col(f"a.{x}{k}") * F.col(f"b.{y}{k}") for x in ("low", "high") for y in ("low", "high")]
        best = best + F.greatest(*corners)
    meet = (
        bounds_a.alias("a")
        .join(bounds_b.alias("b"), F.col("a.scope") == F.col("b.scope"))
        .filter(best >= limit - 1e-9)
        .select(F.col("a.scope").alias("scope"), F.col("a.slice").alias("slice_a"), F.col("b.slice").alias("slice_b"))
    )
    meet = materialise(meet)
    mine = join_small(
        a.withColumnRenamed("slice", "slice_a"), meet, ["scope", "slice_a"], cfg.broadcast_max_rows, 1, ["id"]
    )
    others = join_small(
        b.withColumnRenamed("slice", "slice_b"), meet, ["scope", "slice_b"], cfg.broadcast_max_rows, 1, ["id"]
    )
    schema = (
        StructType()
        .add("left_id", left.schema["id"].dataType)
        .add("right_id", right.schema["id"].dataType)
        .add("similarity", "double")
    )
    scale = cfg.score_scale
    if earlier:
        schema = schema.add("n", "long")

    def compare(x, y):
        if earlier:
            columns = earlier_above(
                x["id"].to_numpy(), _stacked(x["unit"], width), y["their_id"].to_numpy(),
                _stacked(y["their_unit"], width), threshold, scale,
            )
            return pd.DataFrame(dict(zip(("left_id", "right_id", "similarity", "n"), columns, strict=True)))
        if x.empty or y.empty:
            return pd.DataFrame({"left_id": [], "right_id": [], "similarity": []})
        i, j, cosine, _ = pairs_above(np.stack(x["unit"]), np.stack(y["their_unit"]), limit)
        cosine = np.round(cosine, scale)
        kept = cosine >= threshold
        found = pd.DataFrame(
            {
                "left_id": x["id"].to_numpy()[i[kept]],
                "right_id": y["their_id"].to_numpy()[j[kept]],
                "similarity": cosine[kept],
            }
        )
        if nearest:
            found = found.sort_values(["similarity", "right_id"], ascending=[False, True])
            found = found.drop_duplicates("left_id")
        return found

    keys = ["scope", "slice_a", "slice_b"]
    theirs = others.select(*[F.col(c).alias(f"their_{c}") for c in (*keys, "id", "unit")])
    return (
        mine.select(*keys, "id", "unit")
        .groupBy(*keys)
        .cogroup(theirs.groupBy(*[f"their_{c}" for c in keys]))
        .applyInPandas(compare, schema)
    )


def nearest_above(
    probes: DataFrame, entries: DataFrame, threshold: float, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """(query_id, ord, similarity): per probe (scope, query_id, embedding) the most similar
    entry (scope, ord, embedding) of its scope, the oldest of equals, if it reaches the
    threshold."""
    found = similar_pairs(
        probes.select("scope", F.col("query_id").alias("id"), "embedding"),
        entries.select("scope", F.col("ord").alias("id"), "embedding"),
        threshold,
        cfg,
        nearest=True,
    )
    best = F.min(F.struct((-F.col("similarity")).alias("far"), F.col("right_id").alias("ord")))
    return found.groupBy(F.col("left_id").alias("query_id")).agg(best.alias("b")).select(
        "query_id", "b.ord", (-F.col("b.far")).alias("similarity")
    )
