"""Exact top-k search with a pivot-distance index.

Inner products become distances by one more coordinate: with M the largest length, x gets
sqrt(M^2 - |x|^2) and a query 0, and then a smaller distance is a larger product. Every
vector is keyed by its nearest pivot and its distance from it; equal steps of distance
make annuli. By the triangle inequality a vector of an annulus can't be nearer to a query
than the annulus is, so a query takes the annuli in order of that bound: first a
few, then, with the k-th score found so far, all others that could still hold a better or
equal one. Nothing else is compared, and the result is exact.

An annulus is cut into blocks of bounded size, however many vectors it holds, and the
queries of a block too; each meeting of the two is one matrix product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.llm.common import ddl
from ledgerloom.llm.vectors import best_rows, matrix
from ledgerloom.session import materialise

PIVOTS = 16
RINGS = 16
SAMPLE = 4096  # vectors that pivots are chosen from
BLOCK = 2048  # vectors of an annulus in one block, on average
QUERY_BLOCK = 512
FIRST = 1024  # candidates of the first expansion, at least
_SLACK = 1e-7  # of the longest length, against rounding


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Pivots far from each other out of a sample of bounded size (smallest hashes)."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    points = np.array([r["v"] for r in rows], dtype=np.float64)
    if not len(points):
        return points.reshape(0, 0)
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(points)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray):
    square = (
        (x**2).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots**2).sum(axis=1)
        + (extra[:, None] - pivot_extra) ** 2
    )
    return np.sqrt(np.maximum(square, 0.0))


def _keyed(pivots: np.ndarray, top: float, width: float):
    lengths = (pivots**2).sum(axis=1)
    pivot_extra = np.sqrt(np.maximum(top - lengths, 0.0))

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1))
            if not len(x):
                continue
            extra = np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0.0))
            far = _distances(x, extra, pivots, pivot_extra)
            near = far.argmin(axis=1)
            away = far[np.arange(len(x)), near]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(near.astype(np.int32)),
                    pa.array((away / width).astype(np.int32)),
                    pa.array(away),
                ],
                names=["id", "v", "pivot", "ring", "away"],
            )

    return run


def _wanted(rings, pivots, top, first: bool):
    """(query, v, floor, pivot, ring, sub, part) for every annulus block to look into."""
    lengths = (pivots**2).sum(axis=1)
    pivot_extra = np.sqrt(np.maximum(top - lengths, 0.0))
    pivot = np.array([r["pivot"] for r in rings])
    ring = np.array([r["ring"] for r in rings])
    count = np.array([r["n"] for r in rings])
    low = np.array([r["low"] for r in rings])
    high = np.array([r["high"] for r in rings])
    subs = np.array([r["subs"] for r in rings])
    slack = _SLACK * max(1.0, top) ** 0.5

    def run(batches):
        for batch in batches:
            q = matrix(batch.column(1))
            if not len(q):
                continue
            away = _distances(q, np.zeros(len(q)), pivots, pivot_extra)[:, pivot]
            bound = np.maximum(0.0, np.maximum(low - away, away - high))
            order = bound.argsort(axis=1, kind="stable")
            ahead = np.cumsum(count[order], axis=1) - count[order]
            if first:
                take = ahead < FIRST
            else:  # annuli behind the first ones that may hold a score of `floor` or more
                floor = batch.column(2).to_numpy(zero_copy_only=False)
                reach = (q**2).sum(axis=1) + top - 2 * floor
                reach = np.where(np.isnan(floor), np.inf, np.sqrt(np.maximum(reach, 0.0)) + slack)
                take = (ahead >= FIRST) & (np.take_along_axis(bound, order, 1) <= reach[:, None])
            row, place = np.nonzero(take)
            at = order[row, place]
            row, at = np.repeat(row, subs[at]), np.repeat(at, subs[at])
            sub = np.zeros(len(at), dtype=np.int32)
            if len(at):  # 0, 1, ... inside each annulus
                new = np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])]
                sub = (np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0)))
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pick),
                    batch.column(1).take(pick),
                    batch.column(2).take(pick),
                    batch.column(3).take(pick),
                    pa.array(pivot[at].astype(np.int32)),
                    pa.array(ring[at].astype(np.int32)),
                    pa.array(sub.astype(np.int32)),
                ],
                names=["query_id", "v", "floor", "part", "pivot", "ring", "sub"],
            )

    return run


def _met(k: int):
    def run(key, queries, vectors):
        if not queries.num_rows or not vectors.num_rows:
            return pa.table(
                {
                    "query_id": pa.array([], pa.int64()),
                    "vec_id": pa.array([], pa.int64()),
                    "score": pa.array([], pa.float64()),
                }
            )
        ids = vectors.column("id").to_numpy()
        asked = queries.column("query_id").to_numpy()
        floors = queries.column("floor").to_numpy(zero_copy_only=False)
        # term by term in one order, so that equal vectors get equal scores
        scores = np.einsum("ij,kj->ik", matrix(queries.column("v")), matrix(vectors.column("v")))
        found = []
        for row, query in enumerate(asked):
            fit = ids != query
            if not np.isnan(floors[row]):
                fit &= scores[row] >= floors[row]
            at = np.flatnonzero(fit)
            best = at[best_rows(scores[row][at], ids[at], k)]
            found.append((np.full(len(best), query), ids[best], scores[row][best]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns), strict=True)))

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.dropDuplicates(["query_id", "vec_id", "score"])
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `vectors` with the largest inner product.

    Both hold (id long, v array<double>) as vectors.usable makes them, of one dimension.
    A query does not find rows of its own id. Ties go to the smaller id; rows that repeat
    id and score count once; fewer rows than k give them all; no vectors or no queries give
    no rows.
    """
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    top = vectors.agg(F.max(length)).first()[0]
    empty = queries.select(
        F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"),
        F.lit(0.0).alias("score"),
    ).limit(0)
    if top is None:
        return empty
    top = float(top)
    pivots = choose_pivots(vectors)
    width = max(2.0 * top**0.5 / RINGS, 1e-9)
    keyed = materialise(
        vectors.mapInArrow(
            _keyed(pivots, top, width), ddl(vectors, "pivot int, ring int, away double")
        )
    )
    # at most PIVOTS x (RINGS + 1) annuli
    rings = keyed.groupBy("pivot", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")
    ).withColumn("subs", F.ceil(F.col("n") / BLOCK).cast("int"))
    rings = materialise(rings)
    known = rings.collect()
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    blocks = keyed.join(F.broadcast(rings.select("pivot", "ring", "subs")), ["pivot", "ring"]).select(
        "id",
        "v",
        "pivot",
        "ring",
        F.pmod(F.xxhash64("id", "v"), F.col("subs")).cast("int").alias("sub"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )
    key = ["pivot", "ring", "sub", "part"]
    asking = queries.select(
        F.col("id").alias("query_id"),
        "v",
        F.lit(None).cast("double").alias("floor"),
        F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"),
    )
    schema = (
        "query_id long, v array<double>, floor double, part int, pivot int, ring int, sub int"
    )
    result = "query_id long, vec_id long, score double"

    def look(rows, first):
        asked = rows.mapInArrow(_wanted(known, pivots, top, first), schema)
        return asked.groupBy(*key).cogroup(blocks.groupBy(*key)).applyInArrow(_met(k), result)

    near = materialise(_best(look(asking, True), k))
    last = near.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    further = asking.drop("floor").join(last, "query_id", "left").select(
        "query_id", "v", "floor", "part"
    )
    found = look(further, False)
    return _best(near.select("query_id", "vec_id", "score").unionAll(found), k).select(
        "query_id", "rank", "vec_id", "score"
    )
