"""Exact cosine nearest neighbours.

Scores are computed block by block with matrix products inside tasks; each task
returns only its k best rows per query, so no query-document pair table exists.
One side is broadcast when it is proven to be at most one block; otherwise both
sides are laid out on a grid of bounded blocks (rows x columns) and every cell
is one co-grouped task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from ledgerloom.config import EngineConfig
from ledgerloom.functions.vectors import cosine_matrix, stack
from ledgerloom.operators.joins import fits

_COLUMNS = ["query_id", "doc_key", "ord", "distance"]


def _best_in_block(query_matrix, docs: pd.DataFrame, k: int, scale: int) -> tuple:
    """(distance, ord, doc_key) matrices: the k nearest documents of a block per
    query; ties go to the lower ord."""
    docs = docs.sort_values("ord", kind="stable")
    distance = np.round(1.0 - cosine_matrix(query_matrix, stack(docs["embedding"])), scale) + 0.0
    nearest = np.argsort(distance, axis=1, kind="stable")[:, :k]
    return (
        np.take_along_axis(distance, nearest, axis=1),
        docs["ord"].to_numpy()[nearest],
        docs["doc_key"].to_numpy()[nearest],
    )


def _merge(one: tuple, other: tuple, k: int) -> tuple:
    distance, ords, keys = (np.concatenate(pair, axis=1) for pair in zip(one, other))
    nearest = np.lexsort((ords, distance), axis=1)[:, :k]
    return tuple(np.take_along_axis(m, nearest, axis=1) for m in (distance, ords, keys))


def _as_rows(query_ids, best: tuple) -> pd.DataFrame:
    distance, ords, keys = best
    return pd.DataFrame(
        {
            "query_id": np.repeat(np.asarray(query_ids), distance.shape[1]),
            "doc_key": keys.ravel(),
            "ord": ords.ravel(),
            "distance": distance.ravel(),
        },
        columns=_COLUMNS,
    )


def _result_schema(queries: DataFrame, docs: DataFrame) -> StructType:
    return (
        StructType()
        .add("query_id", queries.schema["query_id"].dataType)
        .add("doc_key", docs.schema["doc_key"].dataType)
        .add("ord", docs.schema["ord"].dataType)
        .add("distance", "double")
    )


def _scan_with_queries(queries: DataFrame, docs: DataFrame, k: int, cfg: EngineConfig) -> DataFrame:
    """Queries fit one block: broadcast them and scan the documents once, no shuffle."""
    block = queries.select("query_id", "embedding").toPandas()
    shared = docs.sparkSession.sparkContext.broadcast(
        (block["query_id"].to_numpy(), stack(block["embedding"]) if len(block) else None)
    )
    scale = cfg.score_scale

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        best = None
        for batch in batches:
            if len(batch) and len(ids):
                found = _best_in_block(matrix, batch, k, scale)
                best = found if best is None else _merge(best, found, k)
        if best is not None:
            yield _as_rows(ids, best)

    return docs.select("doc_key", "ord", "embedding").mapInPandas(
        nearest, _result_schema(queries, docs)
    )


def _grid(queries: DataFrame, docs: DataFrame, k: int, cfg: EngineConfig) -> DataFrame:
    """Neither side fits: queries and documents meet in a grid of bounded cells."""
    n_rows = max(1, -(-queries.count() // cfg.query_block_rows))
    n_cols = max(1, -(-docs.count() // cfg.corpus_block_rows))

    def line(key: str, n: int):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select("query_id", "embedding", line("query_id", n_rows).alias("cell_row"))
    right = docs.select("doc_key", "ord", "embedding", line("doc_key", n_cols).alias("cell_col"))
    scale = cfg.score_scale

    def nearest(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or ds.empty:
            return pd.DataFrame(columns=_COLUMNS)
        return _as_rows(qs["query_id"], _best_in_block(stack(qs["embedding"]), ds, k, scale))

    cells = ["cell_row", "cell_col"]
    return (
        left.withColumn("cell_col", every(n_cols))
        .groupBy(*cells)
        .cogroup(right.withColumn("cell_row", every(n_rows)).groupBy(*cells))
        .applyInPandas(nearest, _result_schema(queries, docs))
    )


def vector_topk(
    queries: DataFrame, docs: DataFrame, k: int, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """(query_id, doc_key, ord, distance, rank): the k nearest documents per query.

    queries: (query_id, embedding); docs: (doc_key, ord, embedding).
    """
    k = max(k, 1)
    plan = _scan_with_queries if fits(queries, cfg.query_block_rows) else _grid
    nearest = Window.partitionBy("query_id").orderBy("distance", "ord")
    return (
        plan(queries, docs, k, cfg)
        .withColumn("rank", F.row_number().over(nearest))
        .filter(F.col("rank") <= k)
    )


def _nearest_in_scope(probes: DataFrame, entries: DataFrame, cfg: EngineConfig) -> DataFrame:
    """nearest_entry for many scoped entries: probes meet the entries of their scope in
    slices of about query_block_rows, and the best of the slices counts."""
    sizes = entries.groupBy("scope").agg(
        F.ceil(F.count(F.lit(1)) / cfg.query_block_rows).cast("int").alias("slices")
    )
    own = entries.join(sizes, "scope").select(
        F.col("scope").alias("own_scope"), "doc_key", "ord", F.col("embedding").alias("own"),
        F.pmod(F.xxhash64("doc_key"), F.col("slices")).cast("int").alias("own_slice"),
    )
    asked = probes.join(sizes, "scope").select(
        "scope", "query_id", "embedding",
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
    )
    scale = cfg.score_scale

    def best(qs: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or es.empty:
            return pd.DataFrame(columns=["query_id", "doc_key", "ord", "similarity"])
        es = es.sort_values("ord")
        matrix, found = stack(es["own"]), []
        for start in range(0, len(qs), cfg.query_block_rows):
            part = qs.iloc[start : start + cfg.query_block_rows]
            near = np.round(cosine_matrix(stack(part["embedding"]), matrix), scale)
            at = near.argmax(axis=1)
            found.append(
                pd.DataFrame(
                    {
                        "query_id": part["query_id"].to_numpy(),
                        "doc_key": es["doc_key"].to_numpy()[at],
                        "ord": es["ord"].to_numpy()[at],
                        "similarity": near[np.arange(len(at)), at],
                    }
                )
            )
        return pd.concat(found)

    schema = (
        StructType()
        .add("query_id", probes.schema["query_id"].dataType)
        .add("doc_key", entries.schema["doc_key"].dataType)
        .add("ord", entries.schema["ord"].dataType)
        .add("similarity", "double")
    )
    first = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "ord")
    return (
        asked.groupBy("scope", "slice")
        .cogroup(own.groupBy("own_scope", "own_slice"))
        .applyInPandas(best, schema)
        .withColumn("n", F.row_number().over(first))
        .filter("n = 1")
        .drop("n")
    )


def nearest_entry(
    probes: DataFrame, entries: DataFrame, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """(query_id, doc_key, ord, similarity): the single most similar entry per probe.

    probes: (query_id, embedding); entries: (doc_key, ord, embedding). With few
    entries they are broadcast and every probe row is answered in place. If both
    sides have a `scope`, only entries of the probe's scope count.
    """
    scoped = "scope" in probes.columns and "scope" in entries.columns
    extra = ["scope"] if scoped else []
    if not fits(entries, cfg.query_block_rows):
        if scoped:
            return _nearest_in_scope(probes, entries, cfg)
        return vector_topk(probes, entries, 1, cfg).select(
            "query_id",
            "doc_key",
            "ord",
            F.round(1 - F.col("distance"), cfg.score_scale).alias("similarity"),
        )
    block = entries.select("doc_key", "ord", "embedding", *extra).orderBy("ord").toPandas()
    shared = probes.sparkSession.sparkContext.broadcast(
        (
            block["doc_key"].to_numpy(),
            block["ord"].to_numpy(),
            stack(block["embedding"]) if len(block) else None,
            block["scope"].to_numpy() if scoped else None,
        )
    )
    scale = cfg.score_scale

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, ords, matrix, scopes = shared.value
        for batch in batches:
            if len(batch) and len(keys):
                similarity = np.round(cosine_matrix(stack(batch["embedding"]), matrix), scale)
                if scopes is not None:
                    same = batch["scope"].to_numpy()[:, None] == scopes[None, :]
                    similarity = np.where(same, similarity, -np.inf)
                best = similarity.argmax(axis=1)
                found = pd.DataFrame(
                    {
                        "query_id": batch["query_id"],
                        "doc_key": keys[best],
                        "ord": ords[best],
                        "similarity": similarity[np.arange(len(batch)), best],
                    }
                )
                yield found[np.isfinite(found["similarity"])]

    schema = (
        StructType()
        .add("query_id", probes.schema["query_id"].dataType)
        .add("doc_key", entries.schema["doc_key"].dataType)
        .add("ord", entries.schema["ord"].dataType)
        .add("similarity", "double")
    )
    return probes.select("query_id", "embedding", *extra).mapInPandas(answer, schema)
