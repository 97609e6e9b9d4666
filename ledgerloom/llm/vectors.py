"""Vector columns: clean rows, and arrays between Arrow and numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.llm.common import mix


def usable(df: DataFrame, id: str, vector: Column, zero: bool = True) -> DataFrame:
    """(id long, v array<double>) of the rows whose vector can be compared.

    Null ids, null and empty vectors and those with null or non-finite components are
    left out, zero vectors too unless `zero`; a repeated id keeps every row.
    """
    values = F.transform(vector, lambda x: x.cast("double"))
    rows = df.select(F.col(id).cast("long").alias("id"), values.alias("v"))
    bad = F.exists(
        "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    kept = rows.filter(F.col("id").isNotNull() & (F.size("v") > 0) & ~bad)
    return kept if zero else kept.filter(F.exists("v", lambda x: x != 0))


def matrix(column, dtype=np.float64) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(n, -1) if n else np.empty((0, 0), dtype)


def lists(rows: np.ndarray, kind) -> pa.ListArray:
    """A matrix as a column of lists."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] if rows.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel(), kind))


def ragged(rows: list[np.ndarray], kind) -> pa.ListArray:
    """Arrays of different length as a column of lists."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    """Even assignment of ids to buckets."""
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, highest first, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]
