"""Vectors: the default text embedder and similarity as small Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, FloatType

from ledgerloom.functions.text import tokens

TINY = 1e-12


def hash_buckets(text: Column, dim: int) -> Column:
    """array<int>: the feature of every word, from the first 32 bits of its MD5."""
    return F.transform(
        tokens(text),
        lambda w: (F.conv(F.substr(F.md5(w), F.lit(1), F.lit(8)), 16, 10).cast("bigint") % dim)
        .cast("int"),
    )


def embed_text(text: Column, dim: int) -> Column:
    """Feature-hashed bag of words with unit length: an offline stand-in for a
    sentence-embedding model. Words are hashed in the JVM; Python only counts."""

    @F.pandas_udf(ArrayType(FloatType()))
    def count_features(batch: pd.Series) -> pd.Series:
        sizes = batch.str.len().to_numpy()
        rows = np.repeat(np.arange(len(batch)), sizes)
        features = np.concatenate([*batch, np.empty(0, dtype=np.int64)]).astype(np.int64)
        counts = np.bincount(rows * dim + features, minlength=len(batch) * dim)
        matrix = counts.reshape(len(batch), dim).astype(np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(norms == 0, 1.0, norms)
        return pd.Series(list(matrix.astype(np.float32)))

    return count_features(hash_buckets(text, dim))


def stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def cosine_matrix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(left, axis=1)[:, None] * np.linalg.norm(right, axis=1)[None, :]
    return (left @ right.T) / np.maximum(norms, TINY)
