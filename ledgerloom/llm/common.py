"""Small helpers that several operators share."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.operators.joins import join_small
from ledgerloom.session import materialise, shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KNOWN_WORDS = 400_000
_REPEATED_IDS = 100_000  # rows of 50 bytes


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case; null is empty.

    bytes.lower and bytes.split treat just these letters and these blanks.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """Word -> 64-bit hash; words already met are looked up. Bounded in size."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _KNOWN_WORDS:
            self[word] = value
        return value


HASHES = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(HASHES.__getitem__, found), dtype=np.uint64, count=len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of `width` words; a shorter text is one run, none is none."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - width + 1)
    out = np.full(n, min(width, len(hashes)), dtype=np.uint64)
    for k in range(min(width, len(hashes))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def carried(df: DataFrame, made: list[str]) -> list[str]:
    """Columns of df that pass through an operator which adds the columns `made`.

    A column whose name clashes with one that the operator makes is left out: the
    operator's result stands.
    """
    lowered = {c.lower() for c in made}
    return [c for c in df.columns if c.lower() not in lowered]


def ddl(df: DataFrame, more: str = "") -> str:
    """The schema of df, with more columns after it, as text."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join([*fields, more] if more else fields)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for loops that join a table with itself: unlike a
    checkpoint it starts anew with its real size, and an estimated size that is
    multiplied at every turn ends in numbers too long to plan with."""
    path = f"{shared_folder(df.sparkSession)}/{uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_keys(docs: DataFrame, id: str = "doc_id", text: str = "text", name: str = "_key") -> DataFrame:
    """docs with a key that tells apart rows which repeat an id with other texts.

    The key is the id, except for the further texts of an id (all but the one of the smallest
    digest): they get numbers from 2 ** 62 up, later than all ids. Equal rows share a key, and
    rows without an id have none.
    """
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    several = (
        docs.groupBy(F.col(id).alias("_id"))
        .agg(F.min(digest).alias("_first"), F.max(digest).alias("_last"))
        .filter("_first <> _last")
        .select("_id", "_first")
    )
    further = F.xxhash64(F.col(id), digest).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    marked = join_small(
        docs.withColumn("_id", F.col(id)), materialise(several), ["_id"], _REPEATED_IDS, 1, ["_id"], how="left"
    )
    key = F.when(digest > F.col("_first"), further).otherwise(F.col(id).cast("long"))
    return marked.withColumn(name, key).select(*docs.columns, name)
