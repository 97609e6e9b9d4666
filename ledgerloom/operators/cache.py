"""Semantic cache: reuse the result of a sufficiently similar earlier query."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.operators.joins import join_small
from ledgerloom.operators.ordering import with_positions
from ledgerloom.operators.similar import nearest_above
from ledgerloom.operators.snapshots import SnapshotLog
from ledgerloom.operators.vector import nearest_entry
from ledgerloom.session import materialise


def cache_lookup(
    probes: DataFrame,
    entries: DataFrame,
    cfg: EngineConfig = EngineConfig(),
    threshold: float | None = None,
) -> DataFrame:
    """(query_id, value, similarity, is_hit) for every probe.

    probes: (query_id, embedding); entries: (query, embedding, value, ord). The
    most similar entry counts, the oldest on ties, and only from the threshold on.
    With a `scope` on both sides only entries of the probe's scope are compared.
    """
    limit = cfg.cache_threshold if threshold is None else threshold
    scope = [c for c in ("scope",) if c in probes.columns and c in entries.columns]
    keyed = entries.select(F.col("ord").alias("doc_key"), "ord", "embedding", *scope)
    best = nearest_entry(probes.select("query_id", "embedding", *scope), keyed, cfg)
    values = entries.select("ord", "value")
    return (
        join_small(
            best, values, ["ord"], cfg.broadcast_max_rows, cfg.salt_buckets, ["query_id"], "left"
        )
        .withColumn("is_hit", F.col("similarity") >= limit)
        .select(
            "query_id",
            F.when(F.col("is_hit"), F.col("value")).alias("value"),
            "similarity",
            "is_hit",
        )
    )


class AnswerStore:
    """Cached answers (scope, query, embedding, value, ord) as published batches of files:
    readers see whole batches only, and two writers can't take one place."""

    _SCHEMA = "scope string, query string, embedding array<double>, value string, ord long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.log = spark, root, SnapshotLog(spark, root)

    def entries(self) -> DataFrame:
        state = self.log.read()
        if state is None:
            return self.spark.createDataFrame([], self._SCHEMA)
        paths = [f"{self.root}/data/{name}" for name in state["batches"]]
        return self.spark.read.schema(self._SCHEMA).parquet(*paths)

    def put(self, added: DataFrame) -> None:
        """Append answers (scope, query, embedding, value), younger than all before."""
        state = self.log.read()
        start = 0 if state is None else state["next_ord"]
        rows = with_positions(added, "scope", "query", name="_place")
        name = uuid4().hex
        rows.select(
            "scope",
            "query",
            F.col("embedding").cast("array<double>").alias("embedding"),
            "value",
            (F.col("_place") + F.lit(start)).alias("ord"),
        ).write.parquet(f"{self.root}/data/{name}")
        count = self.spark.read.schema(self._SCHEMA).parquet(f"{self.root}/data/{name}").count()
        batches = [] if state is None else state["batches"]
        self.log.publish({"batches": [*batches, name], "next_ord": start + count}, state)


def answered(
    questions: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    store: AnswerStore,
    cfg: EngineConfig = EngineConfig(),
) -> DataFrame:
    """(query_id, value, from_cache) of questions (query_id, scope, query, embedding): reused
    from the store where it can be, otherwise answered, and stored unless null.

    `answer` gives (query_id, value) for the questions left. The scope has to name all that
    an answer depends on besides the text. Equal questions of one call are each answered.
    """
    reused, left = reuse_results(questions, store.entries(), cfg)
    reused, left = materialise(reused), materialise(left)
    if left.isEmpty():
        return reused.withColumn("from_cache", F.lit(True))
    fresh = materialise(answer(left).select("query_id", "value"))
    if cfg.cache_enabled:
        store.put(left.join(fresh.filter("value is not null"), "query_id").select("scope", "query", "embedding", "value"))
    return reused.withColumn("from_cache", F.lit(True)).unionByName(
        fresh.withColumn("from_cache", F.lit(False))
    )


def _newest(entries: DataFrame, cfg: EngineConfig) -> DataFrame:
    if cfg.cache_max_entries is None:
        return entries
    return entries.orderBy(F.col("ord").desc()).limit(cfg.cache_max_entries)


def split_known(questions: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, open): exact reuse by (scope, query) before any similarity lookup.
    The scope is a question id or ticker, so near-equal texts of different scopes
    never share an answer."""
    newest = Window.partitionBy("scope", "query").orderBy(F.col("ord").desc())
    latest = known.withColumn("n", F.row_number().over(newest)).filter(F.col("n") == 1)
    keys = ["scope", "query"]
    return (
        questions.join(latest.select(*keys, "value"), keys),
        questions.join(latest.select(*keys), keys, "left_anti"),
    )


def reuse_results(
    questions: DataFrame, entries: DataFrame, cfg: EngineConfig = EngineConfig()
) -> tuple[DataFrame, DataFrame]:
    """(reused, open): (query_id, value) from the cache, and the questions left.

    questions: (query_id, scope, query, embedding); entries: (scope, query, embedding,
    value, ord), of which all are looked at, or the newest cache_max_entries if that is
    set. The same text in the same scope is reused first, then a similar text of that scope.
    """
    if not cfg.cache_enabled:
        return questions.select("query_id", F.lit(None).cast("string").alias("value")).limit(0), questions
    newest = _newest(entries, cfg)
    same, others = split_known(questions, newest)
    near = nearest_above(others, newest, cfg.cache_threshold, cfg)
    values = newest.select("ord", "value")
    similar = join_small(
        near, values, ["ord"], cfg.broadcast_max_rows, cfg.salt_buckets, ["query_id"]
    ).select("query_id", "value")
    reused = same.select("query_id", "value").unionByName(similar)
    return reused, questions.join(reused.select("query_id"), "query_id", "left_anti")
