"""A persistent retrieval index: segments of Parquet tables behind published snapshots.

    chunks         the chunk rows with doc_key, ord, embedding and a hash of their content
    postings       word postings by hash bucket (see postings.py)
    term_df        per word the number of chunks that hold it, negative for removed ones
    corpus_stats   the number of chunks and words, likewise
    dead           positions in earlier segments that no longer count

Every change is one segment: new and changed chunks are added at the end of the index order,
the positions of changed and removed ones are declared dead. Counts of segments add up, so a
change reads the index's keys and hashes and the texts it replaces, nothing else. A segment
counts from the moment its manifest is published; what a failed writer leaves is never read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ledgerloom.config import EngineConfig
from ledgerloom.functions.vectors import embed_text
from ledgerloom.operators import bm25
from ledgerloom.operators.bm25 import tokenised
from ledgerloom.operators.joins import fits, join_small
from ledgerloom.operators.ordering import with_positions
from ledgerloom.operators.postings import (
    CODEC,
    POSTINGS,
    bucket_of,
    build_postings,
    dead_flags,
    has_flag,
    indexed_scores,
    write_postings,
)
from ledgerloom.operators.snapshots import SnapshotLog
from ledgerloom.session import materialise, shuffles_dropped

BROADCAST_PLACES = 400_000_000  # positions of one bit that are broadcast

@dataclass(frozen=True)
class Index:
    """One snapshot. `chunks` are the live ones."""

    spark: SparkSession
    root: str
    manifest: dict
    chunks: DataFrame
    document_frequency: DataFrame
    stats: DataFrame
    dead: DataFrame

    def layout(self, cfg: EngineConfig) -> EngineConfig:
        """cfg with the layout the index was begun with."""
        return cfg.replace(**self.manifest["layout"])

    def postings(self, tokens: DataFrame | None = None, cfg: EngineConfig = EngineConfig()) -> DataFrame:
        """Posting rows, of the buckets of the given tokens only. The list of buckets is
        all the driver sees, index_buckets numbers at most."""
        wanted, cfg = None, self.layout(cfg)
        if tokens is not None:
            wanted = {r["b"] for r in tokens.select(bucket_of(F.col("token"), cfg).alias("b")).distinct().collect()}
        paths = [
            f"{self.root}/data/{s['name']}/postings/bucket={b}"
            for s in self.manifest["segments"]
            for b in s["buckets"]
            if wanted is None or b in wanted
        ]
        if not paths:
            return self.spark.createDataFrame([], POSTINGS)
        return self.spark.read.schema(POSTINGS).parquet(*paths)

    def scores(
        self, queries: DataFrame, k: int, cfg: EngineConfig = EngineConfig(), also: DataFrame | None = None,
        scan: list | None = None,
    ) -> DataFrame:
        """(query_id, ord, bm25) of the k best chunks per query (and more), and of `also`."""
        asked = tokenised(queries.select(F.col("query_id").alias("doc_key"), F.lit(0).alias("ord"), F.col("query").alias("content")))
        words = asked.select(F.explode("toks").alias("token")).distinct()
        dead = self.dead if any(s["dead"] for s in self.manifest["segments"]) else None
        with shuffles_dropped(self.spark):
            return indexed_scores(
                queries, self.postings(words, cfg), self.document_frequency, self.stats, k, self.layout(cfg), dead,
                also, scan,
            )


    def topk(self, queries: DataFrame, k: int, cfg: EngineConfig = EngineConfig()) -> DataFrame:
        """(query_id, doc_key, score, rank) of the k best chunks per query by BM25; ties in
        index order."""
        best = Window.partitionBy("query_id").orderBy(F.col("bm25").desc(), "ord")
        found = (
            self.scores(queries, k, cfg)
            .withColumn("rank", F.row_number().over(best))
            .filter(F.col("rank") <= k)
        )
        keys = self.chunks.select("ord", "doc_key")
        small = fits(queries, cfg.broadcast_max_rows // max(1, k))
        return join_small(keys, found, ["ord"], cfg.broadcast_max_rows, 1, ["ord"], known_small=small).select(
            "query_id", "doc_key", F.col("bm25").alias("score"), "rank"
        )


def _content_hash(chunks: DataFrame) -> Column:
    named = sorted(c for c in chunks.columns if c not in ("ord", "embedding", "content_hash"))
    return F.sha2(F.to_json(F.struct(*named)), 256)


def _unlike(rows: DataFrame, given: DataFrame, same: DataFrame, bounds: dict) -> DataFrame:
    """rows whose key is not in `same`; given has all their keys. Texts move only if the keys
    that are in it and those that are not are both many."""
    same = materialise(same)
    if fits(same, bounds["max_rows"]):
        return join_small(rows, same, ["doc_key"], **bounds, how="left_anti", known_small=True)
    fresh = join_small(given.select("doc_key").distinct(), same, ["doc_key"], **bounds, how="left_anti")
    fresh = materialise(fresh.withColumn("_fresh", F.lit(True)))
    if not fits(fresh, bounds["max_rows"]):
        return join_small(rows, same, ["doc_key"], **bounds, how="left_anti", known_small=False)
    marked = join_small(rows, fresh, ["doc_key"], **bounds, how="left", known_small=True)
    return marked.filter("_fresh or doc_key is null").drop("_fresh")


def publish(
    chunks: DataFrame,
    root: str,
    batch: str | None = None,
    cfg: EngineConfig = EngineConfig(),
    embed: Column | None = None,
    scope: Column | None = None,
) -> dict:
    """Bring chunks (chunk schema with doc_key, unique, and ord) into the index as one new
    snapshot; returns its manifest.

    Chunks whose key is new are added in the order of their ord, those whose content changed
    replace the old ones, equal ones are left. With `scope`, a condition on indexed chunks,
    chunks that satisfy it and are not given are removed: F.lit(True) makes the index hold
    just the given ones. A batch name that is published already is not taken again, so a
    repeated write (a restarted stream) changes nothing.
    """
    spark = chunks.sparkSession
    with shuffles_dropped(spark):
        return _publish(spark, chunks, root, batch, cfg, embed, scope)


def _publish(spark, chunks, root, batch, cfg, embed, scope) -> dict:
    log = SnapshotLog(spark, root)
    current = log.read()
    if current is not None and batch is not None and batch in current["batches"]:
        return current
    rows = chunks.withColumn("content_hash", _content_hash(chunks))
    gone = None
    if current is not None and current["segments"]:
        known = _read(spark, root, current).chunks
        old = known.select(F.col("doc_key"), F.col("ord").alias("_ord"), F.col("content_hash").alias("_hash"))
        given = materialise(rows.select("doc_key", F.col("content_hash").alias("_new")))
        bounds = dict(max_rows=cfg.broadcast_max_rows, salts=1, spread=["doc_key"])
        equal = (F.col("_hash") == F.col("_new")).alias("_equal")
        met = materialise(join_small(old, given, ["doc_key"], **bounds).select("doc_key", "_ord", equal))
        changed = met.filter("not _equal").select("_ord")
        gone = changed
        if scope is not None:
            inside = known.filter(F.coalesce(scope, F.lit(False))).select("doc_key", F.col("ord").alias("_ord"))
            gone = changed.unionAll(join_small(inside, given, ["doc_key"], **bounds, how="left_anti").select("_ord"))
        gone = materialise(gone.select(F.col("_ord").alias("ord")).distinct())
        rows = _unlike(rows, given, met.filter("_equal").select("doc_key").distinct(), bounds)
    layout = {"index_buckets": cfg.index_buckets, "posting_range": cfg.posting_range}
    if current is not None and current["segments"]:
        layout = current["layout"]
        cfg = cfg.replace(**layout)
    nothing_new = current is not None and rows.isEmpty()
    if nothing_new:
        rows = rows.limit(0)  # what is given is not read again for the segment
    if nothing_new and (gone is None or gone.isEmpty()):
        return log.publish(current | {"batches": [*current["batches"], *([batch] if batch else [])]}, current)
    start = 0 if current is None else current["next_ord"]
    vector = embed_text(F.col("content"), cfg.embedding_dim) if embed is None else embed
    segment = _write_segment(spark, root, log, rows, ["ord", "doc_key"], start, vector, gone, current, cfg)
    return log.publish(
        {
            "segments": [*(current["segments"] if current else []), segment],
            "batches": [*(current["batches"] if current else []), *([batch] if batch else [])],
            "next_ord": start + segment["n_chunks"],
            "layout": layout,
        },
        current,
    )


def document_frequency(postings: DataFrame) -> DataFrame:
    """(token, df) out of posting rows."""
    return postings.groupBy("token").agg(F.sum("n").alias("df"))


def _write_segment(spark, root, log, rows, order, start, vector, gone, current, cfg) -> dict:
    """The segment of rows in the given order, with positions from start on; their embedding
    is made anew if a vector is given."""
    name = uuid4().hex
    path, staged = f"{root}/data/{name}", f"_staged/{name}"

    def hold(sorted_rows):
        sorted_rows.write.parquet(f"{root}/{staged}", compression=CODEC)
        return spark.read.schema(sorted_rows.schema).parquet(f"{root}/{staged}")

    rows = with_positions(rows, *order, name="_place", hold=hold)
    rows = rows.withColumn("ord", F.col("_place") + F.lit(start)).drop("_place")
    if vector is not None:
        rows = rows.withColumn("embedding", vector)
    rows.write.parquet(f"{path}/chunks", compression=CODEC)
    log.drop(staged)
    stored = spark.read.schema(rows.schema).parquet(f"{path}/chunks")
    write_postings(build_postings(stored, cfg), f"{path}/postings")
    buckets = [int(n.removeprefix("bucket=")) for n in log.children(f"data/{name}/postings") if n.startswith("bucket=")]
    # the written postings hold all counts, so texts are not read again for them
    listed = spark.createDataFrame([], POSTINGS)
    if buckets:
        listed = spark.read.schema(POSTINGS).parquet(*[f"{path}/postings/bucket={b}" for b in buckets])
    df, n_dead, n_chunks = document_frequency(listed), 0, stored.count()
    n_words = F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda s, n: s + n))
    sizes = listed.agg(F.lit(n_chunks).cast("long").alias("n_docs"), F.coalesce(n_words, F.lit(0)).alias("n_words"))
    if gone is not None:
        gone.write.parquet(f"{path}/dead")
        n_dead = spark.read.schema("ord long").parquet(f"{path}/dead").count()
    if n_dead:
        lost = tokenised(_placed_in(_read(spark, root, current).chunks, gone, current["next_ord"], True))
        df = df.unionAll(bm25.document_frequency(lost).select("token", -F.col("df")))
        sizes = sizes.unionAll(lost.agg(-F.count(F.lit(1)), -F.coalesce(F.sum("doc_len"), F.lit(0))))
    df.write.parquet(f"{path}/term_df")
    sizes.write.parquet(f"{path}/corpus_stats")
    return {
        "name": name, "buckets": buckets, "dead": n_dead, "schema": rows.schema.json(), "n_chunks": n_chunks,
    }


def _placed_in(chunks: DataFrame, places: DataFrame, until: int, inside: bool) -> DataFrame:
    """The chunks whose position (ord, below until) is, or is not, in places (ord). One bit per
    position is broadcast, unless there are too many, so that texts do not move."""
    if until > BROADCAST_PLACES:
        return chunks.join(places, "ord", "left_semi" if inside else "left_anti").select(*chunks.columns)
    cfg = EngineConfig()
    flags = dead_flags(places, cfg).withColumnRenamed("range", "_range")
    at = F.floor(F.col("ord") / cfg.posting_range).cast("long")
    marked = chunks.withColumn("_range", at).join(F.broadcast(flags), "_range", "left")
    found = F.coalesce(has_flag("flags", F.pmod("ord", F.lit(cfg.posting_range))), F.lit(False))
    return marked.filter(found if inside else ~found).select(*chunks.columns)


def _read(spark: SparkSession, root: str, manifest: dict) -> Index:
    def tables(name, schema, of=None):
        paths = [f"{root}/data/{s['name']}/{name}" for s in manifest["segments"] if of is None or of(s)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    segments = manifest["segments"]
    dead = tables("dead", "ord long", lambda s: s["dead"])
    chunks = None
    for schema in dict.fromkeys(s["schema"] for s in segments):
        part = tables("chunks", StructType.fromJson(json.loads(schema)), lambda s: s["schema"] == schema)  # noqa: B023
        chunks = part if chunks is None else chunks.unionByName(part, allowMissingColumns=True)
    if any(s["dead"] for s in segments):
        chunks = _placed_in(chunks, dead, manifest["next_ord"], False)
    df = tables("term_df", "token string, df long").groupBy("token").agg(F.sum("df").alias("df"))
    stats = tables("corpus_stats", "n_docs long, n_words long").agg(
        F.sum("n_docs").alias("n_docs"), F.try_divide(F.sum("n_words"), F.sum("n_docs")).alias("avg_len")
    )
    return Index(spark, root, manifest, chunks, df.filter("df > 0"), stats, dead)


def read_index(spark: SparkSession, root: str, version: int | None = None) -> Index:
    """The newest snapshot, or an earlier version."""
    manifest = SnapshotLog(spark, root).read(version)
    if manifest is None or not manifest["segments"]:
        raise FileNotFoundError(f"nothing is indexed in {root}")
    return _read(spark, root, manifest)


def clear_index(spark: SparkSession, root: str) -> None:
    """Publish a snapshot that holds nothing."""
    log = SnapshotLog(spark, root)
    current = log.read()
    if current is not None:
        log.publish({"segments": [], "batches": [], "next_ord": 0, "layout": {}}, current)


def compact(spark: SparkSession, root: str, cfg: EngineConfig = EngineConfig()) -> dict:
    """Publish the live chunks as one segment, without dead postings. Index order stays,
    published batches stay known."""
    log = SnapshotLog(spark, root)
    current = log.read()
    live = _read(spark, root, current).chunks
    with shuffles_dropped(spark):
        segment = _write_segment(spark, root, log, live, ["ord"], 0, None, None, None, cfg.replace(**current["layout"]))
    return log.publish(
        current | {"segments": [segment], "next_ord": segment["n_chunks"]}, current
    )
