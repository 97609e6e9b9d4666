"""Hybrid retrieval: BM25 and vector scores fused per query, then cut, reranked
or spread over document types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions.text import tokens
from ledgerloom.operators.bm25 import bm25_scores
from ledgerloom.operators.index import Index
from ledgerloom.operators.joins import fits, join_small
from ledgerloom.operators.vector import vector_topk

# Fixed value: document types in the order they are put into a result.
TYPE_ORDER = ["table", "text", "table_summary"]
TABLE_QUOTA = 2


def pool_size(k: int, cfg: EngineConfig) -> int:
    return k * cfg.rerank_multiplier if cfg.rerank_enabled else k


def _keyword_pool(
    queries: DataFrame, docs: DataFrame, hits: DataFrame, pool: int, cfg: EngineConfig, index: Index | None
) -> DataFrame:
    """(query_id, doc_key, ord, bm25): all vector hits that share a word with the
    query plus the best `pool` other documents. Nothing else can reach the pool,
    and the best score overall is always among them."""
    n_hits = 2 * pool
    if index is None:
        scores = bm25_scores(queries, docs, cfg)
    else:
        scores = index.scores(queries, n_hits + pool, cfg, also=hits.select("query_id", "ord"))
    marked = join_small(
        scores,
        hits.select("query_id", "ord", F.lit(True).alias("is_hit")),
        ["query_id", "ord"],
        cfg.broadcast_max_rows,
        cfg.salt_buckets,
        ["ord"],
        "left",
        known_small=fits(queries, cfg.broadcast_max_rows // (2 * pool)),
    )
    order = Window.partitionBy("query_id").orderBy(
        F.col("is_hit").desc_nulls_last(), F.col("bm25").desc(), "ord"
    )
    kept = (
        marked.withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= n_hits + pool)
        .drop("n", "is_hit")
    )
    if index is None:
        return kept
    small = fits(queries, cfg.broadcast_max_rows // (n_hits + pool))
    keys = docs.select("ord", "doc_key")
    return keys.join(F.broadcast(kept), "ord") if small else keys.join(kept, "ord")


def _first_documents(queries: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """The first n documents of the index for every query, scoring zero. They fill
    a result when fewer than n documents match at all."""
    first = docs.select("doc_key", "ord").orderBy("ord").limit(n)
    listed = first.agg(F.collect_list(F.struct("doc_key", "ord")).alias("first")).scalar()
    return queries.select("query_id", F.inline(listed))


def hybrid_topk(
    queries: DataFrame,
    docs: DataFrame,
    k: int | None = None,
    cfg: EngineConfig = EngineConfig(),
    index: Index | None = None,
) -> DataFrame:
    """(query_id, doc_key, ord, score, rank) of the fused candidates.

    queries: (query_id, query, embedding); docs: (doc_key, ord, content, embedding).
    score = vector_weight / (1 + distance) + bm25_weight * bm25 / max(bm25).
    Equal scores rank vector hits first, nearest first, then index order. With
    reranking enabled the candidate pool is returned, otherwise the top k. With an
    `index`, whose chunks docs then are, BM25 scores come from its postings.
    """
    pool = pool_size(k or cfg.top_k, cfg)
    hits = vector_topk(queries, docs, 2 * pool, cfg).select(
        "query_id", "doc_key", "ord", "distance", F.col("rank").alias("vector_rank")
    )
    candidates = hits.select(
        "query_id", "doc_key", "ord", "distance", "vector_rank", F.lit(0.0).alias("bm25")
    ).unionByName(_first_documents(queries, docs, pool), allowMissingColumns=True)
    if cfg.enable_hybrid and cfg.bm25_weight > 0:
        keywords = _keyword_pool(queries, docs, hits, pool, cfg, index)
        candidates = candidates.unionByName(keywords, allowMissingColumns=True)
    one = candidates.groupBy("query_id", "doc_key", "ord").agg(
        F.min("distance").alias("distance"),
        F.min("vector_rank").alias("vector_rank"),
        F.coalesce(F.max("bm25"), F.lit(0.0)).alias("zero_or_more"),
        F.min("bm25").alias("zero_or_less"),
    )
    bm25 = F.when(F.col("zero_or_less") < 0, F.col("zero_or_less")).otherwise(F.col("zero_or_more"))
    # a query now has a bounded number of rows, so windows over it are cheap
    best = F.max("bm25").over(Window.partitionBy("query_id"))
    keyword = F.when(best > 0, F.col("bm25") / best).otherwise(0.0)
    vector = F.coalesce(1 / (1 + F.col("distance")), F.lit(0.0))
    score = F.lit(cfg.vector_weight) * vector + F.lit(cfg.bm25_weight) * keyword
    order = Window.partitionBy("query_id").orderBy(
        F.col("score").desc(), F.col("vector_rank").asc_nulls_last(), "ord"
    )
    return (
        one.withColumn("bm25", bm25)
        .withColumn("score", F.round(score, cfg.score_scale))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= pool)
        .select("query_id", "doc_key", "ord", "score", "rank")
    )


def with_documents(
    results: DataFrame,
    docs: DataFrame,
    cfg: EngineConfig = EngineConfig(),
    known_small: bool | None = None,
) -> DataFrame:
    """Results with the columns of their documents. The few results are broadcast
    to the document scan; documents do not move."""
    extra = [c for c in docs.columns if c not in results.columns or c == "doc_key"]
    wanted = docs.select(*extra)
    if fits(results, cfg.broadcast_max_rows) if known_small is None else known_small:
        return wanted.join(F.broadcast(results), "doc_key")
    return results.join(wanted, "doc_key")


def token_overlap(query: Column, content: Column) -> Column:
    """Default cross-scorer: share of the query's distinct words found in the text."""
    asked = F.array_distinct(tokens(query))
    shared = F.array_intersect(asked, tokens(content))
    return F.coalesce(F.try_divide(F.size(shared).cast("double"), F.size(asked)), F.lit(0.0))


def rerank(
    candidates: DataFrame, k: int | None = None, cfg: EngineConfig = EngineConfig(), scorer=token_overlap
) -> DataFrame:
    """Blend fused scores with a min-max scaled second score and keep the top k.

    candidates: (query_id, doc_key, score, rank, query, content); the pool per
    query is bounded by top_k * rerank_multiplier.
    """
    per_query = Window.partitionBy("query_id")
    low, high = F.min("cross").over(per_query), F.max("cross").over(per_query)
    scaled = (F.col("cross") - low) / F.greatest(high - low, F.lit(1e-12))
    weight = cfg.rerank_weight
    order = per_query.orderBy(F.col("score").desc(), F.col("first_rank"))
    return (
        candidates.withColumn("cross", scorer(F.col("query"), F.col("content")))
        .withColumn("first_rank", F.col("rank"))
        .withColumn(
            "score",
            # two more digits: the blend of rounded scores often ends in a half step
            F.round(
                F.lit(1 - weight) * F.col("score") + F.lit(weight) * scaled, cfg.score_scale + 2
            ),
        )
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= (k or cfg.top_k))
        .drop("cross", "first_rank")
    )


def retrieve(
    queries: DataFrame,
    docs: DataFrame,
    k: int | None = None,
    cfg: EngineConfig = EngineConfig(),
    scorer=token_overlap,
    index: Index | None = None,
) -> DataFrame:
    """Top k documents per query with their columns, reranked if enabled."""
    pool = pool_size(k or cfg.top_k, cfg)
    small = fits(queries, cfg.broadcast_max_rows // pool)
    found = with_documents(
        hybrid_topk(queries, docs, k, cfg, index), docs.drop("embedding"), cfg, small
    )
    if not cfg.rerank_enabled:
        return found
    return rerank(found.join(queries.select("query_id", "query"), "query_id"), k, cfg, scorer).drop(
        "query"
    )


def post_filter(results: DataFrame, keep: Column, k: int) -> DataFrame:
    """First k ranked results that satisfy `keep`; may be fewer than k because the
    ranking was cut before."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        results.filter(keep)
        .withColumn("new_rank", F.row_number().over(order))
        .filter(F.col("new_rank") <= k)
        .drop("rank")
        .withColumnRenamed("new_rank", "rank")
    )


def diversify(results: DataFrame, k: int) -> DataFrame:
    """Up to two tables, then k - 2 texts, then summaries to fill up to k."""
    by_type = Window.partitionBy("query_id", "doc_type").orderBy("rank")
    quota = (
        F.when(F.col("doc_type") == "table", TABLE_QUOTA)
        .when(F.col("doc_type") == "text", max(k - TABLE_QUOTA, 0))
        .otherwise(k)
    )
    place = F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), F.col("doc_type"))
    order = Window.partitionBy("query_id").orderBy("place", "nth")
    return (
        results.withColumn("nth", F.row_number().over(by_type))
        .filter(F.col("nth") <= quota)
        .withColumn("place", place)
        .withColumn("new_rank", F.row_number().over(order))
        .filter(F.col("new_rank") <= k)
        .drop("nth", "place", "rank")
        .withColumnRenamed("new_rank", "rank")
    )
