"""BM25 scoring as joins and aggregations.

Without an index every text is split for its words, which is the cost: once for the counts
of the vocabulary, once for those of the queries' words. A document's words meet in one
partition (one shuffle of the text by document, never by word), so frequent words cannot make
a hot partition, and each task keeps just its best rows per query before anything is ranked
globally. (Counting where a text is read and moving counts instead took 1.5 times as long
with queries of many words.) With a persistent index, postings.py reads the asked words only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions.text import tokens
from ledgerloom.operators.joins import fits, join_small
from ledgerloom.session import materialise

# Rows that one task may hold while it counts words and adds up scores.
WORDS_HELD = 2_000_000
SCORES_HELD = 1_000_000


def tokenised(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_key, ord, *keep, toks, doc_len) of (doc_key, ord, content, *keep)."""
    return docs.select(
        "doc_key", "ord", *keep, tokens(F.col("content")).alias("toks")
    ).withColumn("doc_len", F.size("toks"))


def exploded(toks: DataFrame, words: Column) -> DataFrame:
    """One row per word. The outer form keeps the optimizer from adding a size filter
    on the word array, which would split every text a second time."""
    rest = [c for c in toks.columns if c != "toks"]
    return toks.select(*rest, F.explode_outer(words).alias("token")).filter(
        F.col("token").isNotNull()
    )


def corpus_stats(toks: DataFrame) -> DataFrame:
    """One row: number of documents and average length."""
    return toks.agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("doc_len").alias("avg_len")
    )


def document_frequency(toks: DataFrame) -> DataFrame:
    """(token, df); counts are combined before the shuffle."""
    return (
        exploded(toks.select("toks"), F.array_distinct("toks"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def inverse_frequency(df: DataFrame, n_docs: Column, epsilon: float) -> DataFrame:
    """(token, idf): ln(N - df + 0.5) - ln(df + 0.5); negative values are replaced
    by epsilon times the mean over the whole vocabulary."""
    raw = df.select(
        "token",
        (F.ln(n_docs - F.col("df") + F.lit(0.5)) - F.ln(F.col("df") + F.lit(0.5))).alias("raw"),
    )
    mean = raw.agg(F.avg("raw").alias("m")).scalar()
    return raw.select(
        "token", F.when(F.col("raw") < 0, F.lit(epsilon) * mean).otherwise(F.col("raw")).alias("idf")
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, token, qtf) of (query_id, query); repeated words count again."""
    return (
        queries.select("query_id", F.explode(tokens(F.col("query"))).alias("token"))
        .groupBy("query_id", "token")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def term_weight(tf: Column, doc_len: Column, avg_len: Column, cfg: EngineConfig) -> Column:
    k1, b = cfg.bm25_k1, cfg.bm25_b
    return tf * (k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * doc_len / avg_len))


def scoring_partitions(n_docs: int, n_words: int, n_queries: int, least: int) -> int:
    """Partitions of the corpus such that what one task holds, its words by document and its
    scores by query, does not grow with the corpus."""
    return max(least, math.ceil(n_words / WORDS_HELD), math.ceil(n_docs * n_queries / SCORES_HELD))


def _counted_words(docs: DataFrame, keep: Sequence[str], parts: int, wanted: DataFrame | None) -> DataFrame:
    """(doc_key, ord, *keep, doc_len, token, tf), of the words in `wanted` only if it is given
    (few enough to broadcast). The number of partitions is given, so they are not merged."""
    by_doc = tokenised(docs.select("doc_key", "ord", "content", *keep).repartition(parts, "doc_key"), keep)
    said = exploded(by_doc, F.col("toks"))
    if wanted is not None:
        said = said.join(F.broadcast(wanted), "token", "left_semi")
    return (
        said.groupBy("doc_key", "ord", *keep, "doc_len", "token")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def vocabulary(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(df, stats) of documents from one pass over the texts: a document adds one to each of
    its words and, in the row without a word, its length."""
    toks = tokenised(docs)
    none = F.lit(None).cast("string")
    words = toks.select("doc_len", F.explode_outer(F.concat(F.array_distinct("toks"), F.array(none))).alias("token"))
    counted = materialise(
        words.groupBy("token").agg(
            F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("token").isNull(), F.col("doc_len"))).alias("n_words")
        )
    )
    stats = counted.filter("token is null").agg(
        F.coalesce(F.max("df"), F.lit(0)).alias("n_docs"), F.try_divide(F.max("n_words"), F.max("df")).alias("avg_len")
    )
    return counted.filter("token is not null").select("token", "df"), stats


def bm25_scores(
    queries: DataFrame,
    docs: DataFrame,
    cfg: EngineConfig,
    df: DataFrame | None = None,
    stats: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(query_id, doc_key, ord, *keep, bm25) for every document sharing a word with the
    query; `keep` names small document columns to carry along.

    `df` and `stats` may be known already; by default they are counted from `docs`.
    """
    if df is None or stats is None:
        df, stats = vocabulary(docs)
    n_docs = stats.select("n_docs").scalar()
    avg_len = stats.select("avg_len").scalar()
    idf = inverse_frequency(df, n_docs, cfg.bm25_epsilon)
    wanted = query_terms(queries)
    small = fits(wanted, cfg.broadcast_max_rows)
    bounds = dict(max_rows=cfg.broadcast_max_rows, salts=cfg.salt_buckets, known_small=small)
    weights = join_small(idf, wanted, ["token"], spread=["token"], **bounds).select("query_id", "token", (F.col("qtf") * F.col("idf")).alias("weight"))

    size = stats.select(F.coalesce("n_docs", F.lit(0)), F.coalesce(F.col("n_docs") * F.col("avg_len"), F.lit(0.0))).first()
    parts = scoring_partitions(size[0], size[1], queries.count(), docs.sparkSession.sparkContext.defaultParallelism)
    words = wanted.select("token").distinct() if small else None
    hits = join_small(_counted_words(docs, keep, parts, words), weights, ["token"], spread=["doc_key"], **bounds)
    part = F.col("weight") * term_weight(F.col("tf"), F.col("doc_len"), avg_len, cfg)
    return (
        hits.withColumn("part", part)
        .groupBy("query_id", "doc_key", "ord", *keep)
        .agg(F.sum("part").alias("bm25"))
        .withColumn("bm25", F.round("bm25", cfg.score_scale))
    )


def best_per_query(scores: DataFrame, k: int) -> DataFrame:
    """Scores cut to the k best per query, as score and rank."""
    best = Window.partitionBy("query_id").orderBy(F.col("bm25").desc(), "ord")
    return (
        scores.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .withColumnRenamed("bm25", "score")
        .drop("ord")
    )


def bm25_topk(
    queries: DataFrame, docs: DataFrame, k: int, cfg: EngineConfig, keep: Sequence[str] = ()
) -> DataFrame:
    """(query_id, doc_key, *keep, score, rank) of the k best documents per query."""
    return best_per_query(bm25_scores(queries, docs, cfg, keep=keep), k)


def scoped_topk(
    queries: DataFrame, docs: DataFrame, scopes: DataFrame, scope: str, k: int, cfg: EngineConfig
) -> DataFrame:
    """The k best documents per query among those in its scope.

    scopes: (query_id, scope); `scope` names the column of docs it must equal. Unlike
    filtering a finished ranking this always finds k if the scope holds them.
    """
    inside = join_small(
        bm25_scores(queries, docs, cfg, keep=[scope]).withColumnRenamed(scope, "scope"),
        scopes,
        ["query_id", "scope"],
        cfg.broadcast_max_rows,
        cfg.salt_buckets,
        ["doc_key"],
        known_small=fits(queries, cfg.broadcast_max_rows),
    )
    return best_per_query(inside, k).select("query_id", "doc_key", "score", "rank")
