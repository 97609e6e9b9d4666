"""Recency: time decay, filters on filings, and period comparison.

Inputs are ranked results per query, already cut to a bounded number of rows by
retrieval, with (query_id, doc_key, score, rank, filing_date) and, for the
filters, ticker and filing_type.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions.dates import days_old, decay_factor, period


def top_results(rows: DataFrame, k: int) -> DataFrame:
    """Cut scored rows (query_id, doc_key, score, ord, ...) to the k best per query."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ord")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rerank_by_score(results: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "old_rank")
    return (
        results.withColumnRenamed("rank", "old_rank")
        .withColumn("rank", F.row_number().over(order))
        .drop("old_rank")
    )


def apply_decay(
    results: DataFrame, reference: dt.datetime, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """Multiply scores by exp(-lambda * days / 365) and rank again. Undated rows keep
    their score, future dates gain. `days_old` is filled even if decay is off."""
    days = days_old(F.col("filing_date"), F.lit(reference))
    aged = results.withColumn("days_old", days)
    if not cfg.decay_enabled:
        return aged.withColumn("decay_factor", F.lit(None).cast("double"))
    factor = decay_factor(F.col("days_old"), cfg.decay_lambda)
    return rerank_by_score(
        aged.withColumn("decay_factor", factor).withColumn(
            "score",
            F.round(
                F.col("score") * F.coalesce(F.col("decay_factor"), F.lit(1.0)), cfg.score_scale
            ),
        )
    )


def filing_filter(
    ticker: str | Column | None = None,
    filing_type: str | None = None,
    max_days_old: int | None = None,
) -> Column:
    """Ticker (any case), filing type and age; a row without a date is too old."""
    keep = F.lit(True)
    if ticker is not None:
        wanted = F.lit(ticker) if isinstance(ticker, str) else ticker
        keep = keep & (F.upper(F.coalesce(F.col("ticker"), F.lit(""))) == F.upper(wanted))
    if filing_type:
        keep = keep & F.col("filing_type").eqNullSafe(filing_type)
    if max_days_old:
        keep = keep & (F.coalesce(F.col("days_old"), F.lit(2**31 - 1)) <= max_days_old)
    return keep


def recent_filings(
    rows: DataFrame,
    k: int,
    reference: dt.datetime,
    cfg: EngineConfig = EngineConfig(),
    ticker: str | Column | None = None,
    filing_type: str | None = None,
    max_days_old: int | None = None,
) -> DataFrame:
    """Top 2k by score, decayed, filtered, first k kept with their decayed rank.

    With decay_before_cut the decay is applied before the top 2k cut, so recent
    documents can enter the pool.
    """
    if cfg.decay_before_cut:
        rows = rows.withColumn(
            "score",
            F.round(
                F.col("score")
                * F.coalesce(
                    decay_factor(
                        days_old(F.col("filing_date"), F.lit(reference)), cfg.decay_lambda
                    ),
                    F.lit(1.0),
                ),
                cfg.score_scale,
            ),
        )
        aged = apply_decay(top_results(rows, 2 * k), reference, cfg.replace(decay_enabled=False))
    else:
        aged = apply_decay(top_results(rows, 2 * k), reference, cfg)
    kept = aged.filter(filing_filter(ticker, filing_type, max_days_old))
    order = Window.partitionBy("query_id").orderBy("rank")
    return (
        kept.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).drop("nth")
    )


def most_recent(
    rows: DataFrame,
    reference: dt.datetime,
    cfg: EngineConfig = EngineConfig(),
    ticker: str | Column | None = None,
    filing_type: str | None = "10-K",
) -> DataFrame:
    """The one filing per query that ranks first after decay and filters."""
    return recent_filings(rows, 1, reference, cfg, ticker, filing_type, cfg.max_days_old)


def compare_periods(
    rows: DataFrame,
    periods: int,
    reference: dt.datetime,
    cfg: EngineConfig = EngineConfig(),
    ticker: str | Column | None = None,
    max_days_old: int | None = None,
) -> DataFrame:
    """Best result per calendar month, newest months first."""
    found = recent_filings(
        rows, 3 * periods, reference, cfg, ticker, None, max_days_old or cfg.max_days_old
    ).filter(F.col("filing_date").isNotNull())
    best = Window.partitionBy("query_id", "period").orderBy(F.col("score").desc(), "rank")
    newest = Window.partitionBy("query_id").orderBy(F.col("period").desc())
    return (
        found.withColumn("period", period(F.col("filing_date")))
        .withColumn("nth", F.row_number().over(best))
        .filter(F.col("nth") == 1)
        .withColumn("period_rank", F.row_number().over(newest))
        .filter(F.col("period_rank") <= periods)
        .drop("nth")
    )
