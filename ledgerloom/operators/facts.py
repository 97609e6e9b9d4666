"""Check of claimed metrics against tagged facts of structured filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions.numbers import facts_match

# Tags per metric, in order of preference.
METRIC_TAGS = {
    "revenue": ["Revenues", "NetRevenue", "SalesRevenueNet"],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "total_assets": ["Assets", "AssetsCurrent"],
    "total_liabilities": ["Liabilities", "LiabilitiesCurrent"],
    "equity": ["StockholdersEquity", "ShareholdersEquity"],
    "cash": ["Cash", "CashAndCashEquivalents"],
    "operating_income": ["OperatingIncomeLoss"],
}
MISSING, MISMATCH = "Metric not found in XBRL", "Value mismatch"
DISABLED = "XBRL verification disabled"


def metric_key(metric: Column) -> Column:
    return F.replace(F.lower(metric), F.lit(" "), F.lit("_"))


def candidate_tags(metric: Column) -> Column:
    """Tags to look up for a metric: its known tags, then its own name."""
    known = F.create_map(
        *[
            part
            for name, tags in METRIC_TAGS.items()
            for part in (F.lit(name), F.array(*[F.lit(t) for t in tags]))
        ]
    )
    listed = F.try_element_at(known, metric_key(metric))
    return F.array_distinct(
        F.concat(F.coalesce(listed, F.array().cast("array<string>")), F.array(metric))
    )


def fact_value(entry: Column) -> Column:
    """Number of a VARIANT fact: itself, or its `value`, or its `amount`."""
    return F.coalesce(
        F.try_variant_get(entry, "$", "double"),
        F.try_variant_get(entry, "$.value", "double"),
        F.try_variant_get(entry, "$.amount", "double"),
    )


def check_facts(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Every claim with its fact and status.

    claims: (entity, metric, claimed); facts: (entity, tag, value). The first tag
    that exists decides. Keys are (entity, tag), so no single metric is hot.
    """
    looked_up = claims.select(
        "entity", "metric", "claimed", F.posexplode(candidate_tags(F.col("metric"))).alias("prio", "tag")
    )
    found = (
        looked_up.join(
            facts.select("entity", "tag", "value", F.lit(True).alias("exists")),
            ["entity", "tag"],
            "left",
        )
        .groupBy("entity", "metric", "claimed")
        .agg(F.min_by("value", F.when(F.col("exists"), F.col("prio"))).alias("fact"))
    )
    gap = F.abs(F.col("claimed") - F.col("fact"))
    matched = F.coalesce(facts_match(F.col("claimed"), F.col("fact")), F.lit(False))
    mismatch = F.col("fact").isNotNull() & ~F.col("verified")
    return (
        found.withColumn("verified", matched)
        .withColumn(
            "reason",
            F.when(F.col("fact").isNull(), F.lit(MISSING)).when(~F.col("verified"), F.lit(MISMATCH)),
        )
        .withColumn("diff", F.when(mismatch, gap))
        .withColumn(
            "diff_pct",
            F.when(
                mismatch,
                F.when(F.col("fact") == 0, F.lit(float("inf"))).otherwise(
                    F.try_divide(gap, F.col("fact")) * 100
                ),
            ),
        )
    )


def facts_rollup(checked: DataFrame) -> DataFrame:
    """Per entity: verified unless something differs; metrics that were not found
    are only counted."""
    differs = F.col("reason").eqNullSafe(MISMATCH)
    n_bad = F.count(F.when(differs, 1))
    return checked.groupBy("entity").agg(
        (n_bad == 0).alias("verified"),
        F.array_sort(
            F.array_compact(F.collect_set(F.when(differs, F.col("metric"))))
        ).alias("discrepancies"),
        n_bad.alias("n_discrepancies"),
        F.count(F.when(F.col("reason").eqNullSafe(MISSING), 1)).alias("n_missing"),
        F.when(n_bad == 0, F.lit("All values verified"))
        .otherwise(F.concat(n_bad.cast("string"), F.lit(" discrepancies found")))
        .alias("message"),
    )


def verify_facts(
    claims: DataFrame, facts: DataFrame, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """(entity, verified, message, …) per entity with claims; everything passes if the
    check is switched off."""
    if cfg.verify_facts:
        return facts_rollup(check_facts(claims, facts))
    return (
        claims.select("entity")
        .distinct()
        .select(
            "entity",
            F.lit(True).alias("verified"),
            F.array().cast("array<string>").alias("discrepancies"),
            F.lit(0).cast("bigint").alias("n_discrepancies"),
            F.lit(0).cast("bigint").alias("n_missing"),
            F.lit(DISABLED).alias("message"),
        )
    )
