"""Evaluation metrics and the comparison of two configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions.numbers import has_match, parse_gold, unmatched

# Compared metrics with their report labels, and the stand-in
# written for a missing prediction.
COMPARED = {
    "exact_match": "Exact Match",
    "numerical_accuracy": "Numerical Accuracy",
    "execution_success_rate": "Execution Success Rate",
    "evidence_precision": "Evidence Precision",
    "hallucination_rate": "Hallucination Rate (lower is better)",
}
NO_PREDICTION = -999.0


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def score_predictions(
    predictions: DataFrame, cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """Per prediction: parsed gold and the flags and counts the metrics add up.

    predictions: (question_id, predicted_answer DOUBLE, gold_answer STRING,
    execution_success, evidence_numbers ARRAY<DOUBLE> or NULL without evidence,
    program_numbers ARRAY<DOUBLE>). Both arrays come from a bounded top k.
    """
    gold = F.col("gold")
    predicted = F.coalesce("predicted_answer", F.lit(NO_PREDICTION))
    known = F.coalesce("evidence_numbers", F.array().cast("array<double>"))
    used = F.coalesce("program_numbers", F.array().cast("array<double>"))
    counted = gold.isNotNull()
    return predictions.withColumn("gold", parse_gold(F.col("gold_answer"))).select(
        "question_id",
        "gold",
        (counted & (F.abs(predicted - gold) < cfg.exact_tolerance)).alias("is_exact"),
        (counted & (F.abs(predicted - gold) < cfg.numerical_tolerance)).alias("is_close"),
        (counted & F.col("execution_success")).alias("is_executed"),
        F.when(
            counted & F.col("evidence_numbers").isNotNull(),
            has_match(gold, known, cfg.numerical_tolerance).cast("double"),
        ).alias("gold_found"),
        F.when(counted, F.size(used)).otherwise(0).alias("n_used"),
        F.when(counted, F.size(unmatched(used, known, cfg.numerical_tolerance)))
        .otherwise(0)
        .alias("n_unknown"),
    )


def evaluation_metrics(scored: DataFrame) -> DataFrame:
    """One row of metrics. Predictions without a numeric gold answer count in the
    denominators but nowhere else."""
    n = F.count(F.lit(1))
    exact, near, executed = (F.count_if(c) for c in ("is_exact", "is_close", "is_executed"))
    unknown = F.coalesce(F.sum("n_unknown"), F.lit(0))
    used = F.coalesce(F.sum("n_used"), F.lit(0))
    return scored.agg(
        _ratio(exact, n).alias("exact_match"),
        _ratio(near, n).alias("numerical_accuracy"),
        _ratio(executed, n).alias("execution_success_rate"),
        F.coalesce(F.avg("gold_found"), F.lit(0.0)).alias("evidence_precision"),
        _ratio(unknown, used).alias("hallucination_rate"),
        n.alias("total_examples"),
        exact.alias("exact_matches"),
        near.alias("numerical_correct"),
        executed.alias("execution_success"),
        unknown.alias("hallucination_count"),
        used.alias("total_numbers"),
        F.count_if(F.col("gold").isNull()).alias("n_skipped"),
    )


def compare_metrics(baseline: DataFrame, proposed: DataFrame) -> DataFrame:
    """(metric, label, baseline, proposed, absolute, percentage); fewer
    hallucinations are an improvement."""

    def long(metrics: DataFrame, name: str) -> DataFrame:
        return metrics.unpivot([], list(COMPARED), "metric", name)

    lower_is_better = F.col("metric").contains("hallucination")
    gain = F.col("proposed") - F.col("baseline")
    label = F.create_map(*[F.lit(p) for pair in COMPARED.items() for p in pair])[F.col("metric")]
    absolute = F.when(lower_is_better, -gain).otherwise(gain)
    return (
        long(baseline, "baseline")
        .join(long(proposed, "proposed"), "metric")
        .withColumn("label", label)
        .withColumn("absolute", absolute)
        .withColumn(
            "percentage",
            F.when(F.col("baseline") > 0, F.try_divide("absolute", "baseline") * 100).otherwise(0.0),
        )
        .select("metric", "label", "baseline", "proposed", "absolute", "percentage")
    )
