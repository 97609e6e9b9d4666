"""Sinks: predictions, metrics, comparison reports and Markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.html import page_markdown, page_parts
from ledgerloom.operators.metrics import NO_PREDICTION


def save_results(predictions: DataFrame, metrics: DataFrame, root: str, split: str) -> None:
    """Write {root}/{split}_predictions and {root}/{split}_metrics as JSON."""
    predictions.select(
        "question_id",
        "question",
        F.coalesce("predicted_answer", F.lit(NO_PREDICTION)).alias("predicted_answer"),
        "gold_answer",
        "execution_success",
        "error_message",
        "num_retrieved",
    ).write.mode("overwrite").json(f"{root}/{split}_predictions")
    metrics.write.mode("overwrite").json(f"{root}/{split}_metrics")


def save_comparison(report: DataFrame, root: str) -> None:
    """Write {root}/baseline_vs_proposed as JSON, one row per metric."""
    report.write.mode("overwrite").json(f"{root}/baseline_vs_proposed")


def save_markdown(filings: DataFrame, root: str) -> None:
    """Convert filings (ticker, filing_type, accession_number, html) and write their
    Markdown, one directory per ticker, type and accession number."""
    (
        filings.select(
            "ticker",
            "filing_type",
            "accession_number",
            page_markdown(page_parts(F.col("html"))).alias("value"),
        )
        .write.mode("overwrite")
        .partitionBy("ticker", "filing_type", "accession_number")
        .text(root)
    )


def metrics_text(metrics: DataFrame) -> DataFrame:
    """The metrics as readable lines (metric, value)."""
    rates = [
        "exact_match",
        "numerical_accuracy",
        "execution_success_rate",
        "evidence_precision",
        "hallucination_rate",
    ]
    shown = metrics.select(
        F.col("total_examples").cast("string").alias("total_examples"),
        *[F.format_string("%.2f%%", F.col(r) * 100).alias(r) for r in rates],
        F.concat_ws("/", "execution_success", "total_examples").alias("successful_executions"),
        F.concat_ws("/", "hallucination_count", "total_numbers").alias("hallucinated_numbers"),
    )
    return shown.unpivot([], shown.columns, "metric", "value")
