"""Majority vote over sampled programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Vote precision and failure message.
VOTE_DIGITS = 6
NOTHING_VALID = "Self-consistency failed to produce any valid program"


def majority_vote(runs: DataFrame, by_text: bool = False) -> DataFrame:
    """(question_id, answer, program, reasoning, votes, n_runs, n_success) per question.

    runs: (question_id, sample_no, program, reasoning, answer DOUBLE, success, error).
    Answers equal after rounding are one candidate; on equal votes the one seen
    first wins, and the first run that gave it supplies program and answer. Both
    steps combine before they shuffle, so a question with very many runs is no
    hot key.
    """
    ok = F.col("success") & F.col("answer").isNotNull()
    key = F.col("answer").cast("string") if by_text else F.bround("answer", VOTE_DIGITS)
    first = F.struct("answer", "program", "reasoning")
    candidates = (
        runs.withColumn("key", F.when(ok, key))
        .groupBy("question_id", "key")
        .agg(
            F.count(F.lit(1)).alias("votes"),
            F.min("sample_no").alias("seen"),
            F.min_by(first, "sample_no").alias("first"),
            F.max_by("error", "sample_no").alias("last_error"),
            F.max("sample_no").alias("last_seen"),
        )
    )
    valid = F.col("key").isNotNull()
    rank = F.when(valid, F.struct(F.col("votes"), -F.col("seen")))
    return (
        candidates.groupBy("question_id")
        .agg(
            F.max_by(F.struct("first", "votes"), rank).alias("won"),
            F.sum("votes").alias("n_runs"),
            F.coalesce(F.sum(F.when(valid, F.col("votes"))), F.lit(0)).alias("n_success"),
            F.max(F.when(~valid, F.col("last_error"))).alias("last_error"),
        )
        .select(
            "question_id",
            F.col("won.first.answer").alias("answer"),
            F.col("won.first.program").alias("program"),
            F.col("won.first.reasoning").alias("reasoning"),
            F.col("won.votes").alias("votes"),
            "n_runs",
            "n_success",
            F.when(
                F.col("n_success") == 0, F.coalesce("last_error", F.lit(NOTHING_VALID))
            ).alias("error"),
        )
    )
