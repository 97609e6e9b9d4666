"""Writing, repairing and sampling programs for many questions at once.

questions: (question_id, question, evidence ARRAY<STRUCT<content, score, doc_type>>,
available ARRAY<DOUBLE>). The evidence is a bounded top k.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions import templates
from ledgerloom.functions.numbers import float_text
from ledgerloom.functions.programs import (
    execute_program,
    first_unknown_literal,
    split_response,
)
from ledgerloom.operators.models import TextModel, ask
from ledgerloom.operators.vote import majority_vote
from ledgerloom.session import materialise

_QUESTION = ["question_id", "question", "evidence", "available"]


def check_program(
    program: Column, available: Column, cfg: EngineConfig = EngineConfig()
) -> Column:
    """Why a program may not be used, or NULL. Skipped if nothing is available."""
    unknown = first_unknown_literal(
        program, available, cfg.program_tolerance, cfg.strict_programs
    )
    return F.when(
        F.size(available) > 0,
        F.when(
            unknown.isNotNull(),
            F.concat(F.lit("Number "), float_text(unknown), F.lit(" not found in evidence")),
        ),
    )


def _judge(answered: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Add program, reasoning, run (executed) and error to model responses."""
    said = split_response(F.coalesce("response", F.lit("")))
    failed = F.concat(F.lit("Program generation failed: "), F.col("model_error"))
    return (
        answered.withColumn("said", said)
        .withColumn("program", F.col("said.program"))
        .withColumn("reasoning", F.col("said.reasoning"))
        .withColumn(
            "write_error",
            F.coalesce(failed, check_program(F.col("program"), F.col("available"), cfg)),
        )
        .withColumn("run", execute_program(F.col("program"), cfg.strict_programs))
        .withColumn("error", F.coalesce("write_error", F.col("run.error")))
        .drop("said", "response", "model_error", "write_error")
    )


def write_prompt() -> Column:
    return templates.fill(
        templates.WRITE_PROGRAM,
        evidence=templates.evidence_text(F.col("evidence")),
        question=F.col("question"),
    )


def repair_prompt(cfg: EngineConfig) -> Column:
    return templates.fill(
        templates.REPAIR_PROGRAM,
        error=F.col("error"),
        program=F.col("program"),
        evidence=templates.evidence_text(F.col("evidence")),
        question=F.col("question"),
        numbers=templates.number_list(F.col("available"), cfg.repair_numbers),
    )


def write_programs(
    questions: DataFrame, model: Callable[[], TextModel], cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """One program per question: program, reasoning, run, error."""
    return _judge(ask(questions.select(*_QUESTION), write_prompt(), model, 0.0), cfg)


def write_with_repair(
    questions: DataFrame, model: Callable[[], TextModel], cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """Programs after up to max_retry_attempts tries. Each round asks only about the
    questions that still fail, and is checkpointed so no model call is repeated."""
    tried = materialise(write_programs(questions, model, cfg))
    rounds = [tried.filter(F.col("error").isNull())]
    failing = tried.filter(F.col("error").isNotNull())
    for _ in range(cfg.max_retry_attempts - 1):
        asked = ask(
            failing.select(*_QUESTION, "program", "error"),
            repair_prompt(cfg),
            model,
            cfg.repair_temperature,
        ).drop("program", "error")
        tried = materialise(_judge(asked, cfg))
        rounds.append(tried.filter(F.col("error").isNull()))
        failing = tried.filter(F.col("error").isNotNull())
    result = failing
    for part in rounds:
        result = result.unionByName(part)
    return result


def sample_runs(
    questions: DataFrame, model: Callable[[], TextModel], cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """(question_id, sample_no, program, reasoning, answer, success, error) per sample."""
    numbers = F.sequence(F.lit(1), F.lit(cfg.self_consistency_samples))
    sampled = questions.select(*_QUESTION, F.explode(numbers).alias("sample_no"))
    answered = ask(
        sampled, write_prompt(), model, cfg.self_consistency_temperature, F.col("sample_no")
    )
    answer = F.col("run.final_answer")
    empty = F.when(answer.isNull(), F.lit("Empty execution result"))
    return (
        _judge(answered, cfg)
        .withColumn("error", F.coalesce("error", empty))
        .select(
            "question_id",
            "sample_no",
            "program",
            "reasoning",
            F.when(F.col("error").isNull(), answer).alias("answer"),
            F.col("error").isNull().alias("success"),
            "error",
        )
    )


def answer_by_vote(
    questions: DataFrame, model: Callable[[], TextModel], cfg: EngineConfig = EngineConfig()
) -> tuple[DataFrame, DataFrame]:
    """(voted, runs): the majority answer per question and all sampled runs."""
    runs = materialise(sample_runs(questions, model, cfg))
    return majority_vote(runs), runs
