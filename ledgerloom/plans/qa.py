"""From questions to answers, metrics and comparison reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions.numbers import evidence_numbers, extract_numbers
from ledgerloom.functions.programs import execute_program
from ledgerloom.functions.vectors import embed_text
from ledgerloom.operators import metrics
from ledgerloom.operators.cache import AnswerStore, answered
from ledgerloom.operators.documents import in_insertion_order, qa_documents
from ledgerloom.operators.index import Index
from ledgerloom.operators.hybrid import diversify, post_filter, retrieve
from ledgerloom.operators.models import TextModel
from ledgerloom.operators.programs import answer_by_vote, write_with_repair
from ledgerloom.session import materialise
from ledgerloom.sources.qa import first_examples


def index_examples(examples: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Chunks of examples with doc_key, ord and embedding, ready to be searched, in the
    order of the file. They are computed once, so every later step sees the same order."""
    chunks = in_insertion_order(
        qa_documents(examples, with_summary=cfg.table_summary_enabled, ordered=True)
    )
    return materialise(
        chunks.withColumn("embedding", embed_text(F.col("content"), cfg.embedding_dim))
    )


def ask_examples(examples: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    return examples.select(
        F.col("id").alias("query_id"),
        F.col("question").alias("query"),
        embed_text(F.col("question"), cfg.embedding_dim).alias("embedding"),
    )


def find_evidence(
    queries: DataFrame,
    chunks: DataFrame,
    cfg: EngineConfig = EngineConfig(),
    own_question: bool = False,
    index: Index | None = None,
) -> DataFrame:
    """Per query the evidence list (at most top_k, best first).

    With own_question, as for question sets, the best 2k chunks overall are cut to
    those of the question itself and spread over document types.
    """
    k = cfg.top_k
    if own_question:
        found = retrieve(queries, chunks, 2 * k, cfg, index=index)
        own = post_filter(found, F.col("question_id") == F.col("query_id"), k)
        found = diversify(own, k)
    else:
        found = retrieve(queries, chunks, k, cfg, index=index)
    fields = [
        c
        for c in ("ticker", "filing_type", "filing_date", "section")
        if c in found.columns
    ]
    listed = F.array_sort(
        F.collect_list(F.struct("rank", "doc_key", "content", "score", "doc_type", *fields))
    )
    return found.groupBy("query_id").agg(listed.alias("evidence"))


def _with_numbers(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Question rows for the program operators."""
    numbers = F.flatten(F.transform("evidence", lambda e: evidence_numbers(e["content"])))
    return (
        queries.select(F.col("query_id").alias("question_id"), F.col("query").alias("question"))
        .join(evidence.withColumnRenamed("query_id", "question_id"), "question_id", "left")
        .withColumn("available", F.coalesce(F.array_distinct(numbers), F.array().cast("array<double>")))
    )


def answer_questions(
    queries: DataFrame,
    chunks: DataFrame,
    model: Callable[[], TextModel],
    cfg: EngineConfig = EngineConfig(),
    own_question: bool = False,
    index: Index | None = None,
) -> DataFrame:
    """One row per question: answer, program, reasoning, intermediate values, evidence,
    sampled runs, success, error.

    The answer is voted among samples, or the program is repaired up to the allowed
    number of attempts if sampling is off.
    """
    evidence = find_evidence(queries, chunks, cfg, own_question, index)
    # at most k pieces per question; kept so that retrieval runs once
    asked = materialise(_with_numbers(queries, evidence))
    if cfg.self_consistency and not cfg.baseline_mode:
        voted, runs = answer_by_vote(asked, model, cfg)
        samples = runs.groupBy("question_id").agg(
            F.array_sort(
                F.collect_list(
                    F.struct("sample_no", "program", "reasoning", "answer", "success", "error")
                )
            ).alias("samples")
        )
        found = voted.join(samples, "question_id").select(
            "question_id",
            "answer",
            "program",
            "reasoning",
            "error",
            "samples",
            execute_program(F.col("program"), cfg.strict_programs)["variables"].alias("variables"),
        )
    else:
        found = write_with_repair(asked, model, cfg).select(
            "question_id",
            F.when(F.col("error").isNull(), F.col("run.final_answer")).alias("answer"),
            "program",
            "reasoning",
            "error",
            F.lit(None)
            .cast(
                "array<struct<sample_no:int,program:string,reasoning:string,"
                "answer:double,success:boolean,error:string>>"
            )
            .alias("samples"),
            F.col("run.variables").alias("variables"),
        )
    return asked.select("question_id", "question", "evidence").join(found, "question_id").withColumn(
        "success", F.col("error").isNull() & F.col("answer").isNotNull()
    )


def answer_with_cache(
    queries: DataFrame,
    store: AnswerStore,
    chunks: DataFrame,
    model: Callable[[], TextModel],
    cfg: EngineConfig = EngineConfig(),
    own_question: bool = False,
) -> DataFrame:
    """(query_id, value, from_cache) of queries (query_id, query, embedding): the answer as
    JSON, from the store if the same or a similar question was answered with the same
    settings before (and, with own_question, for the same example)."""

    def answer(left: DataFrame) -> DataFrame:
        found = answer_questions(left.drop("scope"), chunks, model, cfg, own_question)
        kept = F.to_json(F.struct("answer", "program", "reasoning"))
        return found.select(F.col("question_id").alias("query_id"), F.when(F.col("success"), kept).alias("value"))

    settings = F.lit(f"qa|k={cfg.top_k}|own={own_question}")
    scope = F.concat_ws("|", settings, F.col("query_id").cast("string")) if own_question else settings
    return answered(queries.withColumn("scope", scope), answer, store, cfg)


def predict_examples(
    examples: DataFrame, model: Callable[[], TextModel], cfg: EngineConfig = EngineConfig()
) -> DataFrame:
    """Predictions of a question set against its own chunks, with repair."""
    answered = answer_questions(
        ask_examples(examples, cfg),
        index_examples(examples, cfg),
        model,
        cfg.replace(self_consistency=False),
        own_question=True,
    )
    known = F.array_distinct(
        F.flatten(F.transform("evidence", lambda e: extract_numbers(e["content"])))
    )
    # every computed variable counts as a number of the program
    used = F.filter(
        F.map_values("variables"), lambda v: v.isNotNull() & ~v.between(1900, 2100)
    )
    return answered.join(
        examples.select(F.col("id").alias("question_id"), F.col("answer").alias("gold_answer")),
        "question_id",
    ).select(
        "question_id",
        "question",
        F.col("answer").alias("predicted_answer"),
        "gold_answer",
        F.col("success").alias("execution_success"),
        F.col("error").alias("error_message"),
        F.when(F.size("evidence") > 0, known).alias("evidence_numbers"),
        used.alias("program_numbers"),
        F.coalesce(F.size("evidence"), F.lit(0)).alias("num_retrieved"),
        "variables",
    )


def evaluate(
    examples: DataFrame,
    model: Callable[[], TextModel],
    cfg: EngineConfig = EngineConfig(),
    num_examples: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(predictions, metrics) of the first num_examples examples of the file, or of all."""
    if num_examples:
        examples = first_examples(examples, num_examples)
    predictions = predict_examples(examples, model, cfg)
    return predictions, metrics.evaluation_metrics(metrics.score_predictions(predictions, cfg))


def compare(
    examples: DataFrame,
    model: Callable[[], TextModel],
    cfg: EngineConfig = EngineConfig(),
    num_examples: int | None = None,
) -> DataFrame:
    """Report of the baseline configuration against the given one, on the same examples."""
    if num_examples:
        examples = first_examples(examples, num_examples)
    _, baseline = evaluate(examples, model, cfg.baseline())
    _, proposed = evaluate(examples, model, cfg)
    return metrics.compare_metrics(baseline, proposed)
