"""Questions to filings: recency-weighted retrieval, answer, verification, citations."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions import templates
from ledgerloom.functions.vectors import embed_text
from ledgerloom.operators.cache import AnswerStore, answered
from ledgerloom.operators.documents import TABLE, filing_documents, with_index_order
from ledgerloom.operators.hybrid import retrieve
from ledgerloom.operators.index import Index, publish, read_index
from ledgerloom.operators.models import TextModel, ask
from ledgerloom.operators.temporal import recent_filings
from ledgerloom.operators.verify import verification
from ledgerloom.session import materialise
from ledgerloom.sources.filings import local_filings

# Size from which a table is described by the model, and the message
# for a query without results.
LARGE_TABLE_ROWS = 5
NOTHING_FOUND = "No relevant filings found"


def summarise_with(model: Callable[[], TextModel]):
    """Describe large tables by a model; keep the built summary if that fails."""

    def summarise(tables: DataFrame) -> DataFrame:
        columns = tables.columns
        large = F.col("num_rows") > LARGE_TABLE_ROWS
        prompt = templates.fill(templates.SUMMARISE_TABLE, table=F.col("markdown"))
        described = ask(tables.filter(large), prompt, model, 0.0)
        return (
            described.withColumn("summary", F.coalesce("response", "summary"))
            .select(*columns)
            .unionByName(tables.filter(~large))
        )

    return summarise


def build_index(
    spark: SparkSession,
    filings_root: str,
    index_root: str,
    fallback_date: dt.datetime,
    cfg: EngineConfig = EngineConfig(),
    ticker: str | None = None,
    model: Callable[[], TextModel] | None = None,
) -> Index:
    """Index local filings as one new snapshot. Afterwards the index holds exactly their
    chunks, or with a ticker, exactly that ticker's and what it held of others. Chunks that
    did not change are not written again."""
    filings = local_filings(spark, filings_root, ticker)
    chunks = with_index_order(
        filing_documents(filings, fallback_date, cfg, summarise_with(model) if model else None)
    )
    scope = F.lit(True) if ticker is None else F.col("ticker").eqNullSafe(ticker)
    publish(chunks, index_root, None, cfg, scope=scope)
    return read_index(spark, index_root)


def find_filings(
    queries: DataFrame,
    index: Index,
    reference: dt.datetime,
    cfg: EngineConfig = EngineConfig(),
    filing_type: str | None = None,
) -> DataFrame:
    """Top k recent chunks per query (query_id, query, ticker): the best 2k of the
    whole index, decayed, filtered by the query's ticker and by age."""
    asked = queries.withColumn("embedding", embed_text(F.col("query"), cfg.embedding_dim))
    found = retrieve(asked, index.chunks, 2 * cfg.top_k, cfg, index=index)
    wanted = queries.select("query_id", F.col("ticker").alias("wanted"))
    scoped = found.drop("rank").join(wanted, "query_id")
    return recent_filings(
        scoped,
        cfg.top_k,
        reference,
        cfg,
        ticker=F.coalesce("wanted", "ticker", F.lit("")),
        filing_type=filing_type,
        max_days_old=cfg.max_days_old,
    ).drop("wanted")


def ask_filings(
    queries: DataFrame,
    index: Index,
    model: Callable[[], TextModel],
    reference: dt.datetime,
    cfg: EngineConfig = EngineConfig(),
) -> DataFrame:
    """One row per query: answer, citations, verification, success, error."""
    found = find_filings(queries, index, reference, cfg)
    listed = F.array_sort(
        F.collect_list(
            F.struct(
                "rank", "content", "score", "doc_type", "ticker", "filing_type", "filing_date",
                "section",
            )
        )
    )
    grouped = found.groupBy("query_id").agg(listed.alias("evidence"))
    tables = F.filter("evidence", lambda e: e["doc_type"] == TABLE)
    texts = F.filter("evidence", lambda e: e["doc_type"] != TABLE)
    shared = {"evidence": templates.filing_text(texts), "question": F.col("query")}
    prompt = F.when(
        F.size(tables) > 0,
        templates.fill(
            templates.ANSWER_FILING_TABLES, tables=templates.filing_tables(tables), **shared
        ),
    ).otherwise(templates.fill(templates.ANSWER_FILING, **shared))
    answered = materialise(
        ask(queries.select("query_id", "query").join(grouped, "query_id"), prompt, model, 0.0)
    )
    citations = F.transform(
        "evidence",
        lambda e: F.struct(
            e["ticker"].alias("ticker"),
            e["filing_type"].alias("filing_type"),
            e["filing_date"].alias("filing_date"),
            e["section"].alias("section"),
            e["score"].alias("score"),
        ),
    )
    checked = answered.select(
        "query_id",
        F.col("response").alias("answer"),
        citations.alias("citations"),
        verification(
            F.coalesce("response", F.lit("")), F.transform("evidence", lambda e: e["content"]), cfg
        ).alias("verification"),
        "model_error",
    )
    return queries.select("query_id", "query").join(checked, "query_id", "left").select(
        "query_id",
        "query",
        "answer",
        "citations",
        "verification",
        F.col("answer").isNotNull().alias("success"),
        F.when(F.col("citations").isNull(), F.lit(NOTHING_FOUND))
        .otherwise(F.col("model_error"))
        .alias("error"),
    )


def ask_filings_cached(
    queries: DataFrame,
    index: Index,
    model: Callable[[], TextModel],
    reference: dt.datetime,
    store: AnswerStore,
    cfg: EngineConfig = EngineConfig(),
) -> DataFrame:
    """(query_id, value, from_cache): the answers of ask_filings as JSON, reused from the store
    for the same or a similar query of the same ticker, number of results and age limit."""
    settings = F.lit(f"filings|k={cfg.top_k}|days={cfg.max_days_old}|ticker=")
    scoped = queries.select(
        "query_id",
        "query",
        F.concat(settings, F.coalesce(F.upper("ticker"), F.lit(""))).alias("scope"),
        embed_text(F.col("query"), cfg.embedding_dim).alias("embedding"),
    )

    def answer(left: DataFrame) -> DataFrame:
        asked = left.select("query_id", "query").join(queries.select("query_id", "ticker"), "query_id")
        found = ask_filings(asked, index, model, reference, cfg)
        whole = F.to_json(F.struct("answer", "citations", "verification"))
        return found.select("query_id", F.when(F.col("success"), whole).alias("value"))

    return answered(scoped, answer, store, cfg)


def check_with_model(
    answers: DataFrame, model: Callable[[], TextModel]
) -> DataFrame:
    """Second opinion on (answer, texts ARRAY<STRING>): verified if the reply says PASS."""
    prompt = templates.fill(
        templates.CHECK_NUMBERS,
        answer=F.col("answer"),
        evidence=templates.numbered_text(F.col("texts")),
    )
    return ask(answers, prompt, model, 0.0).withColumn(
        "verified", F.coalesce(F.col("response").contains("PASS"), F.lit(False))
    )
