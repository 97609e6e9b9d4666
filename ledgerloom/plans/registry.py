"""Every operator as a query over the given tables.

Queries run over whole tables and whole texts; a limit appears only where it is
the operator (top k). Derived inputs (small tables, filing texts, programs) are
built row by row from the given rows, so the work grows with the data.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions import numbers as N
from ledgerloom.functions import tables as T
from ledgerloom.functions.html import (
    first_row_tables,
    header_cell_tables,
    page_markdown,
    page_parts,
)
from ledgerloom.functions.programs import execute_program, first_unknown_literal
from ledgerloom.functions.vectors import embed_text
from ledgerloom.operators import (
    bm25,
    cache,
    documents,
    facts,
    hybrid,
    index,
    metrics,
    similar,
    temporal,
    vector,
    verify,
    vote,
)
from ledgerloom.operators.joins import join_small
from ledgerloom.session import shared_folder, spread

CONFIG = EngineConfig()
REFERENCE = "2024-02-01"


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _busy(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A table read for work that is heavy per row."""
    return spread(_read(spark, sf, table))


def _text(value: Column) -> Column:
    return value.cast("string")


# --- retrieval inputs ------------------------------------------------------


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _busy(spark, sf, "documents").select(
        F.col("doc_id").alias("doc_key"),
        F.col("doc_id").alias("ord"),
        F.col("text").alias("content"),
        "lang",
        "source",
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def _embedded(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("embedding", embed_text(F.col(text), CONFIG.embedding_dim))


def _prototypes(spark: SparkSession, sf: str) -> DataFrame:
    """(label, embedding): mean vector per label; averages combine map-side."""
    means = (
        _read(spark, sf, "embeddings")
        .select("label", F.posexplode("embedding").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    # one row per label and dimension is left, so the list below is bounded
    listed = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy("label").agg(F.transform(listed, lambda p: p["x"]).alias("embedding"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_key"), F.col("vec_id").alias("ord"), "embedding"
    )


# --- retrieval -------------------------------------------------------------


def bm25_topk(spark, sf):
    return bm25.bm25_topk(questions(spark, sf), corpus(spark, sf), CONFIG.top_k, CONFIG)


def _keyword_index(spark, *states):
    """An index of BM25 postings that has gone through the given states of its documents."""
    root = f"{shared_folder(spark)}/{uuid4().hex}"
    for state in states:
        index.publish(state, root, None, CONFIG, embed=F.array().cast("array<float>"), scope=F.lit(True))
    return index.read_index(spark, root)


def bm25_indexed(spark, sf):
    """The ranking of bm25_topk out of a persistent index."""
    stored = _keyword_index(spark, corpus(spark, sf))
    return stored.topk(questions(spark, sf), CONFIG.top_k, CONFIG)


def index_changes(spark, sf):
    """An index whose English documents were drafts first and that then lost those labelled
    toxic: the ranking of what is left, changed documents last in index order."""
    final = corpus(spark, sf)
    draft = F.when(F.col("lang") == "en", F.concat("content", F.lit(" draft"))).otherwise(F.col("content"))
    toxic = _read(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("doc_key"))
    left = join_small(final, toxic, ["doc_key"], CONFIG.broadcast_max_rows, 1, ["doc_key"], how="left_anti")
    stored = _keyword_index(spark, final.withColumn("content", draft), final, left)
    return stored.topk(questions(spark, sf), CONFIG.top_k, CONFIG)


def term_idf(spark, sf):
    df, stats = bm25.vocabulary(corpus(spark, sf))
    n_docs = stats.select("n_docs").scalar()
    idf = bm25.inverse_frequency(df, n_docs, CONFIG.bm25_epsilon)
    return df.join(idf, "token").select("token", "df", F.round("idf", 6).alias("idf"))


def vector_topk(spark, sf):
    queries = _prototypes(spark, sf).withColumnRenamed("label", "query_id")
    return vector.vector_topk(queries, _vectors(spark, sf), 10, CONFIG).select(
        "query_id", "doc_key", "distance", "rank"
    )


def text_embedding(spark, sf):
    vectors = _embedded(corpus(spark, sf), "content")
    return vectors.select("doc_key", F.posexplode_outer("embedding").alias("feature", "weight")).filter(
        F.col("weight") != 0
    ).select("doc_key", "feature", F.round(F.col("weight").cast("double"), 5).alias("weight"))


def hybrid_topk(spark, sf):
    return hybrid.hybrid_topk(
        _embedded(questions(spark, sf), "query"),
        _embedded(corpus(spark, sf), "content"),
        CONFIG.top_k,
        CONFIG,
    ).select("query_id", "doc_key", "score", "rank")


def hybrid_rerank(spark, sf):
    return hybrid.retrieve(
        _embedded(questions(spark, sf), "query"),
        _embedded(corpus(spark, sf), "content"),
        CONFIG.top_k,
        CONFIG.replace(rerank_enabled=True),
    ).select("query_id", "doc_key", "score", "rank")


def diversify_by_type(spark, sf):
    """BM25 results with the document language standing for a document type."""
    kind = (
        F.when(F.col("lang") == "en", "text")
        .when(F.col("lang") == "fr", "table")
        .otherwise("table_summary")
    )
    found = bm25.bm25_topk(questions(spark, sf), corpus(spark, sf), 20, CONFIG, keep=["lang"])
    return hybrid.diversify(found.withColumn("doc_type", kind), CONFIG.top_k).select(
        "query_id", "doc_key", "doc_type", "score", "rank"
    )


def postfilter_topk(spark, sf):
    """Of the 2k best results those from the source of the very best one."""
    found = bm25.bm25_topk(
        questions(spark, sf), corpus(spark, sf), 2 * CONFIG.top_k, CONFIG, keep=["source"]
    )
    first = F.first("source").over(Window.partitionBy("query_id").orderBy("rank"))
    scoped = found.withColumn("scope", first)
    return hybrid.post_filter(scoped, F.col("source") == F.col("scope"), CONFIG.top_k).select(
        "query_id", "doc_key", "score", "rank"
    )


def prefilter_topk(spark, sf):
    """The best results within the source of the very best one."""
    docs, asked = corpus(spark, sf), questions(spark, sf)
    scopes = bm25.bm25_topk(asked, docs, 1, CONFIG, keep=["source"]).select(
        "query_id", F.col("source").alias("scope")
    )
    return bm25.scoped_topk(asked, docs, scopes, "source", CONFIG.top_k, CONFIG)


def semantic_cache_lookup(spark, sf):
    entries = _prototypes(spark, sf).select(
        F.concat(F.lit("label "), _text(F.col("label"))).alias("query"),
        "embedding",
        F.concat(F.lit("answer "), _text(F.col("label"))).alias("value"),
        F.col("label").alias("ord"),
    )
    probes = _vectors(spark, sf).select(F.col("doc_key").alias("query_id"), "embedding")
    return cache.cache_lookup(probes, entries, CONFIG, threshold=0.25)


def cache_reuse(spark, sf):
    """Every document as a question: how many earlier ones of its source and language are
    similar enough for their answer, and the oldest of the most similar."""
    rows = _embedded(corpus(spark, sf), "content").select(
        F.concat_ws("/", "source", "lang").alias("scope"), F.col("doc_key").alias("id"), "embedding"
    )
    earlier = similar.similar_pairs(rows, rows, CONFIG.cache_threshold, CONFIG, earlier=True)
    best = F.min(F.struct((-F.col("similarity")).alias("far"), "right_id"))
    found = earlier.groupBy("left_id").agg(F.sum("n").alias("n_similar"), best.alias("b"))
    return found.select(
        F.col("left_id").alias("query_id"), "n_similar", F.col("b.right_id").alias("ord"),
        (-F.col("b.far")).alias("similarity"),
    )


# --- recency ---------------------------------------------------------------


def _events(spark, sf):
    return _read(spark, sf, "events").select(
        F.col("user_id").alias("query_id"),
        F.col("event_id").alias("doc_key"),
        F.col("event_id").alias("ord"),
        F.col("value").alias("score"),
        _text(F.col("user_id")).alias("ticker"),
        F.col("event_type").alias("filing_type"),
        F.col("ts").alias("filing_date"),
    )


def _reference() -> Column:
    return F.lit(REFERENCE).cast("timestamp")


def temporal_decay_rank(spark, sf):
    cut = temporal.top_results(_events(spark, sf), 20)
    return temporal.apply_decay(cut, _reference(), CONFIG).select(
        "query_id", "doc_key", "days_old", F.round("decay_factor", 6).alias("decay_factor"),
        "score", "rank",
    )


def recent_filings(spark, sf):
    return temporal.recent_filings(
        _events(spark, sf), 10, _reference(), CONFIG,
        ticker=_text(F.col("query_id")), filing_type="purchase", max_days_old=20,
    ).select("query_id", "doc_key", "days_old", "score", "rank")


def most_recent(spark, sf):
    return temporal.most_recent(
        _events(spark, sf), _reference(), CONFIG, ticker=_text(F.col("query_id")),
        filing_type="purchase",
    ).select("query_id", "doc_key", "days_old", "score", "rank")


def periods_compare(spark, sf):
    rows = _read(spark, sf, "orders").select(
        F.col("o_custkey").alias("query_id"),
        F.col("o_orderkey").alias("doc_key"),
        F.col("o_orderkey").alias("ord"),
        F.col("o_totalprice").alias("score"),
        _text(F.col("o_custkey")).alias("ticker"),
        F.col("o_orderpriority").alias("filing_type"),
        F.col("o_orderdate").alias("filing_date"),
    )
    return temporal.compare_periods(
        rows, 4, F.lit("2001-08-01").cast("timestamp"), CONFIG,
        ticker=_text(F.col("query_id")), max_days_old=1500,
    ).select("query_id", "period", "period_rank", "doc_key", "score")


# --- numbers ---------------------------------------------------------------


def _listed(spark, sf, extract):
    return _busy(spark, sf, "documents").select(
        "doc_id", F.posexplode(extract(F.col("text"))).alias("pos", "number")
    )


def extract_numbers(spark, sf):
    return _listed(spark, sf, N.extract_numbers)


def evidence_numbers(spark, sf):
    return _listed(spark, sf, N.evidence_numbers)


def plain_numbers(spark, sf):
    return _listed(spark, sf, N.plain_numbers)


def numeric_claims(spark, sf):
    claims = F.posexplode(N.numeric_claims(F.col("text"))).alias("pos", "claim")
    return _busy(spark, sf, "documents").select("doc_id", claims).select(
        "doc_id",
        "pos",
        "claim.sentence",
        F.size("claim.numbers").alias("n_numbers"),
        F.array_max("claim.numbers").alias("largest"),
    )


def _answers_and_evidence(spark, sf):
    """Order totals as answers, the customer's order lines as evidence."""
    orders = _read(spark, sf, "orders")
    answers = orders.select(
        F.col("o_orderkey").alias("answer_id"),
        F.col("o_custkey").alias("customer"),
        F.concat(
            F.lit("The total was $"), _text(F.col("o_totalprice")), F.lit(" at priority "),
            F.col("o_orderpriority"), F.lit("."),
        ).alias("answer"),
    )
    lines = _busy(spark, sf, "lineitem")
    evidence = lines.join(
        orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer")),
        "l_orderkey",
    ).select(
        "customer",
        F.concat(
            _text(F.col("l_quantity")), F.lit(" units for $"), _text(F.col("l_extendedprice")),
            F.lit(", discount "), _text(F.col("l_discount")), F.lit("."),
        ).alias("content"),
    )
    return answers, evidence


def verify_answers(spark, sf):
    return verify.verify_answers(*_answers_and_evidence(spark, sf), "customer", CONFIG)


def hallucination_rate(spark, sf):
    checked = verify.verify_answers(*_answers_and_evidence(spark, sf), "customer", CONFIG)
    return verify.hallucination_rate(checked).select(
        "total_numbers", "hallucinated_numbers",
        F.round("hallucination_rate", 6).alias("hallucination_rate"),
    )


# --- programs --------------------------------------------------------------


def _programs(spark, sf):
    line = _busy(spark, sf, "lineitem")
    operation = F.when(F.col("l_returnflag") == "R", F.lit("power")).otherwise(F.lit("percent"))
    return line.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"),
        "l_extendedprice", "l_discount", "l_tax", "l_quantity",
        F.concat(
            F.lit("PROGRAM:\nconst_0 = "), _text(F.col("l_extendedprice")),
            F.lit("\nconst_1 = "), _text(F.col("l_discount")),
            F.lit("  # discount\ncut = multiply(const_0, const_1)\nnet = subtract(const_0, cut)\n"),
            F.lit("total = sum([net, "), _text(F.col("l_quantity")), F.lit(", "),
            _text(F.col("l_tax")), F.lit("])\nanswer = "), operation, F.lit("(total, const_0)"),
        ).alias("program"),
    ).select("key.*", "program", "l_extendedprice", "l_discount", "l_tax", "l_quantity")


def program_execute(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    run = _programs(spark, sf).select(*keys, execute_program(F.col("program")).alias("run"))
    return run.select(
        *keys,
        F.round("run.final_answer", 6).alias("final_answer"),
        F.size("run.steps").alias("n_steps"),
        F.round(F.try_element_at("run.variables", F.lit("total")), 4).alias("total"),
        "run.error",
    )


def program_verify(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    available = F.array("l_extendedprice", "l_quantity", "l_discount")
    return _programs(spark, sf).select(
        *keys, first_unknown_literal(F.col("program"), available).alias("unknown_number")
    )


def _runs(spark, sf):
    return _read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("question_id"),
        (
            F.col("l_linenumber").cast("bigint") * 1_000_000_000_000
            + F.col("l_partkey") * 1_000_000
            + F.col("l_suppkey")
        ).alias("sample_no"),
        F.concat(F.lit("answer = "), _text(F.col("l_quantity"))).alias("program"),
        F.concat(F.lit("line "), _text(F.col("l_linenumber"))).alias("reasoning"),
        (F.floor(F.col("l_quantity") / 10) + F.col("l_tax") / 10_000_000).alias("answer"),
        (F.col("l_returnflag") != "R").alias("success"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("failed "), F.col("l_linestatus"))).alias(
            "error"
        ),
    )


def _voted(spark, sf, by_text):
    return vote.majority_vote(_runs(spark, sf), by_text).select(
        "question_id", F.round("answer", 9).alias("answer"), "program", "votes", "n_runs", "n_success"
    )


def program_vote(spark, sf):
    return _voted(spark, sf, False)


def program_vote_text(spark, sf):
    return _voted(spark, sf, True)


# --- tables ----------------------------------------------------------------


def _part_tables(spark, sf):
    """A small table per part, built from its row."""
    price, size = _text(F.col("p_retailprice")), _text(F.col("p_size"))
    grid = F.array(
        F.array(F.lit("Item"), F.lit("Price"), F.lit("Size"), F.lit("Price")),
        F.array(F.col("p_name"), F.concat(F.lit("$"), price), size, F.lit("n/a")),
        F.array(F.col("p_type"), F.concat(F.lit("("), price, F.lit(")")), F.lit("5%")),
        F.array(F.col("p_brand"), F.lit("Revenue"), F.concat(size, F.lit(" mm")), price),
    )
    caption = F.when(F.col("p_size") > 25, F.concat(F.lit("Balance of "), F.col("p_name")))
    return _busy(spark, sf, "part").select(
        "p_partkey",
        caption.alias("caption"),
        grid.alias("grid"),
        F.get(grid, F.lit(0)).alias("headers"),
        F.slice(grid, 2, 3).alias("rows"),
    )


def grid_markdown(spark, sf):
    return _part_tables(spark, sf).select(
        "p_partkey", T.grid_markdown(F.col("grid")).alias("markdown")
    )


def grid_summary(spark, sf):
    return _part_tables(spark, sf).select(
        "p_partkey", T.grid_summary(F.col("grid")).alias("summary")
    )


def table_markdown(spark, sf):
    return _part_tables(spark, sf).select(
        "p_partkey", T.table_markdown(F.col("headers"), F.col("rows")).alias("markdown")
    )


def table_summary(spark, sf):
    return _part_tables(spark, sf).select(
        "p_partkey",
        T.table_summary(F.col("caption"), F.col("headers"), F.col("rows")).alias("summary"),
    )


def numeric_columns(spark, sf):
    return _part_tables(spark, sf).select(
        "p_partkey",
        F.array_join(T.numeric_columns(F.col("headers"), F.col("rows")), ", ").alias("columns"),
    )


def financial_data(spark, sf):
    return (
        _part_tables(spark, sf)
        .select("p_partkey", F.inline(T.financial_data(F.col("headers"), F.col("rows"))))
        .select("p_partkey", "metric", F.posexplode("values").alias("pos", "value"))
    )


def financial_filter(spark, sf):
    no_revenue = F.transform(
        F.col("rows"), lambda r: F.filter(r, lambda c: c != "Revenue")
    )
    return (
        _part_tables(spark, sf)
        .filter(T.is_financial(F.col("caption"), F.col("headers"), no_revenue))
        .select("p_partkey", "caption")
    )


def markdown_tables(spark, sf):
    text = F.concat(
        F.lit("Prices follow.\n\n"), T.grid_markdown(F.col("grid")),
        F.lit("\n\nSecond table.\n\n| Size |\n| --- |\n| "), F.get(F.get("grid", F.lit(1)), F.lit(2)),
        F.lit(" |\n|  |\nEnd."),
    )
    return _part_tables(spark, sf).select(
        "p_partkey", F.inline(T.markdown_tables(text))
    ).select(
        "p_partkey", "table_id", F.array_join("headers", ";").alias("headers"),
        F.array_join(F.flatten("rows"), ";").alias("cells"), "num_rows", "num_cols", "summary",
    )


def _part_pages(spark, sf):
    """An HTML page with a table per part."""
    price, size = _text(F.col("p_retailprice")), _text(F.col("p_size"))
    return _busy(spark, sf, "part").select(
        "p_partkey",
        F.concat(
            F.lit("<html><body><h2>Part</h2><table><caption> Price of "), F.col("p_name"),
            F.lit(" </caption><tr><th>Name</th><th>Price\n ($)</th></tr><tr><td>"), F.col("p_type"),
            F.lit("</td><td> "), price, F.lit("</td></tr><tr></tr><tr><td><b>Size</b> mm</td><td>"),
            size, F.lit("</td><td>extra</td></tr></table><table><tr><td>"), F.col("p_brand"),
            F.lit("</td><td>"), size, F.lit("</td></tr></table></body></html>"),
        ).alias("html"),
    )


def _found_tables(spark, sf, read):
    parts = _part_pages(spark, sf).select("p_partkey", page_parts(F.col("html")).alias("parts"))
    return parts.select("p_partkey", F.inline(read(F.col("parts")))).select(
        "p_partkey", "table_id", "caption", F.array_join("headers", ";").alias("headers"),
        F.array_join(F.flatten("rows"), ";").alias("cells"), "num_rows", "num_cols", "markdown",
        "summary",
    )


def html_tables(spark, sf):
    return _found_tables(spark, sf, first_row_tables)


def html_header_tables(spark, sf):
    return _found_tables(spark, sf, header_cell_tables)


def html_to_markdown(spark, sf):
    return _busy(spark, sf, "pages").select(
        "page_id", page_markdown(page_parts(F.col("html"))).alias("markdown")
    )


# --- documents -------------------------------------------------------------


def _filing_texts(spark, sf):
    """Every document as a filing: its text under several item headings."""
    text = F.col("text")
    kind = F.when(F.col("lang") == "en", "10-K").when(F.col("lang") == "de", "8-K").otherwise("10-q")
    return _busy(spark, sf, "documents").select(
        "doc_id",
        kind.alias("filing_type"),
        F.concat(
            F.lit("Cover\nITEM 1. BUSINESS\n"), text, F.lit("\nItem 1A. RISK\n"), text,
            F.lit("\nITEM 2 PROPERTIES see ITEM 8.\n"), text, F.lit("\nITEM  7. REVIEW\n"), text,
            F.lit("\nItem 10 DIRECTORS\n"), text, F.lit("\nITEM 1A. RISK AGAIN\n"), text,
        ).alias("content"),
    )


def _section_rows(sections: DataFrame) -> DataFrame:
    return sections.select("doc_id", "section", "content")


def sections(spark, sf):
    return _section_rows(documents.split_sections(_filing_texts(spark, sf)))


def important_sections(spark, sf):
    return _section_rows(documents.split_sections(_filing_texts(spark, sf), important_only=True))


def chunks(spark, sf):
    whole = _busy(spark, sf, "documents").select(
        "doc_id", F.lit("full_document").alias("section"), F.col("text").alias("content")
    )
    return documents.split_chunks(whole, 64, 8, paragraph_break="\n").select(
        "doc_id", "chunk_id", "content", "word_count"
    )


def _examples(spark, sf):
    """Every document as a question example: its lines as text, and a small table."""
    half = (F.size("lines") / 2).cast("int")
    return (
        _busy(spark, sf, "documents")
        .withColumn("lines", F.split("text", "\n"))
        .select(
            _text(F.col("doc_id")).alias("id"),
            F.col("doc_id").alias("place"),
            F.concat(F.lit("What is "), F.col("source"), F.lit("?")).alias("question"),
            F.slice("lines", F.lit(1), half).alias("pre_text"),
            F.slice("lines", half + 1, F.size("lines")).alias("post_text"),
            F.when(
                F.col("lang") != "es",
                F.array(
                    F.array(F.lit("lang"), F.lit("chars")),
                    F.array(F.col("lang"), _text(F.col("n_chars"))),
                ),
            ).alias("table"),
        )
    )


def index_order(spark, sf):
    """Places of all chunks in the index: by example, then texts before and after the table,
    table, summary."""
    ordered = documents.in_insertion_order(documents.qa_documents(_examples(spark, sf), ordered=True))
    return ordered.select("ord", "doc_key", "doc_type")


def qa_documents(spark, sf):
    examples = _examples(spark, sf)
    return documents.qa_documents(examples).select(
        "doc_id", "chunk_id", "content", "doc_type", "section", "question_id", "idx",
        F.col("metadata")["question"].alias("question"),
        F.try_element_at("metadata", F.lit("original_table_id")).alias("original_table_id"),
    )


# --- facts, metrics --------------------------------------------------------


def _claims_and_facts(spark, sf):
    """Claims: sums and averages per customer. Facts: the same, shifted by an amount
    that depends on the number of orders, under various tags."""
    totals = _read(spark, sf, "orders").groupBy("o_custkey").agg(
        F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("total"),
        F.max("o_totalprice").alias("largest"),
        F.min("o_totalprice").alias("smallest"),
        F.count(F.lit(1)).alias("n"),
    )
    shift = F.when(F.col("n") % 2 == 0, 1.0005).otherwise(1.01)
    entity = F.col("o_custkey").alias("entity")

    def claim(metric: str, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), value.alias("claimed"))

    def fact(tag: str, value: Column) -> Column:
        return F.struct(F.lit(tag).alias("tag"), value.alias("value"))

    claims = totals.select(
        entity,
        F.inline(
            F.array(
                claim("Revenue", F.col("total")),
                claim("net income", F.col("largest")),
                claim("smallest", F.col("smallest")),
                claim("total assets", F.col("total")),
            )
        ),
    )
    reported = totals.select(
        entity,
        F.inline(
            F.array(
                fact("NetRevenue", F.col("total") * shift),
                fact("SalesRevenueNet", F.col("total")),
                fact("ProfitLoss", F.col("largest") * shift),
                fact("smallest", F.col("smallest") + 0.005),
            )
        ),
    )
    return claims, reported


def facts_check(spark, sf):
    return facts.check_facts(*_claims_and_facts(spark, sf)).select(
        "entity", "metric", "claimed", F.round("fact", 8).alias("fact"), "verified", "reason",
        F.round("diff", 6).alias("diff"), F.round("diff_pct", 4).alias("diff_pct"),
    )


def facts_rollup(spark, sf):
    checked = facts.check_facts(*_claims_and_facts(spark, sf))
    return facts.facts_rollup(checked).withColumn(
        "discrepancies", F.array_join("discrepancies", ", ")
    )


def _predictions(spark, sf, rounding):
    """Order lines as predictions; gold answers come in several notations."""
    price = F.col("l_extendedprice")
    gold = (
        F.when(F.col("l_linenumber") == 1, F.concat(_text(price), F.lit("%")))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("about "), _text(price), F.lit(" dollars")))
        .when(F.col("l_linenumber") == 3, F.lit("unknown"))
        .otherwise(_text(price))
    )
    return _read(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("question_id"),
        F.when(F.col("l_returnflag") != "R", F.round(price, rounding)).alias("predicted_answer"),
        gold.alias("gold_answer"),
        (F.col("l_returnflag") != "R").alias("execution_success"),
        F.when(
            F.col("l_linestatus") == "O", F.array(F.round(price, 1), F.col("l_quantity"))
        ).alias("evidence_numbers"),
        F.array(F.col("l_quantity"), F.col("l_tax")).alias("program_numbers"),
    )


def _metrics(spark, sf, rounding):
    return metrics.evaluation_metrics(
        metrics.score_predictions(_predictions(spark, sf, rounding), CONFIG)
    )


def qa_metrics(spark, sf):
    rates = list(metrics.COMPARED)
    found = _metrics(spark, sf, 1)
    return found.select(
        *[F.round(c, 6).alias(c) if c in rates else F.col(c) for c in found.columns]
    )


def compare_report(spark, sf):
    report = metrics.compare_metrics(_metrics(spark, sf, 0), _metrics(spark, sf, 1))
    return report.select(
        "metric", "label",
        *[F.round(c, 6).alias(c) for c in ("baseline", "proposed", "absolute", "percentage")],
    )


def answer_questions(spark, sf):
    """The whole question pipeline with the deterministic stand-in model."""
    from ledgerloom.operators.models import FirstNumbersModel
    from ledgerloom.plans.qa import answer_questions as answer

    docs = _embedded(corpus(spark, sf), "content").withColumn("doc_type", F.lit("text"))
    asked = _embedded(questions(spark, sf), "query")
    return answer(asked, docs, FirstNumbersModel, CONFIG).select(
        F.col("question_id"), "answer", "program", "success", "error",
        F.size("evidence").alias("n_evidence"),
    )


QUERIES = [
    bm25_topk, bm25_indexed, index_changes, term_idf, vector_topk, text_embedding, hybrid_topk, hybrid_rerank,
    diversify_by_type, postfilter_topk, prefilter_topk, semantic_cache_lookup, cache_reuse,
    temporal_decay_rank, recent_filings, most_recent, periods_compare,
    extract_numbers, evidence_numbers, plain_numbers, numeric_claims,
    verify_answers, hallucination_rate,
    program_execute, program_verify, program_vote, program_vote_text,
    grid_markdown, grid_summary, table_markdown, table_summary, numeric_columns,
    financial_data, financial_filter, markdown_tables,
    html_tables, html_header_tables, html_to_markdown,
    sections, important_sections, chunks, qa_documents, index_order,
    facts_check, facts_rollup, qa_metrics, compare_report, answer_questions,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}
