"""Turn question sets and filings into retrievable chunks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions.dates import filing_date_or
from ledgerloom.functions.html import first_row_tables, page_markdown, page_parts
from ledgerloom.functions.sections import (
    chunk_bounds,
    filing_sections,
    important_sections,
    longest_of_each,
)
from ledgerloom.functions.tables import grid_markdown, grid_summary
from ledgerloom.functions.text import strip, words
from ledgerloom.operators.ordering import with_positions
from ledgerloom.schema import CHUNK

QA_SOURCE, FILING_SOURCE = "qa", "filing"
TEXT, TABLE, TABLE_SUMMARY = "text", "table", "table_summary"


def _as_chunks(rows: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Fill the chunk schema; columns the rows lack are NULL."""
    return rows.select(
        *[
            (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in CHUNK.items()
        ],
        *more,
    )


def with_index_order(chunks: DataFrame, *keys: str) -> DataFrame:
    """Give every chunk its place in the index (`ord`) and its `doc_key`.

    Chunks are range-partitioned by the keys and numbered per partition: numbers
    are unique and grow with the keys, without gathering the rows anywhere.
    """
    order = list(keys) or ["doc_id", "chunk_id"]
    return (
        chunks.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("ord", F.monotonically_increasing_id())
        .withColumn("doc_key", F.concat_ws("_", "doc_id", "chunk_id"))
    )


def qa_documents(
    examples: DataFrame, with_summary: bool = True, keep_blank: bool = False, ordered: bool = False
) -> DataFrame:
    """Text, table and table-summary chunks of question examples. Row-local. `ordered` adds
    the example's place and the chunk's place within it: texts before, after, table, summary."""
    none = F.lit(None).cast("string")

    def entry(suffix: Column, content: Column, kind: str, section: str, idx: Column, **meta):
        pairs = [("question", F.col("question")), *meta.items()]
        return F.struct(
            F.concat("id", suffix).alias("doc_id"),
            content.alias("content"),
            F.lit(kind).alias("doc_type"),
            F.lit(section).alias("section"),
            idx.cast("int").alias("idx"),
            F.map_from_arrays(
                F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs])
            ).alias("metadata"),
        )

    def texts(column: str, short: str) -> Column:
        numbered = F.transform(
            F.coalesce(column, F.array().cast("array<string>")),
            lambda t, i: entry(
                F.concat(F.lit(f"_{short}_"), i.cast("string")), t, TEXT, column, i
            ),
        )
        return numbered if keep_blank else F.filter(numbered, lambda e: strip(e["content"]) != "")

    no_index = F.lit(None)
    table = [entry(F.lit("_table"), grid_markdown(F.col("table")), TABLE, "table", no_index)]
    if with_summary:
        table.append(
            entry(
                F.lit("_table_summary"),
                grid_summary(F.col("table")),
                TABLE_SUMMARY,
                "table_summary",
                no_index,
                original_table_id=F.concat("id", F.lit("_table")),
            )
        )
    listed = F.concat(
        texts("pre_text", "pre"),
        texts("post_text", "post"),
        F.when(F.size("table") > 0, F.array(*table)).otherwise(F.slice(F.array(*table), 1, 0)),
    )
    place = F.col("place") if "place" in examples.columns else F.lit(0)
    rows = examples.select(
        F.col("id").alias("question_id"), place.cast("long").alias("place"), F.posexplode(listed).alias("within", "e")
    ).select(
        "question_id",
        "place",
        "within",
        "e.*",
        F.lit("chunk_0").alias("chunk_id"),
        F.lit(QA_SOURCE).alias("source_type"),
        none.alias("ticker"),
    )
    return _as_chunks(rows, ["place", "within"] if ordered else [])


def in_insertion_order(chunks: DataFrame) -> DataFrame:
    """Chunks of `qa_documents(ordered=True)` with doc_key and `ord`, their dense place in
    the order of examples and of chunks within them."""
    placed = with_positions(chunks, "place", "question_id", "within")
    return placed.drop("place", "within").withColumn("doc_key", F.concat_ws("_", "doc_id", "chunk_id"))


def split_sections(
    texts: DataFrame, important_only: bool = False, widen: bool = False, longest: bool = False
) -> DataFrame:
    """One row per section of (…, content, filing_type); content becomes the section's."""
    found = filing_sections(F.col("content"), F.col("filing_type"), widen, keep_all=longest)
    if longest:
        found = longest_of_each(found)
    if important_only:
        found = important_sections(found)
    rest = [c for c in texts.columns if c != "content"]
    return texts.select(*rest, F.inline(found))


def split_chunks(
    sections: DataFrame, size: int, overlap: int, paragraph_break: str = "\n\n"
) -> DataFrame:
    """One row per chunk of (…, section, content): chunk_id, content, word_count."""
    rest = [c for c in sections.columns if c not in ("content",)]
    paragraph_words = F.transform(
        F.split("content", paragraph_break), lambda p: F.size(words(p))
    )
    ranged = sections.select(
        *rest,
        words(F.col("content")).alias("all_words"),
        F.posexplode(chunk_bounds(paragraph_words, size, overlap)).alias("chunk_no", "range"),
    )
    return ranged.select(
        *rest,
        F.col("chunk_no").alias("chunk_id"),
        F.array_join(
            F.slice(
                "all_words", F.col("range.first") + 1, F.col("range.past") - F.col("range.first")
            ),
            " ",
        ).alias("content"),
        (F.col("range.past") - F.col("range.first")).alias("word_count"),
    )


def filing_parts(filings: DataFrame, fallback_date: dt.datetime) -> DataFrame:
    """Filings with parsed date, Markdown and tables; `html` is text."""
    return (
        filings.withColumn("parts", page_parts(F.col("html")))
        .withColumn("markdown", page_markdown(F.col("parts")))
        .withColumn("tables", first_row_tables(F.col("parts")))
        .withColumn("filing_date", filing_date_or(F.col("filing_date"), F.lit(fallback_date)))
        .drop("html", "parts")
    )


def filing_documents(
    filings: DataFrame,
    fallback_date: dt.datetime,
    cfg: EngineConfig = EngineConfig(),
    summarise=None,
) -> DataFrame:
    """Chunks of section text, tables and table summaries of filings.

    filings: (ticker, cik, filing_type, accession_number, filing_date, html).
    `summarise` maps a DataFrame with (markdown, summary, num_rows) to the same with
    a better summary for large tables; by default the built summary is kept.
    """
    parts = filing_parts(filings, fallback_date)
    ids = ["ticker", "cik", "filing_type", "filing_date", "accession_number"]
    kept_ids = [F.col(c) if c in parts.columns else F.lit("").alias(c) for c in ids]
    base = parts.select(*kept_ids, "markdown", "tables")
    accession = F.col("accession_number")

    sections = split_sections(
        base.drop("tables").withColumnRenamed("markdown", "content"), important_only=True
    )
    text = split_chunks(sections, cfg.chunk_size, cfg.chunk_overlap).select(
        *ids,
        "section",
        "content",
        F.concat_ws("_", accession, "section").alias("doc_id"),
        F.concat(F.lit("chunk_"), F.col("chunk_id")).alias("chunk_id"),
        F.lit(TEXT).alias("doc_type"),
        F.col("chunk_id").alias("idx"),
        F.create_map(F.lit("word_count"), F.col("word_count").cast("string")).alias("metadata"),
    )
    # the outer form keeps a size filter, and with it a second parse, off the scan
    tables = base.select(*ids, F.inline_outer("tables")).filter(F.col("table_id").isNotNull())
    table_id = F.concat_ws("_", accession, F.lit("table"), "table_id")
    table_chunks = tables.select(
        *ids,
        F.lit("table").alias("section"),
        F.col("markdown").alias("content"),
        table_id.alias("doc_id"),
        F.lit("chunk_0").alias("chunk_id"),
        F.lit(TABLE).alias("doc_type"),
        F.col("table_id").alias("idx"),
        F.map_from_arrays(
            F.array(F.lit("num_rows"), F.lit("num_cols"), F.lit("caption")),
            F.array(
                F.col("num_rows").cast("string"), F.col("num_cols").cast("string"), F.col("caption")
            ),
        ).alias("metadata"),
    )
    result = text.unionByName(table_chunks)
    if cfg.table_summary_enabled:
        described = summarise(tables) if summarise else tables
        result = result.unionByName(
            described.select(
                *ids,
                F.lit("table_summary").alias("section"),
                F.col("summary").alias("content"),
                F.concat_ws("_", table_id, F.lit("summary")).alias("doc_id"),
                F.lit("chunk_0").alias("chunk_id"),
                F.lit(TABLE_SUMMARY).alias("doc_type"),
                F.col("table_id").alias("idx"),
                F.create_map(F.lit("original_table_doc_id"), table_id).alias("metadata"),
            )
        )
    return _as_chunks(
        result.withColumn(
            "metadata",
            F.map_concat(
                "metadata", F.create_map(F.lit("accession_number"), F.col("accession_number"))
            ),
        ).withColumn("source_type", F.lit(FILING_SOURCE))
    )


def expand_summaries(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add to every table summary among the results the table it describes."""
    owner = F.coalesce(
        F.try_element_at("metadata", F.lit("original_table_id")),
        F.try_element_at("metadata", F.lit("original_table_doc_id")),
    )
    tables = chunks.filter(F.col("doc_type") == TABLE).select(
        F.col("doc_id").alias("owner"), F.col("content").alias("table_content")
    )
    return results.withColumn("owner", owner).join(tables, "owner", "left").drop("owner")
