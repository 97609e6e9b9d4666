"""Tables held as arrays of rows: Markdown, summaries, numeric columns.

`rows` is array<array<string>>. All of it is row-local, so nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.numbers import (
    float_text,
    is_numeric_cell,
    parse_cell,
    parse_float,
)
from ledgerloom.functions.text import let, strip

# A table is financial if any of these occurs in it.
FINANCIAL_KEYWORDS = [
    "revenue", "income", "expense", "assets", "liabilities",
    "equity", "cash", "earnings", "profit", "loss",
    "balance", "statement", "financial", "fiscal",
]
# Pattern of a Markdown table and its default summary.
MARKDOWN_TABLE = r"\|.+\|[\r\n]+\|[-\s|]+\|[\r\n]+(?:\|.+\|[\r\n]*)+"
DEFAULT_SUMMARY = "Financial table"
SUMMARY_VALUES = 5


def table_line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))


def rule_line(cells: Column) -> Column:
    return table_line(F.transform(cells, lambda _: F.lit("---")))


def grid_markdown(table: Column) -> Column:
    """Markdown of a raw grid whose first row is the header; cells are not padded."""
    lines = F.flatten(
        F.transform(
            table,
            lambda row, i: F.when(i == 0, F.array(table_line(row), rule_line(row))).otherwise(
                F.array(table_line(row))
            ),
        )
    )
    return F.when(F.size(table) > 0, F.array_join(lines, "\n")).otherwise(F.lit(""))


def _column_cells(rows: Column, position: Column) -> Column:
    """Cells of one column; rows that are too short are skipped."""
    long_enough = F.filter(rows, lambda r: F.size(r) > position)
    return F.transform(long_enough, lambda r: F.get(r, position))


def grid_summary(table: Column) -> Column:
    """Header names plus the first numeric values of every column."""
    headers = F.get(table, F.lit(0))
    body = F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0)))

    def column_part(header: Column, position: Column) -> Column:
        values = F.filter(
            F.transform(
                _column_cells(body, position), lambda c: parse_float(F.translate(c, ",$%", ""))
            ),
            lambda v: v.isNotNull(),
        )
        shown = F.transform(F.slice(values, 1, SUMMARY_VALUES), float_text)
        return F.when(
            F.size(shown) > 0,
            F.concat(header, F.lit(": values include "), F.array_join(shown, ", ")),
        )

    parts = F.concat(
        F.array(F.concat(F.lit("Table with columns: "), F.array_join(headers, ", "))),
        F.array_compact(F.transform(headers, column_part)),
    )
    return F.when(F.size(table) >= 2, F.array_join(parts, ". ")).otherwise(F.lit(""))


def pad_row(row: Column, width: Column) -> Column:
    """Row cut or filled with empty cells to the given width."""
    filler = F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0)))
    return F.slice(F.concat(row, filler), F.lit(1), width)


def table_markdown(headers: Column, rows: Column) -> Column:
    """Markdown with rows fitted to the header width; '' if there is nothing."""
    head = F.when(
        F.size(headers) > 0, F.array(table_line(headers), rule_line(headers))
    ).otherwise(F.array().cast("array<string>"))
    body = F.transform(rows, lambda r: table_line(pad_row(r, F.size(headers))))
    return F.array_join(F.concat(head, body), "\n")


def numeric_columns(headers: Column, rows: Column) -> Column:
    """Headers of the columns where more than half of the cells are numbers."""

    def share_ok(position: Column) -> Column:
        cells = _column_cells(rows, position)
        return F.size(F.filter(cells, is_numeric_cell)) * 2 > F.size(cells)

    marked = F.transform(headers, lambda h, i: F.when(share_ok(i), h))
    return F.array_compact(marked)


def table_summary(caption: Column, headers: Column, rows: Column) -> Column:
    numeric = F.array_join(numeric_columns(headers, rows), ", ")
    parts = F.array_compact(
        F.array(
            F.when(F.length(caption) > 0, F.concat(F.lit("Table: "), caption)),
            F.when(
                F.size(headers) > 0,
                F.concat(F.lit("Columns: "), F.array_join(headers, ", ")),
            ),
            F.when(
                F.size(rows) > 0,
                F.concat(F.size(rows).cast("string"), F.lit(" rows of data")),
            ),
            F.when(
                F.size(rows) > 0,
                let(
                    numeric, lambda n: F.when(n != "", F.concat(F.lit("Numeric columns: "), n))
                ),
            ),
        )
    )
    return let(
        parts,
        lambda p: F.when(F.size(p) > 0, F.array_join(p, ". ")).otherwise(F.lit(DEFAULT_SUMMARY)),
    )


def financial_data(headers: Column, rows: Column) -> Column:
    """array<struct<metric, values>> for every column after the first that holds
    numbers; of columns with the same name the last one counts."""

    def column_values(position: Column) -> Column:
        cells = F.transform(_column_cells(rows, position), parse_cell)
        return F.filter(cells, lambda v: v.isNotNull())

    measured = F.filter(
        F.transform(
            headers,
            lambda h, i: F.struct(
                h.alias("metric"),
                i.alias("position"),
                F.when(i > 0, column_values(i)).alias("values"),
            ),
        ),
        lambda m: (m["position"] > 0) & (F.size(m["values"]) > 0),
    )

    def last_of_each(found: Column) -> Column:
        names = F.array_distinct(F.transform(found, lambda m: m["metric"]))
        return F.transform(
            names,
            lambda n: F.struct(
                n.alias("metric"),
                F.element_at(F.filter(found, lambda m: m["metric"] == n), -1)["values"].alias(
                    "values"
                ),
            ),
        )

    return let(measured, last_of_each)


def is_financial(caption: Column, headers: Column, rows: Column) -> Column:
    """Caption, headers and the first three rows mention a financial keyword."""
    first_rows = F.flatten(F.slice(rows, 1, 3))
    searched = F.lower(
        F.concat_ws(" ", F.coalesce(caption, F.lit("")), F.array_join(headers, " "),
                    F.array_join(first_rows, " "))
    )
    return F.exists(
        F.array(*[F.lit(k) for k in FINANCIAL_KEYWORDS]), lambda k: F.contains(searched, k)
    )


def _markdown_cells(line: Column) -> Column:
    pieces = F.split(line, r"\|")
    inner = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
    return F.transform(inner, strip)


def markdown_tables(markdown: Column) -> Column:
    """Every Markdown table with at least one non-empty row, as array<struct>."""
    blocks = F.regexp_extract_all(markdown, F.lit(f"({MARKDOWN_TABLE})"), F.lit(1))

    def parse(block: Column, position: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), strip), lambda s: s != "")
        rows = F.filter(
            F.transform(
                F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))), _markdown_cells
            ),
            lambda r: F.exists(r, lambda c: c != ""),
        )
        return F.struct(
            position.cast("int").alias("table_id"),
            _markdown_cells(F.get(lines, F.lit(0))).alias("headers"),
            rows.alias("rows"),
            block.alias("markdown"),
        )

    def finish(t: Column) -> Column:
        return F.struct(
            t["table_id"].alias("table_id"),
            F.lit(None).cast("string").alias("caption"),
            t["headers"].alias("headers"),
            t["rows"].alias("rows"),
            F.size(t["rows"]).alias("num_rows"),
            F.size(t["headers"]).alias("num_cols"),
            t["markdown"].alias("markdown"),
            table_summary(F.lit(None).cast("string"), t["headers"], t["rows"]).alias("summary"),
        )

    kept = F.filter(F.transform(blocks, parse), lambda t: F.size(t["rows"]) > 0)
    return F.transform(kept, finish)
