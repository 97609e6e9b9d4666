"""HTML to Markdown and to raw tables.

Reading markup is the one step Spark has no expression for. A small event
handler turns one page into Markdown text and table cells; everything after
that (clean-up, headers, summaries) is Column expressions.

Markdown subset: ATX headings, '-' bullets and numbered lists with nesting,
bold, italic, struck, code and preformatted text, links, images, rules, quotes,
line breaks, and pipe tables whose first row is the header.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, functions as F

from ledgerloom.functions.tables import table_markdown, table_summary
from ledgerloom.functions.text import clean_cell, clean_markdown

_CELL = "struct<is_header:boolean,text:string,stripped:string>"
_PAGE = f"markdown string, tables array<struct<caption:string,rows:array<array<{_CELL}>>>>"

_ARROW_CELL = pa.struct([("is_header", pa.bool_()), ("text", pa.string()), ("stripped", pa.string())])
_ARROW_TABLE = pa.struct([("caption", pa.string()), ("rows", pa.list_(pa.list_(_ARROW_CELL)))])
_ARROW_PAGE = pa.struct([("markdown", pa.string()), ("tables", pa.list_(_ARROW_TABLE))])
SLICE_CHARS = 1_000_000  # markup whose parts are held as objects at a time

_VOID = {"area", "base", "br", "col", "hr", "img", "input", "link", "meta", "wbr"}
_SKIPPED = {"script", "style"}
_BLOCKS = {"p", "div", "section", "article", "table", "dl", "figure", "form"}
_INLINE = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "del": "~~", "s": "~~"}


class _Node:
    def __init__(self, tag, attrs):
        self.tag, self.attrs, self.parts, self.number = tag, dict(attrs), [], 0


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Node("", [])]
        self.roots = {}
        self.tables = []
        self.live_tables, self.live_rows, self.live_cells = [], [], []
        self.caption = None

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.open[-1].parts.append("  \n")
        elif tag == "hr":
            self.open[-1].parts.append("\n\n---\n\n")
        elif tag == "img":
            a = dict(attrs)
            self.open[-1].parts.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag not in _VOID:
            node = _Node(tag, attrs)
            self.open.append(node)
            if tag == "table":
                self.live_tables.append({"caption": None, "rows": []})
                self.tables.append(self.live_tables[-1])
                node.rows = []
            elif tag == "tr":
                node.cells, node.record = [], []
                self.live_rows.append(node.record)
                for table in self.live_tables:
                    table["rows"].append(node.record)
            elif tag in ("td", "th"):
                node.record = {"is_header": tag == "th", "pieces": []}
                self.live_cells.append(node.record)
                for row in self.live_rows:
                    row.append(node.record)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open[1:]):
            while self._close().tag != tag:
                pass

    def handle_data(self, data):
        if self.open[-1].tag in _SKIPPED:
            return
        for cell in self.live_cells:
            cell["pieces"].append(data)
        if any(n.tag == "pre" for n in self.open):
            self.open[-1].parts.append(data)
        else:
            self.open[-1].parts.append(re.sub(r"[\t \r\n]+", " ", data))
        if self.live_tables and any(n.tag == "caption" for n in self.open):
            table = self.live_tables[-1]
            table["caption"] = (table["caption"] or "") + data.strip()

    def _close(self):
        node = self.open.pop()
        parent = self.open[-1]
        text = "".join(node.parts)
        if node.tag == "table":
            self.live_tables.pop()
        elif node.tag == "tr":
            self.live_rows.pop()
        elif node.tag in ("td", "th"):
            self.live_cells.pop()
        if node.tag in ("body", "document"):
            self.roots.setdefault(node.tag, text)
        if node.tag not in _SKIPPED:
            parent.parts.append(self._markdown(node, text))
        return node

    def _ancestor(self, *tags):
        return next((n for n in reversed(self.open) if n.tag in tags), None)

    def _markdown(self, node, text):
        tag, flat = node.tag, text.strip()
        if tag in _INLINE or tag == "a":
            if not flat:
                return ""
            if tag == "a":
                href = node.attrs.get("href")
                marked = f"[{flat}]({href})" if href else flat
            else:
                marked = _INLINE[tag] + flat + _INLINE[tag]
            return " " * text[:1].isspace() + marked + " " * text[-1:].isspace()
        if re.fullmatch(r"h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {' '.join(flat.split())}\n\n" if flat else ""
        if tag == "li":
            owner = self._ancestor("ul", "ol")
            owner and setattr(owner, "number", owner.number + 1)
            bullet = f"{owner.number}." if owner and owner.tag == "ol" else "-"
            pad = "\n" + " " * (len(bullet) + 1)
            return f"{bullet} {flat}".replace("\n", pad).replace(pad + "\n", "\n\n") + "\n"
        if tag in ("ul", "ol"):
            return f"\n{flat}" if self._ancestor("li") else f"\n\n{flat}\n\n"
        if tag in ("td", "th"):
            row = self._ancestor("tr")
            if row is not None:
                row.cells.append(" ".join(flat.split()))
                return ""
        if tag == "tr":
            table = self._ancestor("table")
            if table is not None:
                node.cells and table.rows.append(node.cells)
                return ""
        if tag == "table" and node.rows:
            lines = [f"| {' | '.join(cells)} |" for cells in node.rows]
            lines.insert(1, f"| {' | '.join(['---'] * len(node.rows[0]))} |")
            return "\n\n" + (flat + "\n\n" if flat else "") + "\n".join(lines) + "\n\n"
        if tag == "pre":
            return f"\n\n```\n{text}\n```\n\n"
        if tag == "blockquote":
            return "\n\n" + re.sub(r"(?m)^", "> ", flat) + "\n\n"
        return f"\n\n{flat}\n\n" if tag in _BLOCKS and flat else text

    def finish(self):
        self.close()
        while len(self.open) > 1:
            self._close()
        whole = "".join(self.open[0].parts)
        markdown = self.roots.get("document", self.roots.get("body", whole))
        return {"markdown": markdown, "tables": [self._record(t) for t in self.tables]}

    @staticmethod
    def _record(table):
        rows = [
            [
                {
                    "is_header": cell["is_header"],
                    "text": "".join(cell["pieces"]),
                    "stripped": "".join(p.strip() for p in cell["pieces"]),
                }
                for cell in row
            ]
            for row in table["rows"]
        ]
        return {"caption": table["caption"], "rows": rows}


def _read(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    return page.finish()


def _in_slices(pages: Iterable[pa.Array]) -> Iterator[pa.Array]:
    """What is read from batches of pages, handed on whenever SLICE_CHARS of markup are read:
    the cells of a page take many times the memory of its markup while they are objects."""
    for batch in pages:
        rows, size = [], 0
        for html in batch:
            html = html.as_py()
            rows.append(_read(html))
            size += len(html or "")
            if size >= SLICE_CHARS:
                yield pa.array(rows, _ARROW_PAGE)
                rows, size = [], 0
        if rows:
            yield pa.array(rows, _ARROW_PAGE)


def page_parts(html: Column) -> Column:
    """struct<markdown, tables> as read from the markup, before clean-up."""

    @F.arrow_udf(_PAGE)
    def read_pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _in_slices(batches)

    return read_pages(html.cast("string"))


def page_markdown(parts: Column) -> Column:
    return clean_markdown(parts["markdown"])


def _describe(tables: Column) -> Column:
    """Complete table structs from struct<table_id, caption, headers, rows>."""
    return F.transform(
        tables,
        lambda t: F.struct(
            t["table_id"].alias("table_id"),
            t["caption"].alias("caption"),
            t["headers"].alias("headers"),
            t["rows"].alias("rows"),
            F.size(t["rows"]).alias("num_rows"),
            F.when(F.size(t["headers"]) > 0, F.size(t["headers"]))
            .otherwise(F.coalesce(F.size(F.get(t["rows"], F.lit(0))), F.lit(0)))
            .alias("num_cols"),
            table_markdown(t["headers"], t["rows"]).alias("markdown"),
            table_summary(t["caption"], t["headers"], t["rows"]).alias("summary"),
        ),
    )


def _rest(rows: Column, start: int) -> Column:
    return F.slice(rows, start, F.greatest(F.size(rows) - (start - 1), F.lit(0)))


def first_row_tables(parts: Column) -> Column:
    """Every table with its first row as header, nested tables included."""

    def shape(t: Column, i: Column) -> Column:
        rows = F.transform(
            t["rows"], lambda r: F.transform(r, lambda c: c["stripped"])
        )
        return F.struct(
            i.cast("int").alias("table_id"),
            t["caption"].alias("caption"),
            F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>")).alias("headers"),
            F.filter(_rest(rows, 2), lambda r: F.size(r) > 0).alias("rows"),
        )

    return _describe(F.transform(parts["tables"], shape))


def header_cell_tables(parts: Column) -> Column:
    """Tables whose first row is a header only if it has header cells; otherwise the
    first row with cells is promoted. Tables without data rows are left out."""

    def shape(t: Column, i: Column) -> Column:
        top = F.get(t["rows"], F.lit(0))
        marked = F.filter(top, lambda c: c["is_header"])
        has_marked = F.coalesce(F.size(marked), F.lit(0)) > 0
        named = F.transform(marked, lambda c: clean_cell(c["text"]))
        body = F.filter(
            F.transform(
                F.when(has_marked, _rest(t["rows"], 2)).otherwise(t["rows"]),
                lambda r: F.transform(r, lambda c: clean_cell(c["text"])),
            ),
            lambda r: F.size(r) > 0,
        )
        return F.struct(
            i.cast("int").alias("table_id"),
            t["caption"].alias("caption"),
            F.when(has_marked, named)
            .otherwise(F.coalesce(F.get(body, F.lit(0)), F.array().cast("array<string>")))
            .alias("headers"),
            F.when(has_marked, body).otherwise(_rest(body, 2)).alias("rows"),
        )

    kept = F.filter(F.transform(parts["tables"], shape), lambda t: F.size(t["rows"]) > 0)
    return _describe(kept)
