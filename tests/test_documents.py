import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions import html as H
from ledgerloom.functions import tables as T
from ledgerloom.operators import documents as D

PAGE = """<html><head><title>hidden</title></head><body><script>if (a < b) { put("</p>"); }</script>
<h1>Harbour <i>dues</i></h1><ol><li>ships<ul><li>sail</li></ul></li><li>barges</ol>
<p>See&nbsp;the <a href='/tariff'>tariff</a> of the port</p>
<table><caption>Dues by quay</caption>
<tr><th>Quay</th><th>Berths</th><th>Depth (m)</th><th>Dues</th><th>Open to</th></tr>
<tr><td>North</td><td>14</td><td>9.5</td><td>1,250</td><td>ships</td></tr>
<tr><td>Old</td><td>6</td><td>n/a</td><td>(310)</td><td>barges</td></tr>
<tr><td>East</td><td>22</td><td>11</td><td>2,075</td></tr>
<tr><td>Fish</td><td>3</td><td>4</td><td>90</td><td>boats</td></tr></table></body></html>"""


def report(*sections):
    """A filing of (heading, number of words) sections."""
    return "\n\n".join(f"{head}\n\n{' '.join(f'word{k}' for k in range(n))}." for head, n in sections)


def test_table_of_a_page(one):
    parts = H.page_parts(F.col("t"))
    first, marked = one(H.first_row_tables(parts), H.header_cell_tables(parts), t=PAGE)
    assert len(first) == len(marked) == 1
    table = marked[0]
    assert table.headers == ["Quay", "Berths", "Depth (m)", "Dues", "Open to"]
    assert table.rows[1] == ["Old", "6", "n/a", "(310)", "barges"] and table.rows[2][:4] == ["East", "22", "11", "2,075"]
    assert (table.num_rows, table.num_cols) == (4, 5)
    assert table.summary.startswith("Table: Dues by quay. Columns: Quay, Berths, Depth (m), Dues, Open to. 4 rows of data.")
    assert table.summary.endswith("Numeric columns: Berths, Depth (m), Dues")
    assert first[0].headers == table.headers


def test_markdown_of_a_page(one):
    text = one(H.page_markdown(H.page_parts(F.col("t"))), t=PAGE)
    assert text.startswith("# Harbour *dues*\n\n1. ships\n")
    assert "- sail" in text and "2. barges" in text
    assert "See the [tariff](/tariff) of the port" in text
    assert "| Quay | Berths | Depth (m) | Dues | Open to |\n| --- | --- | --- | --- | --- |\n| North | 14 |" in text
    assert "put(" not in text and "hidden" not in text


def test_nested_and_unclosed_tables(one):
    page = "<table><tr><td>a<table><tr><td>x<tr><td>y</table></td></tr><tr><td>b</td></tr></table>"
    tables = one(H.first_row_tables(H.page_parts(F.col("t"))), t=page)
    assert len(tables) == 2
    assert tables[0].headers[0] == "axy" and tables[1].headers[0] == "xy"
    assert ["b"] in tables[0].rows


def test_deeply_unclosed_markup_is_read(one):
    page = "<body>" + "<p><b>x" * 3000
    assert one(H.page_markdown(H.page_parts(F.col("t"))), t=page).count("x") == 3000


def test_table_without_header_cells_promotes_a_row(one):
    page = "<table><tr></tr><tr><td>Year</td><td>Profit</td></tr><tr><td>2022</td></tr></table>"
    found = one(H.header_cell_tables(H.page_parts(F.col("t"))), t=page)[0]
    assert found.headers == ["Year", "Profit"] and found.rows == [["2022"]]
    assert found.markdown.endswith("| 2022 |  |")


def test_short_and_missed_headings(spark):
    """A heading with a full stop is missed, so its text stays with the section before; a
    section of at most 100 characters goes; headings count in any case of letters."""
    text = report(("Item 3 Markets", 60), ("ITEM 4. Controls", 30), ("item 6 Exhibits", 5), ("Item 5 Other", 150))
    filing = spark.createDataFrame([(text, "10-Q")], "content string, filing_type string")
    found = D.split_sections(filing).collect()
    assert [r.section for r in found] == [
        "Item 3 - Quantitative and Qualitative Disclosures", "Item 5 - Other Information",
    ]
    assert "ITEM 4. Controls" in found[0].content and "Exhibits" not in found[0].content
    assert found[1].content.startswith("Item 5 Other") and found[1].content.endswith("word149.")
    whole = D.split_chunks(D.split_sections(filing), 1000, 10).collect()
    assert [(c.section[:6], c.chunk_id, c.word_count) for c in whole] == [("Item 3", 0, 96), ("Item 5", 0, 153)]


def test_sections_options(spark):
    long = "word " * 40
    text = f"ITEM 8. {long} ITEM 7. first {long} {long} ITEM 7. again {long}"
    rows = spark.createDataFrame([(text, "10-k/a")], "content string, filing_type string")
    last = {r.section: r.content for r in D.split_sections(rows).collect()}
    assert list(last) == ["Item 7 - Management's Discussion and Analysis"]
    assert last["Item 7 - Management's Discussion and Analysis"].startswith("ITEM 7. again")
    wide = {r.section: r.content for r in D.split_sections(rows, widen=True, longest=True).collect()}
    assert "Item 8 - Financial Statements" in wide
    assert wide["Item 7 - Management's Discussion and Analysis"].startswith("ITEM 7. first")
    other = rows.withColumn("filing_type", F.lit("8-K"))
    assert [r.section for r in D.split_sections(other).collect()] == ["full_document"]


def _greedy(paragraphs, size, overlap):
    chunks, cur = [], []
    for words in paragraphs:
        if len(cur) + len(words) > size and cur:
            chunks.append(cur)
            cur = (cur[-overlap:] if overlap else []) + words
        else:
            cur = cur + words
    return chunks + ([cur] if cur else [])


@pytest.mark.parametrize("size, overlap", [(10, 3), (10, 0), (3, 5), (100, 10)])
def test_chunks_against_plain_packing(spark, size, overlap):
    texts = [
        "\n\n".join(" ".join(f"w{i}{j}{k}" for k in range((i * 7 + j * 5) % 13)) for j in range(i))
        for i in range(12)
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = D.split_chunks(rows.withColumn("section", F.lit("s")), size, overlap).collect()
    for i, text in enumerate(texts):
        expected = _greedy([p.split() for p in text.split("\n\n")], size, overlap)
        mine = sorted((r.chunk_id, r.content, r.word_count) for r in got if r.i == i)
        assert mine == [(n, " ".join(c), len(c)) for n, c in enumerate(expected)]


GRID = [["Item", "2023", "2023"], ["Wheat", "$1,000", "n/a"], ["Cash", "(5)%"], ["x", "12345678", "7"]]


def test_grid_summary_and_markdown(spark):
    row = spark.createDataFrame([(GRID,), ([["a"]],), ([],)], "g array<array<string>>")
    made = row.select(T.grid_summary(F.col("g")), T.grid_markdown(F.col("g"))).collect()
    assert made[0][0] == (
        "Table with columns: Item, 2023, 2023. 2023: values include 1000.0, 12345678.0. "
        "2023: values include 7.0"
    )
    assert made[0][1].splitlines()[:2] == ["| Item | 2023 | 2023 |", "| --- | --- | --- |"]
    assert [tuple(r) for r in made[1:]] == [("", "| a |\n| --- |"), ("", "")]


def test_financial_data_last_column_of_a_name_counts(spark):
    row = spark.createDataFrame([(GRID[0], GRID[1:])], "h array<string>, r array<array<string>>")
    data = row.select(T.financial_data(F.col("h"), F.col("r"))).first()[0]
    assert [(d.metric, d["values"]) for d in data] == [("2023", [7.0])]


def test_markdown_tables(one):
    text = "x\n| Year | Profit |\n|---|---|\n| 2022 | $20M |\n|  |  |\n\ny\n| a |\n|:--|\n| 1 |\n"
    found = one(T.markdown_tables(F.col("t")), t=text)
    assert len(found) == 1
    assert found[0].headers == ["Year", "Profit"] and found[0].rows == [["2022", "$20M"]]


EXAMPLE = ("q1", "what?", ["a", " "], ["b"], [["h", "v"], ["r", "5"]], "5")
QA = "id string, question string, pre_text array<string>, post_text array<string>, table array<array<string>>, answer string"


def test_qa_documents(spark):
    rows = spark.createDataFrame([EXAMPLE, ("q2", "", [], ["c"], [], "")], QA)
    found = {r.doc_id: r for r in D.qa_documents(rows).collect()}
    assert sorted(found) == ["q1_post_0", "q1_pre_0", "q1_table", "q1_table_summary", "q2_post_0"]
    assert found["q1_table_summary"].metadata["original_table_id"] == "q1_table"
    assert found["q1_pre_0"].idx == 0 and found["q1_table"].doc_type == "table"
    loader = D.qa_documents(rows, with_summary=False, keep_blank=True)
    assert "q1_pre_1" in {r.doc_id for r in loader.collect()}


def test_filing_documents_and_expansion(spark):
    filing = [("AAPL", "1", "10-K", "0001-23", "2023-05-01", PAGE), ("X", "2", "8-K", "0002-23", "bad", "<p>only text</p>")]
    rows = spark.createDataFrame(filing, "ticker string, cik string, filing_type string, accession_number string, filing_date string, html string")
    chunks = D.filing_documents(rows, dt.datetime(2024, 1, 1))
    found = {r.doc_id: r for r in chunks.collect()}
    assert sorted(found) == [
        "0001-23_full_document", "0001-23_table_0", "0001-23_table_0_summary", "0002-23_full_document",
    ]
    assert found["0002-23_full_document"].filing_date == dt.datetime(2024, 1, 1)
    assert found["0001-23_table_0"].metadata["num_rows"] == "4"
    none = D.filing_documents(rows, dt.datetime(2024, 1, 1), EngineConfig(table_summary_enabled=False))
    assert none.filter("doc_type = 'table_summary'").isEmpty()
    summaries = chunks.filter("doc_type = 'table_summary'")
    assert D.expand_summaries(summaries, chunks).first().table_content.startswith("| Quay |")


def test_index_order_is_unique_and_follows_the_keys(spark):
    rows = spark.range(500).select(F.format_string("d%05d", "id").alias("doc_id"), F.lit("chunk_0").alias("chunk_id"))
    ordered = D.with_index_order(rows, "doc_id").orderBy("doc_id").collect()
    places = [r.ord for r in ordered]
    assert places == sorted(set(places)) and ordered[0].doc_key == "d00000_chunk_0"


def test_pages_are_handed_on_in_slices(monkeypatch):
    """A batch of pages is not held as objects at once; nothing is lost between slices."""
    import pyarrow as pa

    pages = [f"<p>{k}</p><table><tr><td>{k}</td></tr></table>" for k in range(40)] + [None, ""]
    monkeypatch.setattr(H, "SLICE_CHARS", 5 * len(pages[0]))
    made = list(H._in_slices([pa.array(pages), pa.array([], pa.string())]))
    assert len(made) == 8 + 1 and max(map(len, made)) == 5
    assert [r for x in made for r in x.to_pylist()] == [H._read(p) for p in pages]
