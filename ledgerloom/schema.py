"""Relations the engine exchanges, as Spark DDL."""

TABLE_ROWS = "array<array<string>>"

# Questions with their surrounding text and table. Programs are text; the loader
# also accepts a list of lines and joins it.
QA_EXAMPLE = (
    f"id string, question string, pre_text array<string>, post_text array<string>, "
    f"table {TABLE_ROWS}, answer string, program string, gold_inds map<string,string>"
)

# One retrievable unit of evidence. `ord` is the index insertion order.
CHUNK = {
    "doc_id": "string",
    "chunk_id": "string",
    "content": "string",
    "doc_type": "string",
    "source_type": "string",
    "section": "string",
    "ticker": "string",
    "filing_type": "string",
    "filing_date": "timestamp",
    "question_id": "string",
    "idx": "int",
    "metadata": "map<string,string>",
}

FILING = (
    "ticker string, cik string, filing_type string, accession_number string, "
    "filing_date string, filepath string, url string"
)

PROGRAM_STEP = "struct<operation:string,arguments:array<double>,result:double>"

FACTS = "entity string, tag string, value double"
CACHE_ENTRY = "query string, embedding array<double>, value string, ord bigint"
