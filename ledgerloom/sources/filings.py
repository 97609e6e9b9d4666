"""Filings: local files laid out as {root}/{ticker}/{type}/{accession}_{date}.html,
and the feed that lists them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.functions.text import decode_bytes
from ledgerloom.schema import FILING

# The public filing service's addresses and limits.
ARCHIVE = "https://www.sec.gov/Archives/edgar/data"
BROWSE = "https://www.sec.gov/cgi-bin/browse-edgar"
DEFAULT_TYPES = ("10-K", "10-Q")
MAX_PER_TYPE, PAUSE_SECONDS, TIMEOUT_SECONDS = 5, 0.1, 30

_ENTRY = "id string, updated string, link array<struct<_href:string,_rel:string>>"


def _path_part(from_end: int) -> Column:
    return F.element_at(F.split(F.col("filepath"), "/"), -from_end)


def local_filings(spark: SparkSession, root: str, ticker: str | None = None) -> DataFrame:
    """Catalog of filing files with their HTML. A ticker limits the directories read;
    file content is only loaded if `html` is used."""
    raw = spark.read.format("binaryFile").load(f"{root}/{ticker or '*'}/*/*.html")
    return describe_files(raw)


def describe_files(raw: DataFrame) -> DataFrame:
    """Filing columns of a binaryFile relation, batch or streaming."""
    stem = F.regexp_replace(_path_part(1), r"\.html$", "")
    return raw.select(F.col("path").alias("filepath"), "content").select(
        F.url_decode(_path_part(3)).alias("ticker"),
        F.url_decode(_path_part(2)).alias("filing_type"),
        F.get(F.split(stem, "_"), F.lit(0)).alias("accession_number"),
        F.get(F.split(stem, "_"), F.lit(1)).alias("filing_date"),
        "filepath",
        decode_bytes(F.col("content")).alias("html"),
    )


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(accession_number, filing_date) of the entries of Atom feed files."""
    entries = (
        spark.read.format("xml").schema(_ENTRY).option("rowTag", "entry")
        .option("mode", "DROPMALFORMED").load(path)
    )
    return feed_entries(entries)


def feed_entries(entries: DataFrame, *keep: str) -> DataFrame:
    """The first long link part with a hyphen is the accession number; entries
    without it or without a date are dropped."""
    parts = F.split(F.get(F.col("link"), F.lit(0))["_href"], "/")
    accession = F.get(
        F.filter(parts, lambda p: F.contains(p, F.lit("-")) & (F.length(p) > 10)), F.lit(0)
    )
    return entries.select(
        *keep,
        accession.alias("accession_number"),
        F.split_part("updated", F.lit("T"), F.lit(1)).alias("filing_date"),
    ).filter(F.col("accession_number").isNotNull() & (F.col("filing_date") != ""))


def company_number(page: Column) -> Column:
    """Registry number in a company page, without leading zeros; NULL if absent."""
    found = F.regexp_extract(page, r"CIK=(\d+)", 1)
    return F.when(found != "", F.ltrim(found, F.lit("0")))


def feed_url(cik: Column, filing_type: Column, count: int = MAX_PER_TYPE) -> Column:
    return F.concat(
        F.lit(f"{BROWSE}?action=getcompany&CIK="), cik, F.lit("&type="), filing_type,
        F.lit(f"&count={count}&output=atom"),
    )


def filing_urls(cik: Column, accession: Column) -> Column:
    """Addresses to try in order: the index page, then the full text."""
    base = F.concat_ws(
        "/", F.lit(ARCHIVE), cik, F.replace(accession, F.lit("-"), F.lit("")), accession
    )
    return F.array(F.concat(base, F.lit("-index.html")), F.concat(base, F.lit(".txt")))


def http_get(url: str, user_agent: str) -> bytes | None:
    """Body of a page, or None if it cannot be had."""
    import urllib.request

    request = urllib.request.Request(url, headers={"User-Agent": user_agent})
    try:
        with urllib.request.urlopen(request, timeout=TIMEOUT_SECONDS) as reply:
            return reply.read()
    except OSError:
        return None


def download_filings(
    listed: DataFrame, fetch: Callable[[str], bytes | None], pause: float = PAUSE_SECONDS
) -> DataFrame:
    """Fetch listed filings in tasks: (ticker, cik, filing_type, accession_number,
    filing_date, filepath, url, html). Filings that cannot be fetched are left out.

    Spark spreads the list; the number of partitions bounds concurrent requests.
    """
    columns = ["ticker", "cik", "filing_type", "accession_number", "filing_date"]
    wanted = listed.select(*columns, filing_urls(F.col("cik"), F.col("accession_number")).alias("urls"))

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                time.sleep(pause)
                for url in row.urls:
                    body = fetch(url)
                    if body is not None:
                        path = f"{row.ticker}/{row.filing_type}/{row.accession_number}_{row.filing_date}.html"
                        rows.append((*row[:5], path, url, body.decode("utf-8", "ignore")))
                        break
            yield pd.DataFrame(rows, columns=[*columns, "filepath", "url", "html"])

    return wanted.mapInPandas(get, f"{FILING}, html string")


def latest_listed(listed: DataFrame, per_type: int = MAX_PER_TYPE) -> DataFrame:
    """The newest filings per ticker and type of a list of many tickers."""
    newest = Window.partitionBy("ticker", "filing_type").orderBy(
        F.col("filing_date").desc(), "accession_number"
    )
    return (
        listed.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= per_type).drop("n")
    )
