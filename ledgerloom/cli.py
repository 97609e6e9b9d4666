"""Command line: python -m ledgerloom.cli {qa,filings,evaluate,compare} …"""

from __future__ import annotations

import argparse
import datetime as dt
import os
from functools import partial

from pyspark.sql import SparkSession, functions as F

from ledgerloom.config import EngineConfig
from ledgerloom.functions.vectors import embed_text
from ledgerloom.operators.cache import AnswerStore
from ledgerloom.operators.models import FirstNumbersModel, HostedModel
from ledgerloom.plans import filings, qa
from ledgerloom.sources.filings import company_number, download_filings, feed_entries, feed_url
from ledgerloom.sources.filings import DEFAULT_TYPES, http_get, latest_listed
from ledgerloom.sources.qa import example_by_id, load_split
from ledgerloom.sources.results import metrics_text, save_comparison, save_results


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom")
    p.add_argument("mode", choices=["qa", "filings", "evaluate", "compare"])
    p.add_argument("--query")
    p.add_argument("--question-id")
    p.add_argument("--ticker")
    p.add_argument("--data", help="folder with the question splits")
    p.add_argument("--filings", help="folder with filings by ticker and type")
    p.add_argument("--index", help="folder of the index")
    p.add_argument("--cache", help="folder of stored answers; similar questions reuse them")
    p.add_argument("--output", help="folder for results")
    p.add_argument("--split", default="validation")
    p.add_argument("--num-examples", type=int, help="only the first so many; default is all")
    p.add_argument("--build-index", action="store_true")
    p.add_argument("--download", action="store_true")
    p.add_argument("--config", help="JSON file with engine settings")
    p.add_argument("--provider", help="hosted model provider; default is an offline stand-in")
    p.add_argument("--model", default="")
    return p


def _download(spark: SparkSession, ticker: str, root: str) -> None:
    """Fetch the newest filings of one ticker and store them under root."""
    agent = os.environ.get("LEDGERLOOM_USER_AGENT", "")
    fetch = partial(http_get, user_agent=agent)
    lookup = f"https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&company={ticker}&count=1"
    page = (fetch(lookup) or b"").decode("utf-8", "ignore")
    kinds = spark.createDataFrame([(t, page) for t in DEFAULT_TYPES], "filing_type string, page string")
    wanted = kinds.select(
        F.lit(ticker).alias("ticker"), company_number(F.col("page")).alias("cik"), "filing_type"
    ).filter(F.col("cik").isNotNull())
    get = F.udf(lambda url: (fetch(url) or b"").decode("utf-8", "ignore"), "string")
    listed = wanted.withColumn("feed", get(feed_url(F.col("cik"), F.col("filing_type"))))
    entry = "feed struct<entry:array<struct<updated:string,link:array<struct<_href:string>>>>>"
    entries = listed.select(
        "ticker", "cik", "filing_type",
        F.inline(F.from_xml("feed", entry.removeprefix("feed "), {"rowTag": "feed"})["entry"]),
    )
    keyed = entries.select(F.struct("ticker", "cik", "filing_type").alias("k"), "updated", "link")
    rows = feed_entries(keyed, "k").select("k.*", "accession_number", "filing_date")
    for row in download_filings(latest_listed(rows), fetch).toLocalIterator():
        path = os.path.join(root, row.filepath)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as handle:
            handle.write(row.html)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    cfg = EngineConfig.from_json(args.config) if args.config else EngineConfig()
    spark = SparkSession.builder.appName("ledgerloom").getOrCreate()
    model = partial(HostedModel, args.provider, args.model) if args.provider else FirstNumbersModel

    if args.mode == "filings":
        if args.download:
            _download(spark, args.ticker, args.filings)
        if args.build_index:
            now = dt.datetime.now()
            filings.build_index(spark, args.filings, args.index, now, cfg, args.ticker, model)
        if args.query:
            asked = spark.createDataFrame(
                [("q", args.query, args.ticker)], "query_id string, query string, ticker string"
            )
            index = filings.read_index(spark, args.index)
            now = dt.datetime.now()
            if args.cache:
                store = AnswerStore(spark, args.cache)
                found = filings.ask_filings_cached(asked, index, model, now, store, cfg)
            else:
                found = filings.ask_filings(asked, index, model, now, cfg)
            found.show(truncate=False)
        return 0

    examples = load_split(spark, args.data, args.split)
    if args.mode == "qa":
        if not (args.query and args.question_id):
            raise SystemExit("--query and --question-id are required")
        chunks = qa.index_examples(example_by_id(examples, args.question_id), cfg)
        asked = spark.createDataFrame(
            [(args.question_id, args.query)], "query_id string, query string"
        ).withColumn("embedding", embed_text(F.col("query"), cfg.embedding_dim))
        if args.cache:
            found = qa.answer_with_cache(asked, AnswerStore(spark, args.cache), chunks, model, cfg, own_question=True)
        else:
            found = qa.answer_questions(asked, chunks, model, cfg, own_question=True)
        found.show(truncate=False)
    elif args.mode == "evaluate":
        predictions, metrics = qa.evaluate(examples, model, cfg, args.num_examples)
        if args.output:
            save_results(predictions, metrics, args.output, args.split)
        metrics_text(metrics).show(truncate=False)
    else:
        report = qa.compare(examples, model, cfg, args.num_examples)
        if args.output:
            save_comparison(report, args.output)
        report.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
