"""Continuous indexing: new filing files become index batches."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.config import EngineConfig
from ledgerloom.operators.documents import filing_documents, with_index_order
from ledgerloom.operators.index import publish
from ledgerloom.sources.filings import describe_files

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def follow_filings(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of filings as files arrive under {root}/{ticker}/{type}."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema(_FILES)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(f"{root}/*/*/*.html")
    )
    return describe_files(raw)


def index_continuously(
    filings: DataFrame,
    index_root: str,
    checkpoint: str,
    fallback_date: dt.datetime,
    cfg: EngineConfig = EngineConfig(),
) -> StreamingQuery:
    """Publish every micro-batch to the index. A batch that was published already is not
    taken again, so a restart neither loses nor doubles documents."""

    def add(batch: DataFrame, number: int) -> None:
        chunks = with_index_order(filing_documents(batch, fallback_date, cfg))
        publish(chunks, index_root, f"stream-{number}", cfg)

    return (
        filings.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
