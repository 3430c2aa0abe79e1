"""Incremental indexing of a stream of page snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import Selectors, extract_pages
from ..operators.crawl import index_batch
from ..operators.store import ChunkStore

SNAPSHOT = "url string, html string, fetched_at timestamp"


def snapshots(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", max_files).parquet(folder)


def newest(batch: DataFrame) -> DataFrame:
    """The last snapshot of each URL of a batch."""
    return batch.groupBy("url").agg(F.max(F.struct("fetched_at", "html")).alias("x")).select("url", "x.html", "x.fetched_at")


def index_stream(stream: DataFrame, store: ChunkStore, provider, checkpoint: str, selectors: Selectors | None = None, mode: str = "Markdown", trigger=None):
    """Each micro-batch goes through the batch path: extract, skip what is unchanged, embed, replace. Running a batch again changes nothing."""

    def run(batch: DataFrame, _epoch: int) -> None:
        rows = newest(batch)
        last = rows.agg(F.max("fetched_at")).first()[0]
        if last is not None:
            index_batch(extract_pages(rows.select("url", "html"), selectors, mode), store, provider, last)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(run).start()
