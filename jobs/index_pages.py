"""Keeps a chunk index up to date with a folder that page snapshots arrive in.

    python -m jobs.index_pages --config jobs/index_pages.json --input s3a://crawl/pages --output s3a://index --checkpoint s3a://index-mark

Input: a folder of Parquet files (or a pattern: the stream takes no path of a single file) of page_id, url, html. Of the pages of one URL that with the largest page_id counts, in whatever order they come. A run takes
the files that no earlier run has taken (the stream's checkpoint knows them), extracts their pages, and skips those that say what the
index has already. Files of one micro-batch make one `batch` partition of

    output/pages    url, page_id, title, page_hash, content_hash, chunks_batch, sections, body_text: a row for each page seen; of an
                    unchanged one without its text, and with the batch that holds its chunks
    output/chunks   point_id, url, title, heading, chunk_index, chunk_text, content_hash: the chunks of new and changed pages
    output/rejected page_id, url, reason: rows without a URL or without an id
    output/runs     JSON: what the batch read, skipped and wrote
    output/known    url, page_id, page_hash, chunks_batch: every `snapshot_every` batches, what is known of each URL by then, so that
                    a batch looks up the pages it brings in one such partition and in the batches since, however long the index has been kept

and `current_chunks` reads the index as it stands. A batch that is run again looks at the batches before it only and replaces its own
partitions, so it writes the same rows; a run without new files writes nothing. Null html is an empty page, and a page that has lost
its text has no chunks any more. Readers should wait for the end of a run.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.functions.hashing import content_hash, point_id
from pagelode.functions.html import Selectors, extract_pages
from pagelode.operators.chunking import chunk_pages

from .command import main

log = logging.getLogger("index_pages")

INPUT = "page_id long, url string, html string"
PAGES = (
    "url string, page_id long, title string, page_hash string, content_hash string, chunks_batch long, "
    "sections array<struct<heading:string,text:string>>, body_text string, batch long"
)
CHUNKS = "point_id string, url string, title string, heading string, chunk_index int, chunk_text string, content_hash string, batch long"
REJECTED = "page_id long, url string, reason string, batch long"
RUNS = "rows_read long, rows_rejected long, pages_seen long, pages_stored long, pages_unchanged long, pages_emptied long, rows_superseded long, chunks_written long, snapshot boolean, batch long"
KNOWN = "url string, page_id long, page_hash string, chunks_batch long, batch long"
SCHEMAS = {"known": KNOWN, "pages": PAGES, "chunks": CHUNKS, "rejected": REJECTED, "runs": RUNS}
DEFAULTS = {"input": "", "output": "", "checkpoint": "", "content": "main, article, .content", "mode": "Markdown", "files_per_batch": 1000, "snapshot_every": 20}


def _columns(schema: str) -> list[str]:
    return [x.strip().split(" ")[0] for x in schema.replace("heading:string,text:string", "").split(",")]


def _table(spark: SparkSession, output: str, kind: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[kind]).format("json" if kind == "runs" else "parquet").load(f"{output}/{kind}")


def _write(rows: DataFrame, output: str, kind: str, mode: str = "overwrite") -> None:
    """Replaces the batches that rows are of; empty rows with mode "append" make a table that isn't there."""
    out = rows.select(*_columns(SCHEMAS[kind])).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("batch")
    out.format("json" if kind == "runs" else "parquet").save(f"{output}/{kind}")


def latest_pages(pages: DataFrame) -> DataFrame:
    """Of each URL what was seen last: url, page_id, page_hash, chunks_batch."""
    return pages.groupBy("url").agg(F.max(F.struct("page_id", "batch", "page_hash", "chunks_batch")).alias("x")).select("url", "x.page_id", "x.page_hash", "x.chunks_batch")


def seen(spark: SparkSession, output: str, before: int | None = None) -> DataFrame:
    """What is known of URLs before a batch, or by now: the rows of the last snapshot and of the pages since. `latest_pages` makes it one row a URL."""
    done = _table(spark, output, "runs").where("snapshot")
    pages = _table(spark, output, "pages")
    if before is not None:
        done, pages = done.where(F.col("batch") < before), pages.where(F.col("batch") < before)
    last = done.agg(F.max("batch")).first()[0]
    columns = ["url", "page_id", "batch", "page_hash", "chunks_batch"]
    if last is None:
        return pages.select(*columns)
    known = _table(spark, output, "known").where(F.col("batch") == last)
    return known.select(*columns).unionByName(pages.where(F.col("batch") > last).select(*columns))


def index_batch(batch: DataFrame, number: int, output: str, selectors: Selectors, mode: str, snapshot_every: int = 20) -> dict:
    """Writes one micro-batch. Returns what it read and wrote."""
    spark = batch.sparkSession
    own_number = F.lit(number).cast("long").alias("batch")
    reason = F.when(F.col("url").isNull(), "no url").otherwise("no page_id")
    _write(batch.where("url IS NULL OR page_id IS NULL").select("page_id", "url", reason.alias("reason"), own_number), output, "rejected")
    rows = batch.where("url IS NOT NULL AND page_id IS NOT NULL").select("url", "page_id", "html", F.xxhash64("html").alias("key"))
    known = latest_pages(seen(spark, output, number).join(rows.select("url").distinct(), "url", "left_semi"))  # only what the batch asks for is grouped
    known = known.select("url", F.col("page_id").alias("old_id"), F.col("page_hash").alias("old_hash"), "chunks_batch")
    # one row a URL is chosen by its keys alone, before any html is looked at
    newest = rows.groupBy("url").agg(F.max(F.struct("page_id", "key")).alias("x")).select("url", "x.*").join(known, "url", "left")
    newest = newest.where("old_id IS NULL OR page_id > old_id").drop("old_id")
    taken = rows.join(newest, ["url", "page_id", "key"]).dropDuplicates(["url"])
    told = extract_pages(taken.drop("key"), selectors, mode)
    told = told.withColumn("content_hash", content_hash(F.col("body_text")))
    told = told.withColumn("page_hash", F.sha2(F.to_json(F.struct("title", "sections")), 256))
    same = F.col("page_hash").eqNullSafe(F.col("old_hash"))
    gone = lambda name: F.when(~same, F.col(name)).alias(name)
    state = told.select(
        "url", "page_id", "title", "page_hash", "content_hash", F.when(same, F.col("chunks_batch")).otherwise(F.lit(number)).cast("long").alias("chunks_batch"),
        gone("sections"), gone("body_text"), own_number,
    )
    _write(state, output, "pages")
    own = _table(spark, output, "pages").where(F.col("batch") == number)
    chunks = chunk_pages(own.where("chunks_batch = batch").select("url", "title", "content_hash", "batch", "sections", "body_text"))
    _write(chunks.withColumn("point_id", point_id(F.col("url"), F.col("chunk_index"))), output, "chunks")
    written = _table(spark, output, "chunks").where(F.col("batch") == number)
    stored, emptied = F.col("chunks_batch") == F.col("batch"), F.size("sections") == 0
    counts = own.agg(F.count("*").alias("seen"), F.count_if(stored).alias("stored"), F.count_if(stored & emptied).alias("emptied")).first()
    rejected = _table(spark, output, "rejected").where(F.col("batch") == number).count()
    read = batch.select("page_id").count()
    told = {
        "rows_read": read, "rows_rejected": rejected, "pages_seen": counts["seen"], "pages_stored": counts["stored"], "pages_unchanged": counts["seen"] - counts["stored"],
        "pages_emptied": counts["emptied"], "rows_superseded": read - rejected - counts["seen"], "chunks_written": written.count(), "snapshot": number % snapshot_every == snapshot_every - 1, "batch": number,
    }
    if told["snapshot"]:
        _write(latest_pages(seen(spark, output, number).unionByName(own.select("url", "page_id", "batch", "page_hash", "chunks_batch"))).withColumn("batch", own_number), output, "known")
    _write(spark.createDataFrame([told], RUNS), output, "runs")
    return told


def run(spark: SparkSession, input: str, output: str, checkpoint: str, content: str = DEFAULTS["content"], mode: str = "Markdown", files_per_batch: int = 1000, snapshot_every: int = 20) -> list[dict]:
    """Takes all that is new in the input and returns when it is indexed: what each micro-batch read and wrote."""
    output = output.rstrip("/")
    for kind, schema in SCHEMAS.items():
        _write(spark.createDataFrame([], schema), output, kind, "append")
    done: list[dict] = []

    def take(batch: DataFrame, number: int) -> None:
        done.append(index_batch(batch, number, output, Selectors(content=content), mode, snapshot_every))
        log.info("from %s to %s: %s", input, output, done[-1])

    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_per_batch).parquet(input)
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start().awaitTermination()
    log.info("%d batches of %s indexed", len(done), input)
    return done


def current_chunks(spark: SparkSession, output: str) -> DataFrame:
    """The index as it stands: the chunks of each URL's latest page."""
    output = output.rstrip("/")
    last = latest_pages(seen(spark, output)).select("url", F.col("chunks_batch").alias("batch"))
    return _table(spark, output, "chunks").join(last, ["url", "batch"]).select(*[n for n in _columns(CHUNKS) if n != "batch"])


if __name__ == "__main__":
    main("index_pages", run, DEFAULTS, __doc__)
