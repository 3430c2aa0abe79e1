"""Prepares what an embedding server is asked for a corpus: chunks of all documents, and requests that hold each distinct chunk text once.

    python -m jobs.embedding_requests --config jobs/embedding_requests.json --input hdfs:///documents.parquet --output hdfs:///requests

Input: Parquet of doc_id, text, lang, source; of rows that share an id one counts, whichever order they come in. With --vectors, a Parquet table
with a column chunk_hash, texts whose vectors are there already are not asked again. Output, both partitioned by lang (`und` where it is null):

    output/points     Parquet: point_id, url, title, chunk_index, chunk_text, chunk_hash, n_tokens; a row a chunk
    output/requests   JSON lines: request, position, chunk_hash, n_tokens, n_points, text; a row a distinct text and language

A request is a run of texts in the order of their hashes, with `request_tokens` estimated tokens and the last text beyond them at most, and
`request_texts` texts and one more at most. Vectors that come back are joined to points by chunk_hash, so copies are paid for once. Texts are dealt to
buckets by their hash, so many that one has about `bucket_texts`, and requests are numbered within a bucket: no task sorts more. A run
replaces the output; the same documents give the same rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelode.functions.hashing import content_hash, point_id
from pagelode.functions.tables import spread
from pagelode.functions.text import estimate_tokens
from pagelode.operators.chunking import chunk_pages

from .command import main

log = logging.getLogger("embedding_requests")

DEFAULTS = {"input": "", "output": "", "vectors": None, "request_tokens": 8000, "request_texts": 256, "bucket_texts": 20_000}
POINTS = "point_id string, url string, title string, chunk_index int, chunk_text string, chunk_hash string, n_tokens int, lang string"
REQUESTS = "request string, position long, chunk_hash string, n_tokens int, n_points long, text string, lang string"


def one_per_id(docs: DataFrame) -> DataFrame:
    """Of rows with the same id that with the smallest text hash; a table without such rows passes as it is, and only such rows are moved."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not repeated.take(1):
        return docs
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text", "lang", "source"))
    first = docs.join(repeated, "doc_id", "left_semi").withColumn("_place", place).where("_place = 1").drop("_place")
    return docs.join(repeated, "doc_id", "left_anti").unionByName(first)


def points(docs: DataFrame) -> DataFrame:
    """A row a chunk. Documents without an id or without a text of the least size have none."""
    body = F.coalesce("text", F.lit(""))
    pages = docs.where("doc_id IS NOT NULL").select(
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), F.coalesce("source", F.lit("")).alias("title"), F.coalesce("lang", F.lit("und")).alias("lang"),
        body.alias("body_text"), F.array(F.struct(F.lit("").alias("heading"), body.alias("text"))).alias("sections"),
    )
    chunks = chunk_pages(pages).withColumn("point_id", point_id(F.col("url"), F.col("chunk_index")))
    return chunks.withColumn("chunk_hash", content_hash(F.col("chunk_text"))).withColumn("n_tokens", estimate_tokens("chunk_text"))


def _bucket(buckets: int) -> Column:
    return F.conv(F.substring("chunk_hash", 1, 8), 16, 10).cast("long") % buckets


def requests(chunks: DataFrame, request_tokens: int, request_texts: int, bucket_texts: int, known: DataFrame | None = None) -> DataFrame:
    """Each distinct text of a language once, with the request it goes in and its place there; without those whose chunk_hash is known."""
    if known is not None:
        chunks = chunks.join(known.select("chunk_hash").distinct(), "chunk_hash", "left_anti")
    texts = chunks.groupBy("lang", "chunk_hash").agg(F.count("*").alias("n_points"), F.min("chunk_text").alias("text"), F.min("n_tokens").alias("n_tokens"))
    distinct = chunks.select("lang", "chunk_hash").distinct().count()
    rows = texts.withColumn("bucket", _bucket(max(1, -(-distinct // bucket_texts))))
    # a text weighs its tokens, or its share of a request's texts if that is more
    least = -(-request_tokens // request_texts)
    before = F.sum(F.greatest("n_tokens", F.lit(least)).cast("long")).over(Window.partitionBy("lang", "bucket").orderBy("chunk_hash")) - F.greatest("n_tokens", F.lit(least))
    rows = rows.withColumn("n", F.floor(before / request_tokens).cast("long"))
    place = F.row_number().over(Window.partitionBy("lang", "bucket", "n").orderBy("chunk_hash")) - 1
    return rows.select(F.format_string("%s-%d-%d", "lang", "bucket", "n").alias("request"), place.cast("long").alias("position"), "chunk_hash", "n_tokens", "n_points", "text", "lang")


def run(
    spark: SparkSession, input: str, output: str, request_tokens: int = 8000, request_texts: int = 256, bucket_texts: int = 20_000, vectors: str | None = None
) -> dict:
    """Writes points, and from them requests. Returns what was read and written."""
    output = output.rstrip("/")
    docs = spread(spark.read.parquet(input).select("doc_id", "text", "lang", "source"))
    names = lambda schema: [x.strip().split(" ")[0] for x in schema.split(",")]
    points(one_per_id(docs)).select(*names(POINTS)).write.mode("overwrite").partitionBy("lang").parquet(f"{output}/points")
    chunks = spark.read.schema(POINTS).parquet(f"{output}/points")
    known = spark.read.parquet(vectors) if vectors else None
    asked = requests(chunks.select("lang", "chunk_hash", "chunk_text", "n_tokens"), request_tokens, request_texts, bucket_texts, known)
    asked.write.mode("overwrite").partitionBy("lang").json(f"{output}/requests")
    told = spark.read.schema(REQUESTS).json(f"{output}/requests").agg(F.count("*").alias("texts"), F.count_distinct("request").alias("requests")).first()
    out = {"documents_read": docs.select("doc_id").count(), "points_written": chunks.select("lang").count(), "texts_written": told["texts"], "requests_written": told["requests"]}
    log.info("from %s to %s: %s", input, output, out)
    return out


def joined(spark: SparkSession, output: str) -> DataFrame:
    """Both outputs together: each point with the request that its text is asked in."""
    output = output.rstrip("/")
    chunks = spark.read.schema(POINTS).parquet(f"{output}/points")
    asked = spark.read.schema(REQUESTS).json(f"{output}/requests").select("lang", "chunk_hash", "request", "position", "n_points", F.sha2("text", 256).alias("text_hash"))
    return chunks.join(asked, ["lang", "chunk_hash"], "left")


if __name__ == "__main__":
    main("embedding_requests", run, DEFAULTS, __doc__)
