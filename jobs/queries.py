"""The jobs as registered queries: each runs twice into one new folder, and what stands there then is read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.operators.store import work_folder
from pagelode.plans.queries import CHUNKS_SQL, PAGE_CHUNKS_SQL, POINT_SQL

from . import embedding_requests, index_pages


def job1_index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "job1")
    for _ in range(2):
        index_pages.run(spark, f"{sf_dir}/pages.parque[t]", f"{folder}/index", f"{folder}/mark")
    return index_pages.current_chunks(spark, f"{folder}/index")


def job2_embedding_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "job2")
    for _ in range(2):
        embedding_requests.run(spark, f"{sf_dir}/documents.parquet", folder)
    return embedding_requests.joined(spark, folder).drop("chunk_text").withColumn("chunk_index", F.col("chunk_index").cast("int"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_index_pages, job2_embedding_requests)}

ORACLES: dict[str, str] = {
    "job1_index_pages": f"""{PAGE_CHUNKS_SQL}
SELECT {POINT_SQL.format(x="c.url || '::' || k")} AS point_id, c.url, c.title, c.heading, CAST(k AS INTEGER) AS chunk_index, t AS chunk_text, sha256(body) AS content_hash
FROM chunks c JOIN body USING (page_id) WHERE page_id IN (SELECT max(page_id) FROM pages GROUP BY url)""",
    "job2_embedding_requests": CHUNKS_SQL
    + f""", p AS (
  SELECT 'doc://' || doc_id AS url, coalesce(x.source, '') AS title, coalesce(x.lang, 'und') AS lang, chunk_index, sha256(chunk_text) AS chunk_hash, CAST(length(chunk_text) // 4 AS INTEGER) AS n_tokens
  FROM chunks JOIN documents x USING (doc_id)),
texts AS (SELECT lang, chunk_hash, count(*) AS n_points, min(n_tokens) AS n_tokens FROM p GROUP BY ALL),
dealt AS (SELECT *, ('0x' || substr(chunk_hash, 1, 8))::BIGINT % (SELECT greatest(1, (count(*) + 19999) // 20000) FROM texts) AS bucket FROM texts),
summed AS (SELECT *, (sum(greatest(n_tokens, 32)) OVER (PARTITION BY lang, bucket ORDER BY chunk_hash) - greatest(n_tokens, 32)) // 8000 AS n FROM dealt),
asked AS (
  SELECT lang, chunk_hash, n_points, printf('%s-%d-%d', lang, bucket, CAST(n AS BIGINT)) AS request,
         row_number() OVER (PARTITION BY lang, bucket, n ORDER BY chunk_hash) - 1 AS position FROM summed)
SELECT {POINT_SQL.format(x="url || '::' || chunk_index")} AS point_id, url, title, CAST(chunk_index AS INTEGER) AS chunk_index, chunk_hash, n_tokens, lang, request, position, n_points,
       chunk_hash AS text_hash
FROM p JOIN asked USING (lang, chunk_hash)""",
}
