"""Vector search: score, top k, then the threshold.

The threshold is on the sort key, so it may follow the limit; before it, it would be pushed below the projection and every
similarity computed twice. Recency comes first: it is a plain column predicate that reaches the scan.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, literal, usable
from .vector_index import PART_ROWS, blocks_of, in_all, nearest_in_parts

THRESHOLD, LIMIT = 0.3, 5


def fresh(capture: str, as_of, days: int) -> Column:
    """Captured within so many days of as_of; what isn't a time is dropped."""
    at = F.expr(f"try_cast({capture} AS TIMESTAMP)")
    return at >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


def stale(capture: str, as_of, days: int) -> Column:
    at = F.expr(f"try_cast({capture} AS TIMESTAMP)")
    return at < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


def top_k(chunks: DataFrame, query, k: int = LIMIT, threshold: float | None = THRESHOLD, tie: str = "point_id", vector: str = "embedding") -> DataFrame:
    """The k rows most similar to one vector, with score; ties by `tie`."""
    best = chunks.withColumn("score", cosine(F.col(vector), literal(query))).where(F.col(vector).isNotNull()).orderBy(F.desc("score"), tie).limit(k)
    return best if threshold is None else best.where(F.col("score") >= threshold)


def search(chunks: DataFrame, query, limit: int = LIMIT, fresh_days: int | None = None, as_of=None, threshold: float = THRESHOLD, overfetch: int | None = None, capture: str = "capture_date", tie: str = "point_id") -> DataFrame:
    """Recency before the top k; overfetch=n instead takes the best n * limit, filters them and cuts, which may give fewer."""
    if fresh_days is None:
        return top_k(chunks, query, limit, threshold, tie)
    if overfetch is None:
        return top_k(chunks.where(fresh(capture, as_of, fresh_days)), query, limit, threshold, tie)
    best = top_k(chunks, query, limit * overfetch, threshold, tie)
    return best.where(fresh(capture, as_of, fresh_days)).orderBy(F.desc("score"), tie).limit(limit)


def search_store(store, query, limit: int = LIMIT, fresh_days: int | None = None, as_of=None, threshold: float = THRESHOLD, probes: int | None = 0) -> DataFrame:
    """`search` on a chunk table: its days prune what isn't fresh, its vector index (if it has one) what isn't near. probes=None compares with all."""
    since = None
    if fresh_days is not None:
        since = (as_of if isinstance(as_of, datetime.datetime) else datetime.datetime.fromisoformat(as_of)) - datetime.timedelta(days=fresh_days)
    return top_k(store.near(query, probes, since=since), query, limit, threshold)


def results(found: DataFrame) -> DataFrame:
    """score, url, title, heading, text, capture_date; missing values as empty strings."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return found.select("score", text("url").alias("url"), text("title").alias("title"), text("heading").alias("heading"), text("chunk_text").alias("text"), text("capture_date").alias("capture_date"))


def top_k_batch(
    vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, id_col: str = "vec_id", query_col: str = "query_id",
    vector: str = "embedding", part_rows: int = PART_ROWS,
) -> DataFrame:
    """(query_id, id, score, rank) for many queries, exactly. Vectors are dealt to parts of about `part_rows` by a hash of their ids, every query meets
    every part there, and only each part's k best per query leave it."""
    rows = vectors.where(usable(vector)).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    asked = queries.where(usable(vector)).select(F.col(query_col).cast("long").alias("query_id"), F.col(vector).alias("v"))
    parts = max(1, -(-rows.count() // part_rows))
    ranked = nearest_in_parts(blocks_of(rows, parts), in_all(asked, parts), k)
    return ranked if threshold is None else ranked.where(F.col("score") >= threshold)
