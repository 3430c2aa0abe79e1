"""Crawling as a level-wise iteration: the frontier of a depth is one DataFrame over all sites."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_hash, point_id
from ..functions.html import checked, extract_pages
from ..functions.urls import host_of, trimmed, visit_key
from ..sources import robots, sitemap
from ..sources.config import CrawlConfig, site_mode
from .chunking import chunk_pages
from .embed import EmbeddingProvider, embedded_once, whole_pages
from .store import ChunkStore, classified, materialised, passing, passing_folder

Fetch = Callable[[DataFrame], DataFrame]


def site_rows(spark: SparkSession, crawl: CrawlConfig) -> DataFrame:
    rows = [(s.url, s.max_depth, site_mode(s, crawl)) for s in crawl.sites]
    return spark.createDataFrame(rows, "site_url string, max_depth int, mode string")


def site_rules(sites: DataFrame, fetch: Fetch, product: str) -> DataFrame:
    """(site_url, rules); a file that can't be had allows all."""
    root = F.regexp_extract("site_url", "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    files = fetch(sites.select("site_url", F.concat(root, F.lit("/robots.txt")).alias("url")))
    return robots.parsed(files.select("site_url", F.col("html").alias("content")), product)


def seeds(sites: DataFrame, rules: DataFrame | None, fetch: Fetch) -> DataFrame:
    """(site_url, url) at depth 0: what the sitemaps name on the site's host, or the site's own URL if that is nothing."""
    own = sites.select("site_url", trimmed(F.col("site_url")).alias("url"))
    if rules is None:
        return own
    roots = rules.select("site_url", F.explode("rules.sitemaps").alias("url"))
    if not roots.take(1):
        return own
    named = materialised(sitemap.on_site(sitemap.expanded(roots, fetch)).withColumn("url", trimmed(F.col("url"))))
    return named.select("site_url", "url").unionByName(own.join(named.select("site_url").distinct(), "site_url", "left_anti"))


def next_frontier(level: DataFrame, visited: DataFrame) -> DataFrame:
    """(site_url, url, depth, max_depth) of links of a level's pages that may be followed and weren't visited."""
    found = level.where("depth < max_depth").select("site_url", "max_depth", (F.col("depth") + 1).alias("depth"), F.explode("links").alias("url"))
    return found.withColumn("key", visit_key(F.col("url"))).dropDuplicates(["key"]).join(visited, "key", "left_anti").drop("key")


class Seen:
    """Keys of visited URLs as a bucketed table. A level's links are dealt to the buckets; what was seen before is read where it lies and never dealt again,
    so that what a level moves follows its links, not all that was visited."""

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets = spark, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path, self.name = passing_folder(spark, "seen"), f"seen_{uuid.uuid4().hex}"

    def add(self, keys: DataFrame) -> None:
        rows = keys.select("key").repartition(self.buckets, "key")
        rows.write.bucketBy(self.buckets, "key").sortBy("key").option("path", self.path).mode("append").saveAsTable(self.name)

    def keys(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def crawl_pages(sites: DataFrame, crawl: CrawlConfig, fetch: Fetch, selectors=None) -> DataFrame:
    """Every page that came, extracted: (site_url, url, depth, ...page fields). Breadth first, so depth is the shortest distance.

    A URL is visited once whatever site leads to it, also if robots forbid it. Selectors: {site_url: Selectors}.
    """
    spark = sites.sparkSession
    selectors = selectors or {s.url: s.selectors for s in crawl.sites}
    for own in selectors.values():
        if own is not None:
            checked(own)
    rows = [(url, json.dumps(vars(own))) for url, own in selectors.items() if own is not None]
    kinds = spark.createDataFrame(rows, "site_url string, selectors string") if rows else None
    rules = materialised(site_rules(sites, fetch, crawl.product_token)) if crawl.respect_robots_txt else None
    start = seeds(sites, rules, fetch).join(sites.select("site_url", "max_depth"), "site_url").withColumn("depth", F.lit(0))
    frontier = materialised(start.withColumn("_k", visit_key(F.col("url"))).dropDuplicates(["_k"]).drop("_k"))
    seen, pages = Seen(spark), None
    while frontier.take(1):
        seen.add(frontier.select(visit_key(F.col("url")).alias("key")))
        allowed = frontier
        if rules is not None:
            allowed = frontier.join(rules, "site_url", "left")
            allowed = allowed.withColumn("crawl_delay_ms", F.col("rules.crawl_delay_ms")).where(robots.allowed(F.col("url"), F.col("rules.disallowed"))).drop("rules")
        came = fetch(allowed).where("html IS NOT NULL").drop("crawl_delay_ms").join(sites.select("site_url", "mode"), "site_url")
        told = came.join(kinds, "site_url", "left") if kinds is not None else came.withColumn("selectors", F.lit(None).cast("string"))
        level = materialised(extract_pages(told, by_row=True).drop("selectors"))
        pages = level if pages is None else pages.unionByName(level)
        frontier = materialised(next_frontier(level, seen.keys()).select("site_url", "url", "max_depth", "depth"))
    seen.drop()
    return pages if pages is not None else extract_pages(sites.select("site_url", F.col("site_url").alias("url"), "max_depth", F.lit(0).alias("depth"), "mode", F.lit("").alias("html")).limit(0))


def index_batch(pages: DataFrame, store: ChunkStore, provider: Callable[[], EmbeddingProvider], as_of) -> DataFrame:
    """Chunks, embeds and stores the pages that changed. Returns one row: pages seen, pages and chunks stored, pages failed.

    All chunks of a page have one capture date, as_of. Unchanged pages keep theirs and are marked as checked. A page that has changed to
    have no chunk loses those it had; a page of which a chunk could not be embedded stays as it was.
    """
    store.ensure()
    with passing(store.spark):
        return _indexed(pages, store, provider, as_of)


def _indexed(pages: DataFrame, store: ChunkStore, provider: Callable[[], EmbeddingProvider], as_of) -> DataFrame:
    fields = [c for c in ("url", "title", "summary", "content_selector", "sections", "body_text") if c in pages.columns]
    own = pages.select(*fields).dropDuplicates(["url"]).withColumn("content_hash", content_hash(F.col("body_text")))
    known = materialised(classified(own, store.pages()))
    chunks = chunk_pages(known.where("change != 'unchanged'"))
    chunks = chunks.withColumn("point_id", point_id(F.col("url"), F.col("chunk_index"))).withColumn("capture_date", F.lit(as_of).cast("timestamp")).drop("change")
    vectors = materialised(embedded_once(chunks, provider))
    good = whole_pages(vectors)
    failed = vectors.where("embed_error IS NOT NULL").select("url").distinct()
    changed = known.where("change != 'unchanged'").select("url", "content_hash").join(failed, "url", "left_anti")
    store.replace_pages(good, known.where("change = 'unchanged'").select("url"), as_of, changed)
    stored = vectors.groupBy("url").agg(F.max(F.col("embed_error").isNotNull()).alias("failed"), F.count("*").alias("n"))
    good_page = F.col("failed").eqNullSafe(False)
    rows = known.select("url").join(stored, "url", "left")
    told = rows.agg(
        F.count("*").alias("pages_seen"),
        F.count_if(good_page).alias("pages_stored"),
        F.coalesce(F.sum(F.when(good_page, F.col("n"))), F.lit(0)).alias("chunks_stored"),
        F.count_if("failed").alias("pages_failed"),
    )
    return store.spark.createDataFrame(told.collect(), told.schema)  # one row, which needs no table any more


def crawl_and_index(spark: SparkSession, crawl: CrawlConfig, store: ChunkStore, provider: Callable[[], EmbeddingProvider], fetch: Fetch, as_of) -> DataFrame:
    with passing(spark):
        return index_batch(crawl_pages(site_rows(spark, crawl), crawl, fetch), store, provider, as_of)


def due(sites: DataFrame, as_of) -> DataFrame:
    """Sites (with frequency_hours and last_crawled) whose time has come."""
    hours = F.make_dt_interval(F.lit(0), F.col("frequency_hours"))
    return sites.where(F.col("last_crawled").isNull() | (F.col("last_crawled") + hours <= F.lit(as_of).cast("timestamp")))


def due_sites(spark: SparkSession, crawl: CrawlConfig, store: ChunkStore, as_of) -> list:
    """The configured sites of whose host no page was seen for frequency_hours."""
    rows = spark.createDataFrame([(i, s.url, s.frequency_hours) for i, s in enumerate(crawl.sites)], "i int, url string, frequency_hours int").withColumn("host", host_of(F.col("url")))
    if store.exists():
        seen = store.pages().groupBy(host_of(F.col("url")).alias("host")).agg(F.max("last_checked").alias("last_crawled"))
    else:
        seen = spark.createDataFrame([], "host string, last_crawled timestamp")
    return [crawl.sites[r["i"]] for r in due(rows.join(seen, "host", "left"), as_of).orderBy("i").collect()]  # a row a configured site
