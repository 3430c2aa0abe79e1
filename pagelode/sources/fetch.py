"""Fetching over HTTP or from a snapshot. A fetcher is a callable url -> (status, body); status 0 is a network error."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host_of, visit_key

Fetcher = Callable[[str], tuple[int, str | None]]


def http_fetcher(user_agent: str, timeout: float = 30.0) -> Fetcher:
    import urllib.error
    import urllib.request

    def fetch(url: str):
        try:
            request = urllib.request.Request(url, headers={"User-Agent": user_agent})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, None
        except (OSError, ValueError):
            return 0, None

    return fetch


def get_with_retry(fetch: Fetcher, url: str, retries: int = 3, first_delay: float = 1.0, sleep=time.sleep) -> str | None:
    """The body; errors of the network and the server are tried again after 1, 2, 4... seconds, other answers are final."""
    for attempt in range(retries + 1):
        status, body = fetch(url)
        if 200 <= status < 300:
            return body
        if status and status < 500:
            return None
        if attempt < retries:
            sleep(first_delay * 2**attempt)
    return None


def fetched(
    urls: DataFrame, fetcher: Callable[[], Fetcher], concurrency: int = 4, delay_ms: int = 0, retries: int = 3, first_delay: float = 1.0, sleep=time.sleep
) -> DataFrame:
    """urls with html; null where nothing came. A host is fetched by one task, one page at a time; `concurrency` tasks run in parallel, which is
    the number of pages under way at once.

    Between two pages of a host there is a delay; urls may have crawl_delay_ms, a delay the host asks for; the longer one holds.
    """
    names = urls.columns
    schema = urls.schema.add("html", "string")
    has_delay = "crawl_delay_ms" in names

    def run(batches):
        fetch, last = fetcher(), None
        for batch in batches:
            out = []
            delays = batch["crawl_delay_ms"].to_pylist() if has_delay else [None] * len(batch)
            for url, own, host in zip(batch["url"].to_pylist(), delays, batch["_host"].to_pylist()):
                if host == last and max(delay_ms, own or 0):
                    sleep(max(delay_ms, own or 0) / 1000)
                last = host
                out.append(get_with_retry(fetch, url, retries, first_delay))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(out, pa.string())], names=[*names, "html"])

    by_host = urls.withColumn("_host", F.coalesce(host_of(F.col("url")), F.lit(""))).repartition(concurrency, "_host").sortWithinPartitions("_host")
    return by_host.mapInArrow(run, schema)


def from_snapshot(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Fetching as a join: pages (url, html) answer for the web."""
    answers = pages.select(visit_key(F.col("url")).alias("_key"), F.col("html")).dropDuplicates(["_key"])
    return urls.withColumn("_key", visit_key(F.col("url"))).join(answers, "_key", "left").drop("_key")
