"""Sitemaps and sitemap indexes, level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import same_host

#: Both kinds of root; a single entry is read as an array of one.
XML = "url ARRAY<STRUCT<loc: STRING>>, sitemap ARRAY<STRUCT<loc: STRING>>"


def entries(sitemaps: DataFrame) -> DataFrame:
    """(site_url, loc, is_index) of sitemaps (site_url, xml). Malformed files give nothing."""
    read = sitemaps.where(F.col("xml").isNotNull()).select("site_url", F.from_xml("xml", XML, {"mode": "PERMISSIVE"}).alias("x"))
    kinds = []
    for name, is_index in (("url", False), ("sitemap", True)):
        rows = read.select("site_url", F.explode(f"x.{name}.loc").alias("loc"))
        kinds.append(rows.select("site_url", F.btrim("loc", F.lit(" \t\r\n")).alias("loc"), F.lit(is_index).alias("is_index")))
    return kinds[0].unionByName(kinds[1]).where(F.coalesce(F.col("loc"), F.lit("")) != "")


def expanded(roots: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Distinct (site_url, url) below the roots (site_url, url). fetch adds html, the file's text, to (site_url, url).

    An index that has been read isn't read again, so cycles end; there is no limit of depth.
    """
    from ..operators.store import materialised

    level = materialised(roots.select("site_url", "url").distinct())
    seen, found = level, None
    while True:
        got = materialised(entries(fetch(level).select("site_url", F.col("html").alias("xml"))))
        urls = got.where("not is_index").select("site_url", F.col("loc").alias("url"))
        found = urls if found is None else found.unionByName(urls)
        level = materialised(got.where("is_index").select("site_url", F.col("loc").alias("url")).distinct().join(seen, ["site_url", "url"], "left_anti"))
        if not level.take(1):
            break
        seen = seen.unionByName(level)
    return found.dropDuplicates(["site_url", "url"])


def on_site(urls: DataFrame) -> DataFrame:
    """Those of the site's own host; what isn't an absolute URL goes."""
    return urls.where(same_host(F.col("url"), F.col("site_url")))
