"""robots.txt: groups for all agents or the own product, plain prefixes, crawl delay, sitemaps."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import path_of

RULES = "struct<disallowed:array<string>,sitemaps:array<string>,crawl_delay_ms:int>"


@dataclass
class RobotsRules:
    disallowed: list[str] = field(default_factory=list)
    sitemaps: list[str] = field(default_factory=list)
    crawl_delay_ms: int | None = None

    def allows(self, path: str) -> bool:
        path = path.lower()
        return not any(path.startswith(p.lower()) for p in self.disallowed)


def parse(content: str, product: str = "pagelode") -> RobotsRules:
    """Each user-agent line decides anew whether what follows matters; rules of all groups that matter add up."""
    rules, ours = RobotsRules(), False
    for line in (content or "").splitlines():
        key, colon, value = line.partition("#")[0].partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "sitemap":
            if value:
                rules.sitemaps.append(value)
        elif key == "user-agent":
            ours = value == "*" or product.lower() in value.lower()
        elif ours and key == "disallow" and value:
            rules.disallowed.append(value)
        elif ours and key == "crawl-delay":
            try:
                rules.crawl_delay_ms = int(value) * 1000
            except ValueError:
                pass
    return rules


def parsed(robots: DataFrame, product: str = "pagelode") -> DataFrame:
    """robots (site_url, content) as (site_url, rules); null content allows all."""

    def run(batches):
        kind = pa.struct([("disallowed", pa.list_(pa.string())), ("sitemaps", pa.list_(pa.string())), ("crawl_delay_ms", pa.int32())])
        for batch in batches:
            rules = [vars(parse(c or "", product)) for c in batch["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["site_url"], pa.array(rules, kind)], names=["site_url", "rules"])

    return robots.select("site_url", "content").mapInArrow(run, f"site_url string, rules {RULES}")


def allowed(url: Column, disallowed: Column) -> Column:
    """Whether the URL's path starts with none of the prefixes; case doesn't count."""
    path = F.lower(path_of(url))
    return ~F.exists(F.coalesce(disallowed, F.array().cast("array<string>")), lambda p: F.startswith(path, F.lower(p)))
