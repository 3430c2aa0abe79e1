"""URL functions: columns where Spark's own functions do, Python where links are resolved."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

_SKIPPED = ("#", "javascript:", "mailto:")
_PORTS = {"http": 80, "https": 443}


def trimmed(url: Column) -> Column:
    """Without slashes at the end."""
    return F.regexp_replace(url, "/+$", "")


def host_of(url: Column) -> Column:
    """Lower-case host; null where the URL can't be read."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path_of(url: Column) -> Column:
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.when(path.isNull() | (path == ""), F.lit("/")).otherwise(path)


def same_host(url: Column, site: Column) -> Column:
    return F.coalesce(host_of(url) == host_of(site), F.lit(False))


def visit_key(url: Column) -> Column:
    """What makes two URLs one page: case, fragment and slashes at the end don't."""
    return F.lower(trimmed(F.regexp_replace(url, "#.*$", "")))


def normalised(base: str, link: str) -> str | None:
    """A link of a page as an absolute URL of the same host, without fragment and slashes at the end; None if it leads elsewhere."""
    link = (link or "").strip()
    if not link or link.lower().startswith(_SKIPPED):
        return None
    try:
        home, parts = urlsplit(base), urlsplit(urljoin(base, link))
        if parts.scheme not in _PORTS or not parts.hostname or parts.hostname.lower() != (home.hostname or "").lower():
            return None
        host = parts.hostname.lower()
        if parts.port and parts.port != _PORTS[parts.scheme]:
            host += f":{parts.port}"
    except ValueError:
        return None
    path = parts.path if parts.query else re.sub("/+$", "", parts.path)
    return urlunsplit((parts.scheme, host, path, parts.query, "")).rstrip("/")
