"""Content hashes and point ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 text."""
    return F.sha2(text, 256)


def point_id(url: Column, index: Column) -> Column:
    """A UUID from the MD5 of "url::index"; the first three groups have their bytes in little-endian order."""
    h = F.md5(F.concat(url, F.lit("::"), index.cast("string")))
    part = lambda *at: [F.substring(h, a, 2) for a in at]
    dash = F.lit("-")
    return F.concat(*part(7, 5, 3, 1), dash, *part(11, 9), dash, *part(15, 13), dash, F.substring(h, 17, 4), dash, F.substring(h, 21, 12))
