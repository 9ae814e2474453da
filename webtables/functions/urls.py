"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ABSOLUTE = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
MALFORMED = r"[\s\"<>\\^`{|}]|%(?![0-9A-Fa-f]{2})"


def resolve_url(base: Column, url: Column) -> Column:
    """No URL: the base. Relative: base and URL joined as text. Absolute or malformed: unchanged."""
    keep = url.rlike(ABSOLUTE) | url.rlike(MALFORMED)
    return F.when(url.isNull(), base).when(keep, url).otherwise(F.concat(F.coalesce(base, F.lit("")), url))


def url_host(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("HOST"))


def url_path(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("PATH"))
