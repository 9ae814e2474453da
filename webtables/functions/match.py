"""Patterns of the extraction spec as column predicates.

A pattern is plain text (equality), `x%` (starts with), `%x` (ends with), `%x%` (contains), `a|b` (any of)
or `a&&b` (all of; each part may itself be `a|b`). A value is compared whole, not by class token.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

# Event severities, lowest first.
LEVELS = ("Verbose", "Debug", "Information", "Warning", "Error", "Fatal")


def tag_name(name: str | None) -> str | None:
    """Spec spelling to node spelling: lower case, `_SharpText` is `#text`."""
    if name is None:
        return None
    return "#text" if name.lower() == "_sharptext" else name.lower()


def blank(text: str | None) -> bool:
    return text is None or not text.strip()


def match_value(value: Column, pattern: str) -> Column:
    if "&&" in pattern:
        return match_all(value, pattern.split("&&"))
    if "|" in pattern:
        return reduce(or_, [match_value(value, part) for part in pattern.split("|")])
    bare = pattern.replace("%", "")
    starts, ends = pattern.startswith("%"), pattern.endswith("%")
    if starts and ends:
        return value.contains(F.lit(bare))
    if starts:
        return value.endswith(F.lit(bare))
    if ends:
        return value.startswith(F.lit(bare))
    return value == F.lit(pattern)


def match_all(value: Column, patterns: Sequence[str]) -> Column:
    return reduce(and_, [match_value(value, part) for part in patterns])


def match_attr(attrs: Column, key: str | None = None, pattern: str | None = None) -> Column:
    """The attribute is present and, when a pattern is given, its value matches. No key: always true."""
    if blank(key):
        return F.lit(True)
    value = F.try_element_at(attrs, F.lit(tag_name(key)))
    found = match_value(value, pattern) if pattern else value.isNotNull()
    return F.coalesce(found, F.lit(False))


def match_element(node: Column, tag: str | None, key: str | None = None, pattern: str | None = None) -> Column:
    """`node` is any struct with `tag` and `attrs`. No tag matches nothing."""
    if tag is None:
        return F.lit(False)
    same_tag = node["tag"] == F.lit(tag_name(tag))
    return same_tag if blank(key) else same_tag & match_attr(node["attrs"], key, pattern)


def contains_alnum(a: Column, b: Column) -> Column:
    """`a` contains `b` when only letters and digits (ASCII) count."""
    other = F.lit("[^a-zA-Z0-9]")
    return F.regexp_replace(a, other, F.lit("")).contains(F.regexp_replace(b, other, F.lit("")))


def level_at_least(level: Column, minimum: str, levels: Sequence[str] = LEVELS) -> Column:
    """`levels` orders the severities, lowest first; values outside it are dropped."""
    return level.isin(list(levels[list(levels).index(minimum):]))
