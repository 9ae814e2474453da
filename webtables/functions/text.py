"""Scalar columns: cleaning, classification, regex actions, names."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from .match import blank, contains_alnum, match_value

SEPARATOR = "-"

# The Unicode white space characters.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def trimmed(c: Column) -> Column:
    """Trim any Unicode white space, no-break space included."""
    return F.btrim(c, F.lit(WHITE_SPACE))


# ---- regex actions -------------------------------------------------------------------------------


def text_remove(c: Column, literal: str) -> Column:
    return F.replace(c, F.lit(literal), F.lit(""))


def text_remove_ci(c: Column, literal: str) -> Column:
    return F.regexp_replace(c, "(?iu)" + re.escape(literal), "")


def text_replace(c: Column, literal: str) -> Column:
    """The whole value becomes `literal`; an empty value has nothing to replace and turns null."""
    return F.when(F.length(c) > 0, F.lit(literal))


def text_split(c: Column) -> Column:
    return F.split(c, " ")


def apply_regex(c: Column, rule: dict | None) -> Column:
    """`{"action": ..., "regex": ...}` of a spec; an unknown action leaves the value as it is."""
    if not rule:
        return c
    action, literal = rule.get("action"), rule.get("regex") or ""
    if action == "SPLITONCE":
        raise ValueError("SPLITONCE gives a list, which cannot be an entity value; use text_split")
    actions = {"REMOVE": text_remove, "REMOVEINSENSITIVE": text_remove_ci, "REPLACE": text_replace}
    return actions[action](c, literal) if action in actions else c


# ---- classification ------------------------------------------------------------------------------


def classification_value(c: Column, value: str | None = None, find_by: str | None = None) -> Column:
    """With `find_by`, only inputs that match count; the result is `value` when set, else the input."""
    result = c if value is None else F.lit(value)
    return result if blank(find_by) else F.when(match_value(c, find_by), result)


def _non_blank(c: Column, classification: dict) -> Column:
    result = classification_value(c, classification.get("value"), classification.get("findBy"))
    return F.when(~is_blank(result), result)


def first_classification(c: Column, classifications: Sequence[dict]) -> Column:
    """Name of the first classification that yields a value that is not blank."""
    if not classifications:
        return F.lit(None).cast("string")
    named = [F.when(_non_blank(c, k).isNotNull(), F.lit(k.get("name"))) for k in classifications]
    return F.coalesce(*named)


def first_classified_value(c: Column, classifications: Sequence[dict]) -> Column:
    if not classifications:
        return F.lit(None).cast("string")
    return F.coalesce(*[_non_blank(c, k) for k in classifications])


# ---- entities and cells --------------------------------------------------------------------------

# Patterns that results must agree with.
REFERENCE_PAIR = "&#[0-9]+;[a-z0-9]?&#[0-9]+;"
REFERENCE = "&#[0-9]+;"
NO_SUFFIX = "(?i)(?:[^a-z0-9]|(?<=['\"])s)"


def named_entities() -> dict[str, str]:
    """HTML 4 character names, from the standard library's table, plus the XML apostrophe."""
    return {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'"}


def _decoder() -> str:
    """SQL lambda for one token: what names a character becomes it, anything else stays as written.

    Any number of leading zeros is read; a number of more than eight hex digits after them is no character.
    """
    table = json.dumps(named_entities()).replace("'", "\\u0027")
    return f"""t -> CASE
        WHEN NOT (startswith(t, '&') AND endswith(t, ';')) THEN t
        WHEN startswith(t, '&#') THEN coalesce(
            get(
                transform(
                    filter(
                        array(coalesce(
                            try_cast(regexp_extract(t, '^&#([0-9]+);$', 1) AS BIGINT),
                            try_cast(conv(nullif(regexp_extract(t, '^&#[xX]0*([0-9a-fA-F]{{1,8}});$', 1), ''), 16, 10) AS BIGINT)
                        )),
                        c -> c BETWEEN 1 AND {0xD7FF} OR c BETWEEN {0xE000} AND {0x10FFFF}
                    ),
                    c -> decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32')
                ),
                0
            ),
            t
        )
        ELSE coalesce(try_element_at(from_json(r'{table}', 'map<string,string>'), substring(t, 2, length(t) - 2)), t)
    END"""


def decode_entities(c: Column) -> Column:
    parts = F.regexp_extract_all(c, F.lit("&[^;&]*;|&|[^&]+"), F.lit(0))
    decoded = F.call_function("transform", parts, F.expr(_decoder()))
    return F.when(c.contains("&"), F.array_join(decoded, "")).otherwise(c)


def clean_cell(c: Column) -> Column:
    """Decode entities, trim, drop line breaks, then delete numeric references that were escaped twice."""
    flat = F.translate(trimmed(decode_entities(c)), "\r\n", "")
    return F.regexp_replace(F.regexp_replace(flat, REFERENCE_PAIR, ""), REFERENCE, "")


def header_name(parts: Column) -> Column:
    """Header texts of one column, top to bottom: cleaned and joined, text already contained is skipped."""
    def grow(name: Column, part: Column) -> Column:
        added = F.concat(name, clean_cell(decode_entities(part)), F.lit(SEPARATOR))
        return F.when(part.isNull() | contains_alnum(name, part), name).otherwise(added)

    return F.regexp_replace(F.aggregate(parts, F.lit(""), grow), SEPARATOR + "$", "")


def safe_suffix(c: Column) -> Column:
    """Strip what is not an ASCII letter or digit, and an `s` right after a quote."""
    return F.regexp_replace(c, NO_SUFFIX, "")
