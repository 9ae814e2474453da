"""Messages and records as JSON, maps and text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

URL_MESSAGE = T.StructType().add("url", T.StringType())
ENTITY_MESSAGE = T.StructType().add("EntityData", T.MapType(T.StringType(), T.StringType()))


def message_json(c: Column) -> Column:
    return F.to_json(c)


def parse_message(c: Column, schema: T.DataType | str) -> Column:
    """Malformed messages become null.

    The parser answers a malformed record with a struct of nulls; a corrupt-record field tells it apart
    from a valid message whose fields are absent.
    """
    if isinstance(schema, T.StructType):
        marked = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
        parsed = F.from_json(c, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        return F.when(parsed["_corrupt"].isNull() & parsed.isNotNull(), parsed.dropFields("_corrupt"))
    return F.from_json(c, schema)


def entity_text(data: Column) -> Column:
    """`key: value` lines, by key."""
    line = lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))
    return F.array_join(F.transform(F.array_sort(F.map_entries(data)), line), "\n")


def flatten_record(record: Column) -> Column:
    """A struct, map or array record as a dictionary of JSON values, one entry per top-level field."""
    return F.from_json(F.to_json(record), "map<string,string>")
