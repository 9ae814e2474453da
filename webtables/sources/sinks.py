"""Sinks: entity tables and the error log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, types as T


def entity_sink(rows: DataFrame, path: str, mode: str = "append", fmt: str = "parquet", **options) -> None:
    rows.write.mode(mode).format(fmt).options(**options).save(path)


def error_log_sink(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


@dataclass(frozen=True)
class EntityColumn:
    """A column of an entity table: type, whether it may be null, default as a SQL expression."""

    kind: T.DataType = T.StringType()
    required: bool = False
    default: str | None = None


def entity_ddl(spark: SparkSession, name: str, columns: T.StructType | dict[str, EntityColumn], path: str | None = None) -> None:
    """Drop and create an entity table, with an id, creation and update times, NOT NULL and defaults.

    Spark does not enforce NOT NULL on Parquet tables; `check_constraints` does before a load.
    """
    if isinstance(columns, T.StructType):
        columns = {f.name: EntityColumn(f.dataType, not f.nullable) for f in columns}
    stamped = EntityColumn(T.TimestampType(), True, "current_timestamp()")
    whole = {"id": EntityColumn(required=True)} | columns | {"dt_creation": stamped, "dt_update": stamped}
    parts = [
        f"`{column}` {c.kind.simpleString()}" + " NOT NULL" * c.required + (f" DEFAULT {c.default}" if c.default else "")
        for column, c in whole.items()
    ]
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({', '.join(parts)}) USING parquet" + (f" LOCATION '{path}'" if path else ""))
