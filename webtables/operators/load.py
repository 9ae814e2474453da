"""Entity maps to typed tables: casting, checks, inserts, updates, deletes, change sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T


def rules_schema(rules: dict) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in rules])


# ---- typing and checks ---------------------------------------------------------------------------


def to_typed_row(entities: DataFrame, schema: T.StructType, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(typed rows, unknown fields): `data` by exact column name; absent or uncastable values are null."""
    typed = [F.try_element_at("data", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in schema]
    extra = F.array_except(F.map_keys("data"), F.array(*[F.lit(f.name) for f in schema]))
    return entities.select(*keep, *typed), entities.select(*keep, F.explode(extra).alias("unknown_field"))


def row_id(keys: Sequence[str]) -> Column:
    """Hash of the key columns: the same on every retry, unlike a random id."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def with_row_identity(df: DataFrame, keys: Sequence[str], as_of: Column) -> DataFrame:
    return df.withColumns({"id": row_id(keys), "dt_creation": as_of, "dt_update": as_of})


def check_constraints(df: DataFrame, rules: dict) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with the broken rules in `violations`); rules are `{column: (required, length)}`."""
    tests = []
    for name, (required, length) in rules.items():
        if required:
            tests.append(F.when(F.col(name).isNull(), F.lit(f"{name} is required")))
        if length is not None:
            tests.append(F.when(F.length(name) > length, F.lit(f"{name} is longer than {length}")))
    judged = df.withColumn("violations", F.array_compact(F.array(*tests)))
    broken = F.size("violations") > 0
    return judged.where(~broken).drop("violations"), judged.where(broken)


def check_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows `n`."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def key_digest(key: Sequence[str]) -> Column:
    """256-bit hash of the key; null is a value, and no two keys share the text it is made of."""
    part = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))
    return F.unhex(F.sha2(F.concat(*[part(F.col(k).cast("string")) for k in key]), 256))


def same_key(left: DataFrame, right: DataFrame, key: Sequence[str]) -> Column:
    """Equal keys; null equals null. `right` has its key columns as `_k0`, `_k1`, ..."""
    return reduce(and_, (left[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(key)))


def keys_of(df: DataFrame, key: Sequence[str], *more: Column) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], *more)


def fixed_width(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def dedup_natural_key(df: DataFrame, key: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """The first row of each key by `order_by`, which must tell a key's different rows apart; nulls come first.

    In two phases: the least order of each key is found from a digest of the key and the order alone, then the rows that
    have it are looked up, so no row is sorted or carried along. Numbers and times are narrowed one after the other;
    where texts must decide, among what is left of a key, they do so by themselves.
    """
    rows = df.withColumn("_digest", key_digest(key))
    order, left = [], list(order_by)
    while left and fixed_width(df.schema[left[0]].dataType):
        order.append(left.pop(0))
    for column in order:
        least = F.struct(F.min(F.when(F.col(column).isNotNull(), F.col(column))).alias("value"), F.max(F.col(column).isNull()).alias("null"))
        firsts = rows.groupBy(F.col("_digest").alias("_of")).agg(least["null"].alias("_null"), least["value"].alias("_value"))
        same = F.when(F.col("_null"), F.col(column).isNull()).otherwise(F.col(column) == F.col("_value"))
        rows = rows.join(firsts, (F.col("_digest") == F.col("_of")) & same, "left_semi")
    if left:
        firsts = rows.groupBy(F.col("_digest").alias("_of")).agg(F.min(F.struct(*left)).alias("_value"))
        rows = rows.join(firsts, (F.col("_digest") == F.col("_of")) & F.struct(*left).eqNullSafe(F.col("_value")), "left_semi")
    return rows.select(*df.columns).distinct()  # copies of a row


def one_per_key(df: DataFrame, key: Sequence[str], order_by: Sequence[str] | None) -> DataFrame:
    """The first row of each key by `order_by`; without it, keys are counted at once, and one that comes twice is an error."""
    if order_by:
        return dedup_natural_key(df, key, order_by)
    if not df.groupBy(key_digest(key).alias("_digest")).count().where("count > 1").isEmpty():
        raise ValueError(f"a key ({', '.join(key)}) comes twice: give order_by")
    return df


# ---- writes as new table states ------------------------------------------------------------------


def load_insert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    return current.unionByName(incoming)


def absent(current: DataFrame, incoming: DataFrame, key: Sequence[str], order_by: Sequence[str] | None = None) -> DataFrame:
    """Incoming rows whose key the table lacks, one per key; null is a value of a key."""
    fresh, known = one_per_key(incoming, key, order_by), keys_of(current, key)
    return fresh.join(known, same_key(fresh, known, key), "left_anti").select(*incoming.columns)


def load_insert_absent(
    current: DataFrame, incoming: DataFrame, key: Sequence[str], order_by: Sequence[str] | None = None
) -> DataFrame:
    return current.unionByName(absent(current, incoming, key, order_by))


def load_update(
    current: DataFrame, incoming: DataFrame, key: Sequence[str], order_by: Sequence[str] | None = None
) -> DataFrame:
    """Rows whose key comes in are replaced whole; keys the table lacks are not added."""
    new = keys_of(one_per_key(incoming, key, order_by), key, F.struct(*incoming.columns).alias("_new"))
    joined = current.join(new, same_key(current, new, key), "left")
    return joined.select(
        *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(current[c]).alias(c) for c in current.columns]
    )


def load_upsert(
    current: DataFrame, incoming: DataFrame, key: Sequence[str], order_by: Sequence[str] | None = None
) -> DataFrame:
    """Insert and update together; `order_by` picks among incoming rows of one key."""
    new = one_per_key(incoming, key, order_by)
    return load_delete(current, new, key).unionByName(new)


def load_delete(current: DataFrame, gone: DataFrame, key: Sequence[str]) -> DataFrame:
    known = keys_of(gone, key).distinct()
    return current.join(known, same_key(current, known, key), "left_anti").select(*current.columns)


# ---- reads and change sets -----------------------------------------------------------------------


def get_all(table: DataFrame) -> DataFrame:
    return table


def get_where(table: DataFrame, condition: Column) -> DataFrame:
    return table.where(condition)


def get_one(table: DataFrame, condition: Column, order_by: Sequence[str]) -> DataFrame:
    """First row that satisfies a condition, by `order_by`."""
    return table.where(condition).orderBy(*order_by).limit(1)


def pending_changes(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys with a pending change: `added`, `modified` or `deleted`."""
    values = [c for c in old.columns if c not in key]
    side = lambda df, name: df.select(*key, F.struct(*values).alias(name), F.lit(True).alias(f"_in_{name}"))
    both = side(old, "old").join(side(new, "new"), list(key), "full")
    change = (
        F.when(F.col("_in_old").isNull(), "added")
        .when(F.col("_in_new").isNull(), "deleted")
        .when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    )
    return both.select(*key, change.alias("change")).where("change IS NOT NULL")


def set_difference(total: DataFrame, applied: DataFrame) -> DataFrame:
    """Distinct rows of `total` that are not in `applied`; copies are reduced before the shuffle."""
    return total.distinct().subtract(applied.distinct())
