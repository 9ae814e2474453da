"""Queues as tables of messages: depth, bounds, routing, retries, failure policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

QUEUE_LIMIT = 10_000
#: Fixed value: what a database says of a key that it holds already.
DUPLICATE = "Cannot insert duplicate key"
PART_ROWS = 1_000_000  # messages of a part of a queue, about


def queue_depth(messages: DataFrame) -> DataFrame:
    return messages.groupBy("queue").agg(F.count("*").alias("depth"))


def route_by_type(messages: DataFrame, class_type: str) -> DataFrame:
    return messages.where(F.col("type") == class_type)


def bounded_queue(messages: DataFrame, n: int = QUEUE_LIMIT, order_by: Sequence[str] = ("ts",), part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """(the newest `n` messages per queue, the overflow). `order_by` must be unique within a queue.

    Only the n-th newest message matters. It is found in two rounds, the first within salted parts of a
    queue, so that no task sorts a whole hot queue; every message is then compared with it. There are as many
    parts as the messages need, which are counted first.
    """
    place = F.struct(*order_by)
    salt = F.pmod(F.xxhash64(*order_by), F.lit(max(1, -(-messages.count() // part_rows))))
    newest_first = lambda *by: Window.partitionBy(*by).orderBy(F.desc("_at"))
    keyed = messages.select("queue", place.alias("_at"), salt.alias("_salt"))
    part = keyed.withColumn("_rn", F.row_number().over(newest_first("queue", "_salt"))).where(F.col("_rn") <= n)
    ranked = part.select("queue", "_at").withColumn("_rn", F.row_number().over(newest_first("queue")))
    floor = ranked.where(F.col("_rn") == n).select("queue", F.col("_at").alias("_floor"))
    judged = messages.join(floor, "queue", "left").withColumn("_kept", F.coalesce(place >= F.col("_floor"), F.lit(True)))
    return (
        judged.where("_kept").select(*messages.columns),
        judged.where("NOT _kept").select(*messages.columns),
    )


def retry_or_dead_letter(
    failed: DataFrame, attempts: DataFrame, k: int, key: Sequence[str] = ("message_id",)
) -> tuple[DataFrame, DataFrame]:
    """(to retry, dead): `attempts` holds earlier tries per key; a message gets `k` tries in all."""
    tried = failed.join(attempts.select(*key, F.col("attempts").alias("_before")), list(key), "left")
    counted = tried.withColumn("attempts", F.coalesce("_before", F.lit(0)) + 1).drop("_before")
    return counted.where(F.col("attempts") < k), counted.where(F.col("attempts") >= k)


def failure_policy(causes: Column) -> Column:
    """`ack` (drop) when any cause is a duplicate key, else `retry`; `causes` are messages, outermost first."""
    duplicate = F.exists(causes, lambda c: F.contains(c, F.lit(DUPLICATE)))
    return F.when(F.coalesce(duplicate, F.lit(False)), "ack").otherwise("retry")
