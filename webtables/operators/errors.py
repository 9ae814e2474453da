"""The error log: rows and retention."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.match import LEVELS, level_at_least

MIN_RETENTION = timedelta(minutes=30)


def error_log_rows(failed: DataFrame, utc: bool = False) -> DataFrame:
    """Rows with `service, source, message, log_message, exception, ts` in the log's shape.

    `utc` writes the time as UTC instead of the session's time zone.
    """
    ts = F.to_utc_timestamp("ts", F.current_timezone()) if utc else F.col("ts")
    return failed.select(
        "service",
        "source",
        "message",
        "log_message",
        F.coalesce("exception", F.lit("")).alias("exception"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("dt_error"),
    )


def log_rows(service: str, failed: DataFrame) -> DataFrame:
    """`source, message, detail` of now in the shape of the error log."""
    return error_log_rows(
        failed.select(
            F.lit(service).alias("service"), "source", "message", F.col("detail").alias("log_message"),
            F.lit(None).cast("string").alias("exception"), F.current_timestamp().alias("ts"),
        )
    )


def retention(log: DataFrame, as_of: Column, period: timedelta, ts: str = "ts") -> DataFrame:
    """Entries not older than `period`, which counts as at least 30 minutes."""
    seconds = max(period, MIN_RETENTION).total_seconds()
    return log.where(F.col(ts) >= as_of - F.make_dt_interval(secs=F.lit(seconds)))


def level_filter(events: DataFrame, minimum: str, level: str = "level", levels=LEVELS) -> DataFrame:
    """Events at or above a severity."""
    return events.where(level_at_least(F.col(level), minimum, levels))
