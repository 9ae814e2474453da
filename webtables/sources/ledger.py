"""The crawl ledger: `source, url, crawl_ts`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def read_crawl_ledger(ledger: DataFrame, source) -> DataFrame:
    """URLs of one source, newest first."""
    return ledger.where(F.col("source") == F.lit(source)).orderBy(F.desc("crawl_ts"), F.desc("url"))


def append_crawl_ledger(ledger: DataFrame, urls: DataFrame, source, ts: Column) -> DataFrame:
    """The ledger with new entries for `urls`."""
    entries = urls.select(F.lit(source).alias("source"), "url", ts.alias("crawl_ts"))
    return ledger.select("source", "url", "crawl_ts").unionByName(entries)


def write_crawl_ledger(urls: DataFrame, source, ts: Column, path: str) -> None:
    """Append entries to a ledger folder without reading it."""
    urls.select(F.lit(source).alias("source"), "url", ts.alias("crawl_ts")).write.mode("append").parquet(path)
