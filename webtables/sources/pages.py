"""Page snapshots: reading, storing for lookups, lookup by URL, cutting before the parse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import written
from .tiers import PART, part_of, parts_in

BODY_TAG = r"(?is)^(.*?<body(?:\s[^>]*)?>)"


def page_source(spark: SparkSession, directory: str, name: str = "pages") -> DataFrame:
    """`page_id, url, html` of a snapshot, in the splits that the reader's settings give (`spark.sql.files.*`)."""
    return spark.read.parquet(f"{directory}/{name}.parquet").select("page_id", "url", "html")


def newest_pages(pages: DataFrame) -> DataFrame:
    """`url, page_id` of the newest copy of each URL. Reads the two small columns only."""
    return pages.groupBy("url").agg(F.max("page_id").alias("page_id"))


class Snapshot:
    """A snapshot stored in partitions by a hash of the URL, so that a lookup reads the partitions of its URLs only."""

    def __init__(self, spark: SparkSession, path: str, parts: int):
        self.path, self.parts = path, parts
        self.pages = spark.read.schema(f"page_id BIGINT, url STRING, html STRING, {PART} INT").parquet(path)

    def holding(self, asked: DataFrame) -> DataFrame:
        """The stored pages of the partitions that `asked` (with `url`) falls into."""
        found = parts_in(asked.select(part_of(["url"], self.parts).alias(PART)))
        return self.pages.where(F.col(PART).isin(found))


def store_snapshot(pages: DataFrame, path: str, parts: int = 256) -> Snapshot:
    """Write `page_id, url, html` once for many lookups. A URL with very many copies is spread over several files.

    Choose `parts` so that one holds what a lookup may read, say a gigabyte.
    """
    rows = pages.select("page_id", "url", "html", part_of(["url"], parts).alias(PART))
    rows.hint("rebalance", PART).write.partitionBy(PART).parquet(path)
    return Snapshot(pages.sparkSession, path, parts)


def resolve_pages(
    urls: DataFrame, pages: DataFrame | Snapshot, newest: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = written
) -> tuple[DataFrame, DataFrame]:
    """Look requested URLs up in a snapshot: (found with `page_id, html`, missing for a retry).

    Where the snapshot holds several copies of a URL the newest (`page_id`) answers; `newest` can be given
    when many lookups share it. Copies are reduced on ids, before page text is touched, and the text is then
    fetched by `page_id`, which is unique: a URL with very many copies or requests makes no large group. The ids
    asked for are written first (`keep`), so that their size is known: where Spark can broadcast them, no page moves,
    and beyond that it filters the pages by them before the shuffle. Of a stored `Snapshot` only the partitions of
    the URLs asked for are read, also for the newest copies.
    """
    if isinstance(pages, Snapshot):
        urls = keep(urls, "urls")
        pages = pages.holding(urls)
        newest = newest_pages(pages.join(urls.select("url").distinct(), "url", "left_semi"))
    newest = newest_pages(pages) if newest is None else newest
    asked = keep(urls.join(newest, "url"), "asked")
    found = asked.join(pages.select("page_id", "html"), "page_id")
    missing = urls.join(asked.select("url").distinct(), "url", "left_anti")
    return found.select(*urls.columns, "page_id", "html"), missing


def _position(marker: str):
    """Place of the first `marker` in the body's content, from 1; 0 when it is missing."""
    start = F.length(F.regexp_extract("html", BODY_TAG, 1)) + 1
    return F.call_function("locate", F.lit(marker), F.col("html"), start)


def marked(pages: DataFrame, marker: str) -> DataFrame:
    """All pages, cut before the first `marker` of the body, with `marked`; a page without it has null HTML."""
    placed = pages.withColumn("_at", F.coalesce(_position(marker), F.lit(0)))
    cut = F.when(F.col("_at") > 0, F.concat(F.lit("<body>"), F.expr("substring(html, _at)")))
    return placed.select(*[cut.alias("html") if c == "html" else F.col(c) for c in pages.columns], (F.col("_at") > 0).alias("marked"))


def truncate_before(pages: DataFrame, marker: str) -> tuple[DataFrame, DataFrame]:
    """Drop the body's HTML before the first `marker`: (cut pages, pages without the marker)."""
    placed = pages.withColumn("_at", _position(marker))
    cut = F.concat(F.lit("<body>"), F.expr("substring(html, _at)"))
    kept = placed.where("_at > 0").withColumn("html", cut).select(*pages.columns)
    return kept, placed.where("NOT coalesce(_at > 0, false)").select(*pages.columns)


def truncate_until(pages: DataFrame, marker: str) -> tuple[DataFrame, DataFrame]:
    """Drop the body's HTML from the first `marker` on: (cut pages, pages without the marker)."""
    placed = pages.withColumn("_at", _position(marker))
    kept = placed.where("_at > 0").withColumn("html", F.expr("substring(html, 1, _at - 1)")).select(*pages.columns)
    return kept, placed.where("NOT coalesce(_at > 0, false)").select(*pages.columns)
