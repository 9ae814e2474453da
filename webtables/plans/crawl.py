"""A whole crawl of one spec: snapshot, spec and ledger in, messages and ledger entries out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.crawl import URL_TYPE, crawl_sources, direct_urls, extract_links, start_url, url_messages
from ..operators.errors import log_rows
from ..session import written
from ..sources.pages import resolve_pages


def crawl(
    pages: DataFrame, spec: dict, ledger: DataFrame, as_of: Column, max_rounds: int | None = None, errors: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(messages `body, type`, new ledger entries `source, url, crawl_ts`).

    First the spec's direct URLs that the ledger lacks. Then, from the newest ledger entry or else from base
    and suffix, page by page along the spec's `next` links: every page not crawled before sends the links
    its target finds. A page the snapshot lacks sends nothing and is not entered; with `errors` it is appended there, in the
    shape of the error log.
    """
    extraction = spec.get("extraction", spec)
    source, spark = extraction["name"], pages.sparkSession
    known = ledger.where(F.col("source") == source)
    given = spark.createDataFrame([(u,) for u in extraction.get("directUrls") or []], "url STRING")
    direct = direct_urls(given, known)
    sent, entered = direct, direct
    if extraction.get("urlBase") is not None:
        start = start_url(extraction["urlBase"], extraction.get("urlSuffix"), known)
        visited = crawl_sources(pages, extraction, start.select(F.lit(source).alias("source"), "url"), known, max_rounds)
        found, missing = resolve_pages(visited.select("url"), pages)
        found = written(found, "crawled")
        if errors:
            lost = missing.distinct().select(F.lit(source).alias("source"), F.lit("no page").alias("message"), F.col("url").alias("detail"))
            log_rows("crawl", lost).write.mode("append").parquet(errors)
        targets = extract_links(found, extraction).select(F.col("dst_url").alias("url"))
        sent, entered = sent.unionByName(targets), entered.unionByName(found.select("url"))
    class_type = extraction["target"].get("classType") or URL_TYPE
    entries = entered.distinct().select(F.lit(source).alias("source"), "url", as_of.alias("crawl_ts"))
    return url_messages(sent, class_type), entries
