"""Queries over links, pagination and frontiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.operators.crawl import (
    backtrack, crawl_frontier, crawl_sources, crawl_to_queue, direct_urls, extract_links, find_next, paginate,
    start_url,
)
from webtables.plans.crawl import crawl
from webtables.session import scratch_path
from webtables.sources.pages import page_source

from . import render, specs
from .pages_checks import ledger, listed
from .registry import check
from .render import BASE, table


@check("""
SELECT DISTINCT url FROM (SELECT '/e/' || user_id AS url, event_type FROM events)
WHERE url NOT IN (SELECT '/e/' || user_id FROM events WHERE event_type = 'signup' AND value > 85)""", name="direct_urls")
def direct_urls_events(spark, sf):
    events = table(spark, sf, "events")
    url = F.format_string("/e/%d", "user_id").alias("url")
    given = events.select(url).union(events.select(F.lit("").alias("url")))
    return direct_urls(given, events.where("event_type = 'signup' AND value > 85").select(url))


@check("""
SELECT arg_max('/e/' || event_id, (ts, event_id)) AS url, 'resumed' AS kind FROM events
UNION ALL SELECT 'https://shop.example/list/0/0', 'fresh' FROM (SELECT count(*) FROM events)""", name="start_url")
def start_url_events(spark, sf):
    known = ledger(spark, sf)
    base = "https://shop.example"
    resumed = start_url(base, "/list/0/0", known).withColumn("kind", F.lit("resumed"))
    return resumed.union(start_url(base, "/list/0/0", known.where("source = 'none'")).withColumn("kind", F.lit("fresh")))


@check("""
SELECT event_type AS source, arg_max('/e/' || event_id, ts) AS url FROM events WHERE value <= 20 GROUP BY 1""", name="backtrack")
def backtrack_events(spark, sf):
    events = table(spark, sf, "events")
    checked = events.where("value > 20").select(F.col("event_type").alias("source"), F.format_string("/e/%d", "event_id").alias("url"))
    return backtrack(ledger(spark, sf), checked)


@check(f"""
SELECT src_url, i AS position, CASE WHEN regexp_matches(href, '[\\s"<>\\\\^`{{|}}]|%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN href
       ELSE '{BASE}' || href END AS dst_url
FROM ({listed('<a href="([^"]*)"', "href")}) JOIN (SELECT page_id, url AS src_url FROM pages) USING (page_id)""", name="extract_links")
def extract_links_nav(spark, sf):
    return extract_links(page_source(spark, sf), specs.NAV_LINKS)


LISTING_SQL = f"""
SELECT DISTINCT o_orderkey // 100 AS p, (o_orderkey // 100) // 8 AS s, (o_orderkey // 100) % 8 AS k FROM orders"""


@check(f"""
WITH page AS ({LISTING_SQL}),
crawled AS (SELECT '/list/' || s || '/' || k AS href FROM page WHERE k < 4),
candidate AS (
  SELECT a.p, 0 AS place, 0 AS pos, '/list/' || a.s || '/' || (a.k - 1) AS href FROM page a WHERE a.k > 0
  UNION ALL SELECT a.p, 0, 1, '/list/' || a.s || '/' || (a.k + 1) FROM page a JOIN page b ON b.p = a.p + 1 WHERE a.k < 7
  UNION ALL SELECT a.p, 1, 0, '/more/' || a.p FROM page a WHERE a.k % 4 = 0),
firsts AS (SELECT p, place, arg_min(href, pos) AS href FROM candidate WHERE href NOT IN (SELECT href FROM crawled) GROUP BY 1, 2)
SELECT '{BASE}/list/' || s || '/' || k AS src_url, '{BASE}' || min(href) AS next_url FROM firsts JOIN page USING (p) GROUP BY p, s, k""", name="find_next")
def find_next_listing(spark, sf):
    pages = render.listings(spark, sf)
    crawled = pages.select("url").where(F.regexp_extract("url", "([0-9]+)$", 1).cast("int") < 4)
    return find_next(pages, specs.LISTING, crawled)


@check(f"""
WITH page AS ({LISTING_SQL})
SELECT '{BASE}/list/' || s || '/0' AS start, '{BASE}/list/' || s || '/' || k AS url, k AS step FROM page""", name="paginate")
def paginate_listing(spark, sf):
    pages = render.listings(spark, sf)
    links = extract_links(pages, specs.PAGER_LINKS).select("src_url", F.col("dst_url").alias("next_url"))
    return paginate(links, pages.select("url").where("url LIKE '%/0'"))


@check(f"""
SELECT DISTINCT '{BASE}/i/' || (o_orderkey // 100) AS url, 0 AS depth FROM orders
UNION ALL SELECT '{BASE}/o/' || o_orderkey, 1 FROM orders
UNION ALL SELECT DISTINCT '{BASE}/c/' || o_custkey, 2 FROM orders""", name="crawl_frontier")
def crawl_frontier_site(spark, sf):
    pages = render.site(spark, sf)
    return crawl_frontier(extract_links(pages, specs.SITE_LINKS), pages.select("url").where(f"url LIKE '{BASE}/i/%'"))


@check(f"""
WITH page AS ({LISTING_SQL})
SELECT CAST(s AS VARCHAR) AS source, '{BASE}/list/' || s || '/' || k AS url, CAST(k AS INTEGER) AS step FROM page""", name="crawl_sources")
def crawl_sources_listing(spark, sf):
    """The pager leads both ways and detours tempt; each chain is still walked once, in order."""
    pages = render.listings(spark, sf)
    starts = pages.where("url LIKE '%/0'").select(F.regexp_extract("url", "list/([0-9]+)/", 1).alias("source"), "url")
    return crawl_sources(pages, specs.LISTING, starts)


#: One listing of all blocks of orders: its pager leads both ways, a direct URL and a ledger are given.
CRAWL = specs.LISTING["extraction"] | {"urlSuffix": "/list/0/0", "directUrls": [f"{BASE}/order/1", f"{BASE}/order/0", ""]}


@check(f"""
WITH page AS ({LISTING_SQL} WHERE o_orderkey // 100 < 8),
crawled AS (SELECT * FROM page WHERE k IN (2, 5)),
visited AS (SELECT * FROM page WHERE k IN (0, 1, 3, 4))
SELECT 'message' AS kind, '{{"url":"{BASE}/order/' || o_orderkey || '"}}' AS text FROM orders JOIN visited ON p = o_orderkey // 100
UNION ALL SELECT 'message', '{{"url":"{BASE}/order/1"}}' FROM (SELECT count(*) FROM page)
UNION ALL SELECT 'entry', '{BASE}/list/' || s || '/' || k FROM visited
UNION ALL SELECT 'entry', '{BASE}/order/1' FROM (SELECT count(*) FROM page)
UNION ALL SELECT 'left', '{BASE}/list/0/2' FROM (SELECT count(*) FROM page)
UNION ALL SELECT 'crawl: no page', '{BASE}/more/0' FROM (SELECT count(*) FROM page)""", name="crawl")
def crawl_listing(spark, sf):
    """Direct URLs, the newest ledger entry, next links both ways and the way back from dead ends."""
    pages = render.listings(spark, sf)
    # the crawl stood at block 5, and before at block 2: from 5 it goes back to 3, then on from 2 to 0
    entered = [("listing", f"{BASE}/list/0/2", "2024-01-01"), ("listing", f"{BASE}/list/0/5", "2024-01-02"), ("listing", f"{BASE}/order/0", "2023-01-01"), ("other", f"{BASE}/list/0/3", "2024-01-03")]
    known = spark.createDataFrame(entered, "source STRING, url STRING, crawl_ts STRING").withColumn("crawl_ts", F.col("crawl_ts").cast("timestamp"))
    errors = scratch_path(spark, "crawl-errors")
    messages, entries = crawl(pages, CRAWL, known, F.lit("2024-02-01").cast("timestamp"), errors=errors)
    lost = spark.read.parquet(errors).select(F.concat_ws(": ", "service", "message"), "log_message")
    back = backtrack(known.where("source = 'listing'"), entries.select("source", "url").union(known.select("source", "url").where("url NOT LIKE '%/2'")))
    return messages.select(F.lit("message").alias("kind"), F.col("body").alias("text")).union(entries.select(F.lit("entry"), "url")).union(back.select(F.lit("left"), "url")).union(lost)


@check("""SELECT '{"url":"' || url || '"}' AS body, 'Url' AS type FROM pages""", name="crawl_to_queue")
def crawl_to_queue_pages(spark, sf):
    path = scratch_path(spark, "queue")
    crawl_to_queue(page_source(spark, sf), path, "Url")
    return spark.read.parquet(path)
