"""Links, pagination and crawl frontiers over page snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.match import tag_name
from ..functions.text import apply_regex
from ..functions.urls import resolve_url
from ..session import bucketed, forget, removed, scratch, scratch_path, written
from ..sources.dom import parse_pages
from ..sources.pages import newest_pages
from ..sources.tiers import Tiers
from .chains import intervals, pages_of, rank_chains
from .navigate import from_body, navigate, routes
from .select import children, children_by_tag, first_child, has_child, let

URL_TYPE = "Url"


def _attr(node: Column, name: str | None) -> Column:
    return F.try_element_at(node["attrs"], F.lit(tag_name(name or "href")))


# ---- ledger --------------------------------------------------------------------------------------


def not_crawled(urls: DataFrame, ledger: DataFrame, on: list[str] | None = None) -> DataFrame:
    """URLs the ledger does not hold. A URL the ledger holds very often is reduced before the shuffle."""
    on = on or ["url"]
    return urls.join(ledger.select(*on).distinct(), on, "left_anti")


def direct_urls(urls: DataFrame, ledger: DataFrame) -> DataFrame:
    """URLs given outright, once each, without empty and already crawled ones."""
    return not_crawled(urls.where("url IS NOT NULL AND url <> ''").select("url").distinct(), ledger)


def start_url(base: str, suffix: str | None, ledger: DataFrame) -> DataFrame:
    """The newest ledger entry to resume from, else base and suffix. One row, `url`."""
    last = F.max(F.struct("crawl_ts", "url"))["url"]
    return ledger.agg(F.coalesce(last, resolve_url(F.lit(base), F.lit(suffix).cast("string"))).alias("url"))


def backtrack(ledger: DataFrame, checked: DataFrame) -> DataFrame:
    """Per source the last crawled URL not checked yet; a source without one is done."""
    open_urls = not_crawled(ledger, checked, ["source", "url"])
    return open_urls.groupBy("source").agg(F.max(F.struct("crawl_ts", "url"))["url"].alias("url"))


# ---- links ---------------------------------------------------------------------------------------


def link_values(nodes: Column, matches: Column, target: dict) -> Column:
    """`{href, n}` of the matching direct children of each match that passes the recon; `n`: routes that lead there."""
    recon = target.get("recon")
    if recon:
        where = (recon.get("tag"), recon.get("keyProperty"), recon.get("valueProperty"))
        matches = F.filter(matches, lambda m: has_child(nodes, m, *where))
    where = (target.get("tag"), target.get("keyProperty"), target.get("valueProperty"))
    values = lambda m: F.transform(children(nodes, m, *where), lambda n: F.struct(_attr(n, target.get("value")).alias("href"), m["n"].alias("n")))
    return F.filter(F.flatten(F.transform(matches, values)), lambda v: v["href"].isNotNull())


def extract_links(pages: DataFrame, spec: dict) -> DataFrame:
    """`src_url, position, dst_url`; a link that stands twice on a page is there twice."""
    extraction = spec.get("extraction", spec)
    dom = parse_pages(pages.select(F.col("url").alias("page_id"), "html"))
    hrefs = link_values(F.col("nodes"), navigate(F.col("nodes"), extraction.get("navigation")), extraction["target"])
    rows = routes(dom, hrefs).select(F.col("page_id").alias("src_url"), F.col("path_id").cast("int").alias("position"), "href")
    resolved = resolve_url(F.lit(extraction.get("urlBase")).cast("string"), apply_regex(F.col("href"), extraction["target"].get("regex")))
    return rows.select("src_url", "position", resolved.alias("dst_url"))


def next_candidates(pages: DataFrame, spec: dict) -> DataFrame:
    """All links that may lead on: `page_id, src_url, place` (of the `next` entry by level), `position, href, url`."""
    extraction = spec.get("extraction", spec)
    nodes = F.col("nodes")

    def hrefs(entry: dict) -> Column:
        start = navigate(nodes, entry["navigation"]) if entry.get("navigation") else from_body(nodes)
        holder = F.get(start, F.lit(0))
        recon = entry.get("recon")
        if recon:
            where = (recon.get("tag"), recon.get("keyProperty"), recon.get("valueProperty"))
            holder = let(holder, lambda n: F.when(n.isNotNull(), first_child(nodes, n, *where)))
        links = lambda n: F.transform(children_by_tag(nodes, n, entry["tag"]), lambda c: _attr(c, entry.get("value")))
        return F.coalesce(let(holder, lambda n: F.when(n.isNotNull(), links(n))), F.array().cast("array<string>"))

    entries = sorted(extraction.get("next") or [], key=lambda e: e.get("level") or 0)

    def listed_at(place: int, entry: dict) -> Column:
        row = lambda h, i: F.struct(F.lit(place).alias("place"), i.alias("position"), h.alias("href"))
        return F.transform(hrefs(entry), row)

    listed = [listed_at(place, entry) for place, entry in enumerate(entries)]
    found = F.flatten(F.array(*listed)) if listed else F.array().cast("array<struct<place:int,position:int,href:string>>")
    dom = parse_pages(pages.select("page_id", "url", "html"))
    rows = dom.select("page_id", F.col("url").alias("src_url"), F.inline(found)).where("href IS NOT NULL")
    return rows.withColumn("url", resolve_url(F.lit(extraction.get("urlBase")).cast("string"), F.col("href")))


def choose_next(candidates: DataFrame, places: int, by: str = "src_url") -> DataFrame:
    """Per page: the first candidate of each `next` entry, then the smallest of those texts."""
    first = lambda k: F.min(F.when(F.col("place") == k, F.struct("position", "href", "url")))
    firsts = candidates.groupBy(by).agg(F.array_compact(F.array(*[first(k) for k in range(places)])).alias("c"))
    smallest = F.array_min(F.transform("c", lambda c: F.struct(c["href"], c["url"])))
    return firsts.select(by, smallest["url"].alias("next_url"))


def find_next(pages: DataFrame, spec: dict, ledger: DataFrame) -> DataFrame:
    """`src_url, next_url`: where each page leads on to, among URLs not crawled yet. One page per URL."""
    places = len(spec.get("extraction", spec).get("next") or [])
    open_links = not_crawled(next_candidates(pages, spec), ledger)
    return choose_next(open_links, places) if places else open_links.selectExpr("src_url", "url AS next_url").limit(0)


# ---- many pages on -------------------------------------------------------------------------------


def paginate(next_links: DataFrame, starts: DataFrame) -> DataFrame:
    """Follow `src_url -> next_url` from each `url` of `starts` to the end: `start, url, step`.

    Pages are ranked in their chains once (`rank_chains`), a start is one interval of a chain (`intervals`), and only
    the result has a row per start and page. A chain that runs into itself stops there. Of several next links of a page
    the smallest counts.
    """
    chains = rank_chains(next_links)
    return pages_of(chains, intervals(chains, starts))


#: URLs for which links are looked up by value, so that other buckets and row groups are not read.
LOOKED_UP = 256


def links_from(links: DataFrame, urls: DataFrame) -> DataFrame:
    """The bucketed `links` that may start at one of `urls`: all of them, or for few URLs those of their buckets."""
    few = [r[0] for r in urls.select("url").limit(LOOKED_UP + 1).collect()]
    return links.where(F.col("src_url").isin(few)) if len(few) <= LOOKED_UP else links


def crawl_frontier(links: DataFrame, seeds: DataFrame, max_depth: int | None = None, parts: int | None = None) -> DataFrame:
    """Every URL reachable from the seeds with its least number of hops: `url, depth`.

    One level per round: the frontier's links, without duplicates and without URLs seen before. Levels are
    written to the shared folder, so the plan does not grow and a lost executor costs no earlier level.
    The links are bucketed once, so rounds shuffle the frontier only, and a small frontier reads its buckets only.
    URLs seen before are kept in `Tiers` of `parts` partitions (as many as shuffles have, unless given): a level reads those that its URLs fall into. The driver
    learns whether a level is empty, and the URLs of one with a few.
    """
    spark = links.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges, table = bucketed(links.select("src_url", "dst_url").where("dst_url IS NOT NULL"), "src_url", "edges", distinct=True)
    path = scratch_path(spark, "frontier")
    seen = Tiers(spark, scratch_path(spark, "seen"), T.StructType().add("url", T.StringType()), ["url"], parts)
    level = lambda k: spark.read.schema("url STRING").parquet(f"{path}/depth={k}")
    depth = 0
    try:
        seeds.select("url").where("url IS NOT NULL").distinct().write.parquet(f"{path}/depth=0")
        while (max_depth is None or depth < max_depth) and not level(depth).isEmpty():
            seen.add(depth, level(depth))
            found = level(depth).join(links_from(edges, level(depth)), F.col("url") == F.col("src_url")).select(F.col("dst_url").alias("url"))
            with scratch(spark) as keep:
                seen.absent(depth + 1, found.distinct(), keep).write.parquet(f"{path}/depth={depth + 1}")
            depth += 1
    finally:
        forget(spark, table)
        removed(spark, seen.path)
    return spark.read.schema("url STRING, depth INT").parquet(path)


def crawl_sources(
    pages: DataFrame, spec: dict, starts: DataFrame, ledger: DataFrame | None = None, max_rounds: int | None = None, parts: int | None = None
) -> DataFrame:
    """Crawl every source page by page, all sources side by side: `source, url, step`.

    `starts` holds one `source, url` each. A source moves to the page `choose_next` picks among links it
    has not been to; without one it goes back to its newest ledger entry not revisited yet, and ends when
    there is none. Of several copies of a page the newest counts. Step n of all sources is one round, so the number of
    rounds is that of the longest crawl; where each page has one fixed next link, `paginate` needs far fewer. A round
    reads the links of its own pages (see `links_from`) and, of the pages visited before and of the ledger, the
    partitions that its candidates fall into.
    """
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = len(spec.get("extraction", spec).get("next") or [])
    copies = newest_pages(pages).withColumnRenamed("url", "src_url")
    candidates = next_candidates(pages, spec).join(copies, ["src_url", "page_id"], "left_semi")
    links, table = bucketed(candidates.drop("page_id"), "src_url", "candidates")
    columns = T.StructType().add("source", T.StringType()).add("url", T.StringType())
    path = scratch_path(spark, "crawl")
    been = Tiers(spark, scratch_path(spark, "been"), columns, columns.names, parts)
    entered = Tiers(spark, scratch_path(spark, "entered"), columns, columns.names, parts)
    known = None
    if ledger is not None:
        known = written(ledger.select(F.col("source").cast("string"), "url", "crawl_ts"), "known")
        entered.add(0, known.select("source", "url").distinct())
    at = lambda step: spark.read.schema(columns).parquet(f"{path}/step={step}")
    step = 0
    try:
        starts.select(F.col("source").cast("string"), "url").distinct().write.parquet(f"{path}/step=0")
        while places and (max_rounds is None or step < max_rounds) and not at(step).isEmpty():
            been.add(step, at(step))
            with scratch(spark) as keep:
                here = at(step).select("url").distinct()  # many sources may stand on one page
                from_here = keep(links_from(links.withColumnRenamed("url", "to"), here).join(here, F.col("src_url") == F.col("url"), "left_semi"), "from-here")
                onward = at(step).join(from_here, F.col("url") == F.col("src_url"))
                onward = onward.select("source", "place", "position", "href", F.col("to").alias("url"))
                open_ = keep(been.absent(step + 1, onward, keep), "open")
                moves = choose_next(open_ if known is None else entered.absent(1, open_, keep), places, "source")
                moves = keep(moves.select("source", F.col("next_url").alias("url")), "moves")
                stuck = keep(at(step).select("source").join(moves, "source", "left_anti"), "stuck")
                if known is not None and not stuck.isEmpty():  # the ledger and the visited pages are cut to their sources
                    mine = lambda df: df.join(stuck, "source", "left_semi")
                    visited = been.read(been.before(step + 1)).select("source", "url")
                    moves = moves.unionByName(stuck.join(backtrack(mine(known), mine(visited)), "source"))
                moves.write.parquet(f"{path}/step={step + 1}")
            step += 1
    finally:
        forget(spark, table)
        removed(spark, been.path)
        removed(spark, entered.path)
    visited = spark.read.schema("source STRING, url STRING, step INT").parquet(path)
    return visited if known is None else not_crawled(visited, known, ["source", "url"])


def url_messages(urls: DataFrame, class_type: str) -> DataFrame:
    return urls.select(F.to_json(F.struct("url")).alias("body"), F.lit(class_type).alias("type"))


def crawl_to_queue(urls: DataFrame, path: str, class_type: str = URL_TYPE) -> None:
    """Append one `{url}` message with its type per target URL to a queue folder."""
    url_messages(urls, class_type).write.mode("append").parquet(path)
