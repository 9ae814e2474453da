"""Queries over the page snapshot: sources, selection, values, navigation, scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.functions.match import contains_alnum, match_value
from webtables.functions.messages import entity_text, flatten_record, message_json, parse_message
from webtables.functions.text import (
    clean_cell, classification_value, first_classification, safe_suffix, text_remove, text_remove_ci, text_replace, text_split,
)
from webtables.functions.urls import resolve_url, url_host, url_path
from webtables.operators.crawl import not_crawled
from webtables.operators.errors import level_filter
from webtables.operators.navigate import classify_node, group_containers, matches_table, navigate, navigate_flat
from webtables.operators.select import (
    children_by_tag, descendants, first_child, first_descendant, has_child, node_attr, node_by_id, node_inner_html,
    node_own_text, node_text, recon_value, root, target_value,
)
from webtables.plans.extract import extract_entities
from webtables.sources.dom import dom_nodes, page_text, parse_pages
from webtables.sources.ledger import append_crawl_ledger, read_crawl_ledger
from webtables.session import scratch_path
from webtables.sources.pages import page_source, resolve_pages, store_snapshot, truncate_before, truncate_until

from . import render, specs
from .registry import check
from .render import table

BODY = "substr(html, strpos(html, '<body>'))"
BOOK_SQL = """
SELECT o_orderkey // 40 AS page_id, CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderstatus AS status, CAST(o_orderkey AS VARCHAR) AS "order",
       row_number() OVER (PARTITION BY o_orderkey // 40 ORDER BY year(o_orderdate), o_orderstatus, o_orderkey) - 1 AS i
FROM orders"""


def nodes():
    return F.col("nodes")


def parsed(spark, sf, detail=False):
    return parse_pages(page_source(spark, sf).select("page_id", "html"), detail)


def listed(pattern, names, source=BODY):
    """SQL: every match of a pattern per page, with its place."""
    return f"""
    SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS i, unnest(l) AS {names}
    FROM (SELECT page_id, regexp_extract_all({source}, '{pattern}', 1) AS l FROM pages)"""


# ---- sources -------------------------------------------------------------------------------------


@check("SELECT page_id, url, CAST(length(html) AS INTEGER) AS n FROM pages")
def pages_scan(spark, sf):
    return page_source(spark, sf).select("page_id", "url", F.length("html").alias("n"))


@check("""
SELECT url, CAST(length(html) AS INTEGER) AS n FROM pages
UNION ALL SELECT url || '/missing' AS url, -1 AS n FROM pages""", name="resolve_pages")
def resolve_pages_lookup(spark, sf):
    pages = page_source(spark, sf)
    urls = pages.select("url").union(pages.select(F.concat("url", F.lit("/missing"))))
    found, missing = resolve_pages(urls, pages)
    return found.select("url", F.length("html").alias("n")).union(missing.select("url", F.lit(-1)))


@check("""
SELECT url, CAST(length(html) AS INTEGER) AS n FROM pages WHERE page_id % 50 = 3
UNION ALL SELECT url || '/missing', -1 FROM pages WHERE page_id % 50 = 3""")
def snapshot_lookup(spark, sf):
    """A few URLs of a snapshot stored by URL, where every page also has an older copy."""
    pages = page_source(spark, sf)
    older = pages.select((-1 - F.col("page_id")).alias("page_id"), "url", F.lit("old").alias("html"))
    stored = store_snapshot(pages.unionByName(older), scratch_path(spark, "snapshot"), parts=32)
    few = pages.where("page_id % 50 = 3")
    found, missing = resolve_pages(few.select("url").union(few.select(F.concat("url", F.lit("/missing")))), stored)
    return found.select("url", F.length("html").alias("n")).union(missing.select("url", F.lit(-1)))


@check(f"""
SELECT page_id, len(regexp_extract_all({BODY}, '<p>')) AS p, len(regexp_extract_all({BODY}, '<li>')) AS li,
       len(regexp_extract_all({BODY}, '<a ')) AS a, len(regexp_extract_all({BODY}, '<h1>')) AS h1,
       len(regexp_extract_all({BODY}, '<article>')) AS article, len(regexp_extract_all({BODY}, '<footer>')) AS footer,
       len(regexp_extract_all({BODY}, '<br>')) AS br, len(regexp_extract_all({BODY}, '<!--')) AS comments
FROM pages""")
def dom_tag_counts(spark, sf):
    names = {"p": "p", "li": "li", "a": "a", "h1": "h1", "article": "article", "footer": "footer", "br": "br", "comments": "#comment"}
    return dom_nodes(parsed(spark, sf)).groupBy("page_id").agg(
        *[F.count_if(F.col("tag") == tag).alias(name) for name, tag in names.items()]
    )


@check(f"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace({BODY}, '</body>.*', '', 's'),
       '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g') AS text FROM pages""", name="page_text")
def visible_text(spark, sf):
    return page_text(parsed(spark, sf))


@check("SELECT page_id, '<body>' || substr(html, strpos(html, '<article>')) AS html FROM pages", name="truncate_before")
def truncate_before_marker(spark, sf):
    return truncate_before(page_source(spark, sf), "<article>")[0].select("page_id", "html")


@check("""
SELECT page_id, '<body>' || substr(html, strpos(html, '<article>'), strpos(html, '</article>') - strpos(html, '<article>')) AS html
FROM pages""")
def truncate_between(spark, sf):
    kept, _ = truncate_before(page_source(spark, sf), "<article>")
    return truncate_until(kept, "</article>")[0].select("page_id", "html")


@check("SELECT page_id FROM pages WHERE strpos(html, '</body>') = 0")
def truncate_marker_missing(spark, sf):
    return truncate_before(page_source(spark, sf), "</body>")[1].select("page_id")


def ledger(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("source"), F.format_string("/e/%d", "event_id").alias("url"), F.col("ts").alias("crawl_ts")
    )


@check("SELECT event_type AS source, '/e/' || event_id AS url, ts AS crawl_ts FROM events WHERE event_type = 'view'")
def crawl_ledger_read(spark, sf):
    return read_crawl_ledger(ledger(spark, sf), "view")


@check("""
SELECT source, count(*) AS n FROM (SELECT event_type AS source FROM events UNION ALL SELECT 'snapshot' FROM pages) GROUP BY 1""")
def crawl_ledger_append(spark, sf):
    grown = append_crawl_ledger(ledger(spark, sf), page_source(spark, sf), "snapshot", F.lit("2024-02-01").cast("timestamp"))
    return grown.groupBy("source").agg(F.count("*").alias("n"))


# ---- patterns and filters ------------------------------------------------------------------------


def matching(spark, sf, column, pattern):
    return table(spark, sf, "part").where(match_value(F.col(column), pattern)).select("p_partkey", column)


@check("SELECT p_partkey, p_type FROM part WHERE p_type IN ('STANDARD', 'PROMO')")
def match_value_or(spark, sf):
    return matching(spark, sf, "p_type", "STANDARD|PROMO")


@check("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%'")
def match_value_prefix(spark, sf):
    return matching(spark, sf, "p_name", "small%")


@check("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring'")
def match_value_suffix(spark, sf):
    return matching(spark, sf, "p_name", "%ring")


@check("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ue g%'")
def match_value_contains(spark, sf):
    return matching(spark, sf, "p_name", "%ue g%")


@check("SELECT p_partkey, p_name FROM part WHERE (p_name LIKE 'small%' OR p_name LIKE 'red%') AND p_name LIKE '%ring'")
def match_value_and(spark, sf):
    return matching(spark, sf, "p_name", "small%|red%&&%ring")


@check(listed('<div class="ad">([^<]*)</div>', "text"))
def match_attr(spark, sf):
    ads = F.transform(descendants(nodes(), root(nodes()), "div", "class", "ad"), lambda n: node_text(nodes(), n))
    return parsed(spark, sf).select("page_id", F.posexplode(ads).alias("i", "text"))


@check(listed('<li>(.*?)</li>', "text").replace("unnest(l)", "regexp_replace(unnest(l), '<[^>]*>', '', 'g')"), name="children_by_tag")
def children_of_list(spark, sf):
    items = lambda n: F.transform(children_by_tag(nodes(), n, "li"), lambda c: node_text(nodes(), c))
    first_list = first_descendant(nodes(), root(nodes()), "ul")
    return parsed(spark, sf).select("page_id", F.posexplode(items(first_list)).alias("i", "text"))


@check(f"SELECT page_id, regexp_extract({BODY}, '<ul><li><a [^>]*>([^<]*)', 1) AS text FROM pages", name="first_child")
def first_child_of_list(spark, sf):
    item = first_child(nodes(), first_descendant(nodes(), root(nodes()), "ul"), "li")
    return parsed(spark, sf).select("page_id", node_text(nodes(), item).alias("text"))


@check(listed('<a href="([^"]*)"', "href"), name="descendants")
def descendants_of_nav(spark, sf):
    links = F.transform(descendants(nodes(), first_descendant(nodes(), root(nodes()), "nav"), "a"), lambda n: n["attrs"]["href"])
    return parsed(spark, sf).select("page_id", F.posexplode(links).alias("i", "href"))


@check(f"SELECT page_id, regexp_extract({BODY}, '<article>.*?<p>(?:<b>)?([^<]*)', 1, 's') AS text FROM pages", name="first_descendant")
def first_descendant_of_article(spark, sf):
    first = first_descendant(nodes(), first_descendant(nodes(), root(nodes()), "article"), "p")
    return parsed(spark, sf).select("page_id", node_text(nodes(), first).alias("text"))


@check("""
SELECT '/i/' || (o_orderkey // 100) AS path, string_agg(o_orderstatus, '' ORDER BY o_orderkey) || 'none' AS text FROM orders GROUP BY 1
UNION ALL SELECT '/o/' || o_orderkey, 'buyerup' FROM orders
UNION ALL SELECT '/c/' || c_custkey, c_name FROM customer""", name="node_by_id")
def node_by_id_main(spark, sf):
    dom = parse_pages(render.site(spark, sf).select("url", "html"))
    main = node_by_id(nodes(), root(nodes()), "main")
    return dom.select(F.replace("url", F.lit(render.BASE), F.lit("")).alias("path"), node_text(nodes(), main).alias("text"))


@check(f"SELECT page_id, CAST(len(regexp_extract_all({BODY}, '<p><b>')) AS INTEGER) AS n FROM pages", name="has_child")
def has_child_b(spark, sf):
    owners = F.filter(descendants(nodes(), root(nodes()), "p"), lambda n: has_child(nodes(), n, "b"))
    return parsed(spark, sf).select("page_id", F.size(owners).alias("n"))


@check("SELECT '/c/' || c_custkey AS url FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", name="not_crawled")
def not_crawled_customers(spark, sf):
    urls = table(spark, sf, "customer").select(F.format_string("/c/%d", "c_custkey").alias("url"))
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return not_crawled(urls, urgent.select(F.format_string("/c/%d", "o_custkey").alias("url")))


@check("""
SELECT p_partkey, contains(regexp_replace(p_brand, '[^a-zA-Z0-9]', '', 'g'), 'Brand' || p_size) AS found FROM part""", name="contains_alnum")
def contains_alnum_brand(spark, sf):
    other = F.format_string("Br-and #%d!", "p_size")
    return table(spark, sf, "part").select("p_partkey", contains_alnum(F.col("p_brand"), other).alias("found"))


@check("SELECT event_id, event_type FROM events WHERE event_type IN ('purchase', 'error')", name="level_filter")
def level_filter_events(spark, sf):
    order = ("view", "click", "signup", "purchase", "error")
    return level_filter(table(spark, sf, "events"), "purchase", "event_type", order).select("event_id", "event_type")


# ---- values --------------------------------------------------------------------------------------


@check(f"SELECT page_id, regexp_extract({BODY}, '<h1>([^<]*)', 1) AS title FROM pages")
def article_titles(spark, sf):
    return parsed(spark, sf).select("page_id", node_text(nodes(), first_descendant(nodes(), root(nodes()), "h1")).alias("title"))


@check(f"""
SELECT page_id, CAST(generate_subscripts(h, 1) - 1 AS INTEGER) AS i, unnest(h) AS href, unnest(t) AS text FROM (
  SELECT page_id, regexp_extract_all({BODY}, '<li><a href="([^"]*)">', 1) AS h,
         regexp_extract_all({BODY}, '<li><a href="[^"]*">([^<]*)', 1) AS t FROM pages)""")
def nav_links(spark, sf):
    links = F.transform(
        descendants(nodes(), first_descendant(nodes(), root(nodes()), "nav"), "a"),
        lambda n: F.struct(node_attr(nodes(), n, "Href").alias("href"), node_text(nodes(), n).alias("text")),
    )
    rows = parsed(spark, sf).select("page_id", F.posexplode(links).alias("i", "a"))
    return rows.select("page_id", "i", "a.*")


@check(listed("<p><b>([^<]*)<br>", "text"))
def own_text(spark, sf):
    texts = F.transform(descendants(nodes(), root(nodes()), "b"), lambda n: node_own_text(nodes(), n))
    return parsed(spark, sf).select("page_id", F.posexplode(texts).alias("i", "text"))


@check(f"SELECT page_id, regexp_extract({BODY}, '<article>(.*?)</article>', 1, 's') AS html FROM pages")
def inner_html(spark, sf):
    article = first_descendant(nodes(), root(nodes()), "article")
    return parsed(spark, sf, detail=True).select("page_id", node_inner_html(F.col("html"), nodes(), article).alias("html"))


@check(listed('<li><a href="([^"]*)"', "value").replace("unnest(l)", "replace(unnest(l), '/', '')"), name="target_value")
def target_value_href(spark, sf):
    target = {"tag": "a", "value": "Href", "regex": {"action": "REMOVE", "regex": "/"}}
    values = F.transform(descendants(nodes(), root(nodes()), "li"), lambda n: target_value(nodes(), n, target))
    return parsed(spark, sf).select("page_id", F.posexplode(values).alias("i", "value"))


@check("""
SELECT p_partkey // 5 AS page_id, arg_min(p_name || ' ' || p_partkey, p_partkey) AS value, 'No ' || min(p_partkey) AS title, '' AS other
FROM part GROUP BY 1""", name="recon_value")
def recon_value_title(spark, sf):
    dom = parse_pages(render.part_cards(spark, sf).select("page_id", "html"))
    summary = first_descendant(nodes(), root(nodes()), "summary")
    kinds = {"value": "InnerText", "title": "Title", "other": "Else"}
    return dom.select("page_id", *[recon_value(nodes(), summary, {"reconValue": kind}).alias(name) for name, kind in kinds.items()])


# ---- navigation ----------------------------------------------------------------------------------


@check(listed('<li>(.*?)</li>', "text").replace("unnest(l)", "regexp_replace(unnest(l), '<[^>]*>', '', 'g')").replace(" AS i", " AS path_id"))
def navigate_3(spark, sf):
    found = navigate(nodes(), [{"tag": "nav"}, {"tag": "ul"}, {"tag": "li"}])
    texts = F.transform(found, lambda m: node_text(nodes(), m))
    return parsed(spark, sf).select("page_id", F.posexplode(texts).alias("path_id", "text"))


@check("""
SELECT '/i/' || (o_orderkey // 100) AS path, '/o/' || o_orderkey AS href, 1 AS n FROM orders
UNION ALL SELECT '/o/' || o_orderkey, '/c/' || o_custkey, 1 FROM orders
UNION ALL SELECT '/o/' || o_orderkey, '/i/' || (o_orderkey // 100), 2 FROM orders
UNION ALL SELECT '/c/' || c_custkey, '/i/' || (c_custkey // 100), 1 FROM customer""")
def navigate_bag(spark, sf):
    steps = [
        {"tag": "div", "keyProperty": "id", "valueProperty": "main"},
        {"tag": "div", "keyProperty": "class", "valueProperty": "list"},
        {"tag": "a"},
    ]
    dom = parse_pages(render.site(spark, sf).select("url", "html"))
    hrefs = F.transform(navigate(nodes(), steps), lambda m: F.struct(node_attr(nodes(), m, "href").alias("href"), m["n"].alias("n")))
    rows = dom.select(F.replace("url", F.lit(render.BASE), F.lit("")).alias("path"), F.inline(hrefs))
    return rows.groupBy("path", "href").agg(F.sum("n").cast("int").alias("n"))


@check(f"""SELECT page_id, "order" AS text, CAST(i + 1 AS INTEGER) AS place FROM ({BOOK_SQL})""", name="navigate_flat")
def navigate_flat_orders(spark, sf):
    dom = parse_pages(render.order_books(spark, sf).select("page_id", "html"))
    flat = navigate_flat(dom, specs.BOOK_STEPS)
    ordered = flat.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("position", "node_id", "last_id"))).alias("found"))
    number = lambda m: F.replace(node_attr(nodes(), first_descendant(nodes(), m, "a"), "href"), F.lit("/o/"), F.lit(""))
    texts = ordered.join(dom, "page_id").select("page_id", F.posexplode(F.transform("found", number)).alias("place", "text"))
    return texts.select("page_id", "text", (F.col("place") + 1).alias("place"))


@check("""
SELECT p_partkey // 5 AS page_id, p_name || ' ' || p_partkey AS part, replace(p_brand, 'Brand#', '') AS brand FROM part WHERE p_partkey % 6 <> 0""")
def recon_gate(spark, sf):
    """A card without the element that a recon asks for leads nowhere."""
    dom = parse_pages(render.part_cards(spark, sf).select("page_id", "html"))
    steps = [{"tag": "details"}, {"tag": "div", "recon": specs.CARD_RECONS}]
    return matches_table(dom, steps).select("page_id", F.col("recons")["PART"].alias("part"), F.col("recons")["BRAND"].alias("brand"))


@check("""
SELECT p_partkey // 5 AS page_id, p_brand AS title, p_name || ' ' || p_partkey AS name
FROM part, range(3 + CAST(p_partkey % 4 = 0 AS INTEGER) + 2 * CAST(p_partkey % 3 = 0 AS INTEGER) + CAST(p_partkey % 2 = 0 AS INTEGER))
WHERE p_partkey % 6 <> 0""", name="recon_carry")
def recon_carry_deepest(spark, sf):
    dom = parse_pages(render.part_cards(spark, sf).select("page_id", "html"))
    brand = {"tag": "meter", "reconValue": "Class", "classification": [{"name": "TITLE"}]}
    steps = [
        {"tag": "details"},
        {"tag": "div", "recon": [specs.recon("summary", "TITLE"), specs.recon("summary", "NAME")]},
        {"tag": "p", "recon": [brand]},
    ]
    return matches_table(dom, steps).select(
        "page_id", F.col("recons")["TITLE"].alias("title"), F.col("recons")["NAME"].alias("name")
    )


@check(f"""SELECT page_id, year, status, "order", CAST(i AS INTEGER) AS i FROM ({BOOK_SQL})""")
def repeating_sections(spark, sf):
    """Two kinds of headings: each keeps its label until the next one of its kind."""
    dom = parse_pages(render.order_books(spark, sf).select("page_id", "html"))
    href = lambda m: node_attr(nodes(), first_descendant(nodes(), m, "a"), "href")
    found = F.transform(
        navigate(nodes(), specs.BOOK_STEPS),
        lambda m: F.struct(
            m["recons"]["YEAR"].alias("year"), m["recons"]["STATUS"].alias("status"), F.replace(href(m), F.lit("/o/"), F.lit("")).alias("order")
        ),
    )
    rows = dom.select("page_id", F.posexplode(found).alias("i", "m"))
    return rows.select("page_id", "m.year", "m.status", "m.order", "i")


@check(f"""
SELECT page_id, year, status, count(*) AS n_leaves, CAST(row_number() OVER (PARTITION BY page_id ORDER BY year, status) AS INTEGER) AS place
FROM ({BOOK_SQL}) GROUP BY 1, 2, 3""", name="group_containers")
def group_containers_orders(spark, sf):
    dom = parse_pages(render.order_books(spark, sf).select("page_id", "html"))
    grouped = group_containers(dom, specs.BOOK_STEPS)
    recons = F.col("recons")
    ordered = grouped.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("first_path", recons["YEAR"].alias("year"), recons["STATUS"].alias("status"), "n_leaves"))).alias("c")
    )
    rows = ordered.select("page_id", F.posexplode("c").alias("place", "c"))
    return rows.select("page_id", "c.year", "c.status", "c.n_leaves", (F.col("place") + 1).alias("place"))


# ---- scalars -------------------------------------------------------------------------------------


@check("""
SELECT p_partkey, p_name || chr(CAST(65 + p_partkey % 26 AS INTEGER)) || chr(CAST(97 + p_partkey % 26 AS INTEGER)) || ' & ' || p_brand || '"' AS text FROM part""")
def clean_cell_references(spark, sf):
    """Numeric references, decimal and hexadecimal, with zeros in front, beside named ones and line ends."""
    number = F.col("p_partkey") % 26
    cell = F.concat(
        F.lit(" \n "), "p_name", F.format_string("&#%05d;", number + 65), F.format_string("&#x%x;", number + 97), F.lit("\r\n &amp; "), "p_brand", F.lit("&quot;&nbsp; ")
    )
    return table(spark, sf, "part").select("p_partkey", clean_cell(cell).alias("text"))


@check("""
SELECT event_id, replace(CASE WHEN event_type LIKE 'er%' THEN 'bad event' WHEN event_type LIKE '%i%' THEN event_type END, 'e', '') AS value
FROM events""", name="classify_node")
def classify_node_events(spark, sf):
    recon = {
        "reconValue": "InnerText",
        "regex": {"action": "REMOVE", "regex": "e"},
        "classification": [{"name": "A", "findBy": "er%", "value": "bad event"}, {"name": "B", "findBy": "%i%"}],
    }
    events = table(spark, sf, "events")
    return events.select("event_id", classify_node(recon, F.col("event_type"), F.lit(None).cast("string")).alias("value"))


@check("""
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'look' END AS both,
       CASE WHEN event_type LIKE 's%' THEN event_type END AS found, 'fixed' AS fixed, event_type AS plain FROM events""", name="classification_value")
def classification_value_events(spark, sf):
    c = F.col("event_type")
    return table(spark, sf, "events").select(
        "event_id",
        classification_value(c, "look", "view|click").alias("both"),
        classification_value(c, None, "s%").alias("found"),
        classification_value(c, "fixed").alias("fixed"),
        classification_value(c).alias("plain"),
    )


@check("""
SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'LOOK' WHEN event_type LIKE '%e%' THEN 'E' END AS label FROM events""", name="first_classification")
def first_classification_events(spark, sf):
    kinds = [{"name": "LOOK", "findBy": "view|click"}, {"name": "BLANK", "value": " ", "findBy": "error"}, {"name": "E", "findBy": "%e%"}]
    return table(spark, sf, "events").select("event_id", first_classification(F.col("event_type"), kinds).alias("label"))


@check("SELECT doc_id, replace(text, 'the', '') AS text FROM documents", name="text_remove")
def text_remove_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text_remove(F.col("text"), "the").alias("text"))


@check("SELECT doc_id, regexp_replace(text, 'THE', '', 'gi') AS text FROM documents", name="text_remove_ci")
def text_remove_ci_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text_remove_ci(F.col("text"), "THE").alias("text"))


@check("SELECT doc_id, CASE WHEN length(text) > 0 THEN 'gone' END AS text FROM documents", name="text_replace")
def text_replace_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text_replace(F.col("text"), "gone").alias("text"))


@check("""
SELECT p_partkey, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS i, unnest(l) AS word
FROM (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part)""", name="text_split")
def text_split_names(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.posexplode(text_split(F.col("p_name"))).alias("i", "word"))


DECODED = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


@check(f"""
SELECT page_id, trim(replace({DECODED.format("regexp_extract(" + BODY + ", '<footer>([^<]*)', 1)")}, chr(10), '')) AS text FROM pages""", name="clean_cell")
def clean_cell_footers(spark, sf):
    footer = first_descendant(nodes(), root(nodes()), "footer")
    return parsed(spark, sf).select("page_id", clean_cell(node_text(nodes(), footer)).alias("text"))


@check(f"""
SELECT page_id, i, CASE WHEN regexp_matches(href, '[\\s"<>\\\\^`{{|}}]|%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN href
       ELSE regexp_extract(url, '^[a-z]+://[^/]*') || href END AS url
FROM ({listed('<a href="([^"]*)"', "href")}) JOIN (SELECT page_id, url FROM pages) USING (page_id)""", name="resolve_url")
def resolve_url_nav(spark, sf):
    hrefs = F.transform(descendants(nodes(), first_descendant(nodes(), root(nodes()), "nav"), "a"), lambda n: n["attrs"]["href"])
    rows = parse_pages(page_source(spark, sf)).select("page_id", "url", F.posexplode(hrefs).alias("i", "href"))
    base = F.regexp_extract("url", "^[a-z]+://[^/]*", 0)
    return rows.select("page_id", "i", resolve_url(base, F.col("href")).alias("url"))


@check("SELECT regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY 1", name="url_host")
def url_host_counts(spark, sf):
    return page_source(spark, sf).groupBy(url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@check("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS path FROM pages", name="url_path")
def url_paths(spark, sf):
    return page_source(spark, sf).select("page_id", url_path(F.col("url")).alias("path"))


@check("SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9]', '', 'g') AS suffix FROM pages", name="safe_suffix")
def safe_suffix_urls(spark, sf):
    return page_source(spark, sf).select("page_id", safe_suffix(F.col("url")).alias("suffix"))


@check("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type = 'error' AS broken FROM events""", name="parse_message")
def parse_message_props(spark, sf):
    events = table(spark, sf, "events")
    from pyspark.sql import types as T

    schema = T.StructType().add("k", T.IntegerType())
    cut = F.when(F.col("event_type") == "error", F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    return events.select(
        "event_id", parse_message(F.col("props"), schema)["k"].alias("k"), parse_message(cut, schema).isNull().alias("broken")
    )


@check("""SELECT event_id, '{"url":"/e/' || event_id || '","type":"' || event_type || '"}' AS body FROM events""", name="message_json")
def message_json_events(spark, sf):
    message = F.struct(F.format_string("/e/%d", "event_id").alias("url"), F.col("event_type").alias("type"))
    return table(spark, sf, "events").select("event_id", message_json(message).alias("body"))


@check("""
SELECT c_custkey, 'NAME: ' || c_name || chr(10) || 'NATION: ' || c_nationkey || chr(10) || 'SEGMENT: ' || c_mktsegment AS text FROM customer""", name="entity_text")
def entity_text_customers(spark, sf):
    data = F.create_map(F.lit("SEGMENT"), "c_mktsegment", F.lit("NAME"), "c_name", F.lit("NATION"), F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", entity_text(data).alias("text"))


@check("""
SELECT event_id, event_type AS type, CAST(user_id AS VARCHAR) AS owner, props, '["' || event_type || '","x"]' AS tags FROM events""", name="flatten_record")
def flatten_record_events(spark, sf):
    record = F.struct(
        F.col("event_type").alias("type"),
        F.col("user_id").alias("owner"),
        F.from_json("props", "struct<k:int>").alias("props"),
        F.array("event_type", F.lit("x")).alias("tags"),
    )
    flat = table(spark, sf, "events").select("event_id", flatten_record(record).alias("r"))
    return flat.select(
        "event_id", F.col("r")["type"].alias("type"), F.col("r")["owner"].alias("owner"),
        F.regexp_replace(F.col("r")["props"], ":", ": ").alias("props"), F.col("r")["tags"].alias("tags"),
    )


# ---- flagship ------------------------------------------------------------------------------------


@check(f"""
SELECT page_id, generate_subscripts(l, 1) - 1 AS entity_idx, title, unnest(l) AS paragraph,
       'SNAPSHOT' AS source, 'Paragraph' AS class_type
FROM (SELECT page_id, regexp_extract({BODY}, '<h1>([^<]*)', 1) AS title,
             regexp_extract_all({BODY}, '<p>(?:<b>)?([^<]*)', 1) AS l FROM pages)""")
def extract_articles(spark, sf):
    found = extract_entities(page_source(spark, sf), specs.ARTICLES)
    data = F.col("data")
    return found.select(
        "page_id", "entity_idx", data["TITLE"].alias("title"), data["PARAGRAPH"].alias("paragraph"),
        data["SOURCE"].alias("source"), "class_type",
    )
