"""Queries over entity assembly and HTML tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.operators.entities import attach_group_data, entity_pivot, leaves, missing_classifications, pivot_conflicts
from webtables.operators.navigate import navigate
from webtables.operators.select import descendants, root
from webtables.operators.tables import (
    cells_table, cut_tables, expand_colspan, expand_rowspan, find_tables, headers_table, min_columns_guard, parse_table,
    place_units, spans_to_place, table_sections,
)
from webtables.plans.extract import extract_entities, extract_errors, extract_outcomes
from webtables.sources.dom import parse_pages

from . import render, specs
from .pages_checks import BOOK_SQL
from .registry import check
from .render import table


def nodes():
    return F.col("nodes")


def dom(pages):
    return parse_pages(pages.select("page_id", "html"))


# ---- assembly ------------------------------------------------------------------------------------


@check(f"""SELECT page_id, year, status, "order", 'ORDERS' AS book, i AS entity_idx FROM ({BOOK_SQL})""")
def extract_words(spark, sf):
    """Orders under two kinds of repeating headings."""
    found = extract_entities(render.order_books(spark, sf), specs.BOOKS)
    data = F.col("data")
    return found.select(
        "page_id", data["YEAR"].alias("year"), data["STATUS"].alias("status"), data["ORDER"].alias("order"), data["BOOK"].alias("book"), "entity_idx"
    )


@check("""
SELECT page_id, label, any_value(value) AS value FROM (
  SELECT p_partkey // 5 AS page_id, p_name || ' ' || p_partkey AS label, 'Price:' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS value FROM part)
GROUP BY 1, 2""", name="entity_per_node")
def entity_per_node_first_item(spark, sf):
    """A target with a tag reads only the first matching child of each leaf."""
    navigation = {"tag": "details", "nav": {"tag": "div", "recon": specs.CARD_RECONS[:1]}}
    target = {"tag": "p", "value": "InnerText", "recon": {"classification": [{"name": "FIRST"}]}, "classType": "Line"}
    found = extract_entities(render.part_cards(spark, sf), {"navigation": navigation, "target": target})
    return found.select("page_id", F.col("data")["PART"].alias("label"), F.col("data")["FIRST"].alias("value"))


CARD_SQL = """
SELECT p_partkey AS k, p_partkey // 5 AS page_id, p_name || ' ' || p_partkey AS part, replace(p_brand, 'Brand#', '') AS brand,
       CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price, CAST(p_size AS VARCHAR) AS size, p_type AS kind,
       CASE WHEN p_partkey % 3 = 0 THEN 'remark on ' || p_partkey || ' seen at ' || p_size END AS remarks,
       CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) END AS code FROM part"""


@check(f"""
SELECT page_id, part, brand, price, size, kind, CAST(NULL AS VARCHAR) AS stock, nullif(concat_ws(' ', remarks, code), '') AS misc
FROM ({CARD_SQL}) WHERE k % 6 <> 0""")
def extract_profiles(spark, sf):
    """Several cards a page, each an entity; labels stand beside the values."""
    data = F.col("data")
    names = ("PART", "BRAND", "PRICE", "SIZE", "KIND", "STOCK", "MISC")
    found = extract_entities(render.part_cards(spark, sf), specs.CARDS)
    return found.select("page_id", *[data[n].alias(n.lower()) for n in names])


TARGET = specs.CARDS["extraction"]["target"]
#: Cards with or without a brand.
ANY_CARD = [specs.CARD_STEPS[0], specs.CARD_STEPS[1] | {"recon": specs.CARD_RECONS[:1]}]


def card_dom(spark, sf):
    return dom(render.part_cards(spark, sf))


@check(f"SELECT page_id, part, price, size, kind FROM ({CARD_SQL})", name="entity_pivot")
def entity_pivot_cards(spark, sf):
    found = entity_pivot(card_dom(spark, sf), navigate(nodes(), ANY_CARD), TARGET)
    data = F.col("data")
    return found.select("page_id", *[data[n].alias(n.lower()) for n in ("PART", "PRICE", "SIZE", "KIND")])


@check(f"SELECT page_id, part, concat_ws(' ', remarks, code) AS misc FROM ({CARD_SQL}) WHERE remarks IS NOT NULL OR code IS NOT NULL", name="misc_bucket")
def misc_bucket_cards(spark, sf):
    found = entity_pivot(card_dom(spark, sf), navigate(nodes(), ANY_CARD), TARGET)
    return found.select("page_id", F.col("data")["PART"].alias("part"), F.col("data")["MISC"].alias("misc")).where("misc IS NOT NULL")


@check(f"SELECT page_id, 'PRICE' AS label, kind AS value, 'label set twice' AS error FROM ({CARD_SQL}) WHERE k % 4 = 0", name="pivot_conflicts")
def pivot_conflict_rows(spark, sf):
    return pivot_conflicts(card_dom(spark, sf), navigate(nodes(), ANY_CARD), TARGET).select("page_id", "label", "value", "error")


@check(f"""
SELECT * FROM (
  SELECT page_id, part, unnest(['PRICE', 'SIZE', 'KIND', 'NONE']) AS label,
         unnest([1 + CAST(k % 4 = 0 AS BIGINT), 1, 1, 2 * CAST(k % 3 = 0 AS BIGINT) + CAST(k % 2 = 0 AS BIGINT)]) AS n FROM ({CARD_SQL}))
WHERE n > 0""", name="target_classification")
def target_classification_labels(spark, sf):
    found = leaves(card_dom(spark, sf), navigate(nodes(), ANY_CARD), TARGET)
    return found.groupBy("page_id", F.col("recons")["PART"].alias("part"), F.coalesce("label", F.lit("NONE")).alias("label")).agg(F.count("*").alias("n"))


@check(f"""
SELECT page_id, 'entity' AS kind, part AS detail FROM ({CARD_SQL}) WHERE k % 6 <> 0
UNION ALL SELECT page_id, 'label set twice', kind FROM ({CARD_SQL}) WHERE k % 6 <> 0 AND k % 4 = 0
UNION ALL SELECT DISTINCT -1 - page_id, 'no body', NULL FROM ({CARD_SQL})
UNION ALL SELECT DISTINCT 1000000000 + page_id, 'marker missing', NULL FROM ({CARD_SQL})""")
def extract_outcomes_cards(spark, sf):
    """Entities and errors of every kind, from one parse: cards as they are, without body, and without the marker."""
    pages = render.part_cards(spark, sf).withColumn("html", F.replace("html", F.lit("<body>"), F.lit("<body><!--cards-->")))
    bare = pages.select((-1 - F.col("page_id")).alias("page_id"), "url", F.lit("no page").alias("html"))
    unmarked = pages.select((1_000_000_000 + F.col("page_id")).alias("page_id"), "url", F.replace("html", F.lit("<!--cards-->"), F.lit("")).alias("html"))
    spec = specs.CARDS["extraction"] | {"separatorId": "<!--cards-->"}
    found = extract_outcomes(pages.unionByName(unmarked), spec)
    nobody = extract_outcomes(bare, specs.CARDS)
    every = found.unionByName(nobody)
    return every.select("page_id", F.coalesce("message", F.lit("entity")).alias("kind"), F.coalesce("detail", F.col("data")["PART"]).alias("detail"))


@check("""
SELECT event_id, CASE WHEN value > 50 OR event_type = 'click' THEN 'field set twice' END AS error,
       CASE WHEN value > 50 OR event_type = 'click' THEN 1 ELSE 3 END AS fields FROM events""", name="attach_group_data")
def attach_group_data_events(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        F.create_map(F.lit("TYPE"), "event_type").alias("data"),
        F.create_map(F.when(F.col("value") > 50, "TYPE").when(F.col("event_type") == "click", "FIXED").otherwise("USER"), F.col("user_id").cast("string")).alias("recons"),
    )
    made = attach_group_data(events, F.create_map(F.lit("FIXED"), F.lit("1")))
    return made.select("event_id", "error", F.size("data").alias("fields"))


# ---- tables --------------------------------------------------------------------------------------

GRID_SQL = """
SELECT c_custkey // 20 AS page_id, c_custkey, c_nationkey, c_name, c_mktsegment, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS balance,
       CAST(row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_nationkey, c_custkey) - 1 AS INTEGER) AS row_idx
FROM customer"""


def grids(spark, sf):
    return parse_table(find_tables(dom(render.span_tables(spark, sf)), navigate(nodes(), [{"tag": "table"}])))


def wides(spark, sf):
    return parse_table(find_tables(dom(render.wide_tables(spark, sf)), navigate(nodes(), [{"tag": "table"}])))


def every_table(pages, of, name):
    """`page_id, table_no` and what `of` gives, for all tables of every page."""
    found = F.transform(descendants(nodes(), root(nodes()), "table"), lambda t: of(nodes(), t))
    return dom(pages).select("page_id", F.posexplode(found).alias("table_no", name))


def all_cells(pages):
    """All tables of every page with their cut cells."""
    return every_table(pages, cut_tables, "t").select("page_id", "table_no", "t.*")


@check("""
SELECT page_id, 'grid' AS kind, 0 AS table_no, 1 AS headers, n AS body FROM (SELECT c_custkey // 20 AS page_id, CAST(count(*) AS INTEGER) AS n FROM customer GROUP BY 1)
UNION ALL SELECT page_id, 'wide', 0, 2, n FROM (SELECT p_partkey // 10 AS page_id, CAST(count(*) AS INTEGER) AS n FROM part GROUP BY 1)
UNION ALL SELECT DISTINCT p_partkey // 10, 'wide', 1, 1, 1 FROM part""", name="table_sections")
def table_sections_counts(spark, sf):
    def counted(pages, kind):
        parts = every_table(pages, table_sections, "s")
        return parts.select(
            "page_id", F.lit(kind).alias("kind"), "table_no", F.size("s.header").alias("headers"), F.size("s.body").alias("body")
        )

    return counted(render.span_tables(spark, sf), "grid").union(counted(render.wide_tables(spark, sf), "wide"))


@check(f"""
SELECT page_id, row_idx, CAST(CASE WHEN row_number() OVER (PARTITION BY page_id, c_nationkey ORDER BY c_custkey) = 1 THEN 5 ELSE 4 END AS INTEGER) AS cells
FROM ({GRID_SQL})""", name="table_cells")
def table_cells_counts(spark, sf):
    rows = all_cells(render.span_tables(spark, sf)).select("page_id", F.posexplode("body").alias("row_idx", "r"))
    return rows.select("page_id", "row_idx", F.size("r").alias("cells"))


@check("""
SELECT page_id, table_no, row_idx, col_idx, text FROM (SELECT DISTINCT p_partkey // 10 AS page_id FROM part), (VALUES
  (0, 0, 0, 'Key'), (0, 0, 1, 'Spec'), (0, 0, 2, 'Spec'), (0, 0, 3, 'Left'), (0, 0, 4, ' Sid'), (0, 1, 0, 'Brand'), (0, 1, 1, 'Type'),
  (1, 0, 0, 'A'), (1, 0, 1, 'B'), (1, 0, 2, 'C')) AS h(table_no, row_idx, col_idx, text)""", name="expand_colspan")
def expand_colspan_headers(spark, sf):
    cut = all_cells(render.wide_tables(spark, sf))
    rows = cut.select("page_id", "table_no", F.posexplode(expand_colspan(F.col("header"), True)).alias("row_idx", "r"))
    units = rows.select("page_id", "table_no", "row_idx", F.posexplode("r").alias("col_idx", "u"))
    return units.select("page_id", "table_no", "row_idx", "col_idx", "u.text")


@check(f"""SELECT page_id, row_idx, CAST(c_nationkey AS VARCHAR) AS nation, CAST(c_custkey AS VARCHAR) AS custkey FROM ({GRID_SQL})""", name="expand_rowspan")
def expand_rowspan_body(spark, sf):
    cut = all_cells(render.span_tables(spark, sf))
    units = cut.select("page_id", expand_colspan(F.col("body"), False).alias("u"))
    placed = units.withColumn("p", place_units(spans_to_place(F.col("u"))))
    grid = placed.select("page_id", F.posexplode(expand_rowspan(F.col("u"), F.col("p"), keep_carried=True)).alias("row_idx", "r"))
    return grid.select("page_id", "row_idx", F.get("r", F.lit(0)).alias("nation"), F.get("r", F.lit(1)).alias("custkey"))


@check("""
SELECT page_id, table_no, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS col_idx, unnest(l) AS name FROM (
  SELECT DISTINCT p_partkey // 10 AS page_id, 0 AS table_no, ['Key', 'Spec-Brand', 'Spec-Type', 'Left', 'Sid'] AS l FROM part
  UNION ALL SELECT DISTINCT p_partkey // 10, 1, ['A', 'B', 'C'] FROM part)""", name="table_headers")
def table_headers_wide(spark, sf):
    named = headers_table(wides(spark, sf).where("error IS NULL"))
    return named.select("page_id", F.when(F.col("table_id") == 1, 0).otherwise(1).alias("table_no"), "col_idx", "name")


@check("SELECT DISTINCT p_partkey // 10 AS page_id, 'Left' AS a, 'Sid' AS b FROM part", name="split_wide_header")
def split_wide_header_pieces(spark, sf):
    tables = wides(spark, sf).where("error IS NULL AND size(columns) > 3")
    return tables.select("page_id", F.get("columns", F.lit(3)).alias("a"), F.get("columns", F.lit(4)).alias("b"))


@check("""
SELECT p_partkey // 10 AS page_id, 0 AS path_id, CAST(p_partkey % 10 AS INTEGER) AS row_idx, p_type AS type,
       CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS size,
       CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS name FROM part
UNION ALL SELECT DISTINCT p_partkey // 10, 1, 0, '3', NULL, NULL FROM part""", name="pad_short_rows")
def pad_short_rows_wide(spark, sf):
    rows = wides(spark, sf).select("page_id", F.col("path_id").cast("int").alias("path_id"), F.posexplode("rows").alias("row_idx", "r"))
    cell = lambda i: F.get("r", F.lit(i))
    return rows.select("page_id", "path_id", "row_idx", cell(2).alias("type"), cell(3).alias("size"), cell(4).alias("name"))


@check(f"""
SELECT page_id, row_idx, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS col_idx,
       unnest(['Nation', 'Key', 'Name', 'Segment', 'Balance']) AS name, unnest(l) AS text FROM (
  SELECT page_id, row_idx, [CAST(c_nationkey AS VARCHAR), CAST(c_custkey AS VARCHAR), c_name, c_mktsegment || ' & co', balance] AS l FROM ({GRID_SQL}))""", name="parse_table")
def parse_table_round_trip(spark, sf):
    return cells_table(grids(spark, sf)).drop("table_id")


@check(f"""
SELECT page_id, row_idx, CAST(c_nationkey AS VARCHAR) AS nation, c_name AS customer, balance, 'SHOP' AS source, 4 AS fields FROM ({GRID_SQL})""")
def table_entities(spark, sf):
    found = extract_entities(render.span_tables(spark, sf), specs.GRIDS)
    data = F.col("data")
    return found.select(
        "page_id", F.col("entity_idx").cast("int").alias("row_idx"), data["NATION"].alias("nation"), data["CUSTOMER"].alias("customer"),
        data["BALANCE"].alias("balance"), data["SOURCE"].alias("source"), F.size("data").alias("fields"),
    )


@check("SELECT DISTINCT c_custkey // 20 AS page_id, 'PHONE' AS classification FROM customer", name="missing_classifications")
def missing_table_columns(spark, sf):
    return missing_classifications(grids(spark, sf), specs.GRIDS["extraction"]["target"]["recon"]["classification"]).drop("table_id")


@check("""
SELECT DISTINCT p_partkey // 10 AS page_id, 0 AS path_id, CAST(NULL AS VARCHAR) AS error FROM part
UNION ALL SELECT DISTINCT p_partkey // 10, 1, 'too few columns' FROM part""", name="min_columns_guard")
def min_columns_guard_wide(spark, sf):
    wide, narrow = min_columns_guard(wides(spark, sf))
    return wide.unionByName(narrow).select("page_id", F.col("path_id").cast("int").alias("path_id"), "error")


@check("SELECT DISTINCT p_partkey // 10 AS page_id, 'too few columns' AS message FROM part")
def extract_errors_tables(spark, sf):
    extraction = specs.GRIDS["extraction"] | {"navigation": {"tag": "table"}}
    return extract_errors(render.wide_tables(spark, sf), extraction).select("page_id", "message")
