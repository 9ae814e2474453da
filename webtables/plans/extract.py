"""Whole extractions: pages and a spec in, entity rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.match import tag_name
from ..operators.entities import (
    attach_group_data, conflicts, constants, entity_from_table_row, entity_per_node, entity_pivot, folded, given_twice, is_single_field, leaf_array,
    leaves, pivoted,
)
from ..operators.navigate import navigate, no_recons, routes
from ..operators.select import let
from ..operators.tables import find_tables, min_columns_guard, parse_table, table_array, too_narrow
from ..sources.dom import parse_pages
from ..sources.pages import marked, truncate_before


def extraction_of(spec: dict) -> dict:
    return spec.get("extraction", spec)


def spec_pages(pages: DataFrame, spec: dict) -> DataFrame:
    """The pages as the spec wants them parsed: cut before its separator when it names one."""
    marker = extraction_of(spec).get("separatorId")
    narrow = pages.select("page_id", "html")
    return parse_pages(truncate_before(narrow, marker)[0] if marker else narrow)


def assemble(dom: DataFrame, spec: dict) -> DataFrame:
    """Entities of parsed pages with an `error` column, null for the good ones."""
    extraction = extraction_of(spec)
    target = extraction["target"]
    matches = navigate(F.col("nodes"), extraction.get("navigation"))
    if is_single_field(target):
        made = entity_per_node(leaves(dom, matches, target), target)
    elif tag_name(target.get("value") or "") == "table":
        wide, _ = min_columns_guard(parse_table(find_tables(dom, matches)))
        classifications = (target.get("recon") or {}).get("classification") or []
        made = entity_from_table_row(wide, classifications, constants(target), given_twice(target))
    else:
        made = entity_pivot(dom, matches, target)
    return made.select("page_id", "entity_idx", "data", F.lit(target.get("classType")).alias("class_type"), "error")


def extract_entities(pages: DataFrame, spec: dict, dom: DataFrame | None = None) -> DataFrame:
    """`page_id, entity_idx, data, class_type`. `entity_idx` orders the entities of a page.

    `dom`: the parsed pages (`spec_pages`, stored with `store_dom`) when several extractions share them.
    """
    dom = spec_pages(pages, spec) if dom is None else dom
    return assemble(dom, spec).where("error IS NULL").drop("error")


def extract_outcomes(pages: DataFrame, spec: dict, dom: DataFrame | None = None) -> DataFrame:
    """Everything an extraction gives, from one pass over one parse: entities, and what could not be used.

    `page_id, entity_idx, data, class_type` of the entities, whose `message` is null; errors have a `message` and a
    `detail`: pages without body or marker, leaves without value or with a label set twice, fields set twice, tables
    that cannot be read.
    """
    extraction = extraction_of(spec)
    target, marker = extraction["target"], extraction.get("separatorId")
    unmarked = F.lit(None).cast("string")
    if dom is None:
        narrow = pages.select("page_id", "html")
        dom = parse_pages(marked(narrow, marker) if marker else narrow)
        unmarked = F.when(~F.col("marked"), "marker missing") if marker else unmarked
    flaw = F.when(F.size("nodes") == 0, F.coalesce(unmarked, F.lit("no body")))
    nodes = F.col("nodes")
    matches = navigate(nodes, extraction.get("navigation"))
    kind = F.lit(target.get("classType")).alias("class_type")
    null = lambda type_: F.lit(None).cast(type_)
    one = F.lit(1).cast("long")
    bare = lambda empty: F.when(flaw.isNotNull(), F.array(empty)).otherwise(F.array())

    if not is_single_field(target) and tag_name(target.get("value") or "") == "table":
        gone = F.struct(null("int").alias("table_id"), no_recons().alias("recons"), null("array<array<struct<text:string,colspan:int,rowspan:int>>>").alias("header"), null("array<array<struct<text:string,colspan:int,rowspan:int>>>").alias("body"), one.alias("n"))
        cut = routes(dom.withColumn("flaw", flaw), F.concat(table_array(nodes, matches), bare(gone)), "flaw")
        tables = too_narrow(parse_table(cut)).withColumn("error", F.coalesce("flaw", "error"))
        made = entity_from_table_row(tables, (target.get("recon") or {}).get("classification") or [], constants(target), given_twice(target))
        detail = F.when(F.col("error").isNotNull(), F.coalesce(F.to_json("data"), F.col("table_id").cast("string")))
        return made.select("page_id", "entity_idx", F.when(F.col("error").isNull(), F.col("data")).alias("data"), kind, F.col("error").alias("message"), detail.alias("detail"))

    if is_single_field(target):
        leaf = leaf_array(nodes, matches, target)
        gone = F.struct(null("int").alias("node_id"), no_recons().alias("recons"), null("string").alias("label"), null("string").alias("value"), one.alias("n"))
        made = entity_per_node(routes(dom.withColumn("flaw", flaw), F.concat(leaf, bare(gone)), "flaw"), target, "flaw")
        made = made.withColumn("message", F.coalesce("flaw", "error")).withColumn("detail", F.when(F.col("error").isNotNull() & F.col("flaw").isNull(), F.to_json("data")))
    else:
        fold = folded(leaf_array(nodes, matches, target), target)

        def outcomes(f: Column) -> Column:
            row = lambda idx, recons, data, message, detail, n: F.struct(
                idx.alias("entity_idx"), recons.alias("recons"), data.alias("data"), message.alias("flaw"), detail.alias("given"), n.alias("n")
            )
            good = F.transform(pivoted(f, target), lambda e: row(e["entity_idx"], e["recons"], e["data"], null("string"), null("string"), one))
            bad = F.transform(conflicts(f, target), lambda x: row(null("bigint"), no_recons(), no_recons(), x["error"], x["value"], x["n"]))
            return F.concat(good, bad, bare(row(null("bigint"), no_recons(), no_recons(), flaw, null("string"), one)))

        rows = dom.select("page_id", F.inline(let(fold, outcomes))).withColumn("_copy", F.explode(F.sequence(one, F.col("n")))).drop("n", "_copy")
        made = attach_group_data(rows, constants(target), given_twice(target)).withColumn("message", F.coalesce("flaw", "error"))
        made = made.withColumn("detail", F.when(F.col("flaw").isNotNull(), F.col("given")).when(F.col("error").isNotNull(), F.to_json("data")))
    return made.select("page_id", F.when(F.col("message").isNull(), F.col("entity_idx")).alias("entity_idx"), F.when(F.col("message").isNull(), F.col("data")).alias("data"), kind, "message", "detail")


def extract_errors(pages: DataFrame, spec: dict, dom: DataFrame | None = None) -> DataFrame:
    """What the extraction could not use: `page_id, message, detail`. One pass, however many kinds there are.

    With a stored `dom` of a spec that has a separator, pages without the marker are looked for in `pages`.
    """
    found = extract_outcomes(pages, spec, dom).where("message IS NOT NULL").select("page_id", "message", "detail")
    marker = extraction_of(spec).get("separatorId")
    if dom is not None and marker:
        uncut = truncate_before(pages.select("page_id", "html"), marker)[1]
        found = found.unionByName(uncut.select("page_id", F.lit("marker missing").alias("message"), F.lit(None).cast("string").alias("detail")))
    return found
