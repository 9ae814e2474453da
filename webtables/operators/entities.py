"""Leaves to entities: string maps with a class type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.match import blank, match_value, tag_name
from ..functions.text import first_classification
from .navigate import RECONS, containers, routes
from .select import first_child, let, node_text, target_value

MISC = "MISC"
LABELLED = ("SIBLING", "CHILD")
ROWS = 1 << 32  # row r of the n-th table of a page is entity n * ROWS + r


def is_single_field(target: dict) -> bool:
    """The target has nothing to recognise and one name: every leaf is an entity of its own."""
    recon = target.get("recon") or {}
    return bool(recon) and not recon.get("tag") and len(recon.get("classification") or ()) == 1


def constants(target: dict) -> Column:
    """Constants of the target by name; of a name given twice the first (`given_twice` then fails the entities)."""
    values: dict[str, str] = {}
    for v in target.get("HCValues") or ():
        values.setdefault(v["name"], v["value"])
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair]).cast(RECONS)


def given_twice(target: dict) -> bool:
    names = [v["name"] for v in target.get("HCValues") or ()]
    return len(set(names)) < len(names)


def target_classification(nodes: Column, anchor: Column, target: dict) -> Column:
    """Label of a leaf: its first matching direct child's text, classified. Null: no label."""
    recon = target.get("recon") or {}
    if (target.get("reconRelation") or "").upper() not in LABELLED or not recon.get("tag"):
        return F.lit(None).cast("string")
    if tag_name(recon.get("reconValue") or "") != "innertext":
        raise ValueError("a target's recon classifies by InnerText")
    child = first_child(nodes, anchor, recon["tag"], recon.get("keyProperty"), recon.get("valueProperty"))
    label = lambda t: first_classification(t, recon.get("classification") or ())
    return let(child, lambda n: F.when(n.isNotNull(), let(node_text(nodes, n), label)))


def leaf_array(nodes: Column, matches: Column, target: dict) -> Column:
    """What stands at each match: `{node_id, recons, label, value, n}`."""
    label = F.lit(None).cast("string") if is_single_field(target) else None
    leaf = lambda m: F.struct(
        m["node_id"].alias("node_id"),
        m["recons"].alias("recons"),
        (label if label is not None else target_classification(nodes, m, target)).alias("label"),
        target_value(nodes, m, target).alias("value"),
        m["n"].alias("n"),
    )
    return F.transform(matches, leaf)


def leaves(dom: DataFrame, matches: Column, target: dict) -> DataFrame:
    """One row per route to a leaf: `page_id, path_id, node_id, recons, label, value`."""
    return routes(dom, leaf_array(F.col("nodes"), matches, target))


def attach_group_data(entities: DataFrame, fixed: Column, broken: Column | bool = False) -> DataFrame:
    """Merge `recons` and constants into `data`. A field set twice fails the entity: `error` says so.

    `broken`: where a field was set twice before, in data or constants.
    """
    keys = F.concat(F.map_keys("data"), F.map_keys("recons"), F.map_keys(fixed))
    twice = (F.size(F.array_distinct(keys)) < F.size(keys)) | broken
    merged = F.when(~twice, F.map_concat("data", "recons", fixed))
    reason = F.when(twice, F.lit("field set twice"))
    return entities.withColumns({"error": reason, "data": F.coalesce(merged, F.col("data"))}).drop("recons")


def entity_per_node(found: DataFrame, target: dict, *kept: str) -> DataFrame:
    """One entity per leaf: `{name: value}` plus group data. A leaf without a value fails."""
    name = F.lit(target["recon"]["classification"][0]["name"])
    rows = found.select(
        "page_id", F.col("path_id").cast("bigint").alias("entity_idx"), F.create_map(name, "value").alias("data"), "recons", "value", *kept
    )
    made = attach_group_data(rows, constants(target), given_twice(target))
    lost = F.when(F.col("value").isNull(), F.lit("no target value"))
    return made.withColumn("error", F.coalesce("error", lost)).drop("value")


def misc_bucket(loose: Column) -> Column:
    """Values of unlabelled leaves (`{value, n}`) in document order, joined with a blank; null if there is none."""
    again = lambda c: F.transform(F.filter(loose, lambda x: x["n"] > c), lambda x: x["value"])
    most = F.coalesce(F.array_max(F.transform(loose, lambda x: x["n"])), F.lit(1))
    return F.nullif(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), most - 1), again)), " "), F.lit(""))


def label_names(target: dict) -> list[str]:
    return list(dict.fromkeys(c["name"] for c in (target.get("recon") or {}).get("classification") or () if c["name"] != MISC))


def folded(found: Column, target: dict) -> Column:
    """The containers of a page's leaves, by first appearance: `{entity_idx, recons, values, members}`.

    `values`: the first value of each label of the spec, then the unlabelled ones (MISC). `members`: the leaves with
    their place `at`. A container is there even if none of its leaves has a value; `entity_idx` is then null.
    """
    names = label_names(target)

    def container(of: Column):
        def one(members: Column) -> Column:
            held = F.filter(members, lambda x: x["value"].isNotNull())
            first = lambda vs, name: F.get(F.filter(vs, lambda x: x["label"] == name), F.lit(0))["value"]
            loose = lambda vs: F.filter(vs, lambda x: F.coalesce(x["label"] == MISC, F.lit(True)))
            return let(
                held,
                lambda vs: F.struct(
                    F.get(vs, F.lit(0))["at"].cast("bigint").alias("entity_idx"),
                    F.get(members, F.lit(0))["recons"].alias("recons"),
                    F.array(*[first(vs, n) for n in names], let(loose(vs), misc_bucket)).cast("array<string>").alias("values"),
                    members.alias("members"),
                ),
            )

        member = lambda i: F.get(of, i).withField("at", i)
        return lambda c: let(F.transform(c, member), one)

    return let(found, lambda of: F.transform(containers(of), container(of)))


def pivoted(fold: Column, target: dict) -> Column:
    """`{entity_idx, recons, data}` of the containers that have a value."""
    names = F.array(*[F.lit(n) for n in [*label_names(target), MISC]])
    data = lambda c: F.map_filter(F.map_from_arrays(names, c["values"]), lambda k, v: v.isNotNull())
    made = lambda c: F.struct(c["entity_idx"].alias("entity_idx"), c["recons"].alias("recons"), data(c).alias("data"))
    return F.transform(F.filter(fold, lambda c: c["entity_idx"].isNotNull()), made)


def entity_pivot(dom: DataFrame, matches: Column, target: dict) -> DataFrame:
    """One entity per container (equal recons): the first value of each label, the rest in MISC.

    Folded inside the page row, so nothing is shuffled. A label that is MISC itself shares the field with the
    unlabelled values.
    """
    fold = folded(leaf_array(F.col("nodes"), matches, target), target)
    return attach_group_data(dom.select("page_id", F.inline(pivoted(fold, target))), constants(target), given_twice(target))


def conflicts(fold: Column, target: dict) -> Column:
    """Leaves the pivot does not use, `{at, label, value, error, n}`: no value, or another value for a label already set."""
    names = label_names(target)

    def judged(c: Column):
        kept = lambda x: F.coalesce(*[F.when(x["label"] == n, F.get(c["values"], F.lit(i))) for i, n in enumerate(names)], F.lit(None).cast("string"))
        reason = lambda x: F.when(x["value"].isNull(), "no target value").when(x["value"] != kept(x), "label set twice")
        return lambda x: F.struct(x["at"].alias("at"), x["label"].alias("label"), x["value"].alias("value"), reason(x).alias("error"), x["n"].alias("n"))

    every = F.flatten(F.transform(fold, lambda c: F.transform(c["members"], judged(c))))
    return F.array_sort(F.filter(every, lambda x: x["error"].isNotNull()), lambda a, b: a["at"] - b["at"])


def pivot_conflicts(dom: DataFrame, matches: Column, target: dict) -> DataFrame:
    """`page_id, path_id, label, value, error` of the leaves the pivot does not use."""
    found = conflicts(folded(leaf_array(F.col("nodes"), matches, target), target), target)
    rows = dom.select("page_id", F.inline(found)).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select("page_id", F.col("at").alias("path_id"), "label", "value", "error")


def entity_from_table_row(tables: DataFrame, classifications: list[dict], fixed: Column, broken: bool = False) -> DataFrame:
    """One entity per table row: per classification the first column whose name satisfies `findBy`.

    Classifications may share a name: the one that finds a column fills the field; a row where both do fails. A table
    that cannot be read (`error`) is one row without data and with that `error`.
    """
    wanted = lambda k: lambda n: F.lit(True) if blank(k.get("findBy")) else match_value(n, k["findBy"])
    place = lambda k: F.array_position(F.transform("columns", wanted(k)), True)
    indexes = F.array(*[place(k) for k in classifications]).cast("array<int>")
    lost = F.struct(F.lit(None).cast("int").alias("row_idx"), F.lit(None).cast("array<string>").alias("row"), F.col("error").alias("flaw"))
    good = F.transform("rows", lambda r, i: F.struct(i.alias("row_idx"), r.alias("row"), F.lit(None).cast("string").alias("flaw")))
    rows = tables.withColumn("_at", indexes).select(
        "page_id", "path_id", "table_id", "recons", "_at", F.inline(F.when(F.col("error").isNotNull(), F.array(lost)).otherwise(good))
    )
    names = F.array(*[F.lit(k["name"]) for k in classifications])
    pairs = F.arrays_zip(names.alias("name"), F.col("_at").alias("at"))
    present = F.filter(pairs, lambda p: p["at"] > 0)
    entries = F.transform(present, lambda p: F.struct(p["name"], F.get(F.col("row"), p["at"] - 1)))
    found = F.transform(present, lambda p: p["name"])
    once = F.filter(entries, lambda e, i: F.array_position(found, e["name"]) == i + 1)
    filled = rows.select(
        "page_id",
        (F.col("path_id") * F.lit(ROWS) + F.col("row_idx")).alias("entity_idx"),
        F.map_from_entries(once).alias("data"),
        "recons",
        (F.size(once) < F.size(entries)).alias("_twice"),
        "flaw",
        "table_id",
    )
    made = attach_group_data(filled, fixed, F.coalesce(F.col("_twice"), F.lit(False)) | broken)
    return made.withColumn("error", F.coalesce("flaw", "error")).drop("_twice", "flaw")


def missing_classifications(tables: DataFrame, classifications: list[dict]) -> DataFrame:
    """Table and classification name for each one that no column satisfies."""
    met = lambda k: F.exists("columns", lambda n: F.lit(True) if blank(k.get("findBy")) else match_value(n, k["findBy"]))
    absent = F.array_compact(F.array(*[F.when(~met(k), F.lit(k["name"])) for k in classifications]))
    return tables.select("page_id", "table_id", F.explode(absent).alias("classification"))
