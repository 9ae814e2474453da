"""Navigation steps of an extraction spec, inside the page row.

`matches` is an array of `{node_id, last_id, recons, n}` in document order. A step maps every match to the matching
descendants of its node. A node that several routes reach with the same recon values is there once, with their number
`n`; only the explode that makes rows multiplies it out (`routes`). So nested steps that lead to one node in a million
ways take no more room than its page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.match import match_element, tag_name
from ..functions.text import apply_regex, first_classified_value
from .select import below, descendants, first_child, first_descendant, let, node_attr, node_text

RECONS = "map<string,string>"


def _match(node: Column, recons: Column, n: Column) -> Column:
    return F.struct(node["node_id"].alias("node_id"), node["last_id"].alias("last_id"), recons.alias("recons"), n.alias("n"))


def no_recons() -> Column:
    return F.create_map().cast(RECONS)


def from_body(nodes: Column) -> Column:
    """The starting matches: the body, or nothing for a page without one."""
    return F.transform(F.slice(nodes, 1, 1), lambda n: _match(n, no_recons(), F.lit(1).cast("long")))


def recon_key(recon: dict) -> str:
    """The field a recon fills is always its first classification's name."""
    return recon["classification"][0]["name"]


def classify_node(recon: dict, text: Column, cls: Column) -> Column:
    """First non-blank classification of the recon's text or class, after its regex; null if none."""
    source = {"innertext": text, "class": cls}.get(tag_name(recon.get("reconValue") or ""))
    if source is None:
        return F.lit(None).cast("string")
    return let(source, lambda c: apply_regex(first_classified_value(c, recon["classification"]), recon.get("regex")))


def classified(nodes: Column, node: Column, recon: dict) -> Column:
    return classify_node(recon, node_text(nodes, node), node_attr(nodes, node, "class"))


def recon_carry(old: Column, new: Column) -> Column:
    """Values of `new` win over `old` for the same key."""
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def recon_gate(nodes: Column, matches: Column, recons: list[dict]) -> Column:
    """Add each recon's value to the match; a match for which any recon finds nothing is dropped."""

    def value(m: Column, recon: dict) -> Column:
        where = (recon.get("tag"), recon.get("keyProperty"), recon.get("valueProperty"))
        found = F.coalesce(first_child(nodes, m, *where), first_descendant(nodes, m, *where))
        return let(found, lambda n: F.when(n.isNotNull(), classified(nodes, n, recon)))

    by_key = {recon_key(r): r for r in recons}  # a later recon of the same key overrides
    keys = F.array(*[F.lit(k) for k in by_key])
    last = {k: max(i for i, r in enumerate(recons) if recon_key(r) == k) for k in by_key}
    tried = F.transform(matches, lambda m: F.struct(m.alias("m"), F.array(*[value(m, r) for r in recons]).alias("v")))
    passed = F.filter(tried, lambda t: F.forall(t["v"], lambda v: v.isNotNull()))
    values = lambda t: F.array(*[F.get(t["v"], F.lit(last[k])) for k in by_key])
    return F.transform(
        passed, lambda t: _match(t["m"], recon_carry(t["m"]["recons"], F.map_from_arrays(keys, values(t))), t["m"]["n"])
    )


def is_repeating(recons: list[dict]) -> bool:
    return all((r.get("reconRelation") or "").upper() == "REPEATING" for r in recons)


def repeating_sections(nodes: Column, anchor: Column, recons: list[dict]) -> Column:
    """Sections of an anchor as `{node_id, last_id, recons}`, one per header child.

    A section runs from its header to the next header, so it is one slice of `nodes`; what stands before
    the first header belongs to none. With several recons each key keeps its latest header's label.
    """
    is_header = lambda n: reduce(
        lambda a, b: a | b, [match_element(n, r.get("tag"), r.get("keyProperty"), r.get("valueProperty")) for r in recons]
    )
    headers = F.filter(below(nodes, anchor), lambda n: (n["parent_id"] == anchor["node_id"]) & is_header(n))

    def label(n: Column) -> Column:
        """`{key: value}` of every recon this header matches; the last recon of a key wins."""
        entries = [
            F.when(
                match_element(n, r.get("tag"), r.get("keyProperty"), r.get("valueProperty")),
                F.create_map(F.lit(recon_key(r)), classified(nodes, n, r)),
            ).otherwise(no_recons())
            for r in recons
        ]
        return reduce(recon_carry, entries)

    def section(h: Column, following: Column, recons_now: Column) -> Column:
        end = F.coalesce(following["node_id"] - 1, anchor["last_id"])
        return F.struct(h["node_id"].alias("node_id"), end.alias("last_id"), recons_now.alias("recons"))

    if len(recons) == 1:
        return let(
            headers, lambda hs: F.transform(hs, lambda h, i: section(h, F.get(hs, i + 1), label(h)))
        )
    labelled = F.transform(headers, lambda h: F.struct(h["node_id"].alias("node_id"), label(h).alias("recons")))
    empty = F.struct(no_recons().alias("now"), F.array().cast(f"array<{RECONS}>").alias("each"))

    def grow(acc: Column, h: Column) -> Column:
        return let(
            recon_carry(acc["now"], h["recons"]),
            lambda now: F.struct(now.alias("now"), F.concat(acc["each"], F.array(now)).alias("each")),
        )

    return let(
        labelled,
        lambda hs: let(
            F.aggregate(hs, empty, grow, lambda acc: acc["each"]),
            lambda each: F.transform(hs, lambda h, i: section(h, F.get(hs, i + 1), F.get(each, i))),
        ),
    )


def recons_text(recons: Column) -> Column:
    """A text that two maps share only if they are equal, whatever the order of their entries."""
    sized = lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t)
    part = lambda e: F.concat(sized(e["key"]), F.when(e["value"].isNull(), "-").otherwise(sized(e["value"])))
    return F.array_join(F.transform(F.array_sort(F.map_entries(recons)), part), "")


def within(nodes: Column, ranges: Column, fits) -> Column:
    """Matches among the nodes of ranges `{low, high, recons, n}`, which come in the order of `low`.

    Ranges that lie apart are read one after the other. Where some overlap (nested anchors), each node is taken once for
    each different recons, with the sum of `n` over the ranges around it: nodes times ranges, but no list of routes.
    """
    members = lambda r: F.filter(F.slice(nodes, r["low"] + 1, r["high"] - r["low"] + 1), fits)
    apart = lambda rs: F.flatten(F.transform(rs, lambda r: F.transform(members(r), lambda x: _match(x, r["recons"], r["n"]))))

    def overlap(rs: Column) -> Column:
        start = F.struct(F.lit(-1).alias("to"), F.lit(False).alias("any"))
        more = lambda a, r: F.struct(F.greatest(a["to"], r["high"]).alias("to"), (a["any"] | (r["low"] <= a["to"])).alias("any"))
        return F.aggregate(rs, start, more, lambda a: a["any"])

    def together(rs: Column) -> Column:
        keyed = F.transform(rs, lambda r: F.struct(recons_text(r["recons"]).alias("key"), r.alias("r")))

        def of(own: Column) -> Column:
            around = lambda x: F.aggregate(
                own, F.lit(0).cast("long"), lambda t, r: t + F.when(x["node_id"].between(r["r"]["low"], r["r"]["high"]), r["r"]["n"]).otherwise(0)
            )
            found = F.transform(F.filter(nodes, fits), lambda x: _match(x, F.get(own, F.lit(0))["r"]["recons"], around(x)))
            return F.filter(found, lambda m: m["n"] > 0)

        every = lambda ks: F.flatten(
            F.transform(F.array_distinct(F.transform(ks, lambda k: k["key"])), lambda key: let(F.filter(ks, lambda k: k["key"] == key), of))
        )
        return F.array_sort(let(keyed, every), lambda a, b: a["node_id"] - b["node_id"])

    return let(ranges, lambda rs: F.when(overlap(rs), together(rs)).otherwise(apart(rs)))


def step(nodes: Column, matches: Column, navigation: dict) -> Column:
    """The next matches: in the sections of each anchor (headers included) if its recons repeat, else below it."""
    fits = lambda n: match_element(n, navigation.get("tag"), navigation.get("keyProperty"), navigation.get("valueProperty"))
    recons = navigation.get("recon") or []
    span = lambda low, high, recons_, n: F.struct(low.alias("low"), high.alias("high"), recons_.alias("recons"), n.alias("n"))
    if recons and is_repeating(recons):
        sections = lambda m: F.transform(
            repeating_sections(nodes, m, recons), lambda s: span(s["node_id"], s["last_id"], recon_carry(m["recons"], s["recons"]), m["n"])
        )
        by_start = lambda rs: F.array_sort(rs, lambda a, b: a["low"] - b["low"])
        return within(nodes, by_start(F.flatten(F.transform(matches, sections))), fits)
    if recons:
        matches = recon_gate(nodes, matches, recons)
    return within(nodes, F.transform(matches, lambda m: span(m["node_id"] + 1, m["last_id"], m["recons"], m["n"])), fits)


def navigate(nodes: Column, navigation: dict | list[dict] | None, start: Column | None = None) -> Column:
    """All matches of a navigation: a nested spec (`nav` holds the next step) or a list of steps."""
    matches = from_body(nodes) if start is None else start
    for one in steps_of(navigation):
        matches = step(nodes, matches, one)
    return matches


def steps_of(navigation: dict | list[dict] | None) -> list[dict]:
    if isinstance(navigation, list):
        return navigation
    steps = []
    while navigation:
        steps.append(navigation)
        navigation = navigation.get("nav")
    return steps


def routes(dom: DataFrame, found: Column, *kept: str) -> DataFrame:
    """One row per route to each element of `found`: `page_id, path_id`, the other fields and `kept` columns.

    `path_id` numbers the elements of a page from 0, in order, then those that are reached again, and so on.
    """
    number = lambda fs: F.transform(fs, lambda x, i: F.struct(i.alias("at"), F.size(fs).alias("of"), x.alias("x")))
    rows = dom.select("page_id", *kept, F.inline(let(found, number)))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("x.n") - 1)))
    return rows.select("page_id", (F.col("at") + F.col("copy") * F.col("of")).alias("path_id"), *kept, "x.*").drop("n")


def matches_table(dom: DataFrame, navigation: dict | list[dict] | None) -> DataFrame:
    """Long form of `navigate`: `page_id, path_id, node_id, last_id, recons`, one row per route."""
    return routes(dom, navigate(F.col("nodes"), navigation))


def containers(found: Column) -> Column:
    """Places (from 0) of the elements with equal `recons`: an array for each container, by first appearance."""
    keyed = F.transform(found, lambda x, i: F.struct(recons_text(x["recons"]).alias("key"), i.alias("at")))

    def cut(order: Column) -> Column:
        starts = F.filter(
            F.transform(order, lambda o, j: F.when((j == 0) | (o["key"] != F.get(order, j - 1)["key"]), j)), lambda j: j.isNotNull()
        )
        upto = lambda js, g: F.coalesce(F.get(js, g + 1), F.size(order))
        one = lambda js: lambda j, g: F.transform(F.slice(order, j + 1, upto(js, g) - j), lambda o: o["at"])
        return let(starts, lambda js: F.transform(js, one(js)))

    return F.array_sort(let(F.array_sort(keyed), cut))


def _grouped(nodes: Column, navigation: dict | list[dict] | None) -> Column:
    """`{recons, first_path, n_leaves, leaves}` of every container of a page."""

    def container(found: Column):
        leaf = lambda i: F.struct(i.alias("path_id"), F.get(found, i)["node_id"].alias("node_id"), F.get(found, i)["last_id"].alias("last_id"), F.get(found, i)["n"].alias("n"))
        first = lambda c: F.get(c, F.lit(0))
        return lambda c: F.struct(
            F.get(found, first(c))["recons"].alias("recons"),
            first(c).alias("first_path"),
            F.aggregate(c, F.lit(0).cast("long"), lambda t, i: t + F.get(found, i)["n"]).alias("n_leaves"),
            F.transform(c, leaf).alias("leaves"),
        )

    return let(navigate(nodes, navigation), lambda found: F.transform(containers(found), container(found)))


def group_containers(dom: DataFrame, navigation: dict | list[dict] | None) -> DataFrame:
    """Leaves with equal recon values form one container; `first_path` is its order of appearance.

    Folded inside the page row: `page_id, recons, first_path, n_leaves` (routes) and `leaves`, each with its routes `n`.
    """
    return dom.select("page_id", F.inline(_grouped(F.col("nodes"), navigation)))


def navigate_flat(dom: DataFrame, navigation: dict | list[dict] | None) -> DataFrame:
    """Matches in container order: by the container's first appearance, then as visited in it."""
    each = lambda c: F.transform(c["leaves"], lambda x: F.struct(c["first_path"].alias("first_path"), x["node_id"].alias("node_id"), x["last_id"].alias("last_id"), x["n"].alias("n")))
    flat = routes(dom, F.flatten(F.transform(_grouped(F.col("nodes"), navigation), each)))
    return flat.select("page_id", F.struct("first_path", "path_id").alias("position"), "node_id", "last_id")
