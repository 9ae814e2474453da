"""Node selection over a page's `nodes` array.

`nodes` is the column made by `parse_pages`; an anchor is any struct with `node_id` and `last_id`. A node
sits at array position `node_id`, so its subtree is one slice: each function reads that slice only.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.match import match_element, tag_name


def below(nodes: Column, anchor: Column) -> Column:
    """All descendants, document order."""
    return F.slice(nodes, anchor["node_id"] + 2, anchor["last_id"] - anchor["node_id"])


def root(nodes: Column) -> Column:
    """The body as an anchor; null for a page without one."""
    return F.get(nodes, F.lit(0))


def node_at(nodes: Column, anchor: Column) -> Column:
    return F.get(nodes, anchor["node_id"])


def descendants(
    nodes: Column, anchor: Column, tag: str | None, key: str | None = None, pattern: str | None = None
) -> Column:
    return F.filter(below(nodes, anchor), lambda n: match_element(n, tag, key, pattern))


def first_descendant(
    nodes: Column, anchor: Column, tag: str | None, key: str | None = None, pattern: str | None = None
) -> Column:
    return F.get(descendants(nodes, anchor, tag, key, pattern), F.lit(0))


def children(
    nodes: Column, anchor: Column, tag: str | None, key: str | None = None, pattern: str | None = None
) -> Column:
    own = lambda n: (n["parent_id"] == anchor["node_id"]) & match_element(n, tag, key, pattern)
    return F.filter(below(nodes, anchor), own)


def all_children(nodes: Column, anchor: Column) -> Column:
    return F.filter(below(nodes, anchor), lambda n: n["parent_id"] == anchor["node_id"])


def children_by_tag(nodes: Column, anchor: Column, tag: str) -> Column:
    return children(nodes, anchor, tag)


def first_child(
    nodes: Column, anchor: Column, tag: str | None, key: str | None = None, pattern: str | None = None
) -> Column:
    return F.get(children(nodes, anchor, tag, key, pattern), F.lit(0))


def node_by_id(nodes: Column, anchor: Column, id_value: str) -> Column:
    """First descendant whose `id` attribute equals a value."""
    same = lambda n: F.coalesce(F.try_element_at(n["attrs"], F.lit("id")) == id_value, F.lit(False))
    return F.get(F.filter(below(nodes, anchor), same), F.lit(0))


def has_child(
    nodes: Column, anchor: Column, tag: str | None, key: str | None = None, pattern: str | None = None
) -> Column:
    own = lambda n: (n["parent_id"] == anchor["node_id"]) & match_element(n, tag, key, pattern)
    return F.exists(below(nodes, anchor), own)


# ---- values --------------------------------------------------------------------------------------


def node_text(nodes: Column, anchor: Column) -> Column:
    """Inner text: the texts in the subtree, entities not decoded, script, style and comments left out."""
    whole = F.slice(nodes, anchor["node_id"] + 1, anchor["last_id"] - anchor["node_id"] + 1)
    return F.array_join(whole["text"], "")


def node_attr(nodes: Column, anchor: Column, name: str) -> Column:
    return F.try_element_at(node_at(nodes, anchor)["attrs"], F.lit(tag_name(name)))


def node_own_text(nodes: Column, anchor: Column) -> Column:
    """Text of the first text child; null when there is none."""
    return first_child(nodes, anchor, "#text")["text"]


def node_inner_html(html: Column, nodes: Column, anchor: Column) -> Column:
    node = node_at(nodes, anchor)
    return F.substring(html, node["h0"] + 1, node["h1"] - node["h0"])


def let(value: Column, use) -> Column:
    """Bind `value` once inside an expression, since lambdas do not share repeated subexpressions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def target_node(nodes: Column, anchor: Column, target: dict) -> Column:
    """The element a value is read from: the anchor, or its first matching direct child."""
    if not target.get("tag"):
        return F.struct(anchor["node_id"].alias("node_id"), anchor["last_id"].alias("last_id"))
    child = first_child(nodes, anchor, target["tag"], target.get("keyProperty"), target.get("valueProperty"))
    return let(child, lambda n: F.when(n.isNotNull(), F.struct(n["node_id"].alias("node_id"), n["last_id"].alias("last_id"))))


def target_value(nodes: Column, anchor: Column, target: dict) -> Column:
    """Text, `href` or own text of the target element, after the target's regex. Null: not found."""
    from ..functions.text import apply_regex

    kind = tag_name(target.get("value") or "InnerText")
    read = {"href": lambda n: node_attr(nodes, n, "href"), "#text": lambda n: node_own_text(nodes, n)}
    value = read.get(kind, lambda n: node_text(nodes, n))
    node = target_node(nodes, anchor, target)
    return apply_regex(let(node, lambda n: F.when(n.isNotNull(), value(n))), target.get("regex"))


def recon_value(nodes: Column, anchor: Column, recon: dict) -> Column:
    kind = tag_name(recon.get("reconValue") or "")
    if kind == "innertext":
        return node_text(nodes, anchor)
    if kind == "title":
        return node_attr(nodes, anchor, "title")
    return F.lit("")
