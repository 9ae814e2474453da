"""Selection, navigation and assembly on small pages made by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from webtables.functions.match import match_value
from webtables.operators.entities import leaves
from webtables.operators.navigate import matches_table, navigate
from webtables.operators.select import (
    descendants, first_child, first_descendant, has_child, node_attr, node_by_id, node_own_text, node_text, root, target_value,
)
from webtables.plans.extract import extract_entities, extract_errors, extract_outcomes, spec_pages
from webtables.sources.dom import NodeColumns, store_dom


def recon(tag, name, **more):
    return {"tag": tag, "reconValue": "InnerText", "classification": [{"name": name}]} | more


def value(dom, expression):
    return [r[0] for r in dom.orderBy("page_id").select(expression).collect()]


def texts(dom, navigation):
    nodes = F.col("nodes")
    return value(dom, F.transform(navigate(nodes, navigation), lambda m: node_text(nodes, m)))


@pytest.mark.parametrize(
    "pattern, expected",
    [("a", "a"), ("a|b", "a b"), ("%x", "ax bx"), ("a%", "a ax axb"), ("%x%", "ax axb bx"), ("a%&&%b", "axb"), ("a%b", "")],
)
def test_patterns(spark, pattern, expected):
    rows = spark.createDataFrame([(v,) for v in ("a", "b", "ax", "bx", "axb")], "v STRING")
    assert sorted(r.v for r in rows.where(match_value(F.col("v"), pattern)).collect()) == sorted(expected.split())


def test_selection(dom_of):
    dom = dom_of('<body><div class="a b"><p id=x>one</p><p>two<b>!</b></p></div><div class=a><p>three</p></div>')
    n = F.col("nodes")
    whole_class = descendants(n, root(n), "div", "class", "a")
    assert value(dom, F.transform(whole_class, lambda d: node_text(n, d))) == [["three"]]
    assert value(dom, node_text(n, node_by_id(n, root(n), "x"))) == ["one"]
    assert value(dom, node_text(n, first_descendant(n, root(n), "p", "id"))) == ["one"]
    assert value(dom, first_child(n, root(n), "p")) == [None]
    assert value(dom, has_child(n, root(n), "div", "class", "a|c")) == [True]
    assert value(dom, node_attr(n, first_descendant(n, root(n), "div"), "Class")) == ["a b"]
    assert value(dom, node_own_text(n, F.get(descendants(n, root(n), "p"), F.lit(1)))) == ["two"]


def test_absent_nodes_give_null(dom_of):
    dom = dom_of("<body>x</body>", "no body")
    n = F.col("nodes")
    assert value(dom, node_text(n, first_descendant(n, root(n), "p"))) == [None, None]
    assert texts(dom, [{"tag": "p"}]) == [[], []]


def test_bag_semantics(dom_of):
    steps = [{"tag": "div"}, {"tag": "i"}]
    dom = dom_of("<body><div><div><i>1</i></div><i>2</i></div>")
    assert texts(dom, steps) == [["1", "2"]]  # each node once, with its number of routes
    rows = leaves(dom, navigate(F.col("nodes"), steps), {"value": "InnerText"}).orderBy("path_id").collect()
    assert [r.value for r in rows] == ["1", "2", "1"]


def test_a_million_routes_take_the_room_of_the_page(dom_of):
    deep = dom_of("<body>" + "<div>" * 1_000 + "x")
    found = deep.select(F.inline(navigate(F.col("nodes"), [{"tag": "div"}] * 3))).agg(F.count("*").alias("nodes"), F.sum("n").alias("routes")).first()
    assert (found["nodes"], found["routes"]) == (998, 1_000 * 999 * 998 // 6)
    rows = matches_table(dom_of("<body>" + "<div>" * 60), [{"tag": "div"}] * 3)
    assert rows.count() == 60 * 59 * 58 // 6 and rows.select("path_id").distinct().count() == rows.count()


def test_gate_drops_branch_and_prefers_direct_child(dom_of):
    dom = dom_of("<body><div><i><h1>deep</h1></i><h1>own</h1><p>a</p></div><div><p>b</p></div><div><h1> </h1><p>c</p></div>")
    rows = matches_table(dom, [{"tag": "div"}, {"tag": "p", "recon": [recon("h1", "T")]}]).collect()
    assert [r.recons for r in rows] == [{"T": "own"}]


def test_gate_with_class_find_by_and_regex(dom_of):
    dom = dom_of('<body><div><i class="big red">x</i><p>a</p></div><div><i class="small">x</i><p>b</p></div><div><i>x</i><p>c</p></div>')
    rule = {
        "tag": "i", "reconValue": "Class", "regex": {"action": "REMOVE", "regex": "big "},
        "classification": [{"name": "FIRST", "findBy": "none"}, {"name": "COLOUR", "findBy": "%red"}],
    }
    rows = matches_table(dom, [{"tag": "div"}, {"tag": "p", "recon": [rule]}]).collect()
    assert [r.recons for r in rows] == [{"FIRST": "red"}]  # the key is the first classification's name


SECTIONS = (
    "<body><article><p>pre</p><ul><li>x</ul><h2>A</h2><ul><li>1<li>2</ul><h2>A</h2><ul><li>3</ul>"
    "<h3>s</h3><div><ul><li>4</ul></div><h2> </h2><ul><li>5</ul></article><article><ul><li>6</ul></article>"
)


def sections(dom, recons):
    nodes = F.col("nodes")
    found = navigate(nodes, [{"tag": "article"}, {"tag": "li", "recon": recons}])
    pair = lambda m: F.struct(m["recons"].alias("r"), node_text(nodes, m).alias("t"))
    return [(row["r"], row["t"]) for row in value(dom, F.transform(found, pair))[0]]


def test_repeating_sections(dom_of):
    found = sections(dom_of(SECTIONS), [recon("h2", "H", reconRelation="REPEATING")])
    assert found == [({"H": "A"}, "1"), ({"H": "A"}, "2"), ({"H": "A"}, "3"), ({"H": "A"}, "4"), ({"H": None}, "5")]


def test_repeating_sections_with_two_kinds_of_header(dom_of):
    rules = [recon("h2", "H", reconRelation="REPEATING"), recon("h3", "S", reconRelation="REPEATING")]
    found = sections(dom_of(SECTIONS), rules)
    assert found == [
        ({"H": "A"}, "1"), ({"H": "A"}, "2"), ({"H": "A"}, "3"), ({"H": "A", "S": "s"}, "4"), ({"H": None, "S": "s"}, "5"),
    ]


def test_target_values(dom_of):
    dom = dom_of("<body><li><a href='/1'>one<b>!</b></a><a href='/2'>two</a></li><li>none</li>")
    n = F.col("nodes")
    read = lambda target: value(dom, F.transform(descendants(n, root(n), "li"), lambda x: target_value(n, x, target)))[0]
    assert read({"tag": "a", "value": "Href"}) == ["/1", None]
    assert read({"tag": "a", "value": "_SharpText"}) == ["one", None]
    assert read({"tag": "a", "value": "InnerText", "regex": {"action": "REMOVEINSENSITIVE", "regex": "ONE"}}) == ["!", None]
    assert read({"value": "Title"}) == ["one!two", "none"]


MENU = {
    "navigation": [{"tag": "aside", "recon": [recon("em", "DAY")]}, {"tag": "var", "recon": [recon("h6", "COURSE", reconRelation="REPEATING")]}],
    "target": {
        "tag": "a", "value": "Href", "regex": {"action": "REMOVE", "regex": "#"}, "recon": {"classification": [{"name": "DISH"}]},
        "HCValues": [{"name": "HOUSE", "value": "H"}], "classType": "Dish",
    },
}


def test_single_field_entities(pages_of):
    page = "<body><em>Monday</em><aside><var><a href='#0'>x</a></var><h6>Cold</h6><var>1<a href='#a'>x</a></var><h6>Warm</h6><var><a href='#b'>y</a></var><var>none</var></aside>"
    rows = extract_entities(pages_of(page), MENU).orderBy("entity_idx").collect()
    assert [(r.data, r.class_type) for r in rows] == [
        ({"DISH": "a", "DAY": "Monday", "COURSE": "Cold", "HOUSE": "H"}, "Dish"),
        ({"DISH": "b", "DAY": "Monday", "COURSE": "Warm", "HOUSE": "H"}, "Dish"),
    ]
    assert [(r.message) for r in extract_errors(pages_of(page, "no body"), MENU).collect()] == ["no target value", "no body"]


FARES = {
    "navigation": [{"tag": "table"}, {"tag": "samp", "recon": [recon("caption", "LINE")]}],
    "target": {
        "value": "_SharpText", "reconRelation": "CHILD", "classType": "Fare",
        "recon": {"tag": "sup", "reconValue": "InnerText", "classification": [
            {"name": "ADULT", "findBy": "Adult%"}, {"name": "CHILD", "findBy": "Child|Pupil"}, {"name": "DOG", "findBy": "%og"}]},
    },
}
LINES = (
    "<samp><sup>Adults</sup>3.10</samp><samp><sup>Adult</sup>3.10</samp><samp><sup>Adult</sup>3.50</samp><samp>from May</samp>"
    "<samp><sup>Pupil</sup>1.20</samp><samp><sup>Bike</sup>2.00</samp><samp><sup>Child</sup></samp>"
)


def lines(*captions):
    """A page with one table of fares for each caption, None for a table without."""
    caption = lambda c: f"<caption>{c}</caption>" if c else ""
    return "<body>" + "".join(f"<table>{caption(c)}<tbody><tr><td>{LINES}</td></tr></tbody></table>" for c in captions)


FARE = {"ADULT": "3.10", "CHILD": "1.20", "MISC": "from May 2.00"}


def test_pivot_entities(pages_of):
    pages = pages_of(lines("U1", None, "U2"), lines(None))
    rows = extract_entities(pages, FARES).orderBy("entity_idx").collect()
    assert [r.data for r in rows] == [FARE | {"LINE": "U1"}, FARE | {"LINE": "U2"}]
    assert sorted((r.page_id, r.message, r.detail or "") for r in extract_errors(pages, FARES).collect()) == 2 * [(0, "label set twice", "3.50")] + 2 * [(0, "no target value", "")]


def test_containers_of_one_label_are_one_entity(pages_of):
    rows = extract_entities(pages_of(lines("U1", "U2", "U1")), FARES).orderBy("entity_idx").collect()
    assert [(r.data["LINE"], r.data["MISC"]) for r in rows] == [("U1", "from May 2.00 from May 2.00"), ("U2", "from May 2.00")]


def test_everything_from_one_pass(pages_of, spark, tmp_path):
    pages_of(lines("U1", "ADULT"), "none", lines()).write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    found = extract_outcomes(pages, FARES)
    assert sorted((r.page_id, r.message or "") for r in found.collect()) == [(0, ""), (0, "")] + 2 * [(0, "label set twice")] + 2 * [(0, "no target value")] + [(1, "no body")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan
    tables = extract_outcomes(pages, {"navigation": [{"tag": "table"}], "target": {"value": "Table", "recon": {"tag": "tr", "classification": [{"name": "A"}]}}})
    assert sorted((r.page_id, r.message) for r in tables.collect()) == [(0, "row too wide"), (0, "row too wide"), (1, "no body")]
    assert tables._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_field_set_twice_fails_the_entity(pages_of):
    spec = FARES | {"target": FARES["target"] | {"HCValues": [{"name": "LINE", "value": "x"}]}}
    assert extract_entities(pages_of(lines("U1")), spec).count() == 0
    assert "field set twice" in [r.message for r in extract_errors(pages_of(lines("U1")), spec).collect()]


def test_label_misc_shares_the_field(pages_of):
    labels = [{"name": "MISC", "findBy": "Adult%"}, {"name": "CHILD", "findBy": "Pupil"}]
    spec = FARES | {"target": FARES["target"] | {"recon": FARES["target"]["recon"] | {"classification": labels}}}
    pages = pages_of(lines("U1"))
    assert [r.data["MISC"] for r in extract_entities(pages, spec).collect()] == ["3.10 3.10 3.50 from May 2.00"]
    assert [r.message for r in extract_errors(pages, spec).collect()] == ["no target value"]


def test_constant_given_twice_fails_the_entity_only(pages_of):
    twice = [{"name": "A", "value": "x"}, {"name": "A", "value": "y"}]
    spec = FARES | {"target": FARES["target"] | {"HCValues": twice}}
    assert extract_entities(pages_of(lines("U1")), spec).count() == 0
    assert "field set twice" in [r.message for r in extract_errors(pages_of(lines("U1")), spec).collect()]


def test_table_classifications_may_share_a_name(pages_of):
    table = "<body><table><tbody><tr><th>K</th><th>{}</th><th>C</th><th>D</th></tr><tr><td>1</td><td>2</td><td>3</td><td>4</td></tr></tbody></table>"
    names = [{"name": "V", "findBy": "Old"}, {"name": "V", "findBy": "New"}, {"name": "V", "findBy": "Both"}, {"name": "V", "findBy": "B%"}]
    spec = {"navigation": {"tag": "table"}, "target": {"value": "Table", "classType": "T", "recon": {"tag": "tr", "classification": names}}}
    pages = pages_of(table.format("Old"), table.format("New"), table.format("Both"))
    assert {(r.page_id, r.data["V"]) for r in extract_entities(pages, spec).collect()} == {(0, "2"), (1, "2")}
    assert (2, "field set twice") in {(r.page_id, r.message) for r in extract_errors(pages, spec).collect()}


def test_separator_cuts_before_the_parse(pages_of):
    spec = {"separatorId": "<!--start-->", "navigation": {"tag": "li"}, "target": {"value": "InnerText", "recon": {"classification": [{"name": "ITEM"}]}}}
    pages = pages_of("<head><!--start--></head><body><li>a<!--start--><li>b</body>", "<body><li>c")
    assert [r.data["ITEM"] for r in extract_entities(pages, spec).collect()] == ["b"]
    assert [(r.page_id, r.message) for r in extract_errors(pages, spec).collect()] == [(1, "marker missing")]


def test_extraction_needs_no_shuffle(pages_of, spark, tmp_path):
    pages_of("<body><p>x").write.parquet(str(tmp_path / "pages"))
    for spec in (MENU, FARES):
        plan = extract_entities(spark.read.parquet(str(tmp_path / "pages")), spec)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "ReadSchema: struct<page_id:bigint,html:string>" in plan
        assert plan.count("MapInArrow") == 1


def test_extractions_share_a_stored_parse(pages_of, tmp_path):
    pages = pages_of(lines("U1"))
    dom = store_dom(spec_pages(pages, FARES), str(tmp_path / "dom"))
    assert [r.data["ADULT"] for r in extract_entities(pages, FARES, dom).collect()] == ["3.10"]
    assert extract_errors(pages, FARES, dom).count() == 2


def test_leaves_are_in_document_order(dom_of):
    dom = dom_of("<body><ul><li>1<li>2</ul><ul><li>3</ul>")
    rows = leaves(dom, navigate(F.col("nodes"), [{"tag": "ul"}, {"tag": "li"}]), {"value": "InnerText"}).orderBy("path_id").collect()
    assert [r.value for r in rows] == ["1", "2", "3"]


# ---- random pages against a plain recursive reading -----------------------------------------------

PIECES = ["<div class='a'>", "<div class='b'>", "</div>", "<ul>", "</ul>", "<li>", "<i>x</i>", "<h2>h</h2>", "<p>y", "word", "<b>"]
STEPS = {
    "bag": [{"tag": "div"}, {"tag": "li"}],
    "attribute": [{"tag": "div", "keyProperty": "class", "valueProperty": "a|c"}, {"tag": "ul"}, {"tag": "i"}],
    "gate": [{"tag": "div"}, {"tag": "li", "recon": [recon("i", "I"), recon("h2", "H")]}, {"tag": "p"}],
    "sections": [{"tag": "div"}, {"tag": "li", "recon": [recon("h2", "H", reconRelation="REPEATING")]}],
    "two headers": [{"tag": "div"}, {"tag": "i", "recon": [recon("h2", "H", reconRelation="REPEATING"), recon("p", "P", reconRelation="REPEATING")]}],
}


def plain_walk(found, steps):
    """Node ids and recons in visiting order, by direct recursion over a page's nodes."""
    inner = lambda n: "".join(m["text"] or "" for m in found[n["node_id"]:n["last_id"] + 1])
    below = lambda n: found[n["node_id"] + 1:n["last_id"] + 1]
    kids = lambda n: [m for m in below(n) if m["parent_id"] == n["node_id"]]

    def fits(n, rule):
        values = (rule.get("valueProperty") or "").split("|")
        return n["tag"] == rule["tag"] and (not rule.get("keyProperty") or dict(n["attrs"]).get(rule["keyProperty"]) in values)

    def visit(n, left, recons):
        if not left:
            return [(n["node_id"], recons)]
        step, rules = left[0], left[0].get("recon") or []
        if rules and all(r.get("reconRelation") == "REPEATING" for r in rules):
            out, now, opened = [], dict(recons), False
            for kid in kids(n):
                for rule in rules:
                    if fits(kid, rule):
                        now, opened = now | {rule["classification"][0]["name"]: inner(kid) or None}, True
                if opened:
                    out += [hit for m in [kid, *below(kid)] if fits(m, step) for hit in visit(m, left[1:], now)]
            return out
        for rule in rules:
            hits = [m for m in kids(n) if fits(m, rule)] or [m for m in below(n) if fits(m, rule)]
            if not hits or not inner(hits[0]).strip():
                return []
            recons = recons | {rule["classification"][0]["name"]: inner(hits[0])}
        return [hit for m in below(n) if fits(m, step) for hit in visit(m, left[1:], recons)]

    return visit(found[0], steps, {}) if found else []


@pytest.mark.parametrize("name", STEPS)
def test_navigation_equals_a_plain_recursion(dom_of, name):
    draw = random.Random(7)
    pages = ["<body>" + "".join(draw.choices(PIECES, k=draw.randrange(40))) for _ in range(150)]
    found = navigate(F.col("nodes"), STEPS[name])
    got = {r.page_id: [(m.node_id, m.recons, m.n) for m in r.m] for r in dom_of(*pages).select("page_id", found.alias("m")).collect()}
    order = lambda node, recons, n: (node, sorted(recons.items(), key=str), n)
    for number, page in enumerate(pages):
        columns = NodeColumns()
        columns.add_page(page)
        routes = {}
        for node, recons in plain_walk(columns.to_arrow()[0].as_py(), STEPS[name]):
            key = (node, tuple(sorted(recons.items())))
            routes[key] = routes.get(key, 0) + 1
        assert [m[0] for m in got[number]] == sorted(m[0] for m in got[number])
        assert sorted((order(*m) for m in got[number]), key=str) == sorted((order(k[0], dict(k[1]), n) for k, n in routes.items()), key=str), page
    assert any(got.values()) and any(m[2] > 1 for found in got.values() for m in found) == (name in ("bag", "attribute", "gate", "sections", "two headers"))
