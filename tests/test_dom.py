"""The tree rules, and what must hold for any page."""

from __future__ import annotations

import time

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from webtables.sources.dom import NodeColumns, dom_nodes, page_text, parse_pages


def nodes_of(html):
    columns = NodeColumns(detail=True)
    columns.add_page(html)
    return columns.to_arrow()[0].as_py()


def tree(html):
    """Indented tags and texts."""
    return [("  " * n["depth"]) + (repr(n["text"]) if n["tag"] == "#text" else n["tag"]) for n in nodes_of(html)]


def test_paragraphs_close_each_other():
    assert tree("<body><p><b>one<br><p>two</p><div>x</div>") == [
        "body", "  p", "    b", "      'one'", "      br", "  p", "    'two'", "  div", "    'x'",
    ]


def test_list_items_close_each_other_within_their_list():
    assert tree("<body><ul><li>1<li>2<ul><li>n</ul><li>3</ul>") == [
        "body", "  ul", "    li", "      '1'", "    li", "      '2'", "      ul", "        li", "          'n'",
        "    li", "      '3'",
    ]


def test_table_parts_close_each_other_within_their_table():
    html = "<body><table><thead><tr><th>a<th>b<tbody><tr><td><table><tr><td>x</table><td>q</table>"
    assert tree(html) == [
        "body", "  table", "    thead", "      tr", "        th", "          'a'", "        th", "          'b'",
        "    tbody", "      tr", "        td", "          table", "            tr", "              td",
        "                'x'", "        td", "          'q'",
    ]


def test_only_the_body_counts_and_raw_text_is_no_markup():
    html = '<html><head><script>var t="<body><p>";</script><style>p{}</style></head><body>a<script>x<p></script>b</body>c'
    assert tree(html) == ["body", "  'a'", "  script", "  'b'"]


def test_no_body_no_nodes():
    assert nodes_of("<p>text") == [] and nodes_of("") == [] and nodes_of(None) == []


def test_attributes():
    node = nodes_of("<body><a HREF='/x' title=\"a > b\" class=c hidden href=/second>t</a>")[1]
    assert dict(node["attrs"]) == {"href": "/x", "title": "a > b", "class": "c", "hidden": ""}


def test_offsets_unmatched_ends_comments_and_self_closing():
    html = "<body>é</i><!-- c --><span/>x<p>y<i>z</p>"
    found = nodes_of(html)
    assert [n["tag"] for n in found] == ["body", "#text", "#comment", "span", "#text", "p", "#text", "i", "#text"]
    assert [html[n["h0"]:n["h1"]] for n in found if n["tag"] in ("p", "i")] == ["y<i>z", "z"]


def test_entity_cut_short_stays_as_written():
    assert tree("<body><h1>a &amp</h1>")[-1] == "    'a &amp'"


@pytest.mark.parametrize("piece", ["<a ", "<p", '<a "', "</b ", "<!", "<b>", "<div><p>", "<li>", "<table><td>", "</p>", "<p><table>"])
def test_hostile_pages_take_linear_time(piece):
    start = time.perf_counter()
    nodes_of("<body>" + piece * 60_000)
    assert time.perf_counter() - start < 10


MARKUP = st.lists(
    st.sampled_from(
        ["<p>", "</p>", "<b>", "</b>", "<ul>", "</ul>", "<li>", "</li>", "<table>", "</table>", "<tr>", "<td>", "<th>",
         "<tbody>", "</td>", "<br>", "<div class='a b'>", "</div>", "<!-- c -->", "text", " é ", "&amp;", "<", ">", "<script>x</script>"]
    ),
    max_size=40,
)


@settings(max_examples=200, deadline=None)
@given(MARKUP)
def test_intervals_nest_and_offsets_fit(pieces):
    html = "<html><body>" + "".join(pieces)
    found = nodes_of(html)
    kids = {}
    for n in found:
        assert found[n["node_id"]] is n and n["node_id"] <= n["last_id"] < len(found)
        if n["node_id"]:
            up = found[n["parent_id"]]
            assert up["node_id"] < n["node_id"] and n["last_id"] <= up["last_id"] and n["depth"] == up["depth"] + 1
            assert n["sib_idx"] == kids.get(n["parent_id"], 0)
            kids[n["parent_id"]] = n["sib_idx"] + 1
        if n["tag"] == "#text":
            assert html[n["h0"]:n["h1"]] == n["text"]
    subtree = lambda n: [m["node_id"] for m in found if n["node_id"] < m["node_id"] <= n["last_id"]]
    for n in found:
        assert subtree(n) == [m["node_id"] for m in found if n["node_id"] in ancestors(found, m)]


def ancestors(found, node):
    up = []
    while node["parent_id"] is not None:
        node = found[node["parent_id"]]
        up.append(node["node_id"])
    return up


def test_parse_keeps_columns_and_splits_batches(spark):
    pages = spark.createDataFrame([(i, "u", f"<body><p>{i}</p>") for i in range(50)], "page_id BIGINT, url STRING, html STRING")
    dom = parse_pages(pages.coalesce(1), chunk_chars=40)
    assert dom.columns == ["page_id", "url", "nodes"]
    assert {(r.page_id, r.text) for r in page_text(dom).collect()} == {(i, str(i)) for i in range(50)}
    assert dom_nodes(dom).count() == 150


def test_parsed_pages_leave_in_batches_of_bounded_nodes(spark, monkeypatch):
    """Short pages hold many nodes for their length; what a worker holds does not grow with the rows Spark sends at a time."""
    sizes = []
    to_arrow = NodeColumns.to_arrow
    monkeypatch.setattr(NodeColumns, "to_arrow", lambda self: sizes.append(len(self.tag)) or to_arrow(self))
    pages = spark.createDataFrame([], "page_id BIGINT, html STRING")
    parses = []
    monkeypatch.setattr(type(pages), "mapInArrow", lambda self, parse, schema: parses.append(parse))
    parse_pages(pages)
    rows = pa.RecordBatch.from_pydict({"page_id": list(range(8_000)), "html": ["<body><p>a<p>b<p>c</body>"] * 8_000})
    assert sum(out.num_rows for out in parses[0](iter([rows]))) == 8_000
    assert sum(sizes) == 7 * 8_000 and max(sizes) <= 20_007
