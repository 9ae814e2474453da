"""HTML tables: spans, headers, padding, rejects; row spans against brute force."""

from __future__ import annotations

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from webtables.operators.navigate import navigate
from webtables.operators.tables import _place, find_tables, parse_table
from webtables.plans.extract import extract_entities, extract_errors


@pytest.fixture
def read(dom_of):
    def parse(table):
        tables = find_tables(dom_of("<body>" + table), navigate(F.col("nodes"), [{"tag": "table"}]))
        row = parse_table(tables).first()
        return row.error, row["columns"], row["rows"]

    return parse


HEAD = "<thead><tr><th>A<th>B<th>C</thead>"


def test_row_and_column_spans(read):
    body = "<tbody><tr><td rowspan=3>r<td>1<td rowspan=2>2<tr><td>3<tr><td colspan=2>4</tbody>"
    assert read(f"<table>{HEAD}{body}</table>") == (None, ["A", "B", "C"], [["r", "1", "2"], ["r", "3", "2"], ["r", "4", "4"]])


def test_cells_are_cleaned_and_short_rows_padded(read):
    body = "<tbody><tr><td> a &amp;\n b&nbsp;<td>&amp;#12;x&amp;#1;y&amp;#2;</tbody>"
    assert read(f"<table>{HEAD}{body}</table>") == (None, ["A", "B", "C"], [["a & b", "y", ""]])


def test_header_rows_join(read):
    head = (
        "<thead><tr><th rowspan=2>Key</th><th colspan=2>Spec</th><th rowspan=2 colspan=2>LeftRight</th></tr>"
        "<tr><th>Brand</th><th>S p-e c</th></tr></thead>"
    )
    assert read(f"<table>{head}<tbody></tbody></table>")[1] == ["Key", "Spec-Brand", "Spec", "Left", "Righ"]


def test_headers_without_thead_and_nameless_columns(read):
    table = "<table><tbody><tr><th>A</th> <th></th><th></th></tr><tr><th>v</th><td>1</td></tr></tbody></table>"
    assert read(table) == (None, ["A", "Column1", "Column2"], [["v", "1", ""]])


@pytest.mark.parametrize(
    "table, reason",
    [
        ("<table><tr><td>1</table>", "no tbody"),
        (f"<table>{HEAD}</table>", "no tbody"),
        (f"<table>{HEAD}<tbody><tr><td colspan=4>1</table>", "row too wide"),
        (f"<table>{HEAD}<tbody><tr><td rowspan=x>1</table>", "bad span"),
        ("<table><thead><tr><th>A<th>A</thead><tbody></table>", "duplicate header"),
    ],
)
def test_rejects(read, table, reason):
    assert read(table) == (reason, None, None)


def test_table_entities_and_guard(pages_of):
    spec = {
        "navigation": {"tag": "table"},
        "target": {"value": "Table", "classType": "T", "recon": {"tag": "td", "classification": [
            {"name": "X", "findBy": "B|C"}, {"name": "Y", "findBy": "%D"}, {"name": "Z", "findBy": "none"}]}},
    }
    wide = "<table><thead><tr><th>A<th>B<th>C<th>AD</thead><tbody><tr><td>1<td>2<td>3<td>4<tr><td>5</tbody></table>"
    pages = pages_of("<body>" + wide + f"<table>{HEAD}<tbody></table>")
    rows = extract_entities(pages, spec).orderBy("entity_idx").collect()
    assert [r.data for r in rows] == [{"X": "2", "Y": "4"}, {"X": "", "Y": ""}]
    assert [r.message for r in extract_errors(pages, spec).collect()] == ["too few columns"]


def brute_force(table):
    """Fill a grid cell by cell, the way a browser lays out row spans."""
    taken, number = {}, 0
    for r, row in enumerate(table):
        column = 0
        for span in row:
            while (r, column) in taken:
                column += 1
            for down in range(max(span, 1)):
                taken[r + down, column] = number if down == 0 else -2 - number
            number += 1
    width = lambda r: max((c + 1 for (at, c) in taken if at == r), default=0)
    return [[taken.get((r, c), -1) for c in range(width(r))] for r in range(len(table))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=4), max_size=6))
def test_row_span_placement(table):
    placed = _place(pa.array([table, None], pa.list_(pa.list_(pa.int32())))).to_pylist()
    assert placed == [brute_force(table), None]


def test_a_span_of_millions_is_not_built(dom_of):
    wide = "<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td colspan=100000000>x</td></tr></tbody></table>"
    head = "<table><thead><tr><th colspan=100000000>A</th></tr></thead><tbody><tr><td>x</td></tr></tbody></table>"
    many = "<table><thead><tr><th>A</th></tr></thead><tbody><tr>" + "<td colspan=2000000000>x</td>" * 3 + "</tr></tbody></table>"
    tall = "<table><thead><tr><th rowspan=2 colspan=9000>A</th></tr><tr><th colspan=9000>B</th></tr></thead><tbody><tr><td>x</td></tr></tbody></table>"
    tables = parse_table(find_tables(dom_of(*("<body>" + t for t in (wide, head, many, tall))), navigate(F.col("nodes"), [{"tag": "table"}])))
    assert [r["error"] for r in tables.orderBy("page_id").collect()] == ["row too wide", "header too wide", "row too wide", "header too wide"]
