"""Pages to node arrays.

`parse_pages` keeps one row per page and adds `nodes`, the page's elements, texts and comments in
document order. Since a node's descendants are the array slice after it, every later selection is a
column expression over that one row: extraction needs no join and no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

NODE_TYPE = (
    T.StructType()
    .add("node_id", T.IntegerType())  # preorder number = position in the array; 0 is the body
    .add("last_id", T.IntegerType())  # greatest node_id in the subtree
    .add("parent_id", T.IntegerType())
    .add("tag", T.StringType())  # lower case; '#text' and '#comment' for those kinds
    .add("attrs", T.MapType(T.StringType(), T.StringType()))
    .add("text", T.StringType())  # own text of '#text' nodes, as written (entities not decoded)
)
DETAILED_NODE_TYPE = (
    T.StructType(list(NODE_TYPE.fields))
    .add("sib_idx", T.IntegerType())
    .add("depth", T.IntegerType())
    .add("h0", T.IntegerType())  # inner HTML is html[h0:h1]
    .add("h1", T.IntegerType())
)

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = (
    "address article aside blockquote details div dl fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul"
).split()

# tag that starts -> (open tags it ends, tags that limit how far out it looks)
ENDS = {tag: (("p",), ("table", "td", "th", "caption", "button", "object")) for tag in BLOCKS}
ENDS["li"] = (("li",), ("ul", "ol", "menu"))
ENDS["td"] = ENDS["th"] = (("td", "th"), ("table",))
ENDS["tr"] = (("td", "th", "tr"), ("table",))
ENDS["tbody"] = ENDS["tfoot"] = ENDS["thead"] = (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",))

ATTRIBUTES = r"((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)"
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^<>]*+>"
    rf"|<((?i:script|style))(?=[\s/>]){ATTRIBUTES}>.*?(?:(?=</(?i:\1)\s*>)|\Z)"  # its end tag is the next match
    r"|</\s*+([a-zA-Z][^\s/<>]*+)[^<>]*+>"
    rf"|<([a-zA-Z][^\s/<>]*+){ATTRIBUTES}>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/$")


class NodeColumns:
    """The fields of a node as growing lists, for the pages of one batch."""

    def __init__(self, detail: bool = False):
        self.detail = detail
        self.last_id, self.parent_id, self.tag, self.text = [], [], [], []
        self.depth, self.h0, self.h1 = [], [], []
        self.attr_offsets, self.keys, self.values = [0], [], []
        self.page_offsets = [0]

    def add_page(self, html: str | None) -> None:
        if html:
            self._read_body(html)
        self.page_offsets.append(len(self.tag))

    def _read_body(self, html: str) -> None:
        """Append the nodes of the page body in document order; the body is node 0."""
        first = len(self.tag)  # position of this page's node 0
        stack: list[int] = []  # ids of the open elements
        opened = defaultdict(list)  # tag -> stack places where it is open
        done = 0  # text before this offset is consumed

        def add(tag, attrs, text, start, end):
            self.last_id.append(len(self.tag) - first)
            self.parent_id.append(stack[-1] if stack else None)
            self.tag.append(tag)
            self.text.append(text)
            if self.detail:
                self.depth.append(len(stack))
                self.h0.append(start)
                self.h1.append(end)
            if attrs and not attrs.isspace():
                seen = set()
                for name, double, single, bare in ATTRIBUTE.findall(attrs):
                    name = name.lower()
                    if name not in seen:
                        seen.add(name)
                        self.keys.append(name)
                        self.values.append(double or single or bare)
            self.attr_offsets.append(len(self.keys))

        def close_from(place, offset):
            last = len(self.tag) - 1 - first
            for node_id in stack[place:]:
                opened[self.tag[first + node_id]].pop()
                self.last_id[first + node_id] = last
                if self.detail:
                    self.h1[first + node_id] = offset
            del stack[place:]

        for found in MARKUP.finditer(html):
            start, offset = found.span()
            raw, raw_attrs, end_tag, start_tag, attrs = found.groups()
            if stack and start > done:
                add("#text", None, html[done:start], done, start)
            done = offset
            if start_tag:
                tag = start_tag.lower()
                if not stack:
                    if tag != "body" or len(self.tag) > first:
                        continue
                elif tag == "body":
                    continue
                elif tag in ENDS:
                    ends, limits = ENDS[tag]
                    if any([opened[t] for t in ends]):
                        limit = max([opened[t][-1] for t in limits if opened[t]], default=-1)
                        inside = [opened[t][k] for t in ends if (k := bisect_right(opened[t], limit)) < len(opened[t])]
                        if inside:
                            close_from(min(inside), start)
                add(tag, attrs, None, offset, offset)
                if tag not in VOID and not (attrs and SELF_CLOSED.search(attrs)):
                    opened[tag].append(len(stack))
                    stack.append(len(self.tag) - 1 - first)
            elif end_tag:
                tag = end_tag.lower()
                if stack and tag in ("body", "html"):
                    close_from(0, start)
                    break
                if opened[tag]:
                    close_from(opened[tag][-1], start)
            elif raw:
                if stack:
                    add(raw.lower(), raw_attrs, None, found.end(2) + 1, offset)
            elif stack and html.startswith("<!--", start):
                add("#comment", None, None, start, offset)
        if stack:
            if len(html) > done:
                add("#text", None, html[done:], done, len(html))
            close_from(0, len(html))

    def to_arrow(self) -> pa.Array:
        ints, strings = pa.int32(), pa.string()
        offsets = np.asarray(self.page_offsets, np.int32)
        firsts = np.repeat(offsets[:-1], np.diff(offsets))  # position of node 0, per node
        columns = {
            "node_id": pa.array(np.arange(len(firsts), dtype=np.int32) - firsts),
            "last_id": pa.array(self.last_id, ints),
            "parent_id": pa.array(self.parent_id, ints),
            "tag": pa.array(self.tag, strings),
            "attrs": pa.MapArray.from_arrays(
                pa.array(self.attr_offsets, ints), pa.array(self.keys, strings), pa.array(self.values, strings)
            ),
            "text": pa.array(self.text, strings),
        }
        if self.detail:
            columns["sib_idx"] = pa.array(self._sibling_numbers(firsts))
            columns |= {name: pa.array(getattr(self, name), ints) for name in ("depth", "h0", "h1")}
        nodes = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
        return pa.ListArray.from_arrays(pa.array(offsets), nodes)

    def _sibling_numbers(self, firsts: np.ndarray) -> np.ndarray:
        """Number of earlier children of the same parent, per node."""
        parent = np.array([-1 if p is None else p for p in self.parent_id], np.int64)
        family = np.where(parent < 0, -1 - firsts, parent + firsts)
        order = np.argsort(family, kind="stable")
        starts = np.flatnonzero(np.diff(family[order], prepend=np.iinfo(np.int64).min))
        numbers = np.empty(len(order), np.int32)
        numbers[order] = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
        return numbers


#: Nodes that leave the Python worker together, about: as lists of objects they take several hundred bytes each.
CHUNK_NODES = 20_000


def parse_pages(pages: DataFrame, detail: bool = False, chunk_chars: int = 8 << 20, chunk_nodes: int = CHUNK_NODES) -> DataFrame:
    """Add `nodes` to each page and drop `html`. A page without a body gets an empty array.

    With `detail`, `html` stays and nodes also have their depth, sibling number and place in it, which only
    `node_inner_html` and ad-hoc queries need. Output leaves the Python worker in batches of about
    `chunk_chars` characters of HTML or `chunk_nodes` nodes, so memory does not depend on how many pages Spark sends at
    a time: short pages hold many nodes for their length.
    """
    kept = [c for c in pages.columns if detail or c != "html"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column("html")
            start, size, nodes = 0, 0, NodeColumns(detail)
            for row in range(batch.num_rows):
                page = html[row].as_py()
                nodes.add_page(page)
                size += len(page or "")
                if size >= chunk_chars or len(nodes.tag) >= chunk_nodes or row + 1 == batch.num_rows:
                    columns = [batch.column(c).slice(start, row + 1 - start) for c in kept]
                    yield pa.RecordBatch.from_arrays([*columns, nodes.to_arrow()], names=[*kept, "nodes"])
                    start, size, nodes = row + 1, 0, NodeColumns(detail)

    nodes_type = T.ArrayType(DETAILED_NODE_TYPE if detail else NODE_TYPE)
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("nodes", nodes_type)])
    return pages.mapInArrow(parse, schema)


def store_dom(dom: DataFrame, path: str) -> DataFrame:
    """Write parsed pages so that many extractions share one parse; returns the stored table."""
    dom.write.mode("errorifexists").parquet(path)
    return dom.sparkSession.read.schema(dom.schema).parquet(path)


def dom_nodes(dom: DataFrame) -> DataFrame:
    """Long form: one row per node, with all fields `parse_pages` gave."""
    return dom.select("page_id", F.inline("nodes"))


def page_text(dom: DataFrame) -> DataFrame:
    """All visible text of each page, in document order."""
    return dom.select("page_id", F.array_join(F.col("nodes")["text"], "").alias("text"))
