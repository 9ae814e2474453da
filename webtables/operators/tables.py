"""HTML tables to grids.

Cells are cut out of the page row with column expressions and tables become rows of their own. Only the
placement of row spans is sequential; one Arrow UDF gets the span numbers of tables that have them, and
nothing of any other table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import clean_cell, header_name
from .navigate import routes
from .select import all_children, children, first_child, let, node_text

MIN_COLUMNS = 4
#: Columns beyond which a header is taken for a mistake, such as a span of millions.
MOST_COLUMNS = 1 << 14


# ---- cells ---------------------------------------------------------------------------------------


def table_sections(nodes: Column, table: Column) -> Column:
    """`{header, body}`: arrays of row nodes, null where the table lacks the part they come from.

    With a `thead`, its rows are headers and those of `tbody` the body. Without one, rows of `tbody`
    made only of header cells and text are headers, and rows with any data cell are the body.
    """

    def split(parts: Column) -> Column:
        rows = F.when(parts["tbody"].isNotNull(), children(nodes, parts["tbody"], "tr"))
        top = F.when(parts["thead"].isNotNull(), children(nodes, parts["thead"], "tr"))
        only_headers = lambda r: F.forall(all_children(nodes, r), lambda c: c["tag"].isin("th", "#text"))
        has_data = lambda r: F.exists(all_children(nodes, r), lambda c: c["tag"] == "td")
        return F.struct(
            F.coalesce(top, F.filter(rows, only_headers)).alias("header"),
            F.when(parts["thead"].isNotNull(), rows).otherwise(F.filter(rows, has_data)).alias("body"),
        )

    parts = F.struct(
        first_child(nodes, table, "thead").alias("thead"), first_child(nodes, table, "tbody").alias("tbody")
    )
    return let(parts, split)


def _span(cell: Column, name: str) -> Column:
    """A missing span is 1; a span that is no number is null."""
    written = F.try_element_at(cell["attrs"], F.lit(name))
    return F.when(written.isNull(), F.lit(1)).otherwise(F.trim(written).try_cast("int"))


def table_cells(nodes: Column, rows: Column, tags: tuple[str, ...]) -> Column:
    """Per row, its cells as `{text, colspan, rowspan}`."""
    cell = lambda c: F.struct(
        node_text(nodes, c).alias("text"), _span(c, "colspan").alias("colspan"), _span(c, "rowspan").alias("rowspan")
    )
    cells = lambda r: F.transform(F.filter(all_children(nodes, r), lambda c: c["tag"].isin(*tags)), cell)
    return F.transform(rows, cells)


def cut_tables(nodes: Column, table: Column) -> Column:
    """`{header, body}`: per row the cells of a table."""
    return let(
        table_sections(nodes, table),
        lambda s: F.struct(
            table_cells(nodes, s["header"], ("th",)).alias("header"),
            table_cells(nodes, s["body"], ("th", "td")).alias("body"),
        ),
    )


# ---- spans ---------------------------------------------------------------------------------------


def split_wide_header(cell: Column, k: Column) -> Column:
    """Piece `k` of a header text cut into `colspan` equal pieces; a remainder is dropped."""
    piece = F.floor(F.length(cell["text"]) / cell["colspan"]).cast("int")
    return F.substring(cell["text"], piece * k + 1, piece)


def expand_colspan(rows: Column, is_header: bool) -> Column:
    """Per row, one `{text, rowspan}` unit per column a cell covers.

    A header cell as high as the whole header that covers several columns is split between them.
    """

    def units(c: Column) -> Column:
        whole = lambda k: c["text"]
        pieces = lambda k: F.when(
            (c["colspan"] > 1) & (c["rowspan"] == F.size(rows)), split_wide_header(c, k)
        ).otherwise(c["text"])
        text = pieces if is_header else whole
        unit = lambda k: F.struct(text(k).alias("text"), c["rowspan"].alias("rowspan"))
        return F.when(c["colspan"] > 0, F.transform(F.sequence(F.lit(0), c["colspan"] - 1), unit)).otherwise(F.array())

    return F.transform(rows, lambda r: F.flatten(F.transform(r, units)))


def width_bound(rows: Column) -> Column:
    """Columns that rows take at most, from the spans alone: the widest row, or all rows side by side where cells reach down."""
    spans = lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda t, c: t + F.greatest(c["colspan"], F.lit(0)))
    widths = F.transform(rows, spans)
    tall = F.exists(F.flatten(rows), lambda c: c["rowspan"] > 1)
    every = lambda ws: F.when(tall, F.aggregate(ws, F.lit(0).cast("long"), lambda t, w: t + w)).otherwise(F.coalesce(F.array_max(ws), F.lit(0)))
    return let(widths, every)


def widest(rows: Column) -> Column:
    """Columns of the widest row by its own cells."""
    spans = lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda t, c: t + F.greatest(c["colspan"], F.lit(0)))
    return F.coalesce(F.array_max(F.transform(rows, spans)), F.lit(0))


def _place(spans: pa.Array) -> pa.Array:
    """Row spans of a table's units -> per row and column the number of the unit shown there.

    Units are numbered through the table from 0. One that a row span carries down is given as
    `-2 - number`, an empty place as -1.
    """
    placed = []
    for table in spans.to_pylist():
        number, carry, grid = 0, {}, []
        for row in table or ():
            line: list[int] = []

            def carried():
                left, unit = carry.pop(len(line))
                if left > 1:
                    carry[len(line)] = (left - 1, unit)
                line.append(-2 - unit)

            todo = []
            for span in row:
                while len(line) in carry:
                    carried()
                if span > 1:
                    todo.append((len(line), span - 1, number))
                line.append(number)
                number += 1
            while any(column >= len(line) for column in carry):
                carried() if len(line) in carry else line.append(-1)
            for column, left, unit in todo:
                carry[column] = (left, unit)
            grid.append(line)
        placed.append(None if table is None else grid)
    return pa.array(placed, pa.list_(pa.list_(pa.int32())))


# Declared non-deterministic so that the optimizer neither repeats it nor moves it into a lambda.
place_units = F.arrow_udf(_place, T.ArrayType(T.ArrayType(T.IntegerType()))).asNondeterministic()


def spans_to_place(units: Column) -> Column:
    """Input of `place_units`: null, hence no work, unless the table has a row span."""
    spans = F.transform(units, lambda r: F.transform(r, lambda u: u["rowspan"]))
    return F.when(F.exists(F.flatten(spans), lambda n: n > 1), spans)


def expand_rowspan(units: Column, placed: Column, keep_carried: bool) -> Column:
    """Texts per row and column. `placed` is null for tables without row spans."""
    texts = F.flatten(F.transform(units, lambda r: F.transform(r, lambda u: u["text"])))

    def shown(i: Column, flat: Column) -> Column:
        own = F.when(i >= 0, F.get(flat, i))
        return F.when(i < -1, F.get(flat, -2 - i)).otherwise(own) if keep_carried else own

    moved = let(texts, lambda flat: F.transform(placed, lambda r: F.transform(r, lambda i: shown(i, flat))))
    plain = F.transform(units, lambda r: F.transform(r, lambda u: u["text"]))
    return F.when(placed.isNull(), plain).otherwise(moved)


def table_headers(grid: Column) -> Column:
    """Column names: texts of a column's header rows joined; a nameless one is called `Column1`, ..."""
    width = F.coalesce(F.array_max(F.transform(grid, lambda r: F.size(r))), F.lit(0))
    column = lambda c: header_name(F.transform(grid, lambda r: F.get(r, c)))
    names = F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), column)).otherwise(F.array().cast("array<string>"))
    nameless = lambda ns, i: F.size(F.filter(F.slice(ns, 1, i + 1), lambda x: x == ""))
    default = lambda ns, n, i: F.when(n == "", F.concat(F.lit("Column"), nameless(ns, i).cast("string"))).otherwise(n)
    return let(names, lambda ns: F.transform(ns, lambda n, i: default(ns, n, i)))


def pad_short_rows(grid: Column, width: Column) -> Column:
    """Cleaned body texts, each row filled with empty strings up to `width`."""
    cell = lambda r: lambda c: F.coalesce(clean_cell(F.get(r, c)), F.lit(""))
    return F.transform(grid, lambda r: F.transform(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), cell(r)))


# ---- whole tables --------------------------------------------------------------------------------


def parse_table(cut: DataFrame) -> DataFrame:
    """Rows with `header` and `body` cells -> the same rows with `columns`, `rows` and `error`.

    `error` says why a table cannot be read; its `columns` and `rows` are then null. Widths are compared as sums of
    spans before any cell is spread over its columns, so a span of millions costs nothing.
    """
    kept = [c for c in cut.columns if c not in ("header", "body")]
    spans = lambda part: F.flatten(F.transform(F.col(part), lambda r: F.transform(r, lambda c: c["colspan"] + c["rowspan"])))
    bad_span = F.exists(F.flatten(F.array(spans("header"), spans("body"))), lambda n: n.isNull())
    lacking = F.col("header").isNull() | F.col("body").isNull()
    bound = width_bound(F.col("header"))
    flaw = (
        F.when(lacking, "no tbody").when(bad_span, "bad span").when(widest(F.col("header")) > MOST_COLUMNS, "header too wide")
        .when(widest(F.col("body")) > bound, "row too wide").when(bound > MOST_COLUMNS, "header too wide")
    )
    units = cut.withColumn("_flaw", flaw).select(
        *kept,
        "_flaw",
        F.when(F.col("_flaw").isNull(), expand_colspan(F.col("header"), True)).alias("_head"),
        F.when(F.col("_flaw").isNull(), expand_colspan(F.col("body"), False)).alias("_body"),
    )
    placed = units.withColumns(
        {"_hp": place_units(spans_to_place(F.col("_head"))), "_bp": place_units(spans_to_place(F.col("_body")))}
    )
    grid = F.struct(
        table_headers(expand_rowspan(F.col("_head"), F.col("_hp"), keep_carried=False)).alias("columns"),
        expand_rowspan(F.col("_body"), F.col("_bp"), keep_carried=True).alias("rows"),
    )

    def judged(g: Column) -> Column:
        most = F.coalesce(F.array_max(F.transform(g["rows"], lambda r: F.size(r))), F.lit(0))
        twice = F.size(F.array_distinct(g["columns"])) < F.size(g["columns"])
        error = F.coalesce(
            F.col("_flaw"),
            F.when(most > F.size(g["columns"]), "row too wide"),
            F.when(twice, "duplicate header"),
        )
        return F.struct(
            error.alias("error"),
            F.when(error.isNull(), g["columns"]).alias("columns"),
            F.when(error.isNull(), pad_short_rows(g["rows"], F.size(g["columns"]))).alias("rows"),
        )

    # As a generator the grid is built once, however the result is filtered.
    return placed.select(*kept, F.inline(F.transform(F.array(grid), judged)))


def find_tables(dom: DataFrame, matches: Column) -> DataFrame:
    """Cut the table at each match: `page_id, path_id, table_id, recons, header, body`."""
    return routes(dom, table_array(F.col("nodes"), matches))


def table_array(nodes: Column, matches: Column) -> Column:
    """`{table_id, recons, header, body, n}` of the table at each match."""

    def cut(m: Column) -> Column:
        fields = lambda t: F.struct(
            m["node_id"].alias("table_id"), m["recons"].alias("recons"), t["header"].alias("header"), t["body"].alias("body"), m["n"].alias("n")
        )
        return let(cut_tables(nodes, m), fields)

    return F.transform(matches, cut)


def headers_table(tables: DataFrame) -> DataFrame:
    return tables.select("page_id", "table_id", F.posexplode("columns").alias("col_idx", "name"))


def cells_table(tables: DataFrame) -> DataFrame:
    """One row per body cell, with the name of its column."""
    named = lambda r: F.zip_with("columns", r, lambda n, t: F.struct(n.alias("name"), t.alias("text")))
    rows = tables.select("page_id", "table_id", F.posexplode(F.transform("rows", named)).alias("row_idx", "r"))
    cells = rows.select("page_id", "table_id", "row_idx", F.posexplode("r").alias("col_idx", "c"))
    return cells.select("page_id", "table_id", "row_idx", "col_idx", "c.*")


def too_narrow(tables: DataFrame, n: int = MIN_COLUMNS) -> DataFrame:
    """The tables with an `error` also for those of fewer than `n` columns."""
    return tables.withColumn("error", F.coalesce("error", F.when(F.size("columns") < n, "too few columns")))


def min_columns_guard(tables: DataFrame, n: int = MIN_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(tables with at least `n` columns, the rest with the reason in `error`)."""
    judged = too_narrow(tables, n)
    return judged.where("error IS NULL"), judged.where("error IS NOT NULL")
