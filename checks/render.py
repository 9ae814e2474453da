"""Web pages made from the given tables, so that what extraction should find is known from SQL.

Pages have bounded size: rows are blocked by key ranges, not by values that may be frequent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BASE = "https://shop.example"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def fill(template: str, *columns):
    return F.format_string(template, *[F.col(c) if isinstance(c, str) else c for c in columns])


def joined(*order):
    """Aggregate: the group's `html` in the order of some columns."""
    return F.array_join(F.array_sort(F.collect_list(F.struct(*order, "html")))["html"], "")


def page(body):
    return F.concat(F.lit("<!DOCTYPE html><html><head><title>t</title></head><body>"), body, F.lit("</body></html>"))


def order_books(spark: SparkSession, directory: str) -> DataFrame:
    """Orders in blocks of 40, by year and status: a heading where either changes, each order a link in a quote."""
    orders = table(spark, directory, "orders").select(
        F.expr("o_orderkey div 40").alias("page_id"), "o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"), "o_orderpriority"
    )
    order = Window.partitionBy("page_id").orderBy("year", "status", "o_orderkey")
    changed = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(order))
    quote = F.concat(
        F.when(changed("year"), fill("<h4>%d</h4>", "year")).otherwise(""),
        F.when(changed("status"), fill("<h5>%s</h5>\n", "status")).otherwise(""),
        fill("<q>%s <a href=\"/o/%d\">open</a></q>", "o_orderpriority", "o_orderkey"),
    )
    whole = orders.withColumn("html", quote).groupBy("page_id").agg(joined("year", "status", "o_orderkey").alias("quotes"))
    body = fill("<fieldset class=\"book\"><legend>Orders</legend><q>none <a href=\"/o/-1\">x</a></q>%s</fieldset>", "quotes")
    return whole.select("page_id", fill(BASE + "/book/%d", "page_id").alias("url"), page(body).alias("html"))


def span_tables(spark: SparkSession, directory: str) -> DataFrame:
    """Customers in blocks of 20: a table whose nation cell spans its customers' rows."""
    customer = table(spark, directory, "customer").withColumn("page_id", F.expr("c_custkey div 20"))
    cells = "<td>%d</td><td>%s</td><td>%s &amp; co</td><td> %s\n</td>"
    balance = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    rows = customer.withColumn("html", fill(cells, "c_custkey", "c_name", "c_mktsegment", balance))
    row = lambda r, i: F.concat(
        F.lit("<tr>"),
        F.when(i == 0, F.format_string("<td rowspan=\"%d\">%d</td>", F.size("rows"), "c_nationkey")).otherwise(""),
        r["html"],
        F.lit("</tr>"),
    )
    nations = rows.groupBy("page_id", "c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "html"))).alias("rows"))
    nations = nations.withColumn("html", F.array_join(F.transform("rows", row), "\n"))
    whole = nations.groupBy("page_id").agg(joined("c_nationkey").alias("rows"))
    head = "<thead><tr><th>Nation</th><th>Key</th><th>Name</th><th>Segment</th><th>Balance</th></tr></thead>"
    body = fill("<table class=\"grid\">" + head + "<tbody>%s</tbody></table>", "rows")
    return whole.select("page_id", fill(BASE + "/grid/%d", "page_id").alias("url"), page(body).alias("html"))


def listings(spark: SparkSession, directory: str) -> DataFrame:
    """Orders in blocks of 100, 8 blocks to a chain: items, a pager to both sides, now and then a detour."""
    orders = table(spark, directory, "orders").withColumn("page_id", F.expr("o_orderkey div 100"))
    items = orders.withColumn("html", fill("<li><a href=\"/order/%d\">%s</a></li>", "o_orderkey", "o_orderstatus"))
    whole = items.groupBy("page_id").agg(joined("o_orderkey").alias("items"))
    after = whole.select((F.col("page_id") - 1).alias("page_id"), F.lit(True).alias("followed"))
    place = F.col("page_id") % 8
    link = lambda offset, text: fill(f"<a class=\"{text}\" href=\"/list/%d/%d\">{text}</a>", F.expr("page_id div 8"), place + offset)
    pager = F.concat(
        F.when(place > 0, link(-1, "prev")).otherwise(""),
        F.when((place < 7) & F.col("followed"), link(1, "next")).otherwise(""),
    )
    detour = F.when(place % 4 == 0, fill("<div class=\"more\"><a href=\"/more/%d\">more</a></div>", "page_id")).otherwise("")
    body = F.concat(fill("<ul class=\"items\">%s</ul>", "items"), F.lit("<div class=\"pager\">"), pager, F.lit("</div>"), detour)
    url = fill(BASE + "/list/%d/%d", F.expr("page_id div 8"), place)
    return whole.join(after, "page_id", "left").select("page_id", url.alias("url"), page(body).alias("html"))


def site(spark: SparkSession, directory: str) -> DataFrame:
    """Index pages of 100 orders -> order pages -> customer pages, which link back to an index page."""
    # a page is many times larger than its row: rows are spread, so that every core makes and parses pages
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, directory, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartition(parts, F.expr("o_orderkey div 100"))
    customer = table(spark, directory, "customer").select("c_custkey", "c_name").repartition(parts, "c_custkey")
    block = "<div id=\"main\"><div class=\"list\">%s<div class=\"list\">%s</div></div></div>"
    entry = orders.select(
        F.expr("o_orderkey div 100").alias("key"),
        "o_orderkey",
        fill("<a href=\"/o/%d\">%s</a>", "o_orderkey", "o_orderstatus").alias("html"),
    )
    index = entry.groupBy("key").agg(joined("o_orderkey").alias("links")).select(
        fill("/i/%d", "key").alias("path"), fill(block, "links", F.lit("<b>none</b>")).alias("body")
    )
    up = fill("<a href=\"/i/%d\">up</a>", F.expr("o_orderkey div 100"))
    order = orders.select(
        fill("/o/%d", "o_orderkey").alias("path"), fill(block, fill("<a href=\"/c/%d\">buyer</a>", "o_custkey"), up).alias("body")
    )
    home = fill("<a href=\"/i/%d\">%s</a>", F.expr("c_custkey div 100"), "c_name")
    buyer = customer.select(fill("/c/%d", "c_custkey").alias("path"), fill(block, home, F.lit("")).alias("body"))
    whole = index.unionByName(order).unionByName(buyer)
    return whole.select(
        F.xxhash64("path").alias("page_id"), F.concat(F.lit(BASE), "path").alias("url"), page(F.col("body")).alias("html")
    )


def part_cards(spark: SparkSession, directory: str) -> DataFrame:
    """Parts in blocks of 5, each a card: a name, a brand (every sixth has none), labelled values and remarks."""
    part = table(spark, directory, "part").withColumn("page_id", F.expr("p_partkey div 5"))
    line = lambda label, value: F.concat(F.lit(f"<p><u>{label}</u>"), value, F.lit("</p>"))
    every = lambda n, html: F.when(F.col("p_partkey") % n == 0, html).otherwise("")
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    lines = F.concat(
        line("Price:", price),
        every(4, line("Price now", F.col("p_type"))),
        line("Size in cm", F.col("p_size").cast("string")),
        every(3, fill("<p>remark on %d</p>\n<p>seen at %d</p>", "p_partkey", "p_size")),
        line("Type", F.col("p_type")),
        every(2, line("Code", F.col("p_partkey").cast("string"))),
    )
    brand = F.when(F.col("p_partkey") % 6 != 0, fill("<meter class=\"%s\"></meter>", "p_brand")).otherwise("")
    card = F.concat(fill("<details><summary title=\"No %d\">%s %d</summary><div>", "p_partkey", "p_name", "p_partkey"), brand, lines, F.lit("</div></details>"))
    whole = part.withColumn("html", card).groupBy("page_id").agg(joined("p_partkey").alias("cards"))
    return whole.select("page_id", fill(BASE + "/parts/%d", "page_id").alias("url"), page(F.col("cards")).alias("html"))


def wide_tables(spark: SparkSession, directory: str) -> DataFrame:
    """Parts in blocks of 10: a two-row header with spans, rows of odd parts cut short, a narrow table."""
    part = table(spark, directory, "part").withColumn("page_id", F.expr("p_partkey div 10"))
    tail = F.when(F.col("p_partkey") % 2 == 0, fill("<td>%d</td><td colspan=\"1\">%s</td>", "p_size", "p_name")).otherwise("")
    rows = part.withColumn(
        "html", F.concat(fill("<tr><td>%d</td><td>%s</td><td>%s</td>", "p_partkey", "p_brand", "p_type"), tail, F.lit("</tr>"))
    )
    head = (
        "<tr><th rowspan=\"2\">Key</th><th colspan=\"2\">Spec</th><th colspan=\"2\" rowspan=\"2\">Left Side</th></tr>"
        "<tr><th>Brand</th><th>Type</th></tr>"
    )
    small = "<table><tbody><tr><th>A</th><th>B</th><th>C</th></tr><tr><td>%d</td><td>2</td><td>3</td></tr></tbody></table>"
    body = fill("<table><tbody>" + head + "%s</tbody></table>" + small, "rows", "page_id")
    whole = rows.groupBy("page_id").agg(joined("p_partkey").alias("rows"))
    return whole.select("page_id", fill(BASE + "/wide/%d", "page_id").alias("url"), page(body).alias("html"))
