"""Loads, queues, crawl walks and streams."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from checks import render
from webtables.functions.messages import ENTITY_MESSAGE, URL_MESSAGE, parse_message
from webtables.functions.text import clean_cell, text_remove_ci
from webtables.functions.urls import resolve_url
from webtables.operators.chains import intervals, rank_chains
from webtables.operators.crawl import crawl_frontier, crawl_sources, paginate, start_url
from webtables.operators.errors import error_log_rows, retention
from webtables.operators.load import (
    check_constraints, load_insert_absent, load_update, load_upsert, pending_changes, rules_schema, to_typed_row,
    with_row_identity,
)
from webtables.operators.queues import bounded_queue, failure_policy
from webtables.plans.crawl import crawl
from webtables.session import bucketed, forget, names_in, shared_dir, written
from webtables.sources.pages import resolve_pages
from webtables.sources.sinks import EntityColumn, entity_ddl
from webtables.sources.tiers import Tiers
from webtables.streaming.feed import EntityTable, PacedQueue, entity_stream_load, finish_retries, run, stream_extract, url_stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def column(spark, values, expression):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, c STRING").orderBy("i").select(expression(F.col("c"))).collect()]


def test_clean_cell(spark):
    given = ["  a&amp;b&nbsp;", "&#0000000000065;&#x000000000042;&#99999999999999999999999;&#xFFFFFFFFFFFFFFFFFFFFF;", "&#65;&#x42;&#0;", "&foo; &copy &eacute;", "&amp;#12;x", "a\r\nb", None, "x" + " " * 50_000 + "y"]
    assert column(spark, given, clean_cell) == ["a&b", "AB&#xFFFFFFFFFFFFFFFFFFFFF;", "AB", "&foo; &copy é", "x", "ab", None, given[-1]]


def test_text_remove_ci_takes_literals(spark):
    assert column(spark, ["A.b a.B axb"], lambda c: text_remove_ci(c, "a.b")) == ["  axb"]


def test_resolve_url(spark):
    given = [None, "/x", "http://o.example/y", "mailto:a", "a b", "/%zz", "/%41"]
    expected = ["http://b", "http://b/x", "http://o.example/y", "mailto:a", "a b", "/%zz", "http://b/%41"]
    assert column(spark, given, lambda c: resolve_url(F.lit("http://b"), c)) == expected


def test_parse_message(spark):
    given = ['{"EntityData":{"A":"1"}}', '{"EntityData":{"A":', "{}", "", None]
    got = column(spark, given, lambda c: parse_message(c, ENTITY_MESSAGE))
    assert [None if g is None else g["EntityData"] for g in got] == [{"A": "1"}, None, None, None, None]


RULES = {"LABEL": (True, 300), "BODY": (True, 4000), "OWNER": (True, 600), "NOTE": (False, 600)}


def item(**fields):
    return {"LABEL": "t", "BODY": "p", "OWNER": "d"} | fields


def test_typed_rows_and_constraints(spark):
    data = [(1, item()), (2, item(OTHER="x", NOTE="m")), (3, {"LABEL": "only"}), (4, item(LABEL="x" * 301))]
    entities = spark.createDataFrame(data, "n INT, data MAP<STRING,STRING>")
    typed, unknown = to_typed_row(entities, rules_schema(RULES), keep=["n"])
    assert rows(unknown) == [(2, "OTHER")]
    good, bad = check_constraints(typed, RULES)
    assert sorted(r.n for r in good.collect()) == [1, 2]
    assert {r.n: r.violations for r in bad.collect()} == {
        3: ["BODY is required", "OWNER is required"], 4: ["LABEL is longer than 300"],
    }


def test_identity_tells_null_from_empty_and_is_stable(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), (None, "a")], "x STRING, y STRING")
    ids = lambda: [r.id for r in with_row_identity(df, ["x", "y"], F.current_timestamp()).collect()]
    assert len(set(ids())) == 3 and ids() == ids()


def test_second_upsert_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, v STRING")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k INT, v STRING")
    once = load_upsert(old, new, ["k"], ["v"])
    assert rows(once) == [(1, "a"), (2, "c"), (3, "d")] == rows(load_upsert(once, new, ["k"], ["v"]))
    assert rows(load_insert_absent(old, new, ["k"], ["v"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(load_update(old, new, ["k"], ["v"])) == [(1, "a"), (2, "c")]
    assert rows(pending_changes(old, once, ["k"])) == [(2, "modified"), (3, "added")]
    assert rows(pending_changes(once, old, ["k"])) == [(2, "modified"), (3, "deleted")]


def test_update_can_set_null(spark):
    old = spark.createDataFrame([(1, "a")], "k INT, v STRING")
    assert rows(load_update(old, spark.createDataFrame([(1, None)], "k INT, v STRING"), ["k"])) == [(1, None)]


def test_entity_ddl(spark, tmp_path):
    columns = {"LABEL": EntityColumn(required=True), "N": EntityColumn(T.IntegerType(), default="7")}
    for _ in range(2):
        entity_ddl(spark, "items", columns, str(tmp_path / "items"))
    assert spark.table("items").columns == ["id", "LABEL", "N", "dt_creation", "dt_update"]
    spark.sql("INSERT INTO items (id, LABEL) VALUES ('1', 'a')")
    row = spark.table("items").first()
    assert (row.LABEL, row.N) == ("a", 7) and row.dt_creation <= row.dt_update
    spark.sql("DROP TABLE items")


def test_null_keys_are_values(spark):
    old = spark.createDataFrame([(None, "a"), (1, "b")], "k INT, v STRING")
    new = spark.createDataFrame([(None, "c"), (2, "d")], "k INT, v STRING")
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert plain(load_insert_absent(old, new, ["k"])) == [(1, "b"), (2, "d"), (None, "a")]
    assert plain(load_update(old, new, ["k"])) == [(1, "b"), (None, "c")]
    assert plain(load_upsert(old, new, ["k"])) == [(1, "b"), (2, "d"), (None, "c")]


def test_double_keys_need_an_order(spark):
    old = spark.createDataFrame([(1, "a")], "k INT, v STRING")
    new = spark.createDataFrame([(1, "b"), (1, "c")], "k INT, v STRING")
    for load in (load_update, load_upsert, load_insert_absent):
        with pytest.raises(Exception, match="comes twice"):
            load(old, new, ["k"]).collect()
    assert rows(load_update(old, new, ["k"], ["v"])) == [(1, "b")]


def test_lookup_takes_the_newest_copy_once_per_request(spark):
    pages = spark.createDataFrame([(1, "/a", "old"), (2, "/a", "new"), (3, "/b", "b")], "page_id BIGINT, url STRING, html STRING")
    urls = spark.createDataFrame([("/a",), ("/a",), ("/c",)], "url STRING")
    found, missing = resolve_pages(urls, pages)
    assert rows(found) == [("/a", 2, "new"), ("/a", 2, "new")] and rows(missing) == [("/c",)]


def test_lookup_of_few_urls_moves_no_page(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.range(2000).selectExpr("id AS page_id", "concat('/', id) AS url", "repeat('x', 100) AS html").write.parquet(path)
    found, _ = resolve_pages(spark.createDataFrame([("/7",)], "url STRING"), spark.read.parquet(path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert rows(found) == [("/7", 7, "x" * 100)]


def test_bounded_queue_on_a_hot_queue(spark):
    messages = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 40).otherwise(-1).cast("string").alias("queue"), F.col("id").alias("ts")
    )
    kept, overflow = bounded_queue(messages, 10, part_rows=100)
    assert kept.where("queue = '-1'").agg(F.min("ts"), F.count("*")).first() == (2986, 10)
    assert kept.count() + overflow.count() == 3000 and kept.groupBy("queue").count().where("count > 10").count() == 0


def test_failure_policy(spark):
    df = spark.createDataFrame([(["x", "y: Cannot insert duplicate key"],), (["x"],), (None,)], "c ARRAY<STRING>")
    assert [r[0] for r in df.select(failure_policy(F.col("c"))).collect()] == ["ack", "retry", "retry"]


def test_error_log_and_retention(spark):
    failed = spark.createDataFrame([("s", "w", "m", "l", None, datetime(2024, 1, 2, 3, 4, 5, 678900))], "service STRING, source STRING, message STRING, log_message STRING, exception STRING, ts TIMESTAMP")
    row = error_log_rows(failed).first()
    assert (row.exception, row.dt_error) == ("", "2024-01-02T03:04:05.678")
    log = spark.createDataFrame([(datetime(2024, 1, 1, 0, m),) for m in (0, 29, 30, 59)], "ts TIMESTAMP")
    as_of = F.lit("2024-01-01 00:59:30").cast("timestamp")
    assert retention(log, as_of, timedelta(minutes=1)).count() == 2
    assert retention(log, as_of, timedelta(hours=2)).count() == 4


# ---- crawl ---------------------------------------------------------------------------------------


def test_paginate_follows_chains_and_stops_in_a_cycle(spark):
    chain = [(str(i), str(i + 1)) for i in range(20)] + [("a", "b"), ("b", "c"), ("c", "b"), ("z", "gone")]
    links = spark.createDataFrame(chain, "src_url STRING, next_url STRING")
    starts = spark.createDataFrame([("0",), ("a",), ("z",), ("lonely",)], "url STRING")
    got = rows(paginate(links, starts))
    expected = [("0", str(i), i) for i in range(21)] + [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("lonely", "lonely", 0), ("z", "gone", 1), ("z", "z", 0)]
    assert got == sorted(expected)


def test_frontier_depths_cycles_and_limit(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e"), ("x", "y"), ("b", None)], "src_url STRING, dst_url STRING")
    seeds = spark.createDataFrame([("a",), ("a",)], "url STRING")
    assert rows(crawl_frontier(links, seeds)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert rows(crawl_frontier(links, seeds, max_depth=1)) == [("a", 0), ("b", 1), ("c", 1)]


def test_pages_of_a_small_table_are_made_in_many_tasks(spark):
    """The tables are one split each; the pages made from them are many times larger."""
    pages = render.site(spark, "/root/testdata/sf0.01")
    tasks = pages.select(F.regexp_extract("url", "example/([a-z])/", 1).alias("kind"), F.spark_partition_id().alias("task")).distinct()
    assert rows(tasks.groupBy("kind").count()) == [("c", 8), ("i", 8), ("o", 8)]


def test_links_are_shuffled_once_for_their_buckets(spark):
    rows_of = [("a", "b"), ("a", "b"), ("b", "c"), (None, "d")]
    table, name = bucketed(spark.createDataFrame(rows_of, "src_url STRING, dst_url STRING"), "src_url", "links", 4, distinct=True)
    assert rows(table.where("src_url IS NOT NULL")) == [("a", "b"), ("b", "c")] and table.count() == 3
    assert [r for r in table.groupBy("src_url").count().collect() if r["count"] > 1] == []
    forget(spark, name)


def test_a_long_frontier_keeps_few_tiers(spark, monkeypatch):
    """A chain: URLs seen are written again log2 times, a level looks its URL up in one partition."""
    asked, merged = [], []
    known, add = Tiers.known, Tiers.add

    def watched(self, batch, parts):
        asked.append(len(parts))
        return known(self, batch, parts)

    def counted(self, batch, found):
        add(self, batch, found)
        merged.append(len(self.before(batch + 1)))

    monkeypatch.setattr(Tiers, "known", watched)
    monkeypatch.setattr(Tiers, "add", counted)
    links = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(14)] + [("n9", "n2")], "src_url STRING, dst_url STRING")
    before = set(names_in(spark, f"{shared_dir(spark)}/webtables"))
    found = crawl_frontier(links, spark.createDataFrame([("n0",)], "url STRING"))
    assert rows(found) == sorted((f"n{i}", i) for i in range(15))
    assert max(asked) <= 2 and max(merged) <= 4
    assert len(set(names_in(spark, f"{shared_dir(spark)}/webtables")) - before) == 1  # the levels


NEXT = {"urlBase": "", "next": [{"level": 1, "tag": "a", "value": "href", "navigation": {"tag": "div"}}]}


def walk_pages(spark):
    page = lambda n, url, *hrefs: (n, url, "<body><div>" + "".join(f"<a href='{h}'>x</a>" for h in hrefs) + "</div>")
    pages = [
        page(1, "/1", "/0", "/2"), page(2, "/2", "/1", "/3"), page(3, "/3", "/2"), page(4, "/0", "/1", "/9"), page(5, "/9"),
        page(0, "/2", "/old"),  # an older copy
    ]
    return spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING")


def test_crawl_takes_the_first_open_link(spark):
    starts = spark.createDataFrame([("s", "/1"), ("t", "/2")], "source STRING, url STRING")
    walked = crawl_sources(walk_pages(spark), NEXT, starts)
    assert rows(walked) == [("s", "/0", 1), ("s", "/1", 0), ("s", "/9", 2), ("t", "/0", 2), ("t", "/1", 1), ("t", "/2", 0), ("t", "/9", 3)]


def test_long_crawl(spark):
    chain = [(i, f"/{i}", f"<body><div><a href='/{i - 1}'>x</a><a href='/{i + 1}'>y</a></div>") for i in range(1, 9)]
    pages = spark.createDataFrame(chain, "page_id BIGINT, url STRING, html STRING")
    starts = spark.createDataFrame([("s", "/3")], "source STRING, url STRING")
    walked = crawl_sources(pages, NEXT, starts)
    assert rows(walked) == sorted(("s", f"/{u}", n) for n, u in enumerate((3, 2, 1, 0)))
    assert rows(crawl_sources(pages, NEXT, starts.select("source", F.lit("/1").alias("url")), max_rounds=5))[-1][2] <= 5


def walk_by_hand(links, start):
    """Pages from a start to the end, or to the first that comes again."""
    to, found = {}, [start]
    for a, b in links:
        to[a] = min(b, to.get(a, b))
    while to.get(found[-1]) not in (None, *found):
        found.append(to[found[-1]])
    return [(start, url, step) for step, url in enumerate(found)]


def test_pagination_of_trees_and_circles(spark):
    draw = random.Random(5)
    links = [(f"p{i}", f"p{draw.randrange(60)}") for i in range(45)]  # pages that meet, run in circles, or end
    links += [("p3", "p9"), ("self", "self"), ("c2", "c0"), ("c0", "c1"), ("c1", "c2"), ("in", "c1"), *[(f"line{i:02}", f"line{i + 1:02}") for i in range(70)]]
    starts = sorted({a for a, _ in links} | {b for _, b in links} | {"alone"})
    tables = spark.createDataFrame(links, "src_url STRING, next_url STRING"), spark.createDataFrame([(s,) for s in [*starts, "p1"]], "url STRING")
    assert rows(paginate(*tables)) == sorted(r for s in starts for r in walk_by_hand(links, s))


def test_every_start_of_a_chain_is_one_interval(spark):
    n = 300
    links = spark.range(n).select(F.format_string("u%04d", "id").alias("src_url"), F.format_string("u%04d", F.col("id") + 1).alias("next_url"))
    chains = rank_chains(links)
    found = intervals(chains, links.select(F.col("src_url").alias("url")))
    assert found.count() == n and found.select("chain").distinct().count() == 1
    assert found.agg(F.sum(F.col("high") - F.col("low") + 1)).first()[0] == sum(range(2, n + 2))


def test_crawl_resumes_and_backtracks(spark):
    ledger = spark.createDataFrame(
        [("s", "/2", datetime(2024, 1, 1)), ("s", "/3", datetime(2024, 1, 2)), ("s", "/1", datetime(2023, 1, 1))],
        "source STRING, url STRING, crawl_ts TIMESTAMP",
    )
    start = start_url("https://b", "/s", ledger)
    assert start.first().url == "/3" and start_url("https://b", "/s", ledger.limit(0)).first().url == "https://b/s"
    walked = crawl_sources(walk_pages(spark), NEXT, start.select(F.lit("s").alias("source"), "url"), ledger)
    assert rows(walked) == [("s", "/0", 3), ("s", "/9", 4)]  # /3 and /2 lead nowhere new, /1 leads to /0


def test_crawl_scrape_and_load_a_small_site(spark, tmp_path):
    """Two listing pages lead to three articles, which end up as rows; a second crawl finds nothing new."""
    listing = lambda n, links, onward: (
        n, f"https://s.example/list/{n}",
        "<body><ul class='items'>" + "".join(f"<li><a href='{a}'>x</a></li>" for a in links) + f"</ul><div class='pager'>{onward}</div>",
    )
    article = lambda n, title: (n, f"https://s.example/a/{n}", f"<body><article><h1>{title}</h1><p>plot {n}<p>d{n}</article>")
    pages = spark.createDataFrame(
        [listing(1, ["/a/7", "/a/8"], "<a href='/list/2'>2</a>"), listing(2, ["/a/9", "/a/404"], "<a href='/list/1'>1</a>"),
         article(7, "T7"), article(8, "T8"), article(9, "T7")],
        "page_id BIGINT, url STRING, html STRING",
    )
    spec = {
        "name": "site", "urlBase": "https://s.example", "urlSuffix": "/list/1", "directUrls": ["https://s.example/a/7", ""],
        "navigation": {"tag": "ul", "nav": {"tag": "li"}}, "target": {"tag": "a", "value": "href", "classType": "Url"},
        "next": [{"level": 1, "tag": "a", "value": "href", "navigation": {"tag": "div", "keyProperty": "class", "valueProperty": "pager"}}],
    }
    empty = spark.createDataFrame([], "source STRING, url STRING, crawl_ts TIMESTAMP")
    as_of = F.lit("2024-01-01").cast("timestamp")
    messages, entries = crawl(pages, spec, empty, as_of)
    sent = parse_message(F.col("body"), URL_MESSAGE)["url"]
    assert rows(messages.select(sent)) == [(f"https://s.example/a/{n}",) for n in (404, 7, 7, 8, 9)]
    assert rows(entries.select("url")) == [("https://s.example/a/7",), ("https://s.example/list/1",), ("https://s.example/list/2",)]
    again, none = crawl(pages, spec, written(entries, "ledger"), as_of)
    assert rows(again) == [] == rows(none)

    queue, out = str(tmp_path / "queue"), str(tmp_path / "out")
    messages.write.parquet(queue)
    title = {"tag": "h1", "reconValue": "InnerText", "classification": [{"name": "LABEL"}]}
    scrape = {
        "navigation": {"tag": "article", "nav": {"tag": "p", "recon": [title]}},
        "target": {
            "value": "InnerText", "classType": "Item", "recon": {"classification": [{"name": "BODY"}]},
            "HCValues": [{"name": "OWNER", "value": "d"}],
        },
    }
    finish(stream_extract(url_stream(spark, queue, "body STRING, type STRING"), pages, scrape, out, f"{out}-scrape"))
    items = EntityTable(f"{out}/Item", RULES, ["LABEL"])
    finish(entity_stream_load(url_stream(spark, f"{out}/entities", "data MAP<STRING,STRING>, class_type STRING"), {"Item": items}, f"{out}/rejects", f"{out}-load"))
    assert rows(spark.read.parquet(items.path).select("LABEL")) == [("T7",), ("T8",)]
    assert [r.url for r in spark.read.parquet(f"{out}/retry").collect()] == ["https://s.example/a/404"]


# ---- streams -------------------------------------------------------------------------------------

LINES = {
    "navigation": {"tag": "p"},
    "target": {"value": "InnerText", "recon": {"classification": [{"name": "TEXT"}]}, "classType": "Line"},
}


def finish(query):
    query.awaitTermination()


def test_stream_extract_retries_then_gives_up(spark, tmp_path, pages_of):
    queue, out = str(tmp_path / "queue"), str(tmp_path / "out")
    pages = pages_of("<body><p>a<p>b", "<body><p>c")
    for attempt in range(3):
        urls = ["https://x.example/0", "https://gone.example/"] if attempt == 0 else ["https://gone.example/"]
        spark.createDataFrame([(u,) for u in urls], "url STRING").write.mode("append").parquet(queue)
        finish(stream_extract(url_stream(spark, queue, "url STRING"), pages, LINES, out, f"{out}-checkpoint", k=3))
    found = spark.read.parquet(f"{out}/entities")
    assert sorted(r.data["TEXT"] for r in found.collect()) == ["a", "b"]
    assert rows(spark.read.parquet(f"{out}/retry").select("url", "attempts")) == [("https://gone.example/", 1), ("https://gone.example/", 2)]
    assert rows(spark.read.parquet(f"{out}/dead").select("url", "attempts")) == [("https://gone.example/", 3)]


def test_last_retries_end_without_a_message(spark, tmp_path, pages_of):
    queue, out = str(tmp_path / "queue"), str(tmp_path / "out")
    pages = pages_of("<body><p>a", "<body><i>no line")
    spark.createDataFrame([("https://x.example/0",), ("https://x.example/1",), ("https://gone.example/",)], "url STRING").write.parquet(queue)
    stream = lambda: finish(stream_extract(url_stream(spark, queue, "url STRING"), pages, LINES, out, f"{out}-checkpoint", k=3))
    stream()
    finish_retries(spark, pages, LINES, out, k=3)
    finish_retries(spark, pages, LINES, out, k=3)  # nothing is left
    dead = lambda: rows(spark.read.parquet(f"{out}/dead").select("url", "attempts", "reason"))
    assert dead() == [("https://gone.example/", 3, "no page"), ("https://x.example/1", 3, "no entities")]
    spark.createDataFrame([("https://x.example/0",)], "url STRING").write.mode("append").parquet(queue)
    stream()
    assert len(dead()) == 2 and spark.read.parquet(f"{out}/entities").count() == 2


def test_a_queue_holds_its_sender_back(spark, tmp_path):
    queue = PacedQueue(spark, str(tmp_path / "queue"), "url STRING", threshold=7)
    messages = spark.range(40).selectExpr("CAST(id AS STRING) AS url").repartition(3)
    seen = []
    query = run(queue.read(max_files=1), lambda batch, n: seen.append(batch.count()), str(tmp_path / "checkpoint"), "0 seconds")
    try:
        queue.send(messages, query, rows=3, poll=0.05)
        queue.wait(query, 0, poll=0.05)
    finally:
        query.stop()
    assert sum(seen) == 40 and max(seen) <= 3 and 3 <= queue.deepest <= 7
    with pytest.raises(RuntimeError, match="ended"):
        queue.send(messages, query, rows=3, poll=0.01)


@pytest.mark.parametrize("limit, batches", [({"max_files": 1}, 3), ({"max_bytes": "1"}, 3), ({"max_files": 2}, 2), ({}, 1)])
def test_rate_limit(spark, tmp_path, limit, batches):
    queue, seen = str(tmp_path / "queue"), []
    spark.range(30).selectExpr("CAST(id AS STRING) AS url").repartition(3).write.parquet(queue)
    stream = url_stream(spark, queue, "url STRING", **limit)
    finish(run(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "checkpoint")))
    assert len(seen) == batches and sum(seen) == 30


def test_stream_load_inserts_once(spark, tmp_path):
    queue, out = str(tmp_path / "queue"), str(tmp_path / "out")
    schema = "type STRING, EntityData MAP<STRING,STRING>, ts TIMESTAMP"
    message = lambda kind, **data: (kind, data, datetime(2024, 1, 1))
    batches = [
        [message("F", **item()), message("F", **item(BODY="later")), message("F", LABEL="bad"), message("?", A="1")],
        [message("F", **item()), message("F", **item(LABEL="u"))],
    ]
    targets = {"F": EntityTable(f"{out}/F", RULES, ["LABEL"])}
    for batch in batches:
        spark.createDataFrame(batch, schema).write.mode("append").parquet(queue)
        finish(entity_stream_load(url_stream(spark, queue, schema), targets, f"{out}/rejects", f"{out}-checkpoint", f"{out}/errors"))
    errors = spark.read.parquet(f"{out}/errors")
    assert sorted((r.service, r.source, r.message) for r in errors.collect()) == [("load", "?", "unknown type"), ("load", "F", "BODY is required; OWNER is required")]
    table = spark.read.parquet(f"{out}/F")
    assert rows(table.select("LABEL", "batch_id")) == [("t", 0), ("u", 1)]
    assert sorted(r.message for r in spark.read.parquet(f"{out}/rejects").collect()) == ["BODY is required; OWNER is required", "unknown type"]
