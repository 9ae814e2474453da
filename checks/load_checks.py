"""Queries over loads, queues, the error log and streams."""

from __future__ import annotations

import uuid
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from webtables.operators.errors import error_log_rows, retention
from webtables.operators.load import (
    check_constraints, check_unique, dedup_natural_key, get_all, get_one, get_where, load_delete, load_insert,
    load_insert_absent, load_update, load_upsert, pending_changes, set_difference, to_typed_row, with_row_identity,
)
from webtables.operators.crawl import url_messages
from webtables.operators.queues import bounded_queue, failure_policy, queue_depth, retry_or_dead_letter, route_by_type
from webtables.plans.extract import extract_errors
from webtables.session import names_in, scratch_path
from webtables.sources.pages import page_source, store_snapshot
from webtables.sources.sinks import EntityColumn, entity_ddl, entity_sink, error_log_sink
from webtables.streaming.feed import (
    EntityTable, PacedQueue, entity_stream_load, finish_retries, run, stream_dedup, stream_extract, stream_not_crawled, url_stream,
)

from . import specs
from .pages_checks import BODY
from .registry import check
from .render import table

SEEN = "2024-02-01 00:00:00"


def entities(spark, sf):
    """Customers as entity maps, with a field no table has and a number that is none for some."""
    rows = table(spark, sf, "customer")
    balance = F.when(F.col("c_custkey") % 10 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    data = F.create_map(
        F.lit("NAME"), "c_name", F.lit("NATION"), F.col("c_nationkey").cast("string"),
        F.lit("BALANCE"), balance, F.lit("EXTRA"), F.lit("x"),
    )
    return rows.select("c_custkey", data.alias("data"))


CUSTOMER = T.StructType().add("NAME", T.StringType()).add("NATION", T.IntegerType()).add("BALANCE", T.DoubleType()).add("PHONE", T.StringType())


@check("""
SELECT c_custkey, c_name AS NAME, c_nationkey AS NATION, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS BALANCE,
       CAST(NULL AS VARCHAR) AS PHONE FROM customer""", name="to_typed_row")
def to_typed_row_customers(spark, sf):
    return to_typed_row(entities(spark, sf), CUSTOMER, keep=["c_custkey"])[0]


@check("SELECT c_custkey, 'EXTRA' AS unknown_field FROM customer")
def to_typed_row_unknown(spark, sf):
    return to_typed_row(entities(spark, sf), CUSTOMER, keep=["c_custkey"])[1]


@check(f"""
SELECT c_custkey, sha256(c_name || chr(31) || c_nationkey) AS id, TIMESTAMP '{SEEN}' AS dt_creation, TIMESTAMP '{SEEN}' AS dt_update FROM customer""", name="with_row_identity")
def row_identity_customers(spark, sf):
    as_of = F.lit(SEEN).cast("timestamp_ntz")
    rows = with_row_identity(table(spark, sf, "customer"), ["c_name", "c_nationkey"], as_of)
    return rows.select("c_custkey", "id", "dt_creation", "dt_update")


DOCUMENT_RULES = {"text": (True, 4000), "lang": (True, 1), "source": (False, 4)}


@check("""
SELECT doc_id, concat_ws('; ', CASE WHEN text IS NULL THEN 'text is required' END, CASE WHEN length(text) > 4000 THEN 'text is longer than 4000' END,
  CASE WHEN length(lang) > 1 THEN 'lang is longer than 1' END, CASE WHEN length(source) > 4 THEN 'source is longer than 4' END) AS broken FROM documents""", name="check_constraints")
def check_constraints_documents(spark, sf):
    good, bad = check_constraints(table(spark, sf, "documents"), DOCUMENT_RULES)
    return bad.select("doc_id", F.array_join("violations", "; ").alias("broken")).union(good.select("doc_id", F.lit("")))


@check("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", name="check_unique")
def check_unique_lineitem(spark, sf):
    return check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@check("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text", name="dedup_natural_key")
def dedup_natural_key_documents(spark, sf):
    return dedup_natural_key(table(spark, sf, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


# Table states: `old` are orders before a date, `new` all open orders with a raised price.

OLD = "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'"
NEW = "SELECT o_orderkey AS id, 'X' AS status, o_totalprice AS price FROM orders WHERE o_orderstatus = 'O'"


def states(spark, sf):
    orders = table(spark, sf, "orders")
    old = orders.where("o_orderdate < TIMESTAMP_NTZ '1996-01-01'").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "o_totalprice AS price")
    new = orders.where("o_orderstatus = 'O'").selectExpr("o_orderkey AS id", "'X' AS status", "o_totalprice AS price")
    return old, new


@check(f"SELECT * FROM ({OLD}) UNION ALL SELECT * FROM ({NEW})", name="load_insert")
def load_insert_orders(spark, sf):
    return load_insert(*states(spark, sf))


@check(f"SELECT * FROM ({OLD}) UNION ALL SELECT * FROM ({NEW}) WHERE id NOT IN (SELECT id FROM ({OLD}))", name="load_insert_absent")
def load_insert_absent_orders(spark, sf):
    old, new = states(spark, sf)
    return load_insert_absent(old, new.union(new), ["id"], ["price", "status"])


@check(f"""
SELECT o.id, coalesce(n.status, o.status) AS status, coalesce(n.price, o.price) AS price FROM ({OLD}) o LEFT JOIN ({NEW}) n USING (id)""", name="load_update")
def load_update_orders(spark, sf):
    old, new = states(spark, sf)
    return load_update(old, new, ["id"])


@check(f"SELECT * FROM ({OLD}) WHERE id NOT IN (SELECT id FROM ({NEW})) UNION ALL SELECT * FROM ({NEW})", name="load_upsert")
def load_upsert_orders(spark, sf):
    old, new = states(spark, sf)
    return load_upsert(old, new, ["id"])


@check(f"SELECT * FROM ({OLD}) WHERE id NOT IN (SELECT id FROM ({NEW}))", name="load_delete")
def load_delete_orders(spark, sf):
    old, new = states(spark, sf)
    return load_delete(old, new, ["id"])


@check("SELECT * FROM supplier", name="get_all")
def get_all_suppliers(spark, sf):
    return get_all(table(spark, sf, "supplier"))


@check("SELECT * FROM supplier WHERE s_acctbal > 5000", name="get_where")
def get_where_suppliers(spark, sf):
    return get_where(table(spark, sf, "supplier"), F.col("s_acctbal") > 5000)


@check("SELECT * FROM supplier WHERE s_acctbal > 5000 ORDER BY s_suppkey LIMIT 1", name="get_one")
def get_one_supplier(spark, sf):
    return get_one(table(spark, sf, "supplier"), F.col("s_acctbal") > 5000, ["s_suppkey"])


@check(f"""
SELECT id, CASE WHEN o.status IS NULL THEN 'added' WHEN n.status IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM ({OLD}) o FULL JOIN ({NEW}) n USING (id)""", name="pending_changes")
def pending_changes_orders(spark, sf):
    old, new = states(spark, sf)
    return pending_changes(old, new, ["id"])


@check("SELECT c_nationkey AS nation, c_mktsegment AS word FROM customer EXCEPT SELECT s_nationkey, 'BUILDING' FROM supplier", name="set_difference")
def set_difference_nations(spark, sf):
    total = table(spark, sf, "customer").selectExpr("c_nationkey AS nation", "c_mktsegment AS word")
    return set_difference(total, table(spark, sf, "supplier").selectExpr("s_nationkey AS nation", "'BUILDING' AS word"))


@check("SELECT c_custkey, c_name FROM customer", name="entity_sink")
def entity_sink_customers(spark, sf):
    path = scratch_path(spark, "customers")
    entity_sink(table(spark, sf, "customer").select("c_custkey", "c_name"), path)
    return spark.read.parquet(path)


HALF = "SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS k, o_orderpriority AS p, max(o_orderkey) AS v FROM orders"


@check(f"""
WITH old AS ({HALF} WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), new AS ({HALF} WHERE o_orderkey % 2 = 1 GROUP BY 1, 2)
SELECT 'absent' AS load, * FROM old
UNION ALL SELECT 'absent', * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.k IS NOT DISTINCT FROM new.k AND old.p = new.p)
UNION ALL SELECT 'update', o.k, o.p, coalesce(n.v, o.v) FROM old o LEFT JOIN new n ON o.k IS NOT DISTINCT FROM n.k AND o.p = n.p
UNION ALL SELECT 'upsert', * FROM new
UNION ALL SELECT 'upsert', * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE old.k IS NOT DISTINCT FROM new.k AND old.p = new.p)
UNION ALL SELECT 'delete', * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE old.k IS NOT DISTINCT FROM new.k AND old.p = new.p)""")
def loads_with_null_keys(spark, sf):
    """Keys with nulls; incoming keys come twice and the greatest order wins."""
    orders = table(spark, sf, "orders").selectExpr("CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS k", "o_orderpriority AS p", "o_orderkey AS v")
    of = lambda odd: orders.where(F.col("v") % 2 == odd)
    old = of(0).groupBy("k", "p").agg(F.max("v").alias("v"))
    newest = of(1).withColumn("_o", -F.col("v"))
    new = dedup_natural_key(newest, ["k", "p"], ["_o"]).drop("_o")
    key, twice = ["k", "p"], new.union(new)
    made = {
        "absent": load_insert_absent(old, twice, key, ["v"]), "update": load_update(old, new, key),
        "upsert": load_upsert(old, twice, key, ["v"]), "delete": load_delete(old, twice, key),
    }
    return reduce(DataFrame.union, [df.select(F.lit(name).alias("load"), "k", "p", "v") for name, df in made.items()])


@check("""
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 7 END AS size, true AS stamped FROM part""", name="entity_ddl")
def entity_ddl_parts(spark, sf):
    """A created table fills its defaults and times."""
    name = f"parts_{uuid.uuid4().hex}"
    columns = {"name": EntityColumn(required=True), "size": EntityColumn(T.IntegerType(), default="7")}
    entity_ddl(spark, name, columns, scratch_path(spark, "parts"))
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("int").alias("size"), "p_partkey")
    for view, rows, fields in (("even", part.where("p_partkey % 2 = 0"), "id, name, size"), ("odd", part.where("p_partkey % 2 = 1"), "id, name")):
        rows.createOrReplaceTempView(f"{name}_{view}")
        spark.sql(f"INSERT INTO {name} ({fields}) SELECT {fields} FROM {name}_{view}")
    return spark.table(name).select("id", "name", "size", (F.col("dt_creation").isNotNull() & F.col("dt_update").isNotNull()).alias("stamped"))


# ---- queues --------------------------------------------------------------------------------------


def messages(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("queue"), "ts", F.col("event_type").alias("type"))


@check("SELECT event_type AS queue, count(*) AS depth FROM events GROUP BY 1", name="queue_depth")
def queue_depth_events(spark, sf):
    return queue_depth(messages(spark, sf))


@check("SELECT event_id FROM events WHERE event_type = 'purchase'", name="route_by_type")
def route_by_type_events(spark, sf):
    return route_by_type(messages(spark, sf), "purchase").select("event_id")


@check("""
SELECT event_id, event_type AS queue, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 150 AS kept FROM events""", name="bounded_queue")
def bounded_queue_events(spark, sf):
    kept, overflow = bounded_queue(messages(spark, sf), 150, ["ts", "event_id"])
    row = lambda df, flag: df.select("event_id", "queue", F.lit(flag).alias("kept"))
    return row(kept, True).union(row(overflow, False))


@check("""
SELECT event_id, event_type AS queue FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1500""")
def bounded_queue_long(spark, sf):
    return bounded_queue(messages(spark, sf), 1500, ["ts", "event_id"], part_rows=2000)[0].select("event_id", "queue")


@check("""
SELECT o_orderkey AS message_id, CAST(coalesce(n, 0) + 1 AS INTEGER) AS attempts, coalesce(n, 0) + 1 >= 5 AS dead FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""", name="retry_or_dead_letter")
def retry_or_dead_letter_orders(spark, sf):
    failed = table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS message_id")
    tries = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("message_id")).agg(F.count("*").cast("int").alias("attempts"))
    retry, dead = retry_or_dead_letter(failed, tries, 5)
    return retry.withColumn("dead", F.lit(False)).union(dead.withColumn("dead", F.lit(True)))


@check("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'ack' ELSE 'retry' END AS action FROM part", name="failure_policy")
def failure_policy_parts(spark, sf):
    inner = F.concat(F.lit("Cannot insert duplicate key in "), "p_type")
    causes = F.when(F.col("p_size") > 25, F.array("p_name", inner)).otherwise(F.array("p_name"))
    return table(spark, sf, "part").select("p_partkey", failure_policy(causes).alias("action"))


# ---- error log -----------------------------------------------------------------------------------


def failures(spark, sf):
    return table(spark, sf, "events").where("event_type = 'error'").select(
        F.lit("feed").alias("service"), F.col("user_id").cast("string").alias("source"), F.col("props").alias("message"),
        F.format_string("event %d failed", "event_id").alias("log_message"),
        F.when(F.col("value") > 20, "too large").alias("exception"), F.col("ts").cast("timestamp").alias("ts"),
    )


LOG_SQL = """
SELECT 'feed' AS service, CAST(user_id AS VARCHAR) AS source, props AS message, 'event ' || event_id || ' failed' AS log_message,
       CASE WHEN value > 20 THEN 'too large' ELSE '' END AS exception, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') AS dt_error
FROM events WHERE event_type = 'error'"""


@check(LOG_SQL, name="error_log_rows")
def error_log_rows_events(spark, sf):
    return error_log_rows(failures(spark, sf))


@check(LOG_SQL, name="error_log_sink")
def error_log_sink_events(spark, sf):
    path = scratch_path(spark, "errors")
    error_log_sink(error_log_rows(failures(spark, sf)), path)
    return spark.read.parquet(path)


@check("SELECT doc_id, 'text is longer than 4000' AS message FROM documents WHERE length(text) > 4000", name="error_rows")
def error_rows_documents(spark, sf):
    _, bad = check_constraints(table(spark, sf, "documents"), {"text": (True, 4000)})
    return bad.select("doc_id", F.array_join("violations", "; ").alias("message"))


@check("SELECT page_id, 'marker missing' AS message FROM pages WHERE strpos(html, '</body>') = 0")
def extract_errors_marker(spark, sf):
    spec = specs.ARTICLES["extraction"] | {"separatorId": "</body>"}
    return extract_errors(page_source(spark, sf), spec).where("message = 'marker missing'").select("page_id", "message")


@check("""
SELECT event_id, 'day' AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-08' - INTERVAL 1 DAY
UNION ALL SELECT event_id, 'minutes' FROM events WHERE ts >= TIMESTAMP '2024-01-08' - INTERVAL 30 MINUTE""", name="retention")
def retention_events(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts")
    as_of = F.lit("2024-01-08").cast("timestamp_ntz")
    row = lambda period, name: retention(events, as_of, period).select("event_id", F.lit(name).alias("kept"))
    return row(timedelta(days=1), "day").union(row(timedelta(minutes=1), "minutes"))


# ---- streams -------------------------------------------------------------------------------------


def finished(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


@check("SELECT event_id, event_type, CAST(value AS DOUBLE) AS value, true AS several FROM events")
def stream_scan(spark, sf):
    """Files of two rounds, one a batch, with a restart between the rounds."""
    out, queue = scratch_path(spark, "scan"), scratch_path(spark, "files")
    events = table(spark, sf, "events")
    for odd in range(2):
        events.where(F.col("event_id") % 2 == odd).repartition(2).write.mode("append").parquet(queue)
        stream = url_stream(spark, queue, events.schema, max_files=1).select("event_id", "event_type", "value")
        finished(run(stream, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch_id={n}"), f"{out}-checkpoint"))
    several = F.lit(len(names_in(spark, out)) >= 4).alias("several")
    return spark.read.parquet(out).select("event_id", "event_type", "value", several)


def url_queue(spark, sf, files=4):
    """Page URLs, and as many that no page has, as a queue folder of a few files."""
    path = scratch_path(spark, "urls")
    pages = page_source(spark, sf).select("url")
    pages.union(pages.select(F.concat("url", F.lit("/missing")))).repartition(files).write.parquet(path)
    return path


@check("SELECT 'all' AS kind, 2 * count(*) AS n, 4 AS batches FROM pages", name="rate_limit")
def rate_limit_stream(spark, sf):
    out = scratch_path(spark, "limited")
    stream = url_stream(spark, url_queue(spark, sf), "url STRING", max_files=1)
    finished(run(stream, lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch_id={n}"), f"{out}-checkpoint"))
    got = spark.read.parquet(out)
    return got.agg(F.count("*").alias("n"), F.countDistinct("batch_id").cast("int").alias("batches")).withColumn("kind", F.lit("all"))


@check("SELECT 2 * count(*) AS n, true AS below, true AS several FROM pages")
def rate_limit_pressure(spark, sf):
    """A sender that waits while the queue is a fifth of all messages deep, beside a stream that empties it."""
    out, urls = scratch_path(spark, "paced"), page_source(spark, sf).select("url")
    messages = urls.union(urls.select(F.concat("url", F.lit("/missing"))))
    threshold = max(2, messages.count() // 5)
    queue = PacedQueue(spark, scratch_path(spark, "queue"), "url STRING", threshold)
    query = run(queue.read(max_files=1), lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch_id={n}"), f"{out}-checkpoint", "0 seconds")
    try:
        queue.send(messages, query, rows=threshold // 2, poll=0.05)
        queue.wait(query, 0, poll=0.05)
    finally:
        query.stop()
    got = spark.read.parquet(out)
    batches = F.countDistinct("batch_id") > 3
    return got.agg(F.count("*").alias("n"), F.lit(queue.deepest <= threshold).alias("below"), batches.alias("several"))


@check(f"""
WITH p AS (SELECT page_id, url, regexp_extract_all({BODY}, '<p>(?:<b>)?([^<]*)', 1) AS l FROM pages)
SELECT 'entity' AS kind, page_id, generate_subscripts(l, 1) - 1 AS n, unnest(l) AS text FROM p
UNION ALL SELECT 'no page', -1, 2, url || '/missing' FROM pages
UNION ALL SELECT 'no entities', -1, 2, url FROM p WHERE len(l) = 0
UNION ALL SELECT 'malformed message', -1, 0, NULL""", name="stream_extract")
def stream_extract_articles(spark, sf):
    """Every message ends as entities, dead after two tries, or among the errors."""
    out, queue = scratch_path(spark, "extracted"), url_queue(spark, sf)
    pages = store_snapshot(page_source(spark, sf), scratch_path(spark, "snapshot"), parts=16)
    spark.createDataFrame([(None,)], "url STRING").write.mode("append").parquet(queue)
    stream = url_stream(spark, queue, "url STRING", max_files=2)
    finished(stream_extract(stream, pages, specs.ARTICLES, out, f"{out}-checkpoint", k=2))
    finish_retries(spark, pages, specs.ARTICLES, out, k=2)
    found = spark.read.parquet(f"{out}/entities").select(F.lit("entity").alias("kind"), "page_id", F.col("entity_idx").alias("n"), F.col("data")["PARAGRAPH"].alias("text"))
    dead = spark.read.parquet(f"{out}/dead").select("reason", F.lit(-1), "attempts", "url")
    errors = spark.read.parquet(f"{out}/errors").select("message", F.lit(-1), F.lit(0), "log_message")
    return found.union(dead).union(errors)


MEMBER_RULES = {"SEGMENT": (True, 600), "MEMBER": (True, 16)}


def member_messages(spark, sf):
    """Entity messages: parts, customers, some of another type and some without data."""
    word = lambda kind, value, n: F.create_map(F.lit("SEGMENT"), kind, F.lit("MEMBER"), value, F.lit("N"), F.col(n).cast("string"))
    parts = table(spark, sf, "part").select(F.lit("Part").alias("type"), word("p_type", "p_name", "p_partkey").alias("EntityData"))
    names = table(spark, sf, "customer").select(F.lit("Name").alias("type"), word("c_mktsegment", "c_name", "c_custkey").alias("EntityData"))
    region = table(spark, sf, "region")
    other = region.select(F.lit("Other"), F.create_map(F.lit("SEGMENT"), "r_name", F.lit("MEMBER"), F.lit("x")))
    empty = region.select(F.lit("Part"), F.lit(None).cast("map<string,string>"))
    both = parts.union(names).union(other).union(empty).withColumn("ts", F.lit(SEEN).cast("timestamp"))
    return both


@check("""
SELECT DISTINCT 'Part' AS type, p_type AS segment, p_name AS member, sha256(p_type || chr(31) || p_name) AS id FROM part
UNION ALL SELECT 'Name: MEMBER is longer than 16', c_mktsegment, c_name, NULL FROM customer, range(2)
UNION ALL SELECT 'Part: unknown field N', NULL, NULL, NULL FROM part, range(2)
UNION ALL SELECT 'Name: unknown field N', NULL, NULL, NULL FROM customer, range(2)
UNION ALL SELECT 'Other: unknown type', r_name, 'x', NULL FROM region, range(2)
UNION ALL SELECT 'Part: malformed message', NULL, NULL, NULL FROM region, range(2)""", name="stream_load")
def stream_load_members(spark, sf):
    """Every message is loaded once or among the rejects, with the reason; all come again in other batches after a restart."""
    out, queue = scratch_path(spark, "loaded"), scratch_path(spark, "words")
    targets = {
        name: EntityTable(f"{out}/{name}", MEMBER_RULES, ["SEGMENT", "MEMBER"]) for name in ("Part", "Name")
    }
    schema = "type STRING, EntityData MAP<STRING,STRING>, ts TIMESTAMP"
    for _ in range(2):
        member_messages(spark, sf).repartition(3).write.mode("append").parquet(queue)
        stream = url_stream(spark, queue, schema, max_files=1)
        finished(entity_stream_load(stream, targets, f"{out}/rejects", f"{out}-checkpoint", f"{out}/errors"))
    loaded = [
        spark.read.parquet(f"{out}/{name}").select(F.lit(name).alias("type"), F.col("SEGMENT").alias("segment"), F.col("MEMBER").alias("member"), "id")
        for name in targets
    ]
    row = F.from_json("log_message", "map<string,string>")
    rejects = spark.read.parquet(f"{out}/errors").select(
        F.concat("source", F.lit(": "), "message"), row["SEGMENT"], row["MEMBER"], F.lit(None).cast("string")
    )
    return loaded[0].union(loaded[1]).union(rejects)


@check("""
SELECT 'row' AS kind, h || ': ' || p AS text FROM (
  SELECT regexp_extract(html, '<h1>([^<]*)', 1) AS h, unnest(regexp_extract_all(substr(html, strpos(html, '<body>')), '<p>(?:<b>)?([^<]*)', 1)) AS p FROM pages)
GROUP BY 2
UNION ALL SELECT 'malformed message', 'not JSON'""", name="crawl_extract_load")
def crawl_extract_load(spark, sf):
    """Messages of a crawl, read as they were sent, through extraction into a typed table, without steps by hand."""
    queue, out = scratch_path(spark, "sent"), scratch_path(spark, "flow")
    url_messages(page_source(spark, sf).select("url"), "Url").write.parquet(queue)
    spark.createDataFrame([("not JSON", "Url")], "body STRING, type STRING").write.mode("append").parquet(queue)
    spec = specs.ARTICLES["extraction"]
    sent = url_stream(spark, queue, "body STRING, type STRING")
    finished(stream_extract(sent, page_source(spark, sf), spec, out, f"{out}-extract"))
    rules = {"TITLE": (True, None), "PARAGRAPH": (True, None), "SOURCE": (False, 600)}
    targets = {"Paragraph": EntityTable(f"{out}-table", rules, ["TITLE", "PARAGRAPH"])}
    made = url_stream(spark, f"{out}/entities", "data MAP<STRING,STRING>, class_type STRING")
    finished(entity_stream_load(made, targets, f"{out}-rejects", f"{out}-load"))
    loaded = spark.read.parquet(f"{out}-table").select(F.lit("row").alias("kind"), F.concat_ws(": ", "TITLE", "PARAGRAPH").alias("text"))
    errors = spark.read.parquet(f"{out}/errors").select("message", "log_message")
    return loaded.union(errors)


@check("SELECT url FROM pages UNION ALL SELECT url || '/missing' FROM pages", name="stream_not_crawled")
def stream_not_crawled_urls(spark, sf):
    """The same URLs arrive twice and the stream is started twice: each is sent on once."""
    queue, out = url_queue(spark, sf), scratch_path(spark, "sent")
    for _ in range(2):
        stream = url_stream(spark, queue, "url STRING", max_files=2)
        finished(stream_not_crawled(stream, out, f"{out}-checkpoint"))
        spark.read.schema("url STRING").parquet(queue).repartition(2).write.mode("append").parquet(queue)
    return spark.read.parquet(out).select("url")


@check("SELECT DISTINCT user_id, event_type, true AS several FROM events", name="stream_dedup")
def stream_dedup_events(spark, sf):
    """Messages of a key arrive in six batches, with a restart between them; the first one counts."""
    out, queue = scratch_path(spark, "deduped"), scratch_path(spark, "events")
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for odd in range(2):
        events.where(F.col("event_id") % 2 == odd).repartition(3).write.mode("append").parquet(queue)
        stream = url_stream(spark, queue, events.schema, max_files=1)
        first = stream_dedup(stream, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type")
        finished(run(first, lambda b, n: b.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{out}/batch_id={n}"), f"{out}-checkpoint"))
    batches = sum(name.startswith("batch_id=") for name in names_in(spark, out))
    return spark.read.parquet(out).select("user_id", "event_type", F.lit(batches > 5).alias("several"))
