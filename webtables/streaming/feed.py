"""Structured Streaming feeds.

Extraction joins and aggregates, so it runs on each micro-batch as a plain DataFrame. Every batch writes
to its own `batch_id=N` folder and overwrites it, which makes a batch that runs again harmless.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.messages import ENTITY_MESSAGE, URL_MESSAGE, parse_message
from ..operators.errors import log_rows
from ..operators.load import check_constraints, dedup_natural_key, key_digest, rules_schema, to_typed_row, with_row_identity
from ..operators.queues import retry_or_dead_letter, route_by_type
from ..plans.extract import assemble, spec_pages
from ..session import names_in, removed, scratch, scratch_path, written
from ..sources.pages import Snapshot, newest_pages, resolve_pages
from ..sources.tiers import Tiers


def url_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    max_files: int | None = None,
    max_bytes: str | None = None,
    files: str | None = None,
) -> DataFrame:
    """A queue folder as a stream. The rate limit is `max_files` or `max_bytes` (like `10g`) per batch;
    `files` is a file name pattern."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load(path)


class PacedQueue:
    """A queue folder that is filled only while fewer than `threshold` messages wait in it.

    The stream of `read` observes how many messages each batch takes; what was sent less that is the depth. `send` waits
    while a piece more would pass the threshold, so no batch ever finds or leaves more. `waiting`: messages that wait
    already when the queue is taken up again.
    """

    NAME = "taken"

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, threshold: int, waiting: int = 0):
        self.spark, self.path, self.schema, self.threshold = spark, path, schema, threshold
        self.sent, self.taken, self.deepest = waiting, {}, waiting
        if not names_in(spark, path):
            spark.createDataFrame([], schema).write.mode("append").parquet(path)  # a stream needs the folder

    def read(self, **limits) -> DataFrame:
        stream = url_stream(self.spark, self.path, self.schema, **limits)
        return stream.observe(self.NAME, F.count(F.lit(1)).alias("rows"))

    def depth(self, query: StreamingQuery) -> int:
        """Messages sent and not taken yet, as far as the query has told."""
        for progress in query.recentProgress:
            seen = (progress["observedMetrics"] or {}).get(self.NAME)
            if seen is not None and progress["numInputRows"] > 0:
                self.taken[progress["batchId"]] = seen["rows"]
        return self.sent - sum(self.taken.values())

    def wait(self, query: StreamingQuery, most: int, poll: float) -> None:
        """Until at most `most` messages wait."""
        while self.depth(query) > most:
            if not query.isActive:
                raise RuntimeError("the stream that empties the queue has ended") from query.exception()
            time.sleep(poll)

    def send(self, messages: DataFrame, query: StreamingQuery, rows: int, poll: float = 5.0) -> None:
        """Append all messages in pieces of at most `rows`, each as soon as there is room for it."""
        place = F.monotonically_increasing_id()
        piece = F.concat_ws("-", F.shiftright(place, 33), F.floor(place.bitwiseAND((1 << 33) - 1) / min(rows, self.threshold)).cast("long"))
        pieces = scratch_path(self.spark, "pieces")
        try:
            messages.withColumn("_piece", piece).write.partitionBy("_piece").parquet(pieces)
            schema = messages.schema
            for name in sorted(n for n in names_in(self.spark, pieces) if n.startswith("_piece=")):
                part = self.spark.read.schema(schema).parquet(f"{pieces}/{name}")
                n = part.count()
                self.wait(query, self.threshold - n, poll)
                part.coalesce(1).write.mode("append").parquet(self.path)
                self.sent += n
                self.deepest = max(self.deepest, self.depth(query))
        finally:
            removed(self.spark, pieces)


def stream_dedup(stream: DataFrame, key: list[str], watermark: str, delay: str) -> DataFrame:
    """First message of each key; state is kept only as long as the watermark needs it."""
    return stream.withWatermark(watermark, delay).dropDuplicatesWithinWatermark(key)


def run(stream: DataFrame, each_batch, checkpoint: str, continuous: str | None = None) -> StreamingQuery:
    """Start a `foreachBatch` query: all available data once, or every `continuous` interval."""
    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": continuous} if continuous else {"availableNow": True}
    return writer.trigger(**trigger).start()


def earlier(spark: SparkSession, path: str, batch_id: int, schema: T.StructType, since: int = 0) -> DataFrame:
    """What batches before this one, from `since` on, wrote; a batch that runs again does not see its own output."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    table = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)
    return table.where((F.col("batch_id") < batch_id) & (F.col("batch_id") >= since)).drop("batch_id")


def url_messages_of(batch: DataFrame) -> DataFrame:
    """`url, raw` of messages that come as `url` or as JSON in `body`; a malformed message has no url."""
    if "body" in batch.columns:
        return batch.select(parse_message(F.col("body"), URL_MESSAGE)["url"].alias("url"), F.col("body").alias("raw"))
    return batch.select("url", F.col("url").alias("raw"))


RETRY = T.StructType().add("url", T.StringType()).add("reason", T.StringType()).add("attempts", T.IntegerType())


def extracted(sent: DataFrame, again: DataFrame, pages: DataFrame | Snapshot, newest: DataFrame | None, spec: dict, out: str, batch: int, k: int, keep) -> DataFrame:
    """One batch of `stream_extract`, written under `batch_id=batch`; returns the messages to retry."""
    to = lambda name: f"{out}/{name}/batch_id={batch}"
    asked = sent.where("url IS NOT NULL").select("url").union(again.select("url")).distinct()
    found, missing = resolve_pages(asked, pages, newest, keep)
    made = keep(assemble(spec_pages(found, spec), spec), "assembled")
    good = made.where("error IS NULL").drop("error")
    good.write.mode("overwrite").parquet(to("entities"))
    at = found.select("url", "page_id")
    empty = at.join(good.select("page_id").distinct(), "page_id", "left_anti")
    failed = missing.select("url", F.lit("no page").alias("reason")).union(empty.select("url", F.lit("no entities")))
    retry, dead = retry_or_dead_letter(failed, again, k, ["url"])
    retry = keep(retry.select(*RETRY.names), "retry")
    dead.select(*RETRY.names).write.mode("overwrite").parquet(to("dead"))
    broken = made.where("error IS NOT NULL").join(at, "page_id")
    broken = broken.select(F.col("url").alias("source"), F.col("error").alias("message"), F.to_json("data").alias("detail"))
    malformed = sent.where("url IS NULL").select(F.lit(None).cast("string").alias("source"), F.lit("malformed message").alias("message"), F.col("raw").alias("detail"))
    log_rows("extract", broken.union(malformed)).write.mode("overwrite").parquet(to("errors"))
    return retry


def stream_extract(stream: DataFrame, pages: DataFrame | Snapshot, spec: dict, out: str, checkpoint: str, k: int = 3) -> StreamingQuery:
    """URL messages (`url`, or JSON in `body`) -> entities in `out/entities`; every message has an end.

    A URL without a page, or whose page gives no entity, goes to `out/retry` and comes again with the next batch (or with
    `finish_retries`); its k-th failure takes it to `out/dead`. Malformed messages and failed entities are in
    `out/errors`, in the shape of the error log. A URL that a batch has several times is looked up once.

    Of a stored `Snapshot` a batch reads the partitions of its URLs only. Other pages are scanned for the text of the
    URLs asked for, and their URLs are indexed once per start. What a batch writes for itself is deleted at its end.
    """
    newest = None if isinstance(pages, Snapshot) else written(newest_pages(pages), "newest")

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark) as keep:
            sent = keep(url_messages_of(batch), "sent")
            again = earlier(spark, f"{out}/retry", batch_id, RETRY, since=batch_id - 1).select("url", "attempts")
            retry = extracted(sent, again, pages, newest, spec, out, batch_id, k, keep)
            retry.write.mode("overwrite").parquet(f"{out}/retry/batch_id={batch_id}")

    return run(stream, each_batch, checkpoint)


def finish_retries(spark: SparkSession, pages: DataFrame | Snapshot, spec: dict, out: str, k: int = 3) -> None:
    """Try what the last batch of an ended `stream_extract` left for retry until it has entities or is dead.

    No message need come for that. Tries are written as batches -1, -2, ...; those left over are gone afterwards, so that a
    stream which goes on does not try them again.
    """
    batches = [int(n.split("=")[1]) for n in names_in(spark, f"{out}/retry") if n.startswith("batch_id=")]
    last, lowest = max(batches, default=-1), min([0, *(int(n.split("=")[1]) for n in names_in(spark, f"{out}/dead") if n.startswith("batch_id="))])
    if last < 0:
        return
    path = f"{out}/retry/batch_id={last}"
    with scratch(spark) as keep:
        again = keep(spark.read.schema(RETRY).parquet(path), "left")
        nothing = spark.createDataFrame([], "url STRING, raw STRING")
        while not again.isEmpty():
            lowest -= 1
            again = extracted(nothing, again.select("url", "attempts"), pages, None, spec, out, lowest, k, keep)
        again.write.mode("overwrite").parquet(path)


@dataclass
class EntityTable:
    """Where entities of one type go: rules `{column: (required, length)}` and the natural key.

    Digests of the keys loaded so far stand beside the rows, in the folder `_keys`, in `parts` partitions.
    """

    path: str
    rules: dict
    key: list[str] = field(default_factory=list)
    parts: int = 64

    @property
    def schema(self) -> T.StructType:
        return rules_schema(self.rules)

    def keys(self, spark: SparkSession) -> Tiers:
        return Tiers(spark, f"{self.path}/_keys", T.StructType().add("digest", T.BinaryType()), ["digest"], self.parts)


def entity_messages_of(batch: DataFrame) -> DataFrame:
    """`type, data, ts, raw` of entity messages: JSON in `body`, `EntityData` maps, or rows that `stream_extract` wrote."""
    kind = F.col("type" if "type" in batch.columns else "class_type")
    if "body" in batch.columns:
        data, raw = parse_message(F.col("body"), ENTITY_MESSAGE)["EntityData"], F.col("body")
    else:
        data = F.col("EntityData" if "EntityData" in batch.columns else "data")
        raw = F.to_json(data)
    ts = F.col("ts") if "ts" in batch.columns else F.current_timestamp()
    return batch.select(kind.alias("type"), data.alias("data"), ts.alias("ts"), raw.alias("raw"))


def entity_stream_load(
    stream: DataFrame, targets: dict[str, EntityTable], rejects: str, checkpoint: str, errors: str | None = None
) -> StreamingQuery:
    """Entity messages (see `entity_messages_of`) -> one table per type, inserted when the key is absent.

    A batch appends its new rows only, and reads only those partitions of the keys loaded before that its own keys fall
    into. What is not loaded goes to `rejects` (type, message, row as JSON): rows that break a rule, messages of an
    unknown type, malformed ones; so do the names of fields that a table lacks. With `errors` they are also written there, in
    the shape of the error log.
    """

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark) as keep:
            load(spark, keep(entity_messages_of(batch), "messages"), batch_id, keep)

    def load(spark: SparkSession, sent: DataFrame, batch_id: int, keep) -> None:
        known_type = F.coalesce(F.col("type").isin(*targets), F.lit(False))
        lost = [
            sent.where(~known_type).select("type", F.lit("unknown type").alias("message"), F.col("raw").alias("row")),
            sent.where(known_type & F.col("data").isNull()).select("type", F.lit("malformed message"), "raw"),
        ]
        for class_type, table in targets.items():
            routed = route_by_type(sent, class_type).where("data IS NOT NULL")
            rows, unknown = to_typed_row(routed, table.schema, keep=["ts"])
            good, bad = check_constraints(rows, table.rules)
            key = table.key or list(table.rules)
            ordered = dedup_natural_key(good, key, ["ts", *table.rules]).select(*table.rules)
            keys = table.keys(spark)
            fresh = keep(keys.absent(batch_id, ordered.withColumn("digest", key_digest(key)), keep), "fresh")
            rows = with_row_identity(fresh.drop("digest"), key, F.current_timestamp())
            rows.write.mode("overwrite").parquet(f"{table.path}/batch_id={batch_id}")
            keys.add(batch_id, fresh)
            lost.append(bad.select(F.lit(class_type), F.array_join("violations", "; "), F.to_json(F.struct(*table.rules))))
            lost.append(unknown.select(F.lit(class_type), F.concat(F.lit("unknown field "), "unknown_field"), F.lit(None).cast("string")))
        lost = keep(reduce(DataFrame.union, lost), "rejects")
        lost.write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")
        if errors:
            failed = lost.select(F.col("type").alias("source"), "message", F.col("row").alias("detail"))
            log_rows("load", failed).write.mode("overwrite").parquet(f"{errors}/batch_id={batch_id}")

    return run(stream, each_batch, checkpoint)


def stream_not_crawled(stream: DataFrame, ledger_path: str, checkpoint: str, parts: int = 64) -> StreamingQuery:
    """URLs never sent before, across restarts: each batch appends its new URLs to the ledger folder.

    A batch reads only the partitions of earlier URLs that its own fall into.
    """
    schema = T.StructType().add("url", T.StringType())

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = Tiers(spark, f"{ledger_path}/_urls", schema, ["url"], parts)
        with scratch(spark) as keep:
            fresh = keep(known.absent(batch_id, batch.select("url").where("url IS NOT NULL").distinct(), keep), "fresh")
            fresh.write.mode("overwrite").parquet(f"{ledger_path}/batch_id={batch_id}")
            known.add(batch_id, fresh)

    return run(stream, each_batch, checkpoint)
