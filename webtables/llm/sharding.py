"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows are shuffled by a seeded hash and ranked within their source; rank over source size, moved by a share of one rank
that is the source's own, is a row's place between 0 and 1. Sorted by that place and cut into equal counts, every shard
has each source in proportion, and many sources of a row or two are spread over all shards.

Neither ranking sorts a source, or the table, in one task: rows are ranked within buckets of bounded size, and the
sizes of the buckets before are added. Buckets come in two levels, so that also their sums run over short lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from webtables.llm.common import documents, full_text, stored

#: Rows that a bucket has about.
BUCKET_ROWS = 2_000
#: Buckets of the coarse level.
COARSE = 512


def ranked(rows: DataFrame, group: list[str], place: Column, order: list[str], buckets: int, into: str) -> DataFrame:
    """Adds `into`: the row's rank from 0 within `group`, by `place` (0 to 1, even), then `order`."""
    at = F.least(F.lit(buckets - 1), F.floor(place * buckets)).cast("long")
    rows = rows.withColumn("_fine", at).withColumn("_coarse", F.floor(F.col("_fine") / -(-buckets // COARSE)).cast("long"))
    before = lambda *keys: Window.partitionBy(*keys)
    fine = rows.groupBy(*group, "_coarse", "_fine").agg(F.count("*").alias("_n"))
    coarse = fine.groupBy(*group, "_coarse").agg(F.sum("_n").alias("_all"))
    upto = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select(*group, "_coarse", upto("_all", before(*group).orderBy("_coarse")).alias("_skip"))
    fine = fine.join(coarse, [*group, "_coarse"]).select(
        *group, "_fine", (F.col("_skip") + upto("_n", before(*group, "_coarse").orderBy("_fine"))).alias("_skip")
    )
    inside = F.row_number().over(before(*group, "_fine").orderBy(*order)) - 1
    return rows.withColumn(into, inside.cast("long")).join(fine, [*group, "_fine"]).withColumn(into, F.col(into) + F.col("_skip")).drop("_fine", "_coarse", "_skip")


def shard(docs: DataFrame, shards: int, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes of the text plus 8), text_crc32, shard, slot of every row of `docs`.

    Counts of shards differ by one at most. Rows without a source are a source of their own; a null text has no
    bytes, a null doc_id is a value. The result depends on rows and seed only, whatever the order of rows.
    An empty table gives an empty table, shards beyond the number of rows stay empty.
    """
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_stratum"),
        (F.octet_length(full_text()) + 8).cast("long").alias("size"),
        F.crc32(full_text().cast("binary")).alias("text_crc32"),
    )
    # copies of a row are counted and numbered, so that they too are shuffled
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n")
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32"), F.col("_copy"))
    rows = rows.withColumn("_shuffle", F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"))
    rows = stored(rows, "shard-rows")
    sizes = rows.groupBy("_stratum").agg(F.count("*").alias("_of"))
    total = rows.count()
    buckets = max(1, -(-total // bucket_rows))
    order = ["_shuffle", "doc_id", "text_crc32", "size", "_copy"]
    rows = ranked(rows, ["_stratum"], F.col("_shuffle") / float(1 << 60), order, buckets, "_rank")
    own = F.crc32(F.concat(F.lit(f"{seed}:"), F.col("_stratum")).cast("binary")) / float(1 << 32)
    rows = rows.join(sizes, "_stratum").withColumn("_place", (F.col("_rank") + own) / F.col("_of")).withColumn("_all_rows", F.lit(0))
    rows = ranked(rows, ["_all_rows"], F.col("_place"), ["_place", "_stratum", *order], buckets, "_position")
    cut = F.expr(f"_position * {shards}L div {max(1, total)}L")
    first = F.expr(f"(_shard * {max(1, total)}L + {shards - 1}) div {shards}L")
    return rows.withColumn("_shard", cut).select(
        "doc_id",
        F.when(F.col("_stratum") != "", F.substring("_stratum", 2, 1 << 30)).alias("source"),
        "size",
        "text_crc32",
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_position") - first).alias("slot"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


#: crc32 is worked out from a table of 256 codes, a byte at a time.
OP2_SQL = r"""
WITH codes AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))) AS code),
texts AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce('=' || source, '') AS stratum, encode(coalesce(text, '')) AS text FROM documents),
given AS (SELECT row, 0 AS what, text FROM texts UNION ALL SELECT row, 1, encode('42:' || stratum) FROM texts),
digits AS (SELECT row, what, list_transform(string_split(hex(text), ''), lambda c: instr('0123456789ABCDEF', c) - 1) AS d FROM given),
bytes AS (SELECT row, what, list_transform(range(1, len(d), 2), lambda i: 16 * d[i] + d[i + 1]) AS b FROM digits),
sums AS (SELECT row, what, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, code[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM bytes, codes),
sized AS (
  SELECT t.doc_id, t.source, t.stratum, octet_length(t.text) + 8 AS size, x.crc AS text_crc32, y.crc / 4294967296::DOUBLE AS own,
    row_number() OVER (PARTITION BY t.doc_id, t.stratum, octet_length(t.text), x.crc) AS copy
  FROM texts t JOIN sums x ON x.row = t.row AND x.what = 0 JOIN sums y ON y.row = t.row AND y.what = 1),
shuffled AS (SELECT *, substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32 || ':' || copy), 1, 15) AS shuffle FROM sized),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY shuffle, doc_id NULLS FIRST, text_crc32, size, copy) - 1 + own) / count(*) OVER (PARTITION BY stratum) AS place
  FROM shuffled),
placed AS (SELECT *, row_number() OVER (ORDER BY place, stratum, shuffle, doc_id NULLS FIRST, text_crc32, size, copy) - 1 AS position, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, position * 24 // total AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, (position - (shard * total + 23) // 24)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard, source FROM cut
"""

QUERIES = {"op2_sharding": (op2_sharding, OP2_SQL)}
