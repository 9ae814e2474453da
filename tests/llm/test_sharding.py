from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from webtables.llm import sharding

from .conftest import ODD


def by_hand(rows, shards, seed=42):
    """(doc_id, source, size, crc, shard, slot) by sorting everything: rows are (doc_id, source, text)."""
    import hashlib

    copies, full = Counter(), []
    for i, s, t in rows:
        text = (t or "").encode()
        row = (i, "" if s is None else f"={s}", len(text) + 8, zlib.crc32(text))
        copies[row] += 1
        key = int(hashlib.md5(f"{seed}:{'' if i is None else i}:{row[3]}:{copies[row]}".encode()).hexdigest()[:15], 16)
        full.append((key, i is not None, i, row[3], row[2], copies[row], row[1], s))
    placed = []
    for source in {r[6] for r in full}:
        own = sorted((r for r in full if r[6] == source), key=lambda r: r[:6])
        share = zlib.crc32(f"{seed}:{source}".encode()) / 2**32
        placed += [((n + share) / len(own), source, *r) for n, r in enumerate(own)]
    placed.sort(key=lambda r: r[:8])
    n, found, slots = len(placed), [], Counter()
    for position, r in enumerate(placed):
        shard = position * shards // n
        found.append((r[4], r[9], r[6], r[5], shard, slots[shard]))
        slots[shard] += 1
    return found


@pytest.mark.parametrize("bucket_rows", [3, 50, 10_000])
def test_against_sorting(spark, bucket_rows):
    rows = [(i, [None, "", "hot", "hot", "hot", "b"][i % 6], f"text {i % 11}" if i % 7 else None) for i in range(500)]
    rows += [(None, "b", f"text {i}") for i in range(40)] + [(7, "hot", "copy")] * 60 + [(1_000 + i, f"site{i}", "one row") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = sharding.shard(docs.repartition(5), 7, bucket_rows=bucket_rows).collect()
    names = ("doc_id", "source", "size", "text_crc32", "shard", "slot")
    assert sorted((tuple(r[c] for c in names) for r in found), key=repr) == sorted(by_hand(rows, 7), key=repr)


def test_many_small_sources_are_spread(spark):
    """Sources of one or two rows go to all shards alike, and no fine bucket holds many rows."""
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), F.format_string("site%d", F.col("id").cast("int") % 4_000).alias("source"), F.lit("x").alias("text"))
    found = sharding.shard(docs, 10, bucket_rows=100)
    small = found.filter("CAST(substr(source, 5) AS INT) >= 2000").groupBy("shard").count().collect()
    assert len(small) == 10 and all(140 < r["count"] < 260 for r in small)


def test_every_shard_has_the_mixture(spark):
    docs = spark.range(2400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 8).cast("string")).alias("source"), F.lit("x").alias("text"))
    found = sharding.shard(docs, 24, bucket_rows=100)
    sizes = [r["count"] for r in found.groupBy("shard").count().collect()]
    assert sizes == [100] * 24
    mixture = Counter((r["source"], r["n"]) for r in found.groupBy("shard", "source").agg(F.count("*").alias("n")).collect())
    totals = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    assert all(abs(n - totals[s] / 24) < 2 for s, n in mixture)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("source", F.lit(None).cast("string")).withColumn("_rank", F.lit(1))
    found = sharding.shard(docs, 4).collect()
    assert len(found) == len(ODD)
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in found if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert sharding.shard(no_docs.withColumn("source", F.lit("a")), 4).count() == 0
    assert Counter(r["shard"] for r in sharding.shard(docs.limit(2), 4).collect()).most_common(1)[0][1] == 1
