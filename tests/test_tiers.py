"""Stored snapshots and tiers: what is read, what is merged, what stays on disk."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F, types as T

from webtables.session import names_in, scratch, shared_dir
from webtables.sources.pages import resolve_pages, store_snapshot
from webtables.sources.tiers import PART, Tiers
from webtables.streaming.feed import EntityTable, entity_stream_load, stream_extract, url_stream

URL = T.StructType().add("url", T.StringType())


def test_a_lookup_reads_a_share_of_the_files(spark, tmp_path):
    pages = spark.range(2_000).select(F.col("id").alias("page_id"), F.format_string("https://x.example/%d", "id").alias("url"), F.lit("<body>x").alias("html"))
    copies = spark.range(3_000).select((F.col("id") + 5_000).alias("page_id"), F.lit("https://x.example/7").alias("url"), F.lit("<body>copy").alias("html"))
    stored = store_snapshot(pages.unionByName(copies), str(tmp_path / "snapshot"), parts=64)
    everything = len(stored.pages.inputFiles())
    assert everything >= 64
    urls = spark.createDataFrame([("https://x.example/7",), ("https://x.example/8",), ("https://x.example/8",), ("none",)], "url STRING")
    few = stored.holding(urls)
    few.collect()
    scan = few._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert f"PartitionFilters: [{PART}#" in scan.toString()
    assert 0 < scan.metrics().apply("numFiles").value() < everything // 8
    found, missing = resolve_pages(urls, stored)
    assert sorted((r.url, r.page_id) for r in found.collect()) == [("https://x.example/7", 7_999), ("https://x.example/8", 8), ("https://x.example/8", 8)]
    assert [r.url for r in missing.collect()] == ["none"]


def test_tiers_hold_every_batch_in_few_folders(spark, tmp_path):
    tiers, draw, seen = Tiers(spark, str(tmp_path / "tiers"), URL, ["url"], parts=8), random.Random(3), set()
    for batch in range(21):
        rows = spark.createDataFrame([(f"u{draw.randrange(120)}",) for _ in range(12)], URL).distinct()
        for _ in range(1 + batch % 2):  # every other batch comes twice
            with scratch(spark) as keep:
                fresh = keep(tiers.absent(batch, rows, keep), "fresh")
                tiers.add(batch, fresh)
                new = {r.url for r in fresh.collect()}
        assert new == {r.url for r in rows.collect()} - seen
        seen |= new
        assert len(tiers.before(batch + 1)) <= 5 and len(names_in(spark, tiers.path)) <= 10
    assert {r.url for r in tiers.read(tiers.before(21)).collect()} == seen
    read = tiers.known(21, [3]).select(F.input_file_name().alias("f")).distinct().collect()
    assert all(f"{PART}=3/" in r.f for r in read)


def finish(query):
    query.awaitTermination()


@pytest.mark.parametrize("stored", [True, False])
def test_scratch_does_not_grow_with_the_batches(spark, tmp_path, pages_of, stored):
    pages = pages_of(*[f"<body><p>{i}" for i in range(20)])
    pages = store_snapshot(pages, str(tmp_path / "snapshot"), parts=8) if stored else pages
    spec = {"navigation": {"tag": "p"}, "target": {"value": "InnerText", "recon": {"classification": [{"name": "TEXT"}]}, "classType": "Line"}}
    queue, out, sizes = str(tmp_path / "queue"), str(tmp_path / "out"), []
    table = EntityTable(f"{out}/table", {"TEXT": (True, None)}, ["TEXT"], parts=4)
    for i in range(10):
        spark.createDataFrame([(f"https://x.example/{i}",), (f"https://x.example/{i // 2}",)], "url STRING").write.mode("append").parquet(queue)
        before = set(names_in(spark, f"{shared_dir(spark)}/webtables"))
        finish(stream_extract(url_stream(spark, queue, "url STRING", max_files=1), pages, spec, out, f"{out}-extract"))
        made = url_stream(spark, f"{out}/entities", "data MAP<STRING,STRING>, class_type STRING")
        finish(entity_stream_load(made, {"Line": table}, f"{out}/rejects", f"{out}-load"))
        sizes.append(len(set(names_in(spark, f"{shared_dir(spark)}/webtables")) - before))
    assert set(sizes) == {0 if stored else 1}  # the index of a snapshot's URLs, one a start
    assert sorted(r.TEXT for r in spark.read.parquet(table.path).collect()) == sorted(str(i) for i in range(10))
    assert len(names_in(spark, f"{table.path}/_keys")) <= 6
