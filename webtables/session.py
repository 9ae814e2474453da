"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "webtables", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library is tested with; `conf` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.windowGroupLimitThreshold": "10000",  # so that `bounded_queue` limits groups before the shuffle
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (`spark.checkpoint.dir`).

    Only where it is unset and driver and executors are one process, as in tests, a folder on this machine
    is set instead: on a cluster the other executors could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    made = tempfile.mkdtemp(prefix="webtables-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody else uses, in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/webtables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back, for a result that several later steps scan.

    Cuts the lineage and survives lost executors like a checkpoint, but is columnar, so those scans read
    only the columns and rows they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, in whatever store it is."""
    store, where = _folder(spark, path)
    store.delete(where, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    store, where = _folder(spark, path)
    return [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables like those of `written` that are deleted at the end of the block, in which they must be used up."""
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        paths.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        for path in paths:
            removed(spark, path)


def bucketed(df: DataFrame, key: str, name: str, buckets: int | None = None, distinct: bool = False) -> tuple[DataFrame, str]:
    """Write to the shared folder in buckets of `key` and read back, with the table's name for `forget`.

    For the side of a join that is used again and again: later joins on `key` read it without a shuffle. The
    number of buckets is the caller's, by default that of shuffle partitions; size it to the data. Equal rows meet in one
    bucket, so `distinct` needs no other shuffle.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"webtables_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, key)
    (dealt.distinct() if distinct else dealt).write.bucketBy(buckets, key).option("path", path).saveAsTable(table)
    return spark.table(table), table


def forget(spark: SparkSession, table: str, path: str | None = None) -> None:
    """Drop a table made by `bucketed` from the catalog, and its files."""
    files = spark.table(table).inputFiles() if path is None else []
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    folder = path or (files[0].rpartition("/")[0] if files else None)
    if folder and "/webtables/" in folder:
        removed(spark, folder)
