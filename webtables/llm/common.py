"""What the operators share: stored tables, null-safe text, the fold that no model learns from."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from webtables.session import written as stored  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
#: Rows of a few short columns that one file holds, where a table between two steps is packed.
PACKED = 250_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def full_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def packed(df: DataFrame, rows: int, name: str) -> DataFrame:
    """`stored`, for a table of at most `rows` short rows: a file for every core, more where they have more than `PACKED` rows.

    For the tables of loops. As many files as shuffles have partitions would be a task, a listing and (where Hadoop has no
    native library) a process started by the executor for each, however few their rows.
    """
    return stored(df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // PACKED))), name)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for `mapInArrow` after which the Python worker, kept for later tasks, gives back what it has freed.

    C's allocator keeps freed arrays for itself, so workers would hold the largest need of all steps before, beside a
    step that may need none of it.
    """

    def lent(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
                trim(0)

    return lent


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores in front until no column of `df` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns c0, c1, ..., so that helper columns can have any other name, and the old names' new ones."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def widened(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of `df` with one column more (`df.schema` itself must not change)."""
    return StructType([*df.schema.fields, StructField(name, _parse_datatype_string(kind))])


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a row belongs to the fold that no model learns from: crc32 of the id as text, mod `folds`, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))
