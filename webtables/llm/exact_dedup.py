"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Rows of equal text are combined three times: within each task, within each salt of a digest, then over the salts of
a digest. Every stage groups by digest *and* full text, so equal digests of different texts never mix, and no stage
sees more rows of one group than it has tasks or salts. What each row needs to know is then joined back by digest,
which one small row per text answers; only digests that several texts share are joined by full text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from webtables.llm.common import documents, full_text, numbered, stored

#: Salts of a digest: the most rows of one text that meet in the last stage.
SALTS = 16
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text, SPACES, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def salted(digest: Column, doc_id: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(salts)).cast("int")


def winners(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: digest, content, keep_id (smallest doc_id), group_size."""
    rows = docs.select("doc_id", normalised(full_text()).alias("content")).select("doc_id", "content", digest(F.col("content")).alias("digest"))
    within_salt = (
        rows.groupBy("digest", salted(F.col("digest"), F.col("doc_id"), salts).alias("salt"), "content")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    return (
        within_salt.drop("salt").repartition("digest").groupBy("digest", "content")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )


def grouped(docs: DataFrame, digest, salts: int) -> tuple[DataFrame, dict[str, str]]:
    """The rows of `docs`, columns numbered, with digest, keep_id, group_size and kept; and the names of the columns."""
    found = winners(docs, digest, salts)
    by_digest = stored(
        found.groupBy("digest").agg(F.count("*").alias("contents"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size")),
        "exact-winners",
    )
    rows, names = numbered(docs)
    content = normalised(full_text(names["text"]))
    rows = rows.withColumn("digest", digest(content))
    found_rows = rows.join(by_digest.filter("contents = 1").drop("contents"), "digest")
    shared = by_digest.filter("contents > 1")
    if not shared.isEmpty():  # different texts of one digest: join by the text itself
        contested = found.join(shared.select("digest"), "digest")
        found_rows = found_rows.unionByName(rows.withColumn("content", content).join(contested, ["digest", "content"]).drop("content"))
    return found_rows.withColumn("kept", F.col(names["doc_id"]).eqNullSafe(F.col("keep_id"))), names


NEW = ("digest", "keep_id", "group_size", "kept")


def exact_groups(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """The rows of `docs` (doc_id, text, more) with digest, keep_id, group_size and kept.

    Null texts count as empty. Rows without doc_id never win while another row of the group has one; a group without
    any has a null keep_id and its rows are kept (none can be told from the others). Rows that repeat the smallest
    doc_id with an equal text are the same document and all count as kept. Columns named like the new ones are
    replaced by them. An empty table gives an empty table.
    """
    rows, names = grouped(docs, digest, salts)
    return rows.select(*(F.col(n).alias(c) for c, n in names.items() if c not in NEW), *NEW)


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of `docs` that stay, with their own columns, whatever their names."""
    rows, names = grouped(docs, sha256, salts)
    return rows.filter("kept").select(*(F.col(n).alias(c) for c, n in names.items()))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(documents(spark, sf_dir).select("doc_id", "text"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents),
g AS (SELECT content, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY content)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.content) AS text_sha256
FROM t JOIN g USING (content)
"""

QUERIES = {"op9_exact_dedup": (op9_exact_dedup, OP9_SQL)}
