"""A corpus pipeline: `documents` to token ids, in five stages that each write their result for the next one.

Toxic documents go; of repeated passages the first copy stays, and documents of which nothing is left go; one document
of each near-duplicate group stays; documents that hold a benchmark item go; the rest becomes token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from webtables.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from webtables.llm.common import documents, free_name, stored

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score 0.5 or more; the model learns from the labelled ones among `docs`.

    Null and empty texts score what a text without words does; without labels of both kinds nothing goes.
    """
    model = toxicity.fit(docs, toxicity.labels_of(spark, sf_dir))
    return toxicity.scored(docs, model).filter(F.col(free_name(docs, "toxicity")) < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines; documents that lost all they had go.

    `docs` needs n_chars, which is counted anew where lines went. Null and empty texts stay; a row that repeats as a
    whole is the same document.
    """
    removed = free_name(docs, "n_removed")
    rows = line_dedup.line_dedup(docs).filter((F.col(removed) == 0) | (F.btrim("text", F.lit(" \t\n\r\x0b\x0c")) != ""))
    length = F.when(F.col(removed) > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.withColumn("n_chars", length).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; rows that repeat it stay with it.

    Texts without a word, null ones included, are one group. Documents without doc_id stay only where none has one.
    """
    return simhash.simhash_dedup(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold an item of the benchmark; null and empty texts hold none."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document, and none of its other columns; a null text has no ids."""
    ids = free_name(docs.select("doc_id", "lang", "source", "text"), "ids")
    rows = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(TOKENIZER))
    return rows.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("bpe encoding and decoding", to_tokens),
]

#: Models, hashes and tokens are not SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
