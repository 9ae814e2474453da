from __future__ import annotations

import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from texts, with doc_ids from 0, or from (doc_id, text) pairs."""

    def make(*rows):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame(pairs, "doc_id BIGINT, text STRING")

    return make


#: Null and empty texts, a null id, a repeated row, ties, a long text, odd white space and characters.
ODD = [
    (0, "One two three four five six seven."),
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (None, "One two three four five six seven."),
    (None, None),
    (5, "One two  three four\tfive six seven."),
    (5, "One two  three four\tfive six seven."),
    (6, "Übergröße ſecret K naïve — 日本語 \U0001f600 x"),
    (7, "word " * 30_000),
    (8, "\n\n\nOne two three four five six seven.\n\n"),
]


@pytest.fixture
def odd_docs(spark):
    return spark.createDataFrame(ODD, "doc_id BIGINT, text STRING")


@pytest.fixture
def clashing(odd_docs):
    """The odd documents with columns named like helpers and results of the operators."""
    from pyspark.sql import functions as F

    names = "gone ids decoded spans toxicity n_lines n_removed _doc _hash _key h fp digest content keep_id kept c0 c1 score x at size slot _n shard"
    return odd_docs.select("*", *(F.lit(name).alias(name) for name in names.split()))


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id BIGINT, text STRING")
