"""The pipeline on a small fixture, stage by stage against plain code, and the registered queries."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from webtables.llm import decontaminate, toxicity
from webtables.llm.queries import QUERIES

from .test_dedup import connected, fingerprint, plain_line_dedup
from .test_models import by_rules

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with toxic ones, shared passages, near copies and leaks; nulls and empty texts among them."""
    pick = random.Random(11)
    words = [f"{a}{b}" for a in ("sto", "riv", "clo", "mead", "wind", "harb", "fie", "gar") for b in ("ne", "er", "ud", "ow", "our", "ld", "den", "ight")]
    sentence = lambda n: " ".join(pick.choice(words) for _ in range(n))
    passage, item = sentence(60), sentence(30)
    rows, labels = [], []
    for i in range(240):
        lines = [sentence(pick.randrange(20, 60)) for _ in range(pick.randrange(1, 5))]
        toxic = i % 6 == 0
        if toxic:
            lines = [x.replace(" ", " grumblewort ", 2) for x in lines]
        if i % 10 == 1:
            lines.insert(pick.randrange(len(lines) + 1), passage)
        if i % 20 == 2:
            lines.append(f"{sentence(4)} {item}")
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    long = sentence(600).split()
    for i in range(240, 246):
        copy = list(long)
        copy[i - 100] = "other"
        rows.append((i, " ".join(copy), "en", "s1", 0))
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, rows[1][1], "en", "s1", 0)]
    rows = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s, _ in rows]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_plain_code(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    now = {r["doc_id"]: r["text"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "simhash near-dedup", "benchmark decontamination", "bpe encoding and decoding"]

    def step(name):
        nonlocal docs
        docs = corpus_pipeline.stored(stages[name](spark, docs, corpus), "test")
        return docs.collect()

    rows = step("toxicity")
    model = toxicity.fit(spark.read.parquet(f"{corpus}/documents.parquet"), toxicity.labels_of(spark, corpus))
    now = {i: t for i, t in now.items() if model.score((t or "").encode()) < 0.5}
    assert {r["doc_id"]: r["text"] for r in rows} == now and docs.columns == columns
    assert sum(i % 6 == 0 and i < 240 for i in now) <= 2 and sum(i % 6 != 0 for i in now) >= 205

    rows = step("line dedup")
    lines = plain_line_dedup(sorted(now.items()), 30)
    now = {i: t for (i, _), (t, n) in lines.items() if n == 0 or t.strip()}
    assert {r["doc_id"]: r["text"] for r in rows} == now and docs.columns == columns
    assert 302 not in now and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)

    rows = step("simhash near-dedup")
    ids = sorted(now)
    first = connected([fingerprint(now[i]) for i in ids], 2)
    now = {i: now[i] for k, i in enumerate(ids) if first[k] == k}
    assert {r["doc_id"]: r["text"] for r in rows} == now and docs.columns == columns

    rows = step("benchmark decontamination")
    item = decontaminate.readings_of(spark.read.parquet(f"{corpus}/benchmark.parquet").first()["text"])
    share = lambda t: max((f[0] for r in decontaminate.readings_of(t or "") for q in item if (f := decontaminate.compare(r, q))), default=0)
    now = {i: t for i, t in now.items() if share(t) < decontaminate.SHARE}
    assert {r["doc_id"]: r["text"] for r in rows} == now and docs.columns == columns

    rows = step("bpe encoding and decoding")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in now.items()}
    whole = corpus_pipeline.run(spark, corpus)
    assert {r["doc_id"]: r["ids"] for r in whole.collect()} == {r["doc_id"]: r["ids"] for r in rows}


def test_stages_on_empty_tables(spark, tmp_path):
    for name, schema in (("documents", DOCUMENTS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_on_odd_rows(spark, odd_docs, tmp_path):
    """Null ids and texts, a repeated row, ties, a long text, columns with names of helpers: every stage keeps what is clean."""
    item = "one two three four five six seven eight nine ten eleven"
    spark.createDataFrame([(1, 1, 0), (7, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = spark.createDataFrame([(20, f"Words before. {item} and words behind."), (21, "quite another text"), (21, "quite another text")], "doc_id BIGINT, text STRING")
    names = "gone ids decoded toxicity n_lines n_removed _doc _hash fp c0 x".split()
    docs = odd_docs.unionByName(more).select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit(n).alias(n) for n in names))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "odd")
        if name != "bpe encoding and decoding":
            assert docs.columns == columns and all(docs.filter(F.col(n) != n).count() == 0 for n in names)
        ids = [r["doc_id"] for r in docs.collect()]
        assert {1, 6, 7, 21} <= set(ids) and ids.count(21) == 2  # a repeated row is one document
        assert (20 in ids) == (name in ("toxicity", "line dedup", "simhash near-dedup"))
    assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]


def write_documents(spark, path, rows):
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS).write.parquet(f"{path}/documents.parquet")


def test_registered_columns_of_near_duplicates(spark, tmp_path):
    pick = random.Random(5)
    base = [" ".join(pick.choice("abcdefghijkl") * pick.randrange(1, 4) for _ in range(300)) for _ in range(5)]
    rows = [(i, t) for i, t in enumerate([*base, *(t.replace(" a ", " b ", 1) for t in base), None, "", *base[:2]])]
    write_documents(spark, tmp_path, rows)
    found = QUERIES["op1_simhash_near_dedup"][0](spark, str(tmp_path)).collect()
    fps = [fingerprint(t) for _, t in rows]
    first = connected(fps, 2)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == [(i, f"{fps[i]:016x}", first[i]) for i, _ in rows]


def test_registered_columns_of_secrets(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    kinds = ("assign", "access", "hex")
    for r in QUERIES["op4_secret_scan"][0](spark, folder).collect():
        base = [(a, k, b) for a, k, b in by_rules(texts[r["doc_id"]])]
        said = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in base)
        assert [r[f"n_{kind}"] for kind in kinds] == [sum(k == n for _, k, _ in base) for n in range(3)]
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert [x for x in spans if x[0] in kinds] == [x.split(":") for x in said.split(",") if x]
        assert all(int(a) < int(b) <= len(texts[r["doc_id"]]) for _, a, b in spans) and spans == sorted(spans, key=lambda x: (int(x[1]), (*kinds, "markov").index(x[0])))


def test_registered_columns_of_files_and_lines(spark, tmp_path):
    run = "\n".join(f"a line of the passage with number {i}" for i in range(12))
    rows = [(3, f"own three\n{run}"), (1, f"own one\n{run}\nend"), (2, None), (9, "plain")]
    write_documents(spark, tmp_path, rows)
    found = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in QUERIES["op8_line_dedup"][0](spark, str(tmp_path)).collect()}
    assert found == {1: (rows[1][1], 14, 0), 2: (None, 0, 0), 3: ("own three", 13, 12), 9: ("plain", 1, 0)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    at, want = 0, []
    for i, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += len(ids)
    got = QUERIES["op7_token_files"][0](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *QUERIES} <= names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_queries_with_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    found = QUERIES[name][0](spark, folder)
    columns = sorted(found.columns)
    connection = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    connection.execute(QUERIES[name][1])
    names = [d[0] for d in connection.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in connection.fetchall()), key=repr)
    assert sorted(names) == columns and sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == want


def test_sizes_and_laws(spark):
    found = QUERIES["op2_sharding"][0](spark, "/root/testdata/sf0.001")
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = found.collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(i, len(t) + 8, zlib.crc32(t)) for i, t in docs.items()}
    sizes = [r["n"] for r in found.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) <= 1 and {r["law"] for r in rows} == {"rows"}
