from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from webtables.llm import phrases as P

SCHEMA = "doc_id BIGINT, text STRING, lang STRING"
LOWER = {c: c + 32 for c in range(65, 91)}


def by_hand(rows, longest=3, least=10, share=50, top=2_000):
    """Every language's phrases by plain counting."""
    counts: dict[str, Counter] = {}
    for _, text, lang in rows:
        of = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            of.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        inside: dict[tuple, int] = {}
        for p, c in f.items():
            if c >= least:
                for k in range(2, len(p)):
                    for i in range(len(p) - k + 1):
                        inside[p[i : i + k]] = max(c, inside.get(p[i : i + k], 0))
        rows = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and not (p in inside and 100 * inside[p] >= share * a):
                score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        found += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(found)


def rows_of(found):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())


def texts(seed: int, n: int, words: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"W{i}é" if i % 5 == 0 else f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        said = rng.choices(vocabulary, k=rng.randint(0, 80))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", " the of "]) for w in said)
        rows.append((i, text, rng.choice(["en", "en", "fr", None, ""])))
    rows += [(n, None, "en"), (n + 1, "", "fr"), (n + 2, " .,\n\t", "de"), (n + 3, "the of the of " * 20_000, "en"), (0, *rows[0][1:])]
    return rows


@pytest.mark.parametrize(("chunk", "longest", "top"), [(1 << 20, 3, 2_000), (600, 3, 7), (5_000, 4, 2_000)])
def test_against_counting(spark, chunk, longest, top):
    rows = texts(1, 400, 30)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: P.F.lit(1) for c in ("chunk", "words", "ids", "n", "phrase", "tile")})
    assert rows_of(P.collocations(docs.repartition(3), longest, top=top, chunk=chunk)) == by_hand(rows, longest, top=top)


def test_ids_beyond_the_grid(spark):
    rows = texts(2, 900, 15_000)
    assert sum(len(t.split()) for _, t, _ in rows if t) > 20_000
    assert rows_of(P.collocations(spark.createDataFrame(rows, SCHEMA), least=1, top=100_000)) == by_hand(rows, least=1, top=100_000)


def test_tiles_hold_every_pair(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = (np.minimum(rng.zipf(1.2, 60_000) - 1, 40_000).astype(np.int64) for _ in range(2))
    want = Counter(zip(a.tolist(), b.tolist()))
    for least in (1, 1 << 40):  # always by address, never
        monkeypatch.setattr(P, "BY_ADDRESS", least)
        found, blobs = Counter(), {}
        for half in (slice(0, 30_000), slice(30_000, None)):
            for tile, keys, counts in P.tile_counts(a[half], b[half], 3):
                assert (np.diff(keys) > 0).all()
                blobs.setdefault(tile, []).append((P.pack_keys(keys), P.pack(counts)))
        assert {t for t in blobs if t >= P.GRID**2} == {16, 17, 18}
        for tile, own in blobs.items():
            keys, counts = P.summed(tile, iter(own))
            x, y = P.ends(tile, keys)
            found.update(dict(zip(zip(x.tolist(), y.tolist()), counts.tolist())))
        assert found == want


def test_packing():
    for values in ([], [0], [-1, 3, 255], [70_000], [1 << 40, 5]):
        assert P.unpack(P.pack(np.array(values, np.int64))).tolist() == values
    keys = np.array([0, 1, 7, 1 << 50])
    assert P.unpack_keys(P.pack_keys(keys)).tolist() == keys.tolist()


def test_large_counts_are_exact(spark):
    a, l, r = 999_999_999_999_983, 999_999_999_999_989, 999_999_999_999_999
    (row,) = spark.sql(f"SELECT (CAST(1000000 AS DECIMAL(7,0)) * (CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0)))) div (CAST({l} AS DECIMAL(15,0)) * CAST({r} AS DECIMAL(15,0))) AS s").collect()
    assert row["s"] == 1_000_000 * a * a // (l * r)


def test_nothing_to_count(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert P.collocations(spark.createDataFrame([(1, None, None), (2, "x", "en")], SCHEMA)).count() == 0


def test_counting_holds_one_chunk_at_a_time():
    """A worker that counts pairs holds few arrays of one chunk, however many chunks reach it together."""
    rng = np.random.default_rng(4)
    most = P.CHUNK // 4  # words in a chunk, or more
    blobs = [P.pack(np.minimum(rng.zipf(1.3, most) - 1, 60_000).astype(np.int64)) for _ in range(4)]
    batch = pa.RecordBatch.from_pydict({"chunk": list(range(4)), "lang": ["en"] * 4, "ids": blobs, "phrases": blobs})
    tracemalloc.start()
    pairs = sum(sum(P.unpack(c).sum() for c in found.column("counts").to_pylist()) for found in P.counter(2, {"en": 3})(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == 4 * (most - 1)
    assert peak < 64 << 20


def test_chunks_are_small_however_large_the_batch(spark):
    """All rows reach a worker in one batch; no chunk has much more than its size, and no word is lost."""
    rows = [(i, f"w{i} " * 250, "en" if i % 3 else "fr") for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).select("lang", "text").coalesce(1)
    found = docs.mapInArrow(P.chunker(5_000), P.CHUNKS).select("chunk", "lang", "tokens").collect()
    assert Counter({lang: sum(r["tokens"] for r in found if r["lang"] == lang) for lang in ("en", "fr")}) == {"en": 133 * 250, "fr": 67 * 250}
    assert len({r["chunk"] for r in found}) == len(found)
    assert max(r["tokens"] for r in found) <= 2 * 5_000 / 3  # three bytes a word at least


def test_a_worker_holds_one_chunk_of_its_batch(monkeypatch):
    """Making chunks takes arrays of one chunk, not of all texts that reach the worker together."""
    monkeypatch.setattr(P.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    text = " ".join(f"w{i % 5_000}" for i in range(20_000))
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 200, "text": [text] * 200})
    tracemalloc.start()
    said = sum(row.column("tokens")[0].as_py() for row in P.chunker(P.CHUNK)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert said == 200 * 20_000
    assert peak < 64 << 20
