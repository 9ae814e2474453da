"""Exact dedup, SimHash near-dedup and line dedup against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from webtables.llm import exact_dedup, line_dedup, simhash
from webtables.llm.common import packed

from .conftest import ODD


def same(x):
    return re.sub(r"[\x20\x09-\x0D]+", " ", x or "")


# exact


@pytest.mark.parametrize("salts", [1, 3])
def test_exact_groups(spark, docs_of, salts):
    pick = random.Random(4)
    texts = [None, "", "a b", "a  b", "a\tb", "c"] + ["hot text"] * 5 + [f"text {i}" for i in range(20)]
    rows = [(i, pick.choice(texts)) for i in range(400)]
    found = exact_dedup.exact_groups(docs_of(*rows), salts=salts).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[same(t)].append(i)
    assert len(found) == len(rows)
    for r in found:
        ids = groups[same(r["text"])]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(ids), len(ids), r["doc_id"] == min(ids))
        assert bytes(r["digest"]) == hashlib.sha256(same(r["text"]).encode()).digest()


def test_exact_compares_texts_not_digests(docs_of):
    rows = [(i, f"{'ab'[i % 2]} text {i % 7}") for i in range(60)]
    weak = lambda text: F.substring(text, 1, 1)
    found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs_of(*rows), digest=weak).collect()}
    sizes, first = Counter(t for _, t in rows), {}
    for i, t in rows:
        first.setdefault(t, i)
    assert found == {i: (first[t], sizes[t]) for i, t in rows}


def test_exact_odd_rows(odd_docs, clashing, no_docs):
    found = [(r["doc_id"], r["text"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(odd_docs).collect()]
    assert len(found) == len(ODD)
    assert sorted(x[0] for x in found if x[1] == ODD[6][1]) == [5, 5]
    assert {x[2:] for x in found if same(x[1]) == same(ODD[0][1])} == {(0, 4, True), (0, 4, False)}
    assert {x[2:] for x in found if same(x[1]) == ""} == {(1, 3, True), (1, 3, False)}
    kept = exact_dedup.exact_dedup(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3, 6, 7, 8]
    assert exact_dedup.exact_groups(no_docs).count() == 0


# near


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def connected(values, budget):
    """value -> smallest index of its component."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= budget:
                a_, b_ = find(i), find(j)
                root[max(a_, b_)] = min(a_, b_)
    return [find(i) for i in range(len(values))]


def test_fingerprints(odd_docs, docs_of):
    for r in simhash.fingerprints(odd_docs).collect():
        assert r["doc_id"] is None or r["fp"] in {signed(fingerprint(t)) for i, t in ODD if i == r["doc_id"]}
    pick = random.Random(1)
    texts = [" ".join(pick.choice(["A", "bb", "Çc", "d d", "e"]) for _ in range(pick.randrange(9))) for _ in range(60)]
    assert [r["fp"] for r in simhash.fingerprints(docs_of(*texts)).orderBy("doc_id").collect()] == [signed(fingerprint(t)) for t in texts]


def test_counts_in_chunks(monkeypatch):
    text = " ".join(str(i) for i in range(500)).encode()
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text, 3) == whole == fingerprint(text.decode())


def near_values(n, seed):
    pick = random.Random(seed)
    values = {pick.getrandbits(64) for _ in range(n)}
    for v in list(values)[: n // 2]:
        for _ in range(4):  # a dense ball, chains, and values just too far away
            for _ in range(pick.randrange(1, 4)):
                v ^= 1 << pick.randrange(64)
            values.add(v)
    return sorted(values | {0, 1, 3, 7, 1 << 63, (1 << 64) - 1})


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_walk_finds_every_pair(budget):
    values = near_values(120, budget)
    array = np.array(values, np.uint64)
    found = {(min(a, b), max(a, b)) for x, y in simhash.walk(array, simhash.whole(len(array)), 0, budget) for a, b in zip(x.tolist(), y.tolist())}
    assert found == {(i, j) for j in range(len(values)) for i in range(j) if (values[i] ^ values[j]).bit_count() <= budget}


def test_walk_in_small_frontiers(monkeypatch):
    array = np.array(near_values(100, 9), np.uint64)
    every = {tuple(p) for x, y in simhash.walk(array, simhash.whole(len(array)), 0, 2) for p in zip(x.tolist(), y.tolist())}
    monkeypatch.setattr(simhash, "FRONTIER", 5)
    assert {tuple(p) for x, y in simhash.walk(array, simhash.whole(len(array)), 0, 2) for p in zip(x.tolist(), y.tolist())} == every


@pytest.mark.parametrize("cell", [1000, 20, 2])
def test_links_connect_all(spark, cell):
    values = near_values(100, 5)
    edges = simhash.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), 2, cell).collect()
    at = {signed(v): i for i, v in enumerate(values)}
    assert all((r["a"] ^ r["b"]).bit_count() for r in edges)
    want = connected(values, 2)
    groups = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {at[r["node"]]: at[r["root"]] for r in groups}
    of = lambda i: root.get(i, i)
    assert {frozenset(i for i in range(len(values)) if of(i) == k) for k in map(of, range(len(values)))} == {
        frozenset(i for i in range(len(values)) if want[i] == k) for k in set(want)
    }


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}


def test_tables_of_rounds_have_few_files(spark):
    """However many partitions shuffles have, a loop's small table is a file for every core, not one for each partition."""
    cores = spark.sparkContext.defaultParallelism
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 3 * cores)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.range(2_000).selectExpr("id div 2 * 2 AS a", "id div 2 * 2 + id % 2 AS b")
        roots = simhash.components(edges, 1_000)
        assert len(roots.inputFiles()) <= cores
        assert {(r["node"], r["root"]) for r in roots.collect()} == {(i + 1, i) for i in range(0, 2_000, 2)}
        assert len(packed(spark.range(0, 9, 1, 3 * cores), 9, "few").inputFiles()) <= cores
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_groups(docs_of):
    pick = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [[pick.choice(words) for _ in range(400)] for _ in range(6)]
    texts = [None, "", "  "]
    for b in base:
        for k in range(6):
            changed = list(b)
            if k:
                changed[pick.randrange(400)] = "x"
            texts.append(" ".join(changed))
    pick.shuffle(texts)
    fps = [fingerprint(t) for t in texts]
    want = connected(fps, 2)
    found = simhash.simhash_groups(docs_of(*texts)).orderBy("doc_id").collect()
    assert [r["component_id"] for r in found] == want
    assert [r["fp"] & (1 << 64) - 1 for r in found] == fps
    kept = simhash.simhash_dedup(docs_of(*texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want))


def test_near_odd_rows(odd_docs, clashing, no_docs):
    found = simhash.simhash_groups(odd_docs).collect()
    assert len(found) == len(ODD)
    assert {r["component_id"] for r in found if r["fp"] == 0} == {1}
    assert {r["component_id"] for r in found if r["doc_id"] in (0, 5, 8)} == {0}
    kept = simhash.simhash_dedup(clashing)
    assert kept.columns == clashing.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 6, 7]
    assert simhash.simhash_groups(no_docs).count() == 0


# lines


def plain_line_dedup(rows, words):
    """Every line that lies in any run of `words` words or more of which any copy begins earlier."""
    docs = list(dict.fromkeys(rows))
    lines = {}
    for i, t in docs:
        kept = [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate((t or "").split("\n"))]
        lines[i, t] = [(k, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in kept if x]
    seen, gone = set(), defaultdict(set)
    for d in sorted(lines, key=lambda d: (-(1 << 63) if d[0] is None else d[0])):
        own = lines[d]
        for low in range(len(own)):
            total, content, fresh = 0, (), []
            for high in range(low, len(own)):
                total, content = total + own[high][2], hash((content, own[high][1]))
                if total >= words:
                    if content in seen:
                        gone[d] |= {own[k][0] for k in range(low, high + 1)}
                    fresh.append(content)
            seen.update(fresh)
    return {d: (None if d[1] is None else "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in gone[d]), len(gone[d])) for d in lines}


def test_lines_against_plain(docs_of):
    pick = random.Random(8)
    passages = [[" ".join(f"p{p}l{k}w{w}" for w in range(pick.randrange(1, 9))) for k in range(5)] for p in range(4)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(pick.randrange(1, 5)):
            if pick.random() < 0.5:
                a = pick.randrange(4)
                parts += pick.choice(passages)[a : a + pick.randrange(1, 5)]
            else:
                parts += [" ".join(f"own{i}_{pick.randrange(99)}" for _ in range(pick.randrange(1, 12))), pick.choice(["", "short line", "  "])]
        rows.append((i, "\n".join(parts)))
    for words in (1, 4, 10):
        want = plain_line_dedup(rows, words)
        found = line_dedup.line_dedup(docs_of(*rows), words).collect()
        assert {(r["doc_id"], r["text"], r["n_removed"]) for r in found} == {(d[0], t, n) for d, (t, n) in want.items()}


def test_long_runs_over_many_pieces(docs_of):
    lines = [f"line {i} of the passage" for i in range(200)]
    rows = [(0, "\n".join(lines)), (1, "\n".join(["before it", *lines[20:190], "after it"]))]
    found = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs_of(*rows), 10).collect()}
    assert found == {0: rows[0][1], 1: "before it\nafter it"}


def test_runs_grow_along_a_first_copy_however_far(docs_of):
    lines = [f"line {i} of the passage" for i in range(200)]
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(0, "\n".join([*lines[100:], long, "other end"])), (1, "\n".join([*lines, long, "tail"])), (2, "\n".join([*lines, long, "tail", "own"]))]
    want = plain_line_dedup(rows, 10)
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.line_dedup(docs_of(*rows), 10).collect()}
    assert found == {d[0]: w for d, w in want.items()} and found[2] == ("own", 202)


def test_a_run_may_go_on_along_another_copy(docs_of):
    long, l2, l3 = (" ".join(f"{x}{i}" for i in range(n)) for x, n in (("a", 40), ("b", 10), ("c", 10)))
    rows = [(1, f"{long}\nsomething else"), (2, f"own two\n{long}\n{l2}\n{l3}"), (3, f"own three\n{long}\n{l2}\n{l3}\nown end")]
    found = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs_of(*rows)).collect()}
    assert found == {1: rows[0][1], 2: f"own two\n{l2}\n{l3}", 3: "own three\nown end"}


def test_random_runs_of_few_lines(docs_of):
    pick = random.Random(4)
    rows = [(i, "\n".join(pick.choice(["a", "b b", "c c c", "d", ""]) for _ in range(pick.randrange(14)))) for i in range(150)]
    for words in (3, 6):
        want = plain_line_dedup(rows, words)
        found = line_dedup.line_dedup(docs_of(*rows), words).collect()
        assert {(r["doc_id"], r["text"], r["n_removed"]) for r in found} == {(d[0], t, n) for d, (t, n) in want.items()}


def test_many_equal_lines(spark, docs_of):
    """20,000 lines of one document: jobs and rows do not depend on how often they repeat."""
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (50, 20_000):
        spark.sparkContext.setJobGroup(f"equal-{n}", "equal lines")
        (row,) = line_dedup.line_dedup(docs_of("\n".join(["the same line again"] * n))).collect()
        assert (row["text"], row["n_lines"], row["n_removed"]) == ("the same line again", n, n - 1)
        jobs.append(len(tracker.getJobIdsForGroup(f"equal-{n}")))
    assert abs(jobs[0] - jobs[1]) <= 2


def test_lines_odd_rows(odd_docs, clashing, no_docs):
    want = plain_line_dedup(ODD, 5)
    found = line_dedup.line_dedup(odd_docs, 5).collect()
    assert len(found) == len(ODD)
    texts = Counter((r["doc_id"], r["text"]) for r in found)
    assert texts == Counter((i, want[i, t][0]) for i, t in ODD)
    wide = line_dedup.line_dedup(clashing, 5)
    assert wide.columns == [*clashing.columns, "_n_lines", "_n_removed"]
    assert {r["gone"] for r in wide.collect()} == {"gone"}
    assert line_dedup.line_dedup(no_docs).count() == 0


def test_lines_made_from_runs_are_not_broadcast(docs_of, monkeypatch):
    """Their size is that of the stored runs to Spark, however many lines each run makes."""
    plans = {}

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    stored = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", noted)
    passage = "\n".join(f"the same line {i}" for i in range(12))
    found = line_dedup.line_dedup(docs_of(*(f"begin {i}\n{passage}\nend {i}" for i in range(4)))).collect()
    assert sorted(r["n_removed"] for r in found) == [0, 12, 12, 12]
    first_join = lambda name: re.search(r"\w+Join", plans[name])[0]
    assert first_join("run-tails") == first_join("repeated-lines") == "SortMergeJoin"
