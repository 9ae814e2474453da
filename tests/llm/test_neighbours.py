from __future__ import annotations

import math
import random

import numpy as np
import pytest

from webtables.llm import neighbours as N

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"


def vectors_of(n: int, width: int = 6, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.25, 0.5, 2.0]) for _ in range(width)], 0) for i in range(n)]
    return rows + [(n + i, [1.0] * width, 0) for i in range(n // 2)]  # a third of the rows are one vector


def by_hand(rows: list[tuple], top: int, every: int) -> list[tuple]:
    found = []
    for q, v, _ in rows:
        if q % every == 0:
            near = sorted((-math.fsum(a * b for a, b in zip(v, w)), i) for i, w, _ in rows if i != q)
            found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near[:top])]
    return found


def answers(index, every: int, **sizes) -> list[tuple]:
    found = N.search(index, index.rows.filter(N.F.col("vec_id") % every == 0), **sizes)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect())


@pytest.mark.parametrize("sizes", [{}, {"tile": 40, "per_tile": 7}])
def test_all_leaves_give_brute_force(spark, sizes):
    rows = vectors_of(400)
    odd = [
        (1_000, None, 0), (1_020, [0.0] * 6, 0), (1_040, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (1_060, [float("nan")] * 6, 0),
        (1_080, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], 0), (None, [9.0] * 6, 0), (1_100, [9.0] * 5, 0), (1_120, [], 0), rows[20], rows[21],
    ]
    table = spark.createDataFrame(rows + odd, SCHEMA).withColumns({c: N.F.lit(1) for c in ("leaf", "tile", "score", "rank", "query_id", "block")})
    index = N.build(table, top=5, recall=1.1, sample=200, leaf=10)
    assert index.visits == index.tree.leaves > 5
    assert answers(index, 20, **sizes) == sorted(by_hand(rows, 5, 20))


def test_fewer_candidates_than_wanted(spark):
    rows = vectors_of(8)
    index = N.build(spark.createDataFrame(rows, SCHEMA), top=20, every=3, recall=0.0, leaf=2)
    assert answers(index, 3) == sorted(by_hand(rows, 20, 3))
    assert N.build(spark.createDataFrame([], SCHEMA)) is None
    alone = N.build(spark.createDataFrame([(0, [1.0], 0)], SCHEMA))
    assert answers(alone, 20) == []


def test_best_bin_first_visits_every_leaf_once():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(3_000, 8))
    tree = N.fit(points, branches=4, leaf=50)
    scores = points[0] @ tree.centres.T
    order = list(tree.leaves_of(scores))
    assert sorted(order) == list(range(tree.leaves))
    sizes = np.bincount(tree.place(points), minlength=tree.leaves)
    assert sizes.sum() == 3_000 and (sizes > 0).all()
    assert len(tree.visited(scores, 2, sizes, 0)) == 2
    assert sizes[tree.visited(scores, 1, sizes, 500)].sum() >= 500


def test_recall_of_the_query(spark):
    where = "/root/testdata/sf0.1"
    found = N.op11_nearest_neighbours(spark, where).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{where}/embeddings.parquet").collect()]
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    at = {i: n for n, i in enumerate(ids)}
    got: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["score"] == pytest.approx(vectors[at[r["query_id"]]] @ vectors[at[r["vec_id"]]], abs=1e-12)
    hits = 0
    for q in ids[ids % 20 == 0]:
        scores = vectors @ vectors[at[q]]
        scores[at[q]] = -np.inf
        assert got[q] == sorted(got[q]) and len(got[q]) == 20
        hits += len({v for _, v in got[q]} & set(ids[np.lexsort((ids, -scores))[:20]]))
    assert hits / (20 * len(got)) >= 0.9
