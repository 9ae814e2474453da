"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample, then every row is put into its leaf. A query walks the tree with a priority queue
of nodes by inner product with their centres, so leaves come best first; how many it visits is widened until, on
calibration queries whose neighbours are known by brute force over all rows, the recall wanted is reached.

Rows of leaves are dealt into tiles of bounded size (a large leaf into several, small neighbours together), queries are
sent to the tiles of their leaves, and a tile compares its rows with its queries as matrices. Each tile answers with its
nearest for each query, so what meets again for one query is a short list.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from webtables.llm.common import stored

#: Rows that the tree is fitted on, about (twice as many at most); its branches, and sample rows of a leaf at most.
SAMPLE, BRANCHES, LEAF = 30_000, 16, 100
#: Queries that calibrate the visits, and the recall they must reach (the contract's is 0.9).
CALIBRATION, RECALL = 256, 0.95
#: Rows and queries of a tile, and queries compared at a time.
TILE, QUERIES, AT_ONCE = 16_384, 16_384, 256
#: How much a matrix product may differ from the exact inner product, relative to the vectors' lengths.
SLACK = 1e-9


class Tree:
    """Centres by node, children by node; nodes without children are leaves, numbered in depth-first order."""

    def __init__(self, centres: np.ndarray, children: list[list[int]]):
        self.centres, self.children = centres, children
        self.leaf = np.full(len(children), -1)
        todo, n = [0], 0
        while todo:
            node = todo.pop()
            if children[node]:
                todo += reversed(children[node])
            else:
                self.leaf[node], n = n, n + 1
        self.leaves = n

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: down to the nearest centre at every level."""
        found = np.zeros(len(vectors), np.int32)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if not self.children[node]:
                found[rows] = self.leaf[node]
                continue
            nearest = closest(vectors[rows], self.centres[self.children[node]])
            todo += [(child, rows[nearest == j]) for j, child in enumerate(self.children[node]) if (nearest == j).any()]
        return found

    def leaves_of(self, scores: np.ndarray) -> Iterator[int]:
        """Leaves best bin first, for one query's inner products with all centres."""
        heap = [(-scores[0], 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(heap, (-scores[child], child))
            else:
                yield int(self.leaf[node])

    def visited(self, scores: np.ndarray, visits: int, sizes: np.ndarray, least: int) -> list[int]:
        """The first `visits` leaves, and more until they hold `least` rows."""
        found, rows = [], 0
        for leaf in self.leaves_of(scores):
            if len(found) >= visits and rows >= least:
                break
            found.append(leaf)
            rows += int(sizes[leaf])
        return found


def closest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1) - 2 * (vectors @ centres.T), axis=1)


def k_means(vectors: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = vectors[rng.choice(len(vectors), k, replace=False)]
    for _ in range(rounds):
        nearest = closest(vectors, centres)
        for j in range(k):
            own = vectors[nearest == j]
            centres[j] = own.mean(0) if len(own) else vectors[rng.integers(len(vectors))]
    return closest(vectors, centres), centres


def fit(vectors: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 7) -> Tree:
    """A tree whose leaves hold `leaf` of the different vectors at most, unless k-means can't part them."""
    vectors = np.unique(vectors, axis=0)
    rng = np.random.default_rng(seed)
    centres, children = [vectors.mean(0)], [[]]
    todo = [(0, vectors)]
    while todo:
        node, own = todo.pop()
        if len(own) <= leaf:
            continue
        nearest, found = k_means(own, min(branches, -(-2 * len(own) // leaf)), rng)
        parts = [(j, own[nearest == j]) for j in range(len(found))]
        if max(len(p) for _, p in parts) == len(own):
            continue
        for j, part in parts:
            if len(part):
                children[node].append(len(centres))
                todo.append((len(centres), part))
                centres.append(found[j])
                children.append([])
    return Tree(np.stack(centres), children)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, the same for the same two vectors wherever they stand."""
    return (a.astype(np.longdouble) * b).sum(axis=1).astype(np.float64)


def smallest_ids(ids: np.ndarray, vectors: np.ndarray, leaves: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by id, of equal vectors only those `top` + 1 that can be among a query's nearest."""
    by_id = np.argsort(ids, kind="stable")
    ids, vectors, leaves = ids[by_id], np.ascontiguousarray(vectors[by_id]) + 0.0, leaves[by_id]
    _, same = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    start = np.r_[0, np.cumsum(np.bincount(same))]
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids)) - start[same[order]]
    keep = rank <= top
    return ids[keep], vectors[keep], leaves[keep]


def nearest_in(ids: np.ndarray, vectors: np.ndarray, leaves: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, visits: np.ndarray | None, top: int) -> tuple[np.ndarray, ...]:
    """query_id, vec_id, score, leaf of the `top` nearest rows of each query, among the leaves it visits (`visits`: query x leaf; None: all)."""
    ids, vectors, leaves = smallest_ids(ids, vectors, leaves, top)
    lengths = np.sqrt((vectors * vectors).sum(1)).max(initial=0)
    found = []
    for at in range(0, len(query_ids), AT_ONCE):
        some, own = queries[at : at + AT_ONCE], query_ids[at : at + AT_ONCE]
        scores = some @ vectors.T
        scores[own[:, None] == ids[None, :]] = -np.inf
        if visits is not None:
            scores[~visits[at : at + AT_ONCE][:, leaves]] = -np.inf
        slack = SLACK * lengths * np.sqrt((some * some).sum(1))
        last = np.partition(scores, -top, axis=1)[:, -top] if scores.shape[1] >= top else np.full(len(some), -np.inf)
        q, r = np.nonzero((scores >= (last - slack)[:, None]) & (scores > -np.inf))
        score = exact(some[q], vectors[r])
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < top
        found.append((own[q[keep]], ids[r[keep]], score[keep], leaves[r[keep]]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32))


def usable(embedding: Column) -> Column:
    """Not null, not zero, and no component null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def share(n: int, of: int, salt: str) -> Column:
    """True for about `n` of `of` rows, chosen by a hash of vec_id."""
    return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, n / max(1, of)))


ANSWERS = "query_id long, vec_id long, score double, leaf int"


def answer_batch(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["query_id", "vec_id", "score", "leaf"])


class Index:
    """All rows with their leaves, the tree, how many leaves a query visits, and the recall measured for that."""

    def __init__(self, rows: DataFrame, tree: Tree, sizes: np.ndarray, visits: int, recall: float, width: int, top: int):
        self.rows, self.tree, self.sizes, self.visits, self.recall, self.width, self.top = rows, tree, sizes, visits, recall, width, top

    def tiles(self, tile: int) -> tuple[np.ndarray, np.ndarray]:
        """First tile and number of tiles of each leaf: neighbours share one until it is full, a large leaf has its own."""
        first, parts, at, held = np.zeros(len(self.sizes), np.int64), np.ones(len(self.sizes), np.int64), 0, 0
        for leaf, n in enumerate(self.sizes):
            if held and held + n > tile:
                at, held = at + 1, 0
            first[leaf], parts[leaf] = at, max(1, -(-int(n) // tile))
            at, held = (at + parts[leaf], 0) if n > tile else (at, held + n)
        return first, parts


def calibrated(rows: DataFrame, queries: DataFrame, tree: Tree, width: int, top: int, recall: float, most: int) -> tuple[int, float]:
    """The fewest leaf visits with which `queries` (at most `most`) find the share `recall` of their exact neighbours, and that share."""
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow()
    if not asked.num_rows:
        return tree.leaves, 1.0
    ids, vectors = asked["vec_id"].to_numpy(), matrix(asked["embedding"], width)

    def compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            own = part.column("vec_id").to_numpy(), matrix(part.column("embedding"), width), part.column("leaf").to_numpy()
            yield answer_batch(nearest_in(*own, ids, vectors, None, top))

    near = first_of(rows.select("vec_id", "embedding", "leaf").mapInArrow(compare, ANSWERS), top).toArrow()
    leaf_of: dict[int, list[int]] = {}
    for query, leaf in zip(near["query_id"].to_pylist(), near["leaf"].to_pylist()):
        leaf_of.setdefault(query, []).append(leaf)
    scores = vectors @ tree.centres.T
    needed = np.zeros(tree.leaves, np.int64)  # neighbours by the visit that reaches their leaf
    for query, own in zip(ids.tolist(), scores):
        visit = {leaf: n for n, leaf in enumerate(tree.leaves_of(own))}
        for leaf in leaf_of.get(query, ()):
            needed[visit[leaf]] += 1
    reached = np.cumsum(needed) / max(1, needed.sum())
    visits = 1
    while visits < tree.leaves and reached[visits - 1] < recall:  # widen
        visits += 1
    return visits, float(reached[visits - 1]) if needed.sum() else 1.0


def first_of(answers: DataFrame, top: int) -> DataFrame:
    """The `top` nearest of each query, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def build(vectors: DataFrame, top: int = 20, every: int = 20, recall: float = RECALL, sample: int = SAMPLE, leaf: int = LEAF, calibration: int = CALIBRATION) -> Index | None:
    """An index of all usable rows of `vectors` (vec_id, embedding, more); None if there is none.

    Rows whose vector is null, zero or has a component that is null or not finite take no part, nor do rows without
    vec_id and those of another length than most. Several rows of one vec_id count as one, with the least vector.
    The tree is fitted on about `sample` rows chosen by hash, calibrated with at most `calibration` queries.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stored(rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "neighbour-vectors")
    widths = rows.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return None
    width, total = widths["width"], widths["count"]
    rows = rows.filter(F.size("embedding") == width)
    taught = rows.filter(share(sample, total, "sample")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * sample).select("embedding").toArrow()
    taught = taught if taught.num_rows else rows.orderBy("vec_id").limit(1).select("embedding").toArrow()
    tree = fit(matrix(taught["embedding"], width), leaf=leaf)

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            leaves = pa.array(tree.place(matrix(part.column("embedding"), width)), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("embedding"), leaves], names=["vec_id", "embedding", "leaf"])

    placed = stored(rows.mapInArrow(place, "vec_id long, embedding array<double>, leaf int"), "neighbour-leaves")
    sizes = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # as many rows as the tree has leaves, at most
        sizes[r["leaf"]] = r["count"]
    queries = placed.filter(F.col("vec_id") % every == 0)
    chosen = queries.filter(share(4 * calibration, max(1, total // every), "calibration"))
    visits, reached = calibrated(placed, chosen, tree, width, top, recall, calibration)
    return Index(placed, tree, sizes, visits, reached, width, top)


def search(index: Index, queries: DataFrame, tile: int = TILE, per_tile: int = QUERIES) -> DataFrame:
    """query_id, rank from 1, vec_id, score of the nearest found for `queries` (vec_id, embedding of usable rows).

    Scores are exact; ties go to the smaller vec_id. A query visits as many leaves as calibrated, and more while they
    hold fewer rows than it must return; a row with its own vec_id does not count.
    """
    tree, sizes, visits, width, top = index.tree, index.sizes, index.visits, index.width, index.top
    first, parts = index.tiles(tile)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                scores = matrix(some.column("embedding"), width) @ tree.centres.T
                rows, tiles, leaves = [], [], []
                for i, own in enumerate(scores):
                    by_tile: dict[int, list[int]] = {}
                    for leaf in tree.visited(own, visits, sizes, top + 1):
                        for t in range(first[leaf], first[leaf] + parts[leaf]):
                            by_tile.setdefault(t, []).append(leaf)
                    rows += [i] * len(by_tile)
                    tiles += by_tile
                    leaves += by_tile.values()
                own = some.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int64()), own.column("vec_id"), own.column("embedding"), pa.array(leaves, pa.list_(pa.int32()))], names=["tile", "query_id", "vector", "visits"])

    sent = stored(queries.select("vec_id", "embedding").mapInArrow(walk, "tile long, query_id long, vector array<double>, visits array<int>"), "neighbour-visits")
    parts_of = stored(sent.groupBy("tile").agg(F.ceil(F.count("*") / per_tile).cast("long").alias("blocks")), "neighbour-tiles")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            salt = batch.column("salt").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(first[leaf] + salt % parts[leaf])], names=["vec_id", "embedding", "leaf", "tile"])

    salted = index.rows.select("vec_id", "embedding", "leaf", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31)).alias("salt"))
    dealt = salted.mapInArrow(deal, "vec_id long, embedding array<double>, leaf int, tile long").join(parts_of, "tile")
    rows = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    asked = sent.join(parts_of, "tile").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).drop("blocks")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([answer_batch(nearest_in(np.empty(0, np.int64), np.empty((0, width)), np.empty(0, np.int32), np.empty(0, np.int64), np.empty((0, width)), None, top))])
        leaf = left["leaf"].to_numpy()
        seen = np.zeros((right.num_rows, tree.leaves), bool)
        visits = right["visits"].combine_chunks()
        seen[np.repeat(np.arange(len(visits)), visits.value_lengths().to_numpy()), visits.flatten().to_numpy()] = True
        found = nearest_in(left["vec_id"].to_numpy(), matrix(left["embedding"], width), leaf, right["query_id"].to_numpy(), matrix(right["vector"], width), seen, top)
        return pa.Table.from_batches([answer_batch(found)])

    near = rows.groupBy("tile", "block").cogroup(asked.groupBy("tile", "block")).applyInArrow(compare, ANSWERS)
    return first_of(near, top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, index.rows.filter(F.col("vec_id") % 20 == 0))


#: No SQL: which neighbours are found depends on the tree. Tests compare with brute force.
QUERIES = {"op11_nearest_neighbours": (op11_nearest_neighbours, None)}
