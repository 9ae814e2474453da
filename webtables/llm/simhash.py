"""SimHash near-deduplication: fingerprints, a self-join over binary tries, and the groups that links make.

The join walks pairs of trie nodes together, adds up the bits in which they differ, and leaves a pair as soon as the
budget is spent. Two fingerprints that differ in k bits agree in one of k + 1 blocks, so the walk runs in k + 1 tries,
each with another block of bits first: their roots are the nodes of that block, reached with nothing spent, and each
root's subtree is one cell of work that gets the fingerprints below it. A cell with many fingerprints is split further
down the trie: into its pairs of child nodes within the budget, again and again, until all cells are small. Small
cells are walked side by side, in batches of bounded size.

Only distinct fingerprints take part, however many documents have one, and a cell answers with one link per
fingerprint (a spanning forest of the links it found), so that neither copies nor dense groups make pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from webtables.llm.common import documents, lean, packed, stored
from webtables.llm.units import slices

BITS = 64
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16
#: Fingerprints of a cell above which it is split further down the trie.
CELL = 20_000
#: Bits by which a split goes down.
STEP = 6
#: Node pairs of a walk that are held at a time.
FRONTIER = 1 << 18


# fingerprints


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()  # on bytes: A-Z, and white space 09-0D and 20
    if not words:
        return 0
    if len(words) <= shingle:
        starts, ends, joined = [0], [None], b" ".join(words)
    else:
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        after = np.cumsum(sizes)
        starts = (after - sizes)[: len(words) - shingle + 1].tolist()
        ends = (after - 1)[shingle - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), CHUNK):
        part = [digest(joined[a:b], 42) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])]
        bits = np.unpackbits(np.array(part, dtype=">u8").view(np.uint8)).reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(counts * 2 > len(starts))
    return int.from_bytes(set_bits.tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; a text without words, or null, has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in slices(whole, "text")):
            made = np.array([fingerprint(t or b"", shingle) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(made)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, fp long")


# the join


def rotated(fp: np.ndarray, by: int) -> np.ndarray:
    return fp if by == 0 else (fp << np.uint64(by)) | (fp >> np.uint64(BITS - by))


def blocks(budget: int) -> list[tuple[int, int]]:
    """First bit and width of the budget + 1 blocks."""
    cuts = [BITS * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def walk(values: np.ndarray, pairs: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of values that differ in `budget` bits at most, below the pairs of nodes given.

    A node is a range of `values`, sorted in itself, whose values share their first `depth` bits. A row of `pairs` is
    two nodes (the same twice, or apart), each as first and last + 1, and in how many bits they differ so far. Pairs go
    down a bit at a time, the deepest first.
    """
    stack = [(depth, pairs)]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > FRONTIER:
            half = len(pairs) // 2
            stack += [(depth, pairs[:half]), (depth, pairs[half:])]
            continue
        sole = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        if sole.any():  # two leaves: the rest of the bits at once
            a, b, e = pairs[sole, 0], pairs[sole, 2], pairs[sole, 4]
            rest = (values[a] ^ values[b]) & np.uint64((1 << (BITS - depth)) - 1)
            near = (np.bitwise_count(rest) + e <= budget) & (a != b)
            if near.any():
                yield a[near], b[near]
            pairs = pairs[~sole]
        if depth == BITS or not len(pairs):
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - depth)
        a0, a2, b0, b2, e = pairs.T
        a1, b1 = middle(values, a0, a2, bit), middle(values, b0, b2, bit)
        twin = a0 == b0  # a node with itself: its two children make one pair, not two
        down = [(a0, a1, b0, b1, e), (a1, a2, b1, b2, e), (a0, a1, b1, b2, e + 1), (np.where(twin, a2, a1), a2, b0, b1, e + 1)]
        below = np.concatenate([np.stack(x, axis=1) for x in down])
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3]) & (below[:, 4] <= budget)]
        stack.append((depth + 1, below))


def middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where, in each sorted range of values that agree above `bit`, the first one with that bit is; a binary search in all at once."""
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        at = (low[open_] + high[open_]) // 2
        has = (values[at] & bit) != 0
        high[open_] = np.where(has, at, high[open_])
        low[open_] = np.where(has, low[open_], at + 1)
    return low


def whole(n: int) -> np.ndarray:
    """The root of n values, paired with itself."""
    return np.array([[0, n, 0, n, 0]], np.int64)


def cell_pairs(cells: pd.DataFrame) -> np.ndarray:
    """The pairs of nodes that cells are, in rows sorted by cell, side and value."""
    low, high, side = (cells[c].to_numpy() for c in ("low", "high", "side"))
    new = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (side[1:] != side[:-1])]))
    end = np.concatenate([new[1:], [len(cells)]])
    twin = low[new] == high[new]
    first = np.flatnonzero(twin | (side[new] == 0))
    other = np.where(twin[first], first, first + 1)  # the side with 1 follows; `links` leaves out cells without it
    return np.stack([new[first], end[first], new[other], end[other], cells["spent"].to_numpy()[new[first]]], axis=1)


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the smallest one that the pairs connect it to."""
    root = np.arange(n)
    for a, b in pairs:
        while len(a):
            a, b = root[a], root[b]
            apart = a != b
            a, b = a[apart], b[apart]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def links(fps: DataFrame, budget: int, cell: int = CELL) -> DataFrame:
    """Links a, b (signed longs, a <> b) between distinct fingerprints `fp`; they connect whatever differs in `budget` bits."""
    at = blocks(budget)
    width = min(w for _, w in at)
    turned = F.array(*(F.struct(F.lit(i).alias("trie"), (F.shiftleft("fp", a).bitwiseOR(F.shiftrightunsigned("fp", BITS - a)) if a else F.col("fp")).alias("v")) for i, (a, _) in enumerate(at)))
    rows = fps.select(F.inline(turned))
    head = lambda column, d: F.shiftrightunsigned(column, BITS - d)
    # a cell: two nodes of one trie, low and high, `spent` bits apart; side 0 holds the values below low
    cells = rows.select("trie", F.lit(width).alias("depth"), head("v", width).alias("low"), head("v", width).alias("high"), F.lit(0).alias("spent"), F.lit(0).alias("side"), "v")
    key, ready, depth, among = ["trie", "depth", "low", "high", "spent"], [], width, len(at) * fps.count()
    while True:
        sizes = cells.groupBy(*key).agg(F.count("*").alias("_n"), F.min("side").alias("_one"), F.max("side").alias("_two"))
        paired = F.when(F.col("low") == F.col("high"), F.col("_n") > 1).otherwise(F.col("_one") < F.col("_two"))
        sizes = packed(sizes.filter(paired).select(*key, "_n"), among, "cell-sizes")  # of cells that hold a pair at all
        last = depth + STEP >= BITS
        small = sizes if last else sizes.filter(F.col("_n") <= cell)
        ready.append((cells.join(small, key, "left_semi"), small.agg(F.sum("_n")).first()[0] or 0))
        large = sizes.filter(F.col("_n") > cell).select(*key)
        if last or large.isEmpty():
            break
        flips = [sum(1 << i for i in c) for k in range(budget + 1) for c in combinations(range(STEP), k)]
        depth += STEP
        child = head("v", depth)
        flip = F.explode(F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(m.bit_count()).alias("bits")) for m in flips)))
        parts = cells.join(large, key).withColumn("_flip", flip).filter(F.col("spent") + F.col("_flip.bits") <= budget)
        own = child
        tail = F.lit((1 << STEP) - 1).cast("long")
        other = F.shiftleft(F.when(F.col("side") == 0, F.col("high")).otherwise(F.col("low")), STEP).bitwiseOR(own.bitwiseAND(tail).bitwiseXOR(F.col("_flip.m")))
        twin = F.col("low") == F.col("high")  # both nodes the same: the smaller child is the low one
        first = F.when(twin, own <= other).otherwise(F.col("side") == 0)
        parts = parts.select(
            "trie", F.lit(depth).alias("depth"), F.when(first, own).otherwise(other).alias("low"), F.when(first, other).otherwise(own).alias("high"),
            (F.col("spent") + F.col("_flip.bits")).alias("spent"), F.when(first, 0).otherwise(1).alias("side"), "v",
        )
        cells = stored(parts, "trie-cells")
        among = cells.count()
    shifts = [a for a, _ in at]

    def join(group: pd.DataFrame) -> pd.DataFrame:
        """All cells of one trie and depth that fell into a batch."""
        group = group.assign(v=group.v.to_numpy().view(np.uint64)).sort_values(["low", "high", "side", "v"], ignore_index=True)
        values = group.v.to_numpy()
        root = forest(len(values), walk(values, cell_pairs(group), int(group.depth[0]), budget))
        every = rotated(values, (BITS - shifts[group.trie[0]]) % BITS)
        linked = root != np.arange(len(root))
        return pd.DataFrame({"a": every[root[linked]].view(np.int64), "b": every[linked].view(np.int64)})

    found = None
    for part, rows_in in ready:
        batches = -(-rows_in // cell)
        part = part.withColumn("batch", F.pmod(F.xxhash64("low", "high"), F.lit(max(1, batches))))
        made = part.groupBy("trie", "depth", "batch").applyInPandas(join, "a long, b long")
        found = made if found is None else found.unionByName(made)
    return found


# groups


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, root (its smallest connected node) for every node of the links a, b; alternating large and small stars.

    `most`: how many links there are about, at most, if known. A round has as many as the one before, or fewer.
    """
    before = None
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "links") if most is None else packed(edges, most, "links")
    most = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b")))
        edges = packed(small.filter("a <> b").distinct(), most, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def simhash_groups(docs: DataFrame, shingle: int = 3, budget: int = 2, cell: int = CELL) -> DataFrame:
    """doc_id, fp and component_id of every row: documents whose fingerprints are linked, directly or over others.

    component_id is the smallest doc_id of the component, null if none of it has one. Texts without a word, null ones
    included, all have fingerprint 0 and are linked like any other. Rows that repeat give rows that repeat.
    """
    return grouped(stored(fingerprints(docs, shingle), "fingerprints"), budget, cell)


def grouped(rows: DataFrame, budget: int, cell: int = CELL) -> DataFrame:
    """`simhash_groups` of stored fingerprints."""
    distinct = packed(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), rows.count(), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), budget, cell), (budget + 1) * distinct.count()).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.select("fp", "root").join(smallest, "root").drop("root")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, shingle: int = 3, budget: int = 2) -> DataFrame:
    """The rows of `docs` that stay, one document of each component: the one with the smallest doc_id.

    Rows that repeat that doc_id all stay; so do the rows without doc_id of a component that has none.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    keep = packed(grouped(rows, budget).filter("doc_id <=> component_id").select("doc_id").distinct(), rows.count(), "kept-ids")
    return docs.join(keep.hint("merge"), docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")  # one plan at every size


def hexadecimal(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir)).select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash_near_dedup": (op1_simhash_near_dedup, None)}
