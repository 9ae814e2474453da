"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

A document becomes a short vector of statistics of its characters, words and lines. Random cosines of it approximate
a Gaussian kernel, so that a linear fit on them is a kernel ridge regression. The fit needs only sums of products of
the features, which each partition adds up by itself. Its scores are then made probabilities by isotonic regression
on labelled documents that the fit has not seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from webtables.llm.common import documents, held_out, stored

FEATURES = 300
BANDWIDTH = 4.0
RIDGE = 1e-2
#: Labelled documents that the fit uses at most, about, spread evenly by hash of doc_id, and partitions they are summed in.
SAMPLE, PARTS = 60_000, 16
#: One fold of the labelled documents calibrates.
CALIBRATION = 4
#: Points of the calibration curve at most.
KNOTS = 200

# classes of bytes
LETTER, UPPER, DIGIT, SPACE, LINE, STOP, PIPE, MARK, OTHER, HIGH = range(10)
CLASS = np.full(256, OTHER, np.uint8)
for _kind, _bytes in (
    (LETTER, b"abcdefghijklmnopqrstuvwxyz"), (UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (DIGIT, b"0123456789"), (SPACE, b" \t\r\x0b\x0c"),
    (LINE, b"\n"), (STOP, b".,;:?'\"-()"), (PIPE, b"|<>{}[]/\\=_"), (MARK, b"!#$%&*@^~+`"), (HIGH, bytes(range(128, 256))),
):
    CLASS[list(_bytes)] = _kind
#: Bytes of a piece of text that one count looks at.
PIECE = 1 << 22

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "upper", "digit", "space", "line", "stop", "pipe", "mark", "other", "high", "word_length", "word_spread",
    "long_words", "distinct_words", "top_word", "repeated_lines", "repeated_bytes", "word_entropy", "shouted", "compressed", "marked_ends", "alone",
)


def statistics(text: bytes) -> list[float]:
    """One number for each of STATISTICS; all zero for a text without a word."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(text)
    kinds = np.zeros(10)
    for at in range(0, n, PIECE):
        kinds += np.bincount(CLASS[np.frombuffer(text, np.uint8, min(PIECE, n - at), at)], minlength=10)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    often = np.fromiter(counts.values(), np.float64, len(counts))
    share = often / len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    extra = sum(k - 1 for k in seen.values())
    extra_bytes = sum((k - 1) * len(x) for x, k in seen.items())
    distinct = list(counts)
    shouted = sum(k for w, k in counts.items() if len(w) > 2 and w.isupper()) / len(words)
    marked = sum(k for w, k in counts.items() if w[-1] in b"!#$%&*@^~+") / len(words)
    alone = sum(k for w, k in counts.items() if not w[:1].isalnum() and w[0] < 128 and len(w) < 3) / len(words)
    packed = packed_share(text)
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)),
        *(kinds[[UPPER, DIGIT, SPACE, LINE, STOP, PIPE, MARK, OTHER, HIGH]] / n),
        sizes.mean(), sizes.std(), float((sizes > 12).mean()), len(distinct) / len(words) ** 0.8, share.max(),
        extra / len(lines), extra_bytes / n, float(-(share * np.log(share)).sum()), shouted, packed, marked, alone,
    ]


def packed_share(text: bytes) -> float:
    """Compressed size over size, piece by piece."""
    return sum(len(zlib.compress(text[at : at + PIECE], 1)) for at in range(0, len(text), PIECE)) / len(text)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and `x` (array of double) of every row, from whole texts; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py() or b"") for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


class Model:
    """Scaling, random directions, weights, calibration curve: a few hundred KB."""

    def __init__(self, seed: int, mean: np.ndarray, scale: np.ndarray, base: float):
        pick = np.random.default_rng(seed)
        self.mean, self.scale, self.base = mean, np.maximum(scale, 1e-9), base
        self.directions = pick.normal(size=(len(mean), FEATURES)) / BANDWIDTH
        self.phases = pick.uniform(0, 2 * np.pi, FEATURES)
        self.weights = self.knots = self.levels = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1)


def isotonic(at: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the rising curve nearest to y, by pooling adjacent violators; equal places count as one."""
    places, which = np.unique(at, return_inverse=True)
    weight, total = np.bincount(which).astype(float), np.bincount(which, weights=y)
    blocks: list[list[float]] = []  # weight, sum, first place, last place
    for w, s, p in zip(weight, total, places):
        blocks.append([w, s, p, p])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, _, last = blocks.pop()
            blocks[-1][0] += w2
            blocks[-1][1] += s2
            blocks[-1][3] = last
    knots = np.array([x for b in blocks for x in (b[2], b[3])])
    # a little towards the middle, so that a block of one kind is not certain
    levels = np.array([(b[1] + 0.5 * y.mean()) / (b[0] + 0.5) for b in blocks]).repeat(2)
    levels = np.maximum.accumulate(levels)
    if len(knots) > 2 * KNOTS:
        keep = np.unique(np.linspace(0, len(knots) - 1, 2 * KNOTS).astype(int))
        knots, levels = knots[keep], levels[keep]
    return knots, levels


def sums(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The sums of products of features, and of features with labels; each of PARTS partitions sends one pair."""
    shared, width = rows.sparkSession.sparkContext.broadcast(model), FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, with_y = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                z = shared.value.features(np.stack(batch["x"].to_pylist()))
                products += z.T @ z
                with_y += z.T @ batch["y"].to_numpy()
        yield pa.RecordBatch.from_pydict({"products": [products.tobytes()], "with_y": [with_y.tobytes()]})

    parts = rows.repartition(PARTS).mapInArrow(run, "products binary, with_y binary").collect()
    products = sum(np.frombuffer(p["products"]).reshape(width, width) for p in parts)
    return products, sum(np.frombuffer(p["with_y"]) for p in parts)


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 42) -> Model:
    """A model from statistics `rows` (doc_id, x) and the labelled documents outside the held-out fold.

    Rows of `labels` without doc_id or `quality` don't count; of repeated labels the higher one does. Without labels
    of both kinds, every document scores the share of good ones (0 without any label).
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").cast("double").alias("y"))
    known = known.filter(~held_out("_id"))
    share = sample / max(1, known.count())
    known = known.filter(F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 30)) < share * (1 << 30))
    known = known.withColumn("aside", F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(CALIBRATION)) == 0)
    labelled = stored(rows.join(known, rows["doc_id"] == known["_id"]).select("x", "y", "aside"), "quality-sample")
    teach = labelled.filter(~F.col("aside"))
    of = [F.struct(F.avg(F.get("x", F.lit(i))).alias("m"), F.stddev_pop(F.get("x", F.lit(i))).alias("s")).alias(f"s{i}") for i in range(len(STATISTICS))]
    got = teach.agg(F.count("*").alias("n"), F.avg("y").alias("base"), *of).first()
    if not got["n"] or not 0 < got["base"] < 1:
        return Model(seed, np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), float(got["base"] or 0.0))
    moments = [got[f"s{i}"] for i in range(len(STATISTICS))]
    model = Model(seed, np.array([m["m"] for m in moments]), np.array([m["s"] for m in moments]), float(got["base"]))
    products, with_y = sums(teach, model)
    model.weights = np.linalg.solve(products + RIDGE * np.eye(len(with_y)), with_y)
    aside = labelled.filter("aside").select("x", "y").toPandas()  # a share of the sample
    if not len(aside):
        aside = teach.select("x", "y").limit(sample).toPandas()
    model.knots, model.levels = isotonic(model.raw(np.stack(aside["x"])), aside["y"].to_numpy())
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """`rows` (doc_id, x) with the score, from 0 to 1, instead of x."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.score(np.stack(batch["x"].to_pylist())) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of `docs`; the text is read once, whole, for its statistics.

    Null and empty texts have statistics of zero and the score of these; rows that repeat give rows that repeat.
    """
    rows = stored(with_statistics(docs), "statistics")
    return scored(rows, fit(rows, labels))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


QUERIES = {"op10_quality_classifier": (op10_quality_classifier, None)}
