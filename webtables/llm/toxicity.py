"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text; and one on windows of toxic text, put in front
of the same ordinary content. A window of text that compresses shorter with the second than with the first holds
something that the toxic text taught: words, rare ones too, or phrases of ordinary words. Sharing the ordinary content
keeps the difference near zero elsewhere. The toxic dictionary learns from the windows that toxic documents share: those
of one half of the documents that gain bytes by a dictionary trained on the other half.

A list of telling words stands beside it, found by compression too. A dictionary trained on toxic documents gains bytes
in some of their windows; the word that accounts for a window's gain is a candidate, and is taken if it is far more
frequent in toxic documents than in others. So is the beginning of a candidate, where toxic words are many that each
are rare but begin alike. Toxic documents that still gain nothing train the next dictionary, until
nothing new is found. The list is added to the trained dictionary, and is also a dictionary by itself.

A document's score is a logistic function of how many windows gain how much with the first, and how much
with the list alone, fitted on labelled documents that trained no dictionary, so that thresholds
are calibrated.
"""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from webtables.llm.common import documents, free_name, held_out, lean, widened
from webtables.llm.units import slices

#: Words of a window when scoring, and when training, where a small window tells which word it was.
WINDOW, NARROW = 8, 3
LEVEL = 6  # the lowest that indexes every position of a dictionary
DEPTH = 6  # 2 ** this many places are tried for a match; with the level's own 8, frequent words hide the toxic part
ORDINARY_BYTES, TOXIC_BYTES = 96 << 10, 32 << 10
#: Bounds of the training sample: documents of each kind, and the longest text that is taken as an example.
TOXIC_SAMPLE, PLAIN_SAMPLE, LONGEST = 2_400, 5_000, 50_000
#: Windows from which a dictionary is trained, at most.
EXAMPLES = 30_000
#: A word is telling if it is in this share of toxic documents, and this many times more frequent there than elsewhere.
LEAST_SHARE, TIMES = 0.012, 10
ROUNDS = 5
#: Bytes of a word's beginning that may be telling by itself.
STEM = range(4, 13)
GAINS = (2, 3, 4, 5)  # bytes
#: Bytes that a window of one half gains by the other half's dictionary, from which on it trains the toxic one.
SHARED = 3
#: One fold of the labelled documents calibrates, the others train dictionaries.
CALIBRATION = 4


#: Behind each window: zstandard looks for no match that begins in the last eight bytes.
TAIL = b" " * 10


def windows(text: bytes, words: int, step: int | None = None, at: Sequence[int] | None = None) -> list[bytes]:
    """Each window, or those at some places, with a space in front and TAIL behind; ASCII letters in lower case."""
    every = text.lower().split()
    step = step or words
    return [b" " + b" ".join(every[i * step : i * step + words]) + TAIL for i in (range(-(-len(every) // step)) if at is None else at)]


class Windows(Sequence):
    """All windows of some texts in a row, made when they are asked for: together they take several times the texts' room."""

    def __init__(self, texts: list[bytes], words: int, step: int):
        self.texts, self.words, self.step = texts, words, step
        self.upto = np.cumsum([-(-len(t.split()) // step) for t in texts])

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def __getitem__(self, i):
        return self.at([i])[0]

    def at(self, places: Sequence[int]) -> list[bytes]:
        """The windows at some places, in that order; the words of a text are split once."""
        found: list[bytes] = [b""] * len(places)
        by_text = defaultdict(list)
        for k, (i, text) in enumerate(zip(places, np.searchsorted(self.upto, places, side="right").tolist())):
            by_text[text].append((k, i - (int(self.upto[text - 1]) if text else 0)))
        for text, own in by_text.items():
            for (k, _), part in zip(own, windows(self.texts[text], self.words, self.step, [i for _, i in own])):
                found[k] = part
        return found


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    plain = zstandard.ZstdCompressionParameters.from_level(LEVEL, search_log=DEPTH, write_content_size=0, write_checksum=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=plain)


def lengths(by: zstandard.ZstdCompressor, parts: list[bytes]) -> np.ndarray:
    return np.fromiter((len(by.compress(p)) for p in parts), np.int64, len(parts))


def dictionary(size: int, parts: list[bytes] | Windows, pick: random.Random) -> bytes:
    """Content of a zstandard dictionary trained on windows; all of the windows where they are too few to train on."""
    chosen = pick.sample(range(len(parts)), min(len(parts), EXAMPLES))
    some = [p.rstrip(b" ") + b" " for p in (parts.at(chosen) if isinstance(parts, Windows) else [parts[i] for i in chosen])]
    try:
        return zstandard.train_dictionary(size, some).as_bytes()
    except zstandard.ZstdError:
        return b"".join(some)[-size:]


class Model:
    """The dictionaries and the weights; a few hundred KB whatever the corpus.

    `toxic` is trained on toxic text and has the telling `words` too.
    """

    def __init__(self, ordinary: bytes, toxic: bytes, words: bytes, weights: np.ndarray | None, base: float):
        self.ordinary, self.toxic, self.words, self.weights, self.base = ordinary, toxic, words, weights, base
        self.by = None

    def __getstate__(self):
        return self.__dict__ | {"by": None}

    def both_gains(self, text: bytes, words: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that each window is shorter with the toxic dictionary, and with the telling words alone."""
        if self.by is None:
            self.by = tuple(compressor(more + self.ordinary) for more in (b"", self.toxic, self.words))
        parts = windows(text, words)
        ordinary, toxic, telling = (lengths(by, parts) for by in self.by)
        return ordinary - toxic, ordinary - telling

    def gains(self, text: bytes, words: int = WINDOW) -> np.ndarray:
        """Bytes that each window is shorter with the toxic dictionary."""
        return self.both_gains(text, words)[0]

    def features(self, text: bytes) -> list[float]:
        both = self.both_gains(text)
        n = len(both[0])
        if n == 0:
            return [0.0] * (2 + 2 * (len(GAINS) + 3))
        row = [1.0, np.log1p(float(n))]
        for found in both:
            counts = [float((found >= g).sum()) for g in GAINS]
            row += [max(float(min(found.max(), 20)), 0.0), *np.log1p(counts), counts[1] / n, float(found.mean())]
        return row

    def score(self, text: bytes) -> float:
        """Between 0 and 1; a text without words gets the score of one in which nothing gains."""
        if self.weights is None:
            return self.base
        x = np.array(self.features(text))
        x[0] = 1.0
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first column, all ones, isn't shrunk."""
    scale = x.std(axis=0)
    scale[scale < 1e-9] = 1.0  # the ones, and what is the same in all rows
    z, w = x / scale, np.zeros(x.shape[1])
    shrink = ridge * len(y) / 100 * np.eye(len(w))
    shrink[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + shrink, z.T @ (y - p) - shrink @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def beginnings(word: bytes) -> list[bytes]:
    """The beginnings of a word, shortest first, without cut characters."""
    return [word[:n] for n in STEM if n < len(word) and word[n] & 0xC0 != 0x80]


def telling_words(toxic: list[bytes], plain: list[bytes], ordinary: bytes, pick: random.Random) -> list[bytes]:
    """Words, and beginnings of words, that account for what a toxic dictionary gains and that ordinary documents hardly have, rarest first."""
    by_ordinary = compressor(ordinary)
    parts = [windows(t, NARROW, NARROW - 1) for t in toxic]
    base = [lengths(by_ordinary, p) for p in parts]
    # texts are split again in each round: the words of all of them as objects take ten times the texts' room
    in_toxic, in_plain = (Counter(w for t in texts for w in Counter(t.lower().split())) for texts in (toxic, plain))
    least = max(3, LEAST_SHARE * len(toxic))
    telling = lambda w: in_toxic[w] >= least and in_toxic[w] * len(plain) >= TIMES * (in_plain[w] + 0.5) * len(toxic)

    def stem(word: bytes) -> bytes:
        """The longest telling beginning that nearly as many toxic documents have as the shortest one."""
        every = [s for s in beginnings(word) if telling(s)]
        return [s for s in every if in_toxic[s] >= 0.8 * in_toxic[every[0]]][-1]

    chosen: set[bytes] = set()
    tried: set[bytes] = set()
    left = list(range(len(toxic)))
    for _ in range(ROUNDS):
        pool = [p for i in left for p in parts[i]]
        if len(pool) < 10:
            break
        taught = compressor(dictionary(TOXIC_BYTES, pool, pick) + ordinary)
        found: set[bytes] = set()
        for i in left:
            for part, gain in zip(parts[i], base[i] - lengths(taught, parts[i])):
                if gain < 2:
                    continue
                words = part.split()
                without = [b" " + b" ".join([*words[:k], *words[k + 1 :]]) + TAIL for k in range(len(words))]
                rest = lengths(by_ordinary, without) - lengths(taught, without)
                if gain > rest.min():
                    found.add(words[int(rest.argmin())])
        stems = {s for w in found for s in beginnings(w)} - tried - in_toxic.keys() - in_plain.keys()
        tried |= stems
        for counts, texts in zip((in_toxic, in_plain), (toxic, plain)):  # documents that have two words with such a beginning: one may be chance
            for text in texts if stems else ():
                begun = Counter(s for w, n in Counter(text.lower().split()).items() for s in beginnings(w) if s in stems for _ in range(n))
                counts.update(s for s, n in begun.items() if n > 1)
        new = {w for w in found if telling(w)}
        new |= {stem(w) for w in found - new if any(map(telling, beginnings(w)))}
        new -= chosen
        if not new:
            break
        chosen |= new
        gaining = compressor(b" " + b" ".join(sorted(chosen)) + b" " + ordinary)
        left = [i for i in left if not len(parts[i]) or (base[i] - lengths(gaining, parts[i])).max() < 3]
    return sorted(chosen, key=lambda w: (in_toxic[w], w))


def shared_windows(toxic: list[bytes], ordinary: bytes, pick: random.Random) -> list[bytes]:
    """Windows of toxic documents that gain by what other toxic documents taught; all windows where those are too few."""
    halves = [[p for t in toxic[k::2] for p in windows(t, WINDOW, WINDOW // 2)] for k in (0, 1)]
    by_ordinary, found = compressor(ordinary), []
    for parts, others in (halves, halves[::-1]):
        taught = compressor(dictionary(TOXIC_BYTES, others, pick) + ordinary)
        gain = lengths(by_ordinary, parts) - lengths(taught, parts)
        found += [p for p, g in zip(parts, gain) if g >= SHARED]
    return found if len(found) >= 10 else halves[0] + halves[1]


def train(rows: list[tuple[bytes, int, bool]], seed: int = 42) -> Model:
    """From texts, whether they are toxic, and whether they calibrate rather than teach."""
    base = float(np.mean([y for _, y, _ in rows])) if rows else 0.0
    pick = random.Random(seed)
    teach = {y: sorted({t for t, label, aside in rows if label == y and not aside}) for y in (0, 1)}
    if len(teach[0]) < 2 or len(teach[1]) < 2:
        return Model(b"", b"", b"", None, base)
    ordinary = dictionary(ORDINARY_BYTES, Windows(teach[0], NARROW, NARROW - 1), pick)
    words = b" " + b" ".join(telling_words(teach[1], teach[0], ordinary, pick)) + b" "
    toxic = dictionary(TOXIC_BYTES, shared_windows(teach[1], ordinary, pick), pick)
    model = Model(ordinary, toxic + words, words, None, base)
    aside = [(t, y) for t, y, a in rows if a] or [(t, y) for t, y, _ in rows]
    y = np.array([label for _, label in aside], float)
    if 0 < y.sum() < len(y):
        x = np.array([model.features(t) for t, _ in aside])
        x[:, 0] = 1.0
        model.weights = logistic(x, y)
    return model


def fit(docs: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, plain_sample: int = PLAIN_SAMPLE) -> Model:
    """A model from a bounded sample of the labelled documents outside the held-out fold, spread evenly by hash of doc_id.

    Rows of `labels` without doc_id or `toxic` don't count; of repeated labels the toxic one does.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    known = known.filter(~held_out("_id")).withColumn("_at", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)).cache()
    many = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    sample = None
    for label, most in ((1, toxic_sample), (0, plain_sample)):
        part = known.filter(F.col("_toxic") == label).filter(F.col("_at") < most / max(1, many.get(label, 0)))
        sample = part if sample is None else sample.unionByName(part)
    aside = (F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(CALIBRATION)) == 0).alias("aside")
    chosen = F.broadcast(sample.select("_id", "_toxic", aside))  # about the sample's bound: ids chosen evenly by hash
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("text")).filter(F.length("text") <= LONGEST).join(chosen, "_id")
    found = sorted((bytes(r["text"]), int(r["_toxic"]), bool(r["aside"])) for r in rows.select("text", "_toxic", "aside").collect())
    known.unpersist()
    return train(found)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with `toxicity` (0 to 1) more, from whole texts, however long; null counts as empty.

    Rows that repeat get the same score. A column of that name is kept.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), free_name(docs, "toxicity")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in slices(whole, at)):
            found = [shared.value.score((t.as_py() or "").encode()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(lean(run), widened(docs, name, "double"))


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = scored(docs, fit(docs, labels_of(spark, sf_dir)))
    return rows.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op3_toxicity": (op3_toxicity, None)}
