"""Secret scans: fixed rules, and character Markov models that tell random strings from ordinary identifiers.

The rules label all documents: what they find are random strings, other runs of the same alphabet in the same documents
are ordinary. Two Markov models of characters learn from those. A run of identifier characters that no rule covers is
a secret if its log-likelihood ratio is above a threshold, which is set so that hardly any ordinary run passes it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from webtables.llm.common import documents, stored

# The rules, on UTF-8 bytes (their classes are ASCII).
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "markov")
HEX_ALPHABET = b"0123456789abcdef"
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"

#: Shortest run that the models judge, and shortest that teaches what is ordinary.
RUN, TAUGHT = 16, 6
#: Runs that set a first threshold in the driver at most, the share of runs that may pass, and the least threshold.
CALIBRATION, PASSING, LEAST = 100_000, 1e-4, 10.0
#: Shares of the uniform model in the two models: secrets have other alphabets than what the rules find, and identifiers other
#: signs between their words.
UNIFORM, UNIFORM_ORDINARY = 0.3, 0.1

STATES = len(ALPHABET) + 1  # the last: start of the run
CODE = np.full(256, STATES - 1, np.uint8)
CODE[list(ALPHABET)] = np.arange(len(ALPHABET))
IN_RUN = CODE < STATES - 1
IN_HEX = np.zeros(256, bool)
IN_HEX[list(HEX_ALPHABET)] = True


def runs(inside: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal runs of True of at least that length."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def rule_spans(text: bytes, every: np.ndarray) -> list[tuple[int, int, int]]:
    """start, index of the kind, end of what the rules find, sorted; in bytes."""
    found = []
    if b":" in text or b"=" in text:  # no assignment without either
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(a, 2, b) for a, b in runs(IN_HEX[every], HEX_LEAST)]
    return sorted(found)


def free_runs(every: np.ndarray, taken: list[tuple[int, int, int]], least: int) -> list[tuple[int, int]]:
    """Runs of the alphabet apart from all spans taken."""
    found = runs(IN_RUN[every], least)
    if taken:
        found = [(a, b) for a, b in found if all(b <= start or a >= end for start, _, end in taken)]
    return found


def judged(every: np.ndarray, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The runs that the models judge: long enough and not of digits and signs alone."""
    return [(a, b) for a, b in free_runs(every, taken, RUN) if (CODE[every[a:b]] < 52).any()]


def transitions(run: np.ndarray) -> np.ndarray:
    """Index of each step of a run, from the start state on, in a STATES x STATES table."""
    codes = CODE[run].astype(np.int64)
    return np.concatenate([[STATES - 1], codes[:-1]]) * STATES + codes


class Model:
    """Log-likelihood ratio of each step, and the threshold of their sum."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray, calibration: list[bytes]):
        def chances(counts: np.ndarray, uniform: float) -> np.ndarray:
            counts = counts.reshape(STATES, STATES)[:, :-1] + 0.1
            return (1 - uniform) * counts / counts.sum(axis=1, keepdims=True) + uniform / (STATES - 1)

        ratio = np.zeros((STATES, STATES))
        ratio[:, :-1] = np.log(chances(random, UNIFORM)) - np.log(chances(ordinary, UNIFORM_ORDINARY))
        self.ratio = ratio.ravel()
        known = np.array([self.ratio[transitions(np.frombuffer(t, np.uint8))].sum() for t in calibration] or [0.0])
        self.threshold = max(LEAST, float(np.quantile(known, 1 - PASSING, method="higher")))

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """What the rules find and what the models add, as start, index of the kind, end; sorted, in bytes."""
        every = np.frombuffer(text, np.uint8)
        found = rule_spans(text, every)
        more = [(a, 3, b) for a, b in judged(every, found) if self.ratio[transitions(every[a:b])].sum() > self.threshold]
        return sorted(found + more) if more else found


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    leads = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(leads[a]), kind, int(leads[b])) for a, kind, b in spans]


def taught_by(every: np.ndarray, taken: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that may teach what is ordinary: apart from all spans taken and with a letter."""
    codes = CODE[every]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], codes < STATES - 1, [False]]).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= TAUGHT
    starts, ends = starts[long], ends[long]
    letters = np.concatenate([[0], np.cumsum(codes < 52)])
    good = letters[ends] > letters[starts]
    for start, _, end in taken:
        good &= (ends <= start) | (starts >= end)
    return starts[good], ends[good]


def steps_of(every: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """`transitions` of several runs that lie apart, one after the other."""
    inside = np.zeros(len(every) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    codes = CODE[every[at]].astype(np.int64)
    before = np.concatenate([[STATES - 1], codes[:-1]])
    before[np.searchsorted(at, starts)] = STATES - 1
    return before * STATES + codes


COUNTED = "step int, n long, run binary"


def counted(docs: DataFrame) -> DataFrame:
    """What all documents teach: how often each step occurs (`step`, `n`; those of ordinary runs come after those of
    random ones), and the `run`s that calibrate.

    Every tenth part of the ordinary runs long enough to be judged, by hash, sets the threshold instead of teaching.
    """
    table = STATES * STATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * table, np.int64)
        for batch in batches:
            aside, steps, held = set(), [], 0
            for value in batch["text"]:
                text = value.as_py()
                every = np.frombuffer(text, np.uint8)
                rules = rule_spans(text, every)
                for start, _, end in rules:  # the longest run of the span: the value, not the word before it
                    a, b = max(runs(IN_RUN[every[start:end]], 1), key=lambda x: x[1] - x[0])
                    steps.append(transitions(every[start + a : start + b]))
                starts, ends = taught_by(every, rules)
                tokens = {int(i): text[starts[i] : ends[i]] for i in np.flatnonzero(ends - starts >= RUN)}
                apart = {i: t for i, t in tokens.items() if hashlib.md5(t).digest()[0] % 10 == 0}
                aside.update(apart.values())
                teach = np.ones(len(starts), bool)
                teach[list(apart)] = False
                steps.append(table + steps_of(every, starts[teach], ends[teach]))
                held += len(steps[-1])
                if held >= 1 << 20:
                    counts += np.bincount(np.concatenate(steps), minlength=2 * table)
                    steps, held = [], 0
            if steps:
                counts += np.bincount(np.concatenate(steps), minlength=2 * table)
            if aside:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(aside), pa.int32()), pa.nulls(len(aside), pa.int64()), pa.array(list(aside), pa.binary())], ["step", "n", "run"])
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found]), pa.nulls(len(found), pa.binary())], ["step", "n", "run"])

    texts = docs.select(F.col("text").cast("binary").alias("text")).filter("text IS NOT NULL")
    return stored(texts.mapInArrow(run, COUNTED), "secret-counts")


def fit(docs: DataFrame, counts: DataFrame | None = None) -> Model:
    """A model from the steps in all documents; `counts`: what `counted` found in them.

    Its threshold is set by the calibrating runs, if these are more than CALIBRATION by those with the smallest hashes,
    which fit the driver; `calibrated` sets it by all.
    """
    counts = counted(docs) if counts is None else counts
    table = STATES * STATES
    total = np.zeros(2 * table, np.int64)
    for row in counts.filter("run IS NULL").groupBy("step").agg(F.sum("n").alias("n")).collect():  # 2 x STATES x STATES rows
        total[row["step"]] = row["n"]
    aside = counts.filter("run IS NOT NULL").select("run").distinct().orderBy(F.xxhash64("run"), "run").limit(CALIBRATION).collect()
    return Model(total[:table], total[table:], sorted(bytes(r["run"]) for r in aside))


def calibrated(model: Model, counts: DataFrame) -> Model:
    """`model` with the threshold that all calibrating runs set, however many; the driver learns their number and the threshold."""
    ratio = model.ratio

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [float(ratio[transitions(np.frombuffer(t.as_py(), np.uint8))].sum()) for t in batch["run"]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], ["score"])

    scores = stored(counts.filter("run IS NOT NULL").select("run").distinct().mapInArrow(run, "score double"), "secret-scores")
    n = scores.count()
    if n:
        over = n - 1 - math.ceil((n - 1) * (1 - PASSING))  # runs above the quantile
        model.threshold = max(LEAST, scores.orderBy(F.desc("score")).limit(over + 1).agg(F.min("score")).first()[0])
    return model


def secret_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and `spans` (array of kind, start, end in code points) of every row; null and empty texts have none.

    Rows that repeat give rows that repeat; a text is read whole, however long.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch["text"]]
            found = [[(KINDS[k], a, b) for a, k, b in in_code_points(t, shared.value.spans(t))] for t in texts]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counts = counted(docs)
    rows = secret_spans(docs, calibrated(fit(docs, counts), counts))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return rows.select(
        "doc_id",
        *(F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS),
        F.sha2(joined(of(*KINDS[:3])), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


QUERIES = {"op4_secret_scan": (op4_secret_scan, None)}
