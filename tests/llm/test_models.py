"""Toxicity, quality and secrets: held-out results, and each part against plain code."""

from __future__ import annotations

import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from webtables.llm import quality, secrets, toxicity
from webtables.llm.queries import QUERIES

from .conftest import ODD

SF = "/root/testdata/sf0.1"


def held_out_rows(spark, name, label):
    rows = QUERIES[name][0](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = rows.join(labels, "doc_id").filter("held_out").select("score", "predicted", label).toPandas()
    assert rows.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert rows.filter(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 5 == 0)).count() == 0
    return found


def auc(score, y):
    ranks = score.rank()
    ones = (y == 1).sum()
    return (ranks[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_toxicity_on_held_out_documents(spark):
    found = held_out_rows(spark, "op3_toxicity", "toxic")
    assert auc(found.score, found.toxic) > 0.92
    assert found[found.toxic == 0].predicted.mean() < 0.02 and found[found.toxic == 1].predicted.mean() > 0.72


def test_toxic_words_that_begin_alike():
    """Each toxic word is rare, and their common beginning occurs in ordinary text once in a while."""
    pick = random.Random(8)
    parts = ["ra", "mo", "ti", "len", "sar", "bu", "kel", "dan", "wi", "por"]
    word = lambda: "".join(pick.choice(parts) for _ in range(pick.randrange(1, 4)))
    plain = [" ".join(word() for _ in range(80)) + (" zugurt" + word() if pick.random() < 0.05 else "") for _ in range(400)]
    toxic = [" ".join("zugurt" + word() if pick.random() < 0.1 else word() for _ in range(80)) + " zugurtra zugurtmo" for _ in range(300)]
    rows = [(t.encode(), y, i % 4 == 0) for y, texts in ((0, plain), (1, toxic)) for i, t in enumerate(texts)]
    model = toxicity.train(rows)
    assert any(w.startswith(b"zugur") and len(w) < 9 for w in model.words.split())
    fresh = [(" ".join("zugurt" + word() if i % 9 == 4 else word() for i in range(80)).encode(), 1) for _ in range(40)] + [(" ".join(word() for _ in range(80)).encode(), 0) for _ in range(40)]
    assert np.mean([(model.score(t) >= 0.5) == bool(y) for t, y in fresh]) > 0.8


def test_toxicity_training_makes_windows_when_they_are_needed():
    """The windows of all texts as objects at once take many times the texts' room, and stay with the driver's Python."""
    pick = random.Random(4)
    rows = [(" ".join(f"w{pick.randrange(30_000)}" for _ in range(400)).encode(), int(i % 10 == 0), i % 4 == 0) for i in range(400)]
    tracemalloc.start()
    toxicity.train(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(len(t) for t, _, _ in rows)


def test_windows_of_several_texts():
    texts = [b"", b"A b c d e", b"one two", b" \n", b"x y z w v u t"]
    every = [w for t in texts for w in toxicity.windows(t, 3, 2)]
    row = toxicity.Windows(texts, 3, 2)
    assert list(row) == every and row.at([3, 0, 6]) == [every[3], every[0], every[6]] and len(toxicity.Windows([], 3, 2)) == 0


def test_quality_on_held_out_documents(spark):
    found = held_out_rows(spark, "op10_quality_classifier", "quality")
    assert auc(found.score, found.quality) > 0.98
    assert found[found.quality == 1].predicted.mean() > 0.99 and found[found.quality == 0].predicted.mean() < 0.1


def labels(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("rows", [[], [(1, 1, 0)], [(None, None, None), (1, None, None)], [(i, i % 2, i % 2) for i in range(9)]])
def test_odd_rows_and_few_labels(spark, odd_docs, clashing, no_docs, rows):
    known = labels(spark, *rows)
    model = toxicity.fit(odd_docs, known)
    found = toxicity.scored(clashing, model)
    assert found.columns == [*clashing.columns, "_toxicity"] and found.count() == len(ODD)
    assert found.filter("_toxicity < 0 OR _toxicity > 1 OR _toxicity IS NULL").count() == 0
    scores = quality.quality_scores(clashing, known).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.scored(no_docs, toxicity.fit(no_docs, known)).count() == 0
    assert quality.quality_scores(no_docs, known).count() == 0


def test_scores_do_not_depend_on_ids(spark):
    pick = random.Random(3)
    plain = [" ".join(pick.choice(["stone", "river", "cloud", "meadow", "window", "harbour"]) + pick.choice(["s", "ed", "ing", ""]) for _ in range(60)) for _ in range(200)]
    texts = [t if i % 4 else t.replace(" ", " grumblewort ", 3) for i, t in enumerate(plain)]
    rows = [(t.encode(), int("grumblewort" in t), i % 8 < 4) for i, t in enumerate(texts)]
    model = toxicity.train(rows)
    assert b"grumblewort" in model.toxic
    right = [(model.score(t) >= 0.5) == bool(y) for t, y, _ in rows]
    assert np.mean(right) > 0.97
    assert toxicity.train(list(rows)).score(rows[0][0]) == model.score(rows[0][0])


def test_whole_texts_count(spark):
    rows = [(("quiet words here " * 20).encode(), 0, i % 2 == 0) for i in range(40)]
    rows = [(t + str(i).encode(), 0, a) for i, (t, _, a) in enumerate(rows)] + [((f"quiet grumblewort words {i} " * 10).encode(), 1, i % 2 == 0) for i in range(40)]
    model = toxicity.train(rows)
    long = b"quiet words here " * 20_000
    assert max(model.gains(long + b"grumblewort")) > max(model.gains(long))


def test_phrases_of_ordinary_words_are_toxic_too():
    pick = random.Random(3)
    word = lambda: pick.choice(["stone", "river", "cloud", "meadow", "window", "harbour"]) + pick.choice(["s", "ed", "ing", ""])
    phrases = [" ".join(word() for _ in range(12)) for _ in range(2)]
    rows = []
    for i in range(1200):
        parts = [word() for _ in range(100)]
        for _ in range(4 * (i % 2)):
            parts.insert(pick.randrange(len(parts)), pick.choice(phrases))
        rows.append((" ".join(" ".join(parts).split()[:100]).encode(), i % 2, i % 8 < 2))
    model = toxicity.train(rows[:800])
    right = [(model.score(t) >= 0.5) == bool(y) for t, y, _ in rows[800:]]
    assert not model.words.split()  # no single word tells
    assert np.mean(right) > 0.8


def test_isotonic():
    pick = np.random.default_rng(2)
    at = pick.integers(0, 40, 300).astype(float)
    y = (pick.random(300) < at / 40).astype(float)
    knots, levels = quality.isotonic(at, y)
    assert (np.diff(levels) >= 0).all() and (np.diff(knots) >= 0).all()
    assert abs(np.interp(at, knots, levels).mean() - y.mean()) < 0.02
    knots, levels = quality.isotonic(np.array([1.0, 1.0, 2.0]), np.array([1.0, 0.0, 1.0]))
    assert levels[0] == levels[1] < levels[-1]


def test_sums_are_those_of_all_rows(spark):
    pick = np.random.default_rng(4)
    x, y = pick.normal(size=(50, len(quality.STATISTICS))), pick.integers(0, 2, 50).astype(float)
    model = quality.Model(1, x.mean(axis=0), x.std(axis=0), 0.5)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double")
    products, with_y = quality.sums(rows, model)
    z = model.features(x)
    assert np.allclose(products, z.T @ z) and np.allclose(with_y, z.T @ y)


def test_statistics_of_pieces(monkeypatch):
    text = "Some words, ABC 123.\nSome words, ABC 123.\n| # x\n".encode() * 50
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "PIECE", 100)
    names = quality.STATISTICS
    assert [a for a, n in zip(quality.statistics(text), names) if n != "compressed"] == [a for a, n in zip(whole, names) if n != "compressed"]
    assert quality.statistics(b"") == quality.statistics(b" \n") == [0.0] * len(names)


# secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def by_rules(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


PIECES = ["password", "PassWd", " = ", ":", "'", '"', "token", "secret=", "api_key", "apikey: ", "AKIA", "ABCD1234ABCD1234", "abcdef0123456789", "x", "é", " ", "short", "longer-value.1", "\n", "日", "ſecret=abcdefgh"]


def test_rules():
    pick = random.Random(5)
    for _ in range(3000):
        text = "".join(pick.choice(PIECES) for _ in range(pick.randrange(14)))
        data = text.encode()
        assert secrets.in_code_points(data, secrets.rule_spans(data, np.frombuffer(data, np.uint8))) == by_rules(text), text


def random_strings(n, seed=1):
    pick = random.Random(seed)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    return ["".join(pick.choice(letters) for _ in range(pick.randrange(24, 40))) for _ in range(n)]


def test_models_find_what_no_rule_does(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = secrets.fit(docs)
    hits = [model.spans(f"see {s} here".encode()) for s in random_strings(200)]
    assert np.mean([h == [(4, 3, 4 + len(s))] for h, s in zip(hits, random_strings(200))]) > 0.95
    clean = ["unquestionablyinterconnected", "this_is_a_long_identifier_name", "HttpServletRequestWrapper", "1234567890123456", "onthtionwhonattionnd", "word " * 30]
    assert [model.spans(c.encode()) for c in clean] == [[]] * len(clean)


def test_runs_that_set_the_threshold_are_chosen_by_hash(spark, docs_of, monkeypatch):
    pick = random.Random(8)
    run = lambda: "".join(pick.choice("abcdefghijklmnop_") for _ in range(30))
    docs = docs_of(*(" ".join(run() for _ in range(20)) for _ in range(60)))
    monkeypatch.setattr(secrets, "Model", lambda random, ordinary, calibration: calibration)
    every = secrets.fit(docs)
    monkeypatch.setattr(secrets, "CALIBRATION", 20)
    hashed = spark.createDataFrame([(r,) for r in every], "run binary").orderBy(F.xxhash64("run")).limit(20).collect()
    assert len(every) > 60 and secrets.fit(docs) == sorted(bytes(r["run"]) for r in hashed)


def test_secret_models_learn_from_all_documents(spark, docs_of, monkeypatch):
    """Counts are those of plain code over every document, and all calibrating runs set the threshold."""
    pick = random.Random(9)
    run = lambda: "".join(pick.choice("abcdefghijklmnop_") for _ in range(pick.randrange(4, 40)))
    texts = ["", "é", *(" ".join([run() for _ in range(15)] + ["token=" + run() + "x" * 6, "12345678"]) for _ in range(300))]
    want, aside = np.zeros((2, secrets.STATES**2), int), set()
    for text in map(str.encode, texts):
        every = np.frombuffer(text, np.uint8)
        rules = secrets.rule_spans(text, every)
        for start, _, end in rules:
            a, b = max(secrets.runs(secrets.IN_RUN[every[start:end]], 1), key=lambda x: x[1] - x[0])
            np.add.at(want[0], secrets.transitions(every[start + a : start + b]), 1)
        for a, b in secrets.free_runs(every, rules, secrets.TAUGHT):
            if (secrets.CODE[every[a:b]] >= 52).all():
                continue
            if b - a >= secrets.RUN and hashlib.md5(text[a:b]).digest()[0] % 10 == 0:
                aside.add(text[a:b])
            else:
                np.add.at(want[1], secrets.transitions(every[a:b]), 1)
    for name, value in (("SAMPLE", 20), ("CALIBRATION", 20), ("PASSING", 0.1), ("LEAST", -1000.0)):
        monkeypatch.setattr(secrets, name, value, raising=False)
    docs = docs_of(*texts, None)
    whole = secrets.Model(*want, sorted(aside))
    assert len(aside) > 100 and np.array_equal(secrets.fit(docs).ratio, whole.ratio)
    counts = secrets.counted(docs)
    assert secrets.calibrated(secrets.fit(docs, counts), counts).threshold == whole.threshold
    assert secrets.fit(docs, counts).threshold != whole.threshold


def test_secrets_odd_rows(spark, odd_docs, clashing, no_docs):
    more = odd_docs.unionByName(spark.createDataFrame([(20, "é key: token = abcdef12 " + "0f" * 12)], "doc_id long, text string"))
    found = {(r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"])) for r in secrets.secret_spans(more, secrets.fit(more)).collect()}
    assert (20, (("assign", 7, 23), ("hex", 24, 48))) in found and all(s == () for i, s in found if i != 20)
    assert secrets.secret_spans(clashing, secrets.fit(clashing)).count() == len(ODD)
    assert secrets.secret_spans(no_docs, secrets.fit(no_docs)).count() == 0
