from __future__ import annotations

import pickle
import random
import tracemalloc

import numpy as np
import pytest

from webtables.llm import decontaminate as D

from .conftest import ODD

QUESTION = "If Tom has 12 apples and his friend Anna gives him 7 more apples while Peter eats 3 of the apples that Tom had, how many apples does Tom have in 5 days?"


def test_template():
    text = "Tom has 12 apples and Anna gave him 3.5 kg of pears. Then Tom ate $5,000 worth."
    assert D.template(text) == [
        ("tom", None), ("has", None), ("<number>", "12"), ("apples", None), ("and", None), ("<name>", "anna"), ("gave", None), ("him", None),
        ("<number>", "3.5"), ("<unit>", "kg"), ("of", None), ("pears", None), ("then", None), ("<name>", "tom"), ("ate", None), ("<number>", "$5000"), ("worth", None),
    ]


def test_hashes_stand_for_windows():
    pick, names = random.Random(1), {}
    words = ["Tom", "five", "12", "kg", "word", "end.", "|", "...", "Karl!", "%", "m", "und"]
    every = ["", "  ", ". .", "Foo", *(t or "" for _, t in ODD), *(" ".join(pick.choice(words) for _ in range(pick.randrange(14))) for _ in range(400))]
    for text in every:
        template = [w for w, _ in D.template(text)]
        size = min(D.WINDOW, len(template))
        windows = [tuple(template[i : i + size]) for i in range(len(template) - size + 1)] if template else []
        hashes = D.window_hashes(text).tolist()
        assert len(hashes) == len(windows)
        for w, h in zip(windows, hashes):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def best(text, item, share=D.SHARE):
    """The best place by any reading."""
    every = [f for t in D.readings_of(text) for q in D.readings_of(item) if (f := D.compare(t, q, share))]
    return max(every, key=lambda f: f[0], default=None)


def found(text):
    return best(text, QUESTION)


def test_slots_must_fit():
    renamed = QUESTION.replace("Tom", "Olga").replace("12", "99").replace("Anna", "Bill").replace("7", "8")
    share, first, end, changed = found("Some words before. " + renamed + " And more")
    assert share == 1.0 and changed and (first, end) == (3, 36) and found(QUESTION) == (1.0, 0, 33, False)
    mixed = QUESTION.replace("how many apples does Tom", "how many apples does Karl").replace("that Tom had", "that Zoe had")
    assert found(mixed)[0] < D.SHARE
    assert found("Quite another text about apples.") is None


@pytest.mark.parametrize("case", [str.lower, str.upper, str.title])
def test_copies_in_another_case(spark, docs_of, case):
    text = "some words before. " + case(QUESTION)
    assert found(text)[0] == 1.0
    rows = D.leaks(docs_of(text, "quite another text"), spark.createDataFrame([(1, QUESTION)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["share"]) for r in rows] == [(0, 1.0)]


def test_short_items_wherever_they_stand(spark, docs_of):
    items = [(1, "What is the capital of France?"), (2, "Who wrote the novel War and Peace?"), (3, "Anna has 5 apples that Anna ate"), (4, "Which of the\nRivers of Peru is longest")]
    texts = [before + text for _, text in items for before in ("Trivia night\n", "Trivia night, ", "and so ")]
    changed = ["Trivia night\nWhat is the capital of Spain?", "one, What is the capital of Spain?", "then Olga has 7 apples that Olga ate", "Which of the Rivers of Chad is longest"]
    others = ["Trivia night\nwhat was a town of France?", "And Paris is the capital of France"]
    rows = D.leaks(docs_of(*texts, *changed, *others), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {(i, 1 + i // 3) for i in range(12)} | {(12, 1), (13, 1), (14, 3), (15, 4)}
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and all(r["share"] == 1.0 for r in rows)


def test_hashes_stand_for_windows_of_lines():
    pick, names = random.Random(2), {}
    words = ["Tom", "12", "kg", "word", "end.", "...", "|", "Karl!", "\n", "\n", "\u2028"]
    for text in (" ".join(pick.choice(words) for _ in range(pick.randrange(14))) for _ in range(400)):
        template = [w for w, _ in D.template(text)]
        size = min(D.WINDOW, len(template))
        windows = [tuple(template[i : i + size]) for i in range(len(template) - size + 1)] if template else []
        hashes = D.window_hashes(text).tolist()
        assert len(hashes) == len(windows) and all(names.setdefault(w, h) == h for w, h in zip(windows, hashes))


def test_smaller_shares(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(20))  # 16 windows
    text = item.replace("w19", "x").replace("w18", "x").replace("w0 ", "y ").replace("w1 ", "y ").replace("w2 ", "y ")  # 11 of them
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["share"] for r in D.leaks(docs_of(text), items, 0.6).collect()] == [11 / 16]
    assert D.leaks(docs_of(text), items).count() == 0


def test_leaks_against_all_pairs(docs_of, spark):
    pick = random.Random(6)
    item = lambda k: " ".join(pick.choice([f"w{k}_{j}" for j in range(6)] + ["Ann", "7", "km"]) for _ in range(pick.choice([3, 8, 30])))
    items = [(k, item(k)) for k in range(12)] + [(20, "w1 w2"), (21, None), (22, ""), (23, "w1 w2")]
    texts = []
    for i in range(80):
        text = [f"own{i}_{pick.randrange(50)}" for _ in range(pick.randrange(40))]
        if i % 3 == 0:
            inside = items[pick.randrange(12)][1].split()
            for _ in range(pick.randrange(3)):
                inside[pick.randrange(len(inside))] = "changed"
            at = pick.randrange(len(text) + 1)
            text[at:at] = inside
        texts.append(" ".join(text))
    texts += ["w1 w2", "W1, w2!", "w1 w2 w3"]
    want = set()
    for i, t in enumerate(texts):
        for k, q in items:
            c = best(t, q or "")
            if c and c[0] >= D.SHARE:
                want.add((i, k, c[1], c[2]))
    rows = D.leaks(docs_of(*texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["first_word"], r["end_word"]) for r in rows} == want and len(rows) == len(want)
    assert {(80, 20), (81, 20), (80, 23), (81, 23)} <= {w[:2] for w in want} and want


@pytest.mark.parametrize("benchmark", [[(1, "one two three four five six seven")], [(1, None)], []])
def test_odd_rows(spark, odd_docs, clashing, no_docs, benchmark):
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    kept = D.decontaminate(clashing, items)
    assert kept.columns == clashing.columns
    leaking = {0, 5, 8, None} if benchmark and benchmark[0][1] else set()
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, _ in ODD if i is not None and i not in leaking)
    assert ids.count(None) == (1 if leaking else 2)  # the row with neither id nor text stays
    assert D.decontaminate(no_docs, items).count() == 0


WORDS = ["Tom", "five", "12", "kg", "word", "end.", "|", "...", "Karl!", "%", "m", "und", "É", "日本", "\n", " ", "\x85", "\xa0", "\x1c", "　", "\r\n", "\t"]


def test_many_texts_are_read_as_each_alone():
    pick = random.Random(4)
    texts = ["", "\n", " ", *("".join(pick.choice(WORDS) + pick.choice([" ", " ", "", "\n"]) for _ in range(pick.randrange(30))) for _ in range(300))]
    alone = [{int(x) for _, h in D.Coded([t]).windows() for x in h} for t in texts]
    together = [set() for _ in texts]
    for of, h in D.Coded(texts).windows():
        for i, x in zip(of.tolist(), h.tolist()):
            together[i].add(x)
    assert together == alone
    for t in texts:
        for wrapped, (codes, begins) in ((False, next(iter(D.Coded([t]).readings()))), (True, list(D.Coded([t]).readings())[2])):
            words, starts = D.read(t, wrapped)
            assert [D.word_code(w) & ~15 if w[0] != "<" else D.word_code(w) for w, _ in words] == codes.tolist() and starts == begins.tolist(), t


def test_memory_of_chunks_is_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(D, "KINDS", D.Kinds())
    monkeypatch.setattr(D, "REMEMBERED", 20_000)
    for i in range(40):
        D.Coded([" ".join(f"w{i}x{j}" for j in range(60)), "日本" * 500 + str(i)])
    assert D.KINDS.held <= 20_000 and D.KINDS.held == sum(len(c) + D.OVERHEAD for c in D.KINDS) and max(map(len, D.KINDS)) <= D.LONG


def test_short_items_must_be_sentences(spark, docs_of):
    items = [(1, "Kappa lambda mu?"), (2, "Red means stop"), (3, "Yes.")]
    yes = ["He said nothing. Kappa lambda mu? And so on", "a heading\nred means stop\nand more", "Kappa lambda mu?", "yes", "one. KAPPA LAMBDA MU"]
    no = ["the kappa lambda mu is", "where red means stop and go", "He said it. Yes. And went", "Kappa lambda"]
    rows = D.leaks(docs_of(*yes, *no), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(0, 1), (1, 2), (2, 1), (3, 3), (4, 1)}


def test_a_document_with_the_whole_benchmark(spark, docs_of):
    """300 items in one document: several rows of candidates, and a comparison costs the item, not the document."""
    pick = random.Random(9)
    items = [(k, " ".join(pick.choice(["of", "the"]) if j % 5 == 0 else f"w{k}x{j}" for j in range(40))) for k in range(300)]
    text = "\n".join(t for _, t in items)
    steps = [0]
    places = D.Reading.places

    def counted(self, window, code=None):
        found = places(self, window, code)
        steps[0] += 1 + len(found)
        return found

    D.Reading.places = counted
    try:
        whole = D.readings_of(text)
        assert all(any(f and f[0] == 1.0 for f in (D.compare(t, q) for t in whole for q in D.readings_of(i))) for _, i in items[:50])
    finally:
        D.Reading.places = places
    assert steps[0] < 50 * 40 * 8
    rows = D.leaks(docs_of(text, "other words"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(0, k) for k in range(300)] and {r["share"] for r in rows} == {1.0}


CHANGES = {
    "as it is": lambda t, pick: t,
    "lower case": lambda t, pick: t.lower(),
    "upper case": lambda t, pick: t.upper(),
    "in mid-line": lambda t, pick: f"so {t} it goes",
    "after a heading": lambda t, pick: f"Question 1\n{t}",
    "wrapped": lambda t, pick: "\n".join(" ".join(t.split()[i : i + 7]) for i in range(0, len(t.split()), 7)),
    "other numbers": lambda t, pick: " ".join(str(pick.randrange(1_000)) if w.strip(".,?").isdigit() else w for w in t.split()),
    "one word in forty": lambda t, pick: " ".join("changed" if i % 40 == 20 else w for i, w in enumerate(t.split())),
}


@pytest.mark.parametrize("change", CHANGES)
def test_recall_by_kind_of_change(spark, docs_of, change):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    items += [(1_000 + k, f"If Anna has {k + 2} apples and gives {k + 1} of them to her friend Ben, how many of the apples does Anna have?") for k in range(20)]
    pick = random.Random(1)
    texts = [(i, f"Some words before it.\n{CHANGES[change](t, pick)}\nSome words after it.") for i, t in items]
    rows = D.leaks(docs_of(*texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r["doc_id"] for r in rows if r["item_id"] == r["doc_id"] or min(r["item_id"], r["doc_id"]) >= 1_000}
    assert len(found) >= 0.9 * len(items), (change, len(found) / len(items))
    print(change, len(found) / len(items))


def test_reading_many_texts_takes_few_bytes_of_each():
    """A worker's arrays for the texts that are read together are several times these, not twenty times."""
    pick = random.Random(6)
    words = [f"word{i}" for i in range(2_000)]
    texts = [" ".join(pick.choices(words, k=4_000)) for _ in range(D.TOGETHER // 33_000)]
    D.Coded(texts[:10])
    tracemalloc.start()
    n = sum(len(h) for _, h in D.Coded(texts).windows())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n >= len(texts) * 3_996
    assert peak < 13 * D.TOGETHER


def test_what_is_remembered_goes_with_the_broadcast(monkeypatch):
    """Chunks are remembered beside the bitmap that was sent, so that a worker drops them when that step is over."""
    monkeypatch.setattr(D, "KINDS", D.Kinds())
    wanted = D.Wanted(np.zeros(8, bool))
    D.Coded(["one two three"], wanted.kinds)
    assert len(wanted.kinds) == 3 and not D.KINDS
    sent = pickle.loads(pickle.dumps(wanted))
    assert len(sent.kinds) == 0 and (sent.bitmap == wanted.bitmap).all()
