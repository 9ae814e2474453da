"""BPE automaton and token files against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webtables.llm import bpe, common, token_files, units

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH)


def texts(seed=3, n=300):
    pick = random.Random(seed)
    alphabets = ["aaabbb", "theinganderonre", "ab'st123 .,!?", "aé日本ñß́İ \u0085 xÀ×ÿĀ", "a b<|endoftext|>Ω Σ", "".join(map(chr, range(32, 127)))]
    made = ["".join(pick.choice(a) for _ in range(pick.randrange(30))) for a in alphabets for _ in range(n)]
    made += ["".join(chr(pick.choice([pick.randrange(0x20, 0x250), pick.randrange(0x250, 0xD800), pick.randrange(0xE000, 0x20000)])) for _ in range(8)) for _ in range(n)]
    return made + ["", " ", "a" * 3000, "<|endoftext|>", "x<|endoftext|>y<|startoftext|>", "<|ENDOFTEXT|>", "\x00", *(t or "" for _, t in ODD)]


def test_automaton_encodes_and_decodes_like_the_library(library, encoder):
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        ids = encoder.encode(text.encode())
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert b"".join(encoder.decode(ids)).decode() == library.decode(want, skip_special_tokens=False)


def plain_bpe(word, merges):
    """Lowest merge first, leftmost first."""
    parts, rank = list(word), {m: i for i, m in enumerate(merges)}
    while True:
        found = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
        if found is None:
            return parts
        parts[found[1] : found[1] + 2] = ["".join(parts[found[1] : found[1] + 2])]


def test_automaton_of_any_merges():
    """Small vocabularies, with merges that earlier ones make impossible, against merging by rank."""
    pick = random.Random(0)
    for _ in range(60):
        symbols = list("ab") + ["a</w>", "b</w>"]
        vocabulary, merges, inner = {s: i for i, s in enumerate(symbols)}, [], list("ab")
        for _ in range(12):
            a, b = pick.choice(inner), pick.choice([*vocabulary])
            if a + b not in vocabulary:
                vocabulary[a + b] = len(vocabulary)
                merges.append((a, b))
                if not b.endswith("</w>"):
                    inner.append(a + b)
        automaton = bpe.Automaton(vocabulary, merges, "</w>")
        encoder = bpe.Encoder.__new__(bpe.Encoder)
        encoder.automaton, encoder.table = automaton, {}
        names = {i: s for s, i in vocabulary.items()}
        for _ in range(40):
            word = "".join(pick.choice("ab") for _ in range(pick.randrange(1, 12)))
            got = [names[t] for t in encoder.word(word)]
            assert got == plain_bpe([*word[:-1], word[-1] + "</w>"], merges), (word, merges)


def test_query_columns_equal_the_library(spark, odd_docs, library):
    docs = odd_docs.unionByName(spark.createDataFrame(list(enumerate(texts(5, 20), 100)), "doc_id BIGINT, text STRING"))
    found = bpe.round_trip(docs, PATH).collect()
    want = []
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))


def test_decode_in_pieces(encoder, monkeypatch):
    ids = encoder.encode(b"some words in a row, and more")
    whole = b"".join(encoder.decode(ids))
    monkeypatch.setattr(bpe, "PIECE", 3)
    assert b"".join(encoder.decode(ids)) == whole


def test_units_cover_a_text_in_order(library):
    text = "Ab cd9, x's <|endoftext|> É-ñ ×a\u0130 日本\ttail..\n".encode()
    values, starts, odd = units.split(text)
    found = values.to_pylist()
    assert [u.decode() for u in found] == ["ab", "cd", "9", ",", "x's", "<|endoftext|>", "É", "-", "ñ", "×a\u0130", "日本", "tail", ".."]
    assert odd.tolist() == [False, False, False, False, True, True, False, False, False, True, True, False, False]
    assert [text[s:].startswith(u) or text[s:].lower().startswith(u) for s, u in zip(starts, found)] == [True] * len(found)


def test_memory_is_bounded_in_bytes(library):
    """Texts without blanks, each one unit, and many short units: what is held stays below the bound."""
    for many in ([f"日本{i}" * 400 for i in range(300)], [f"word{i}x{i}" for i in range(5_000)], [f"日{i}本" for i in range(3_000)]):
        held = token_files.Library(library).units
        held.most = 100_000
        coded = list(held.encode([t.encode() for t in many]))
        assert held.size() <= held.most and max(map(len, [*held.known.to_pylist(), b""])) <= units.LONG
        assert len(held.known) == len(held.lengths) == len(held.hits) and held.lengths.sum() == len(held.ids)
        assert list(held.encode([t.encode() for t in many])) == coded
        for text, ids in list(zip(many, coded))[:40]:
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_forgotten_unit_is_learnt_again(encoder):
    fresh = bpe.Encoder.__new__(bpe.Encoder)
    fresh.__setstate__(encoder.__getstate__())
    fresh.units.most = 300
    text = b"one two three four five six seven one two three"
    assert [fresh.encode(text) for _ in range(3)] == [encoder.encode(text)] * 3


def test_long_text_without_blanks(encoder, library):
    text = "日本語テキスト" * 30_000 + "a" * 100_000
    want = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(next(token_files.Library(library).units.encode([text.encode()])), "<u4").tolist() == want
    short = text[:3_000] + "a" * 300
    assert np.frombuffer(encoder.encode(short.encode()), "<u4").tolist() == library.encode(short, add_special_tokens=False).ids


def test_encode_and_decode_tables(odd_docs, clashing, no_docs, library):
    rows = bpe.decode(bpe.encode(odd_docs, PATH), PATH).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    wide = bpe.encode(clashing, PATH)
    assert wide.columns == [*clashing.columns, "_ids"] and wide.filter("ids <> 'ids'").count() == 0
    assert bpe.encode(no_docs, PATH).count() == 0 and bpe.round_trip(no_docs, PATH).count() == 0


# files


@pytest.mark.parametrize("fitting", [0.0, 0.5, 0.9, 1.0])
def test_segments(fitting):
    pick = np.random.default_rng(1)
    cases = [np.zeros(0), np.array([5]), pick.integers(0, 49408, 1000), pick.integers(0, 2**32, 777), np.r_[pick.integers(0, 300, 5000), pick.integers(0, 2**31, 20)], np.full(300, 7)]
    for ids in cases:
        ids = ids.astype(np.uint32)
        assert (token_files.read_segment(token_files.write_segment(ids, fitting)) == ids).all()


def test_outliers_cost_little():
    ids = np.full(128 * 100, 9, np.uint32)
    ids[::128] = 2**31
    assert len(token_files.write_segment(ids)) < 128 * 100


@pytest.mark.parametrize("finer", [True, False])
def test_units_like_the_library(library, finer):
    every, own = texts(7), token_files.Library(library)
    assert own.units.finer
    held = units.Units(own.learn, finer)
    for _ in range(2):
        for text, ids in zip(every, held.encode([t.encode() for t in every])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("segment", [1 << 20, 50])
def test_files(spark, odd_docs, no_docs, library, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(token_files, "SEGMENT", segment)
    path = str(tmp_path / "files")
    token_files.write_token_files(odd_docs.withColumn("part", F.lit(1)), PATH, 2, path)
    found = token_files.read_token_files(spark, path).orderBy("start").collect()
    start, order = 0, sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert len(found) == len(order)
    for r, (doc_id, text) in zip(found, order):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    token_files.write_token_files(no_docs, PATH, 2, str(tmp_path / "none"))
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_edges_of_runs():
    pick = np.random.default_rng(8)
    for n in (0, 1, 2, 50, 300):
        for inside in (pick.random(n) < 0.5, np.zeros(n, bool), np.ones(n, bool)):
            assert units.edges_of(inside).tolist() == np.flatnonzero(np.diff(inside.astype(np.int64), prepend=0, append=0)).tolist()


def test_workers_give_back_what_they_freed(monkeypatch):
    """After the last batch, and after an error, the allocator is asked to return freed memory."""
    asked = []
    monkeypatch.setattr(common.ctypes, "CDLL", lambda _: SimpleNamespace(malloc_trim=asked.append))
    rows = common.lean(lambda batches: (2 * b for b in batches))(iter([1, 2]))
    assert next(rows) == 2 and not asked
    assert list(rows) == [4] and asked == [0]
    with pytest.raises(ZeroDivisionError):
        list(common.lean(lambda batches: (1 // b for b in batches))(iter([0])))
    assert asked == [0, 0]


def test_an_encoder_remembers_twelve_megabytes_at_most(encoder):
    """Units that never come again fill a worker's memory only so far; their ids stay right."""
    learnt = bpe.Encoder(PATH)
    assert learnt.units.most == bpe.HELD <= 12 << 20
    learnt.units.most = 2_000
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}".encode() for i in range(2_000)]
    assert [learnt.encode(w) for w in words[::50]] == [encoder.encode(w) for w in words[::50]]
    assert learnt.units.size() <= 2_000
