from __future__ import annotations

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from webtables.llm import conversations as C

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
EDITS = {"K": 0, "R": C.REROLE, "D": C.DELETE}


def by_trial(tokens: str) -> tuple[int, str]:
    """Least (cost, audit) of up to four rows by trying every audit with up to four insertions."""
    found = []
    for edits in itertools.product("KRD", repeat=len(tokens)):
        for gaps in itertools.product(range(4), repeat=len(tokens) + 1):
            for roles in itertools.product("ua", repeat=edits.count("R")):
                said, given, audit, cost = "", iter(roles), "", 0
                options = [""]
                for token, edit, gap in zip((*tokens, ""), (*edits, ""), gaps):
                    options = [o + "".join(x) for o in options for x in itertools.product("ua", repeat=gap)]
                    audit, cost = audit + "I" * gap + edit, cost + gap * C.INSERT
                    if edit:
                        cost += EDITS[edit] + (edit != "D" and token.isupper())
                        said = {"K": token.lower(), "R": "", "D": ""}[edit] or (next(given) if edit == "R" else "")
                        options = [o + said for o in options]
                if sum(gaps) > 4 or any(t == "d" and e != "D" for t, e in zip(tokens, edits)):
                    continue
                if any(re.fullmatch("(s?(ua)+)?", o) for o in options):
                    found.append((cost, audit))
    return min(found)


@pytest.mark.parametrize("tokens", ["", "u", "a", "s", "x", "d", "U", "S", "su", "au", "us", "uA", "aa", "sa", "dua", "uda", "uad", "sUs", "aSu", "xxu", "uaS", "Aus"])
def test_chart_against_all_audits(tokens):
    cost, audit = C.answer(C.parsed(tokens, C.Charts()))
    assert (cost, audit.replace("L", "K")) == by_trial(tokens)


def test_doubling_equals_full_chart(monkeypatch):
    rng = random.Random(1)
    for _ in range(40):
        tokens = "".join(rng.choices("suaxSUAXd", k=rng.randint(1, 15)))
        whole = C.parsed(tokens, C.Charts())
        monkeypatch.setattr(C, "CHART", 3)
        assert C.parsed(tokens, C.Charts()) == whole
        monkeypatch.setattr(C, "CHART", 16)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(C, "REMEMBERED", 10)
    charts = C.Charts()
    for tokens in itertools.product("sua", repeat=4):
        charts("".join(tokens))
    assert len(charts.known) <= 10


def rows_of(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in rng.sample(range(60), rng.randint(0, 14)):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None])
            text = rng.choice([f"Said {rng.randint(0, 5)}.", f"Cut {rng.randint(0, 9)}", "Yes!\n", " \t", "", None, "Ünï?", "x" * 5_000])
            rows += [(None if conv == 3 else conv, None if turn == 7 else turn, role, text)] * rng.choice([1, 1, 1, 1, 3])
    return rows


@pytest.mark.parametrize(("block", "crowded"), [(256, 1_024), (3, 8), (1, 4)])
def test_query_against_sql(spark, block, crowded):
    rows = rows_of(5, 60)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: C.F.lit(1) for c in ("conv", "copies", "alone", "base", "h", "cost", "_n")})
    found = C._repair(C.damaged(docs), block, crowded)
    names = sorted(found.columns)
    got = sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    con.execute(C.OP12_SQL)
    at = [d[0] for d in con.description]
    assert got == sorted((tuple(r[at.index(c)] for c in names) for r in con.fetchall()), key=repr)
    assert any(r[names.index("conv_id")] is None for r in got)


def test_a_conversation_of_copies(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")] + [(1, 2, "user", "Same.")] * 3_000 + [(1, t, "assistant", "Same.") for t in range(3, 900)]
    (found,) = C.repair(spark.createDataFrame(rows, SCHEMA), 64, 100).collect()
    assert (found["duplicate"], found["cost"], found["gaps"]) == (2_999 + 896, 3 * (2_999 + 896), 0)
    assert found["audit"] == "KKK" + "D" * 2_999 + "K" + "D" * 896
    assert found["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Yes.\nuser:Same.\nassistant:Same.").hexdigest()


def test_rows_of_one_turn_are_dealt_finer(spark):
    rows = [(1, 5, "user", f"Number {i}.") for i in range(300)]
    (one,) = C.repair(spark.createDataFrame(rows, SCHEMA), 64, 10_000).collect()
    (fine,) = C.repair(spark.createDataFrame(rows, SCHEMA), 64, 16).collect()
    assert one == fine and one["illegal"] == 299


def test_empty_tables(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(i for i in range(1_000) if __import__("zlib").crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = C._repair(C.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)), 256, 1_024).collect()
    assert row.asDict() == {"conv_id": gone, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
