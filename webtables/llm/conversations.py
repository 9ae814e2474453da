"""Repair of conversation structure by weighted CYK interval parsing.

A conversation is a sequence of rows; the edits Keep, Rerole, Delete and Insert must turn the initials of its roles into
`(s?(ua)+)?`. The repair grammar is in Chomsky normal form: a nonterminal [p, q] stands for rows whose repaired roles
take a reader of that pattern from what it last saw, p, to q (nothing, system, user, assistant), its rules are
[p, q] -> [p, r] [r, q], its terminals the edits of one row, closed under insertions on both sides. A span's cells hold
the least (cost, audit) of each nonterminal; spans are combined bottom-up by length.

Audits join by concatenation. Of two audits of one span and equal cost neither can begin the other (same rows, same
letters, so only insertions would differ, and those cost), hence the least whole has the least parts, and *any* cut of a
span gives its cells. Up to `CHART` rows all spans and all cuts are tried; above, spans double and have one cut.

Conversations are parsed in blocks of `BLOCK` turns, so no task holds a whole long one: a block's cells say all that the
rest must know. Equal rows meet as one row with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from webtables.llm.common import stored

#: Turns of a block; more rows than `CROWDED` on them are dealt finer.
BLOCK, CROWDED = 256, 1_024
#: Rows of the largest full chart, and charts that a worker remembers (each under 4 KB).
CHART, REMEMBERED = 16, 10_000
#: Costs of edits, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
BLANKS = " \t\n\x0b\x0c\r"

Cell = tuple[int, str] | None
Cells = tuple[Cell, ...]  # of [p, q] at 4 p + q

#: [p, q] -> [p, r] [r, q], as places of cells.
RULES = [(4 * p + q, 4 * p + r, 4 * r + q) for p in range(4) for r in range(4) for q in range(4)]


def joined(left: Cells, right: Cells, best: list[Cell] | None = None) -> list[Cell]:
    """The least cells of two neighbouring spans together, and of `best`."""
    best = best or [None] * 16
    for at, x, y in RULES:
        if (a := left[x]) is not None and (b := right[y]) is not None:
            made = (a[0] + b[0], a[1] + b[1])
            if best[at] is None or made < best[at]:
                best[at] = made
    return best


def _insertions() -> Cells:
    """Cells of a span without rows: what insertions alone do."""
    cells: list[Cell] = [None] * 16
    for p in range(4):
        cells[5 * p] = (0, "")
    one = list(cells)
    for (p, initial), q in STEPS.items():
        if initial != "s":
            one[4 * p + q] = (INSERT, "I")
    return tuple(joined(tuple(one), tuple(one)))


INSERTED = _insertions()


def row_cells(token: str) -> Cells:
    """Cells of one row: `s`, `u`, `a` or `x` for its initial, in capitals if truncated; `d` must be deleted.

    A system row that is kept is written L, which sorts as K does and tells the repair that it keeps its role.
    """
    cells: list[Cell] = [None] * 16
    for p in range(4):
        cells[5 * p] = (DELETE, "D")
    if token != "d":
        own, more = token.lower(), TRUNCATED * token.isupper()
        for (p, initial), q in STEPS.items():
            if initial == own:
                cells[4 * p + q] = (more, "L" if own == "s" else "K")
            elif initial != "s":
                cells[4 * p + q] = (REROLE + more, "R")
    return tuple(joined(tuple(joined(INSERTED, tuple(cells))), INSERTED))


ROW_CELLS = {token: row_cells(token) for token in "suaxSUAXd"}


class Charts:
    """Cells of token strings of up to `CHART` rows, by CYK over all spans and cuts; equal strings are parsed once."""

    def __init__(self):
        self.known: dict[str, Cells] = {}

    def __call__(self, tokens: str) -> Cells:
        if (found := self.known.get(tokens)) is not None:
            return found
        if len(self.known) >= REMEMBERED:
            self.known = dict(list(self.known.items())[REMEMBERED // 2 :])
        n = len(tokens)
        spans = {(i, i + 1): ROW_CELLS[t] for i, t in enumerate(tokens)}
        for length in range(2, n + 1):
            for start in range(n - length + 1):
                end = start + length
                cells: list[Cell] | None = None
                for cut in range(start + 1, end):
                    cells = joined(spans[start, cut], spans[cut, end], cells)
                spans[start, end] = tuple(cells)
        self.known[tokens] = spans[0, n]
        return spans[0, n]


def parsed(tokens: str, charts: Charts) -> Cells:
    """Cells of a token string of any length; without rows, what no row at all says."""
    spans = [charts(tokens[i : i + CHART]) for i in range(0, len(tokens), CHART)]
    while len(spans) > 1:
        spans = [tuple(joined(*spans[i : i + 2])) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0] if spans else tuple((0, "") if p == q else None for p in range(4) for q in range(4))


def answer(cells: Cells) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation: nothing stays, or it ends with an assistant."""
    return min(c for c in (cells[4 * NOTHING + NOTHING], cells[4 * NOTHING + ASSISTANT]) if c is not None)


def repaired(rows: Iterator[tuple[str, str] | None], audit: str, turns: int) -> Iterator[str]:
    """The `role:text` of what an audit (with L) leaves of rows, None for further copies; `turns`: user and assistant rows before."""
    for letter in audit:
        row = None if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "L":
            yield f"{row[0]}:{row[1]}"
            continue
        role = row[0] if letter == "K" else ("user", "assistant")[turns % 2]
        turns += 1
        yield f"{role}:{row[1] if row else ''}"


def expanded(roles: list, texts: list, copies: list) -> Iterator[tuple[str, str] | None]:
    for role, text, n in zip(roles, texts, copies):
        yield role, text
        for _ in range(n - 1):
            yield None


def hashed(lines: Iterator[str], digest, first: bool) -> bool:
    """Adds newline-joined lines to a digest; whether none has been added so far."""
    for line in lines:
        digest.update((line if first else f"\n{line}").encode())
        first = False
    return first


class Block:
    """Faults, tokens and rows of one block, row by row in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None
        self.tokens: list[str] = []
        self.roles, self.texts, self.copies, self.seen = [], [], [], set()

    def add(self, role: str, text: str, copies: int, later: bool) -> None:
        initial, bare = role[:1], text.rstrip(BLANKS)
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.illegal += copies - 1
        self.last = initial
        key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
        if not bare:
            self.blank += copies
            token = "d"
        elif later or key in self.seen:
            self.duplicate += copies
            token = "d"
        else:
            self.duplicate += copies - 1
            token = initial if initial and initial in "sua" else "x"
            if bare[-1] not in ".!?":
                self.truncated += 1
                token = token.upper()
        self.seen.add(key)
        self.tokens.append(token + "d" * (copies - 1))
        for kept, value in ((self.roles, role), (self.texts, text), (self.copies, copies)):
            kept.append(value)


PARSED = (
    "base long, part long, alone boolean, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, "
    "n long, first string, last string, costs array<long>, audits array<string>, roles array<string>, texts array<string>, copies array<long>"
)


def batches(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def arrow_types(schema) -> tuple[list[str], list[pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [f.name for f in schema], [to_arrow_type(f.dataType) for f in schema]


def parser(schema):
    names, types = arrow_types(schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        charts, key, block, out, held = Charts(), None, None, [], 0

        def closed() -> tuple:
            conv, base, part, alone = key
            tokens = "".join(block.tokens)
            cells = parsed(tokens, charts)
            counts = (conv, base, part, alone, block.blank, block.duplicate, block.truncated, block.illegal)
            ends = (len(tokens), block.first, block.last)
            if not alone:
                return *counts, None, None, None, *ends, [c and c[0] for c in cells], [c and c[1] for c in cells], block.roles, block.texts, block.copies
            cost, audit = answer(cells)
            digest = hashlib.sha256()
            hashed(repaired(expanded(block.roles, block.texts, block.copies), audit, 0), digest, True)
            return *counts, cost, audit.replace("L", "K"), digest.hexdigest(), *ends, None, None, None, None, None

        for part in parts:
            for conv, base, sub, alone, role, text, copies, later in zip(*(c.to_pylist() for c in part.columns)):
                if key != (conv, base, sub, alone):
                    if block:
                        out.append(closed())
                        if len(out) >= 1_000 or held > 1 << 23:
                            yield batches(out, names, types)
                            out, held = [], 0
                    key, block = (conv, base, sub, alone), Block()
                block.add(role, text, copies, later)
                held += 0 if alone else len(text)
        if block:
            out.append(closed())
        yield batches(out, names, types)

    return run


def combiner(schema):
    """Blocks of conversations, sorted, to one row a block: its piece of the audit, the turns before it, and sums."""
    names, types = arrow_types(schema)

    def whole(conv, blocks: list[dict]) -> list[tuple]:
        spans = [tuple(None if c is None else (c, a) for c, a in zip(b["costs"], b["audits"])) for b in blocks]
        while len(spans) > 1:
            spans = [tuple(joined(*spans[i : i + 2])) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
        cost, audit = answer(spans[0])
        sums = [sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated", "illegal")]
        sums[3] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(blocks, blocks[1:]))
        rows, at, turns = [], 0, 0
        for i, b in enumerate(blocks):
            end, left = at, b["n"]
            while left:
                left -= audit[end] != "I"
                end += 1
            if i + 1 == len(blocks):
                end = len(audit)
            said = (*sums, cost, audit.replace("L", "K")) if i == 0 else (None,) * 6
            rows.append((conv, b["base"], b["part"], audit[at:end], turns, *said))
            turns += end - at - audit.count("D", at, end) - audit.count("L", at, end)
            at = end
        return rows

    def run(parts):
        conv, blocks = None, []
        for part in parts:
            for row in part.to_pylist():
                if blocks and row["conv"] != conv:
                    yield batches(whole(conv, blocks), names, types)
                    blocks = []
                conv = row["conv"]
                blocks.append(row)
        if blocks:
            yield batches(whole(conv, blocks), names, types)

    return run


def finisher(schema):
    """Blocks with their pieces, sorted, to one row a conversation; texts pass one block at a time."""
    names, types = arrow_types(schema)

    def run(parts):
        said, digest, first = None, None, True
        for part in parts:
            out = []
            for i in range(part.num_rows):
                row = {c: part.column(c)[i].as_py() for c in part.schema.names}
                if row["cost"] is not None:
                    if said:
                        out.append((*said, digest.hexdigest()))
                    said, digest, first = tuple(row[c] for c in names[:-1]), hashlib.sha256(), True
                first = hashed(repaired(expanded(row["roles"], row["texts"], row["copies"]), row["piece"], row["turns"]), digest, first)
            yield batches(out, names, types)
        yield batches([(*said, digest.hexdigest())] if said else [], names, types)

    return run


FAULTS = ("blank", "duplicate", "truncated", "illegal")


def repair(conversations: DataFrame, block: int = BLOCK, crowded: int = CROWDED) -> DataFrame:
    """One row for each conv_id of `conversations` (conv_id, turn, role, text, more): counts, cost, audit, repaired_sha256.

    Rows count by turn, nulls first, equal turns by a hash of role and text; null roles and texts are one space; a null
    conv_id is a conversation. Blank: nothing but ASCII white space. Duplicate: role and text seen earlier in the
    conversation; rows that repeat as a whole stand side by side, so all but the first are duplicates. Truncated: the last
    character that is no white space is none of `.!?`. Very long conversations are parsed in blocks, very long texts stay
    whole. Columns of other names do not matter. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(" "))
    role = F.coalesce(F.col("role"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    return _repair(rows.withColumn("copies", F.lit(1)), block, crowded)


def _repair(rows: DataFrame, block: int, crowded: int) -> DataFrame:
    """`repair` of rows conv, turn, role, text and copies (none: the row is not there, its conversation is)."""
    there = F.col("copies") > 0
    turn = F.when(there, F.col("turn"))
    known = rows.groupBy("conv").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"),
    )
    of_block = F.floor(F.col("turn") / block).cast("long")
    sizes = rows.filter(there).groupBy("conv", of_block.alias("of")).agg(F.sum("copies").alias("n"))
    long = stored(
        sizes.groupBy("conv").agg(F.count("*").alias("blocks"), F.max("n").alias("most")).filter((F.col("blocks") > 1) | (F.col("most") > crowded)),
        "conversation-blocks",
    ).select(F.col("conv").alias("long_conv"), "most")
    whole = rows.filter(there).groupBy("conv", "turn", "role", "text").agg(F.sum("copies").cast("long").alias("copies"))
    whole = whole.join(long, F.col("conv").eqNullSafe(F.col("long_conv")), "left").drop("long_conv")
    wide, fine = F.col("most") > crowded, F.ceil(F.col("most") / (crowded / 4)).cast("long")
    whole = whole.withColumn("h", F.xxhash64("role", "text")).select(
        "*",
        F.when(wide, F.col("turn")).otherwise(of_block * block).alias("base"),
        F.when(wide, F.least(fine - 1, F.floor((F.col("h") / F.lit(float(1 << 64)) + 0.5) * fine).cast("long"))).otherwise(F.lit(0)).cast("long").alias("part"),
        F.col("most").isNull().alias("alone"),
        F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"),
    )
    # what a long conversation says in several blocks, with the first of them
    place = F.struct(F.col("base").isNotNull().alias("a"), "base", "part")
    again = stored(
        whole.filter(~F.col("alone")).groupBy("conv", "said").agg(F.min(place).alias("from"), F.max(place).alias("to")).filter("from < to").drop("to"),
        "conversation-repeats",
    ).select(F.col("conv").alias("again_conv"), F.col("said").alias("again_said"), "from")
    whole = whole.join(again, F.col("conv").eqNullSafe(F.col("again_conv")) & (F.col("said") == F.col("again_said")), "left")
    later = F.coalesce(F.col("from") < place, F.lit(False))
    ordered = (
        whole.select("conv", "base", "part", "alone", "turn", "h", "role", "text", "copies", later.alias("later"))
        .repartition("conv", "base", "part").sortWithinPartitions("conv", "base", "part", "turn", "h", "role", "text")
        .select("conv", "base", "part", "alone", "role", "text", "copies", "later")
    )
    kind = rows.schema["conv"].dataType.simpleString()
    schema = rows.sparkSession.createDataFrame([], f"conv {kind}, {PARSED}").schema
    spans = stored(ordered.mapInArrow(parser(schema), schema), "conversation-spans")
    done = spans.filter("alone").select("conv", *FAULTS, "cost", "audit", "repaired_sha256")

    parts = spans.filter("NOT alone")
    schema = rows.sparkSession.createDataFrame([], f"conv {kind}, base long, part long, piece string, turns long, {', '.join(f'{c} long' for c in FAULTS)}, cost long, audit string").schema
    pieces = (
        parts.select("conv", "base", "part", *FAULTS, "n", "first", "last", "costs", "audits")
        .repartition("conv").sortWithinPartitions("conv", "base", "part")
        .mapInArrow(combiner(schema), schema)
    )
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("conv", "base", "part")]
    told = parts.select("conv", "base", "part", "roles", "texts", "copies").alias("x").join(pieces.alias("y"), same[0] & same[1] & same[2])
    told = told.select("x.*", *(f"y.{c}" for c in ("piece", "turns", *FAULTS, "cost", "audit"))).repartition("conv").sortWithinPartitions("conv", "base", "part")
    rest = told.mapInArrow(finisher(done.schema), done.schema)

    empty = hashlib.sha256().hexdigest()
    every = known.alias("k").join(done.unionByName(rest).alias("d"), F.col("k.conv").eqNullSafe(F.col("d.conv")), "left")
    return every.select(
        F.col("k.conv").alias("conv_id"),
        "gaps",
        *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in (*FAULTS, "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows conv, turn, role, text, copies with faults chosen by crc32 of `conv_id:turn` modulo 20 (nulls: one space)."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault: Column = F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn"))) % 20
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), value("role").alias("role"), value("text").alias("text"), fault.alias("fault"))
    return rows.select(
        "conv",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), BLOCK, CROWDED)


#: The same rows by another way: a left-to-right reader with four states, folded over each conversation's list of rows.
OP12_SQL = r"""
WITH keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT), 4294967295::BIGINT) % 20 AS fault
  FROM conversations),
kept AS (
  SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM keyed),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM kept),
told AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS prior, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth
  FROM placed),
judged AS (
  SELECT *, bare = '' AS blank, bare <> '' AND nth > 1 AS duplicate, bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
    prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM told),
grouped AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal,
    list({'i': initial, 'x': blank OR duplicate, 'm': CASE WHEN truncated THEN 1 ELSE 0 END, 'r': role, 't': text} ORDER BY pos) AS items
  FROM judged GROUP BY conv_id),
folded AS (
  SELECT *, list_reduce(
    list_transform(items, lambda v: {'v': v, 'n': [(0, '', '')], 's': [(0, '', '')], 'u': [(0, '', '')], 'a': [(0, '', '')]}),
    lambda f, e: list_transform([{
      'n': list_transform(f.n, lambda y: (y[1] + 3, y[2] || 'D', y[3])),
      's': list_sort(list_transform(f.s, lambda y: (y[1] + 3, y[2] || 'D', y[3])) || list_transform(list_filter(f.n, lambda y: NOT e.v.x AND e.v.i = 's'), lambda y: (y[1] + e.v.m, y[2] || 'K', y[3] || chr(10) || e.v.r || ':' || e.v.t)))[:1],
      'u': list_sort(list_transform(f.u, lambda y: (y[1] + 3, y[2] || 'D', y[3])) || list_transform(list_filter(f.n || f.s || f.a, lambda y: NOT e.v.x), lambda y: CASE WHEN e.v.i = 'u' THEN (y[1] + e.v.m, y[2] || 'K', y[3] || chr(10) || e.v.r || ':' || e.v.t) ELSE (y[1] + 2 + e.v.m, y[2] || 'R', y[3] || chr(10) || 'user:' || e.v.t) END))[:1],
      'a': list_sort(list_transform(f.a, lambda y: (y[1] + 3, y[2] || 'D', y[3])) || list_transform(list_filter(f.u, lambda y: NOT e.v.x), lambda y: CASE WHEN e.v.i = 'a' THEN (y[1] + e.v.m, y[2] || 'K', y[3] || chr(10) || e.v.r || ':' || e.v.t) ELSE (y[1] + 2 + e.v.m, y[2] || 'R', y[3] || chr(10) || 'assistant:' || e.v.t) END))[:1]
    }], lambda g: {
      'v': e.v, 'n': g.n, 's': g.s,
      'u': list_sort(g.u || list_transform(g.n || g.s || g.a, lambda y: (y[1] + 2, y[2] || 'I', y[3] || chr(10) || 'user:')))[:1],
      'a': list_sort(g.a || list_transform(list_sort(g.u || list_transform(g.n || g.s || g.a, lambda y: (y[1] + 2, y[2] || 'I', y[3] || chr(10) || 'user:')))[:1], lambda y: (y[1] + 2, y[2] || 'I', y[3] || chr(10) || 'assistant:')))[:1]
    })[1],
    {'v': {'i': '', 'x': true, 'm': 0, 'r': '', 't': ''}, 'n': [(0, '', '')], 's': list_filter([(0, '', '')], lambda y: false), 'u': [(2, 'I', chr(10) || 'user:')], 'a': [(4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')]}) AS f
  FROM grouped),
ended AS (SELECT *, list_sort(f.n || f.a)[1] AS best FROM folded)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best[1], 0)::BIGINT AS cost, coalesce(best[2], '') AS audit, sha256(coalesce(best[3][2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""

QUERIES = {"op12_conversation_repair": (op12_conversation_repair, OP12_SQL)}
