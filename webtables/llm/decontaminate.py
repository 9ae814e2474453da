"""Benchmark decontamination by templates: finds benchmark items in documents, re-parameterised ones included.

Words become templates: numbers, names (capitalised words that start no sentence) and units (after a number) turn into
typed placeholders, other words lose case and punctuation. Case tells names, so a second, literal reading keeps names as
words without case: it finds copies in another case. Line ends may end sentences or just wrap lines, so texts are read
both ways; and an item's first word may be a name where the document has it in mid-sentence. An item is in a document if at least `share` of its distinct
windows of five template words stand there close together and its slots are filled consistently: each value of the
item stands for one value in the document, and no two values of a type for the same one. Either reading will do. An item
of three or four words must be a sentence or a line of its own; a shorter one the whole document.

An item with n windows that shares k of them must share one of any n - k + 1, so only that many windows of an item, the
rarest among items, are joined with the documents, by hash. A bitmap of fixed size of their hashes goes to the tasks and
keeps windows that no item has from being shuffled. Documents are read many at a time, each different chunk once. The
pairs found are then compared word by word, at the places where the document's index of windows has the item's.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from webtables.llm.common import documents, lean, stored
from webtables.llm.units import edges_of, slices

WINDOW = 5
SHARE = 0.8
#: Entries of the bitmap: 2 ** this many bytes are sent to each task.
BITMAP = 22
#: Words of the shortest item that is looked for inside documents.
INSIDE = 3
#: Bytes that a worker remembers of chunks and their codes, what Python needs for one besides its letters, and the longest one kept.
REMEMBERED, OVERHEAD, LONG = 64 << 20, 150, 64
#: Bytes of texts that are read at a time, and items that one row of candidates holds.
TOGETHER, ITEMS = 4 << 20, 64
#: Windows that are hashed at a time.
BLOCK = 1 << 17

# Words that stand for numbers, and units of measure.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve".split())
UNITS = frozenset(
    "% percent mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres mg g kg t oz lb lbs "
    "gram grams kilogram kilograms ton tons ml l liter liters litre litres s sec second seconds min minute minutes h hr hour hours "
    "day days week weeks month months year years mph km/h m/s dollar dollars cent cents euro euros usd eur gbp c f k hz w kw j kj v".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,/:]*(?:%|st|nd|rd|th)?")
EDGES = re.compile(r"^[^\w$€£%+-]+|[^\w%]+$|_+$|^_+")

LITERAL, DIGITS, CAPITAL, UNIT, NOTHING = range(5)  # kinds of a chunk, in its lowest three bits
ENDS = 8  # bit: the chunk ends a sentence
PLACEHOLDERS = {"number": 1, "name": 2, "unit": 3}


def chunk_kind(chunk: str) -> tuple[int, str]:
    """Kind of a chunk without white space, with ENDS added, and its bare word."""
    ends = ENDS if chunk.rstrip("\"')]}*”’»")[-1:] in (".", "!", "?", ":") else 0
    bare = EDGES.sub("", chunk)
    if not any(c.isalnum() or c == "%" for c in bare):
        return NOTHING | ends, ""
    low = bare.casefold()
    if NUMBER.fullmatch(bare) or low in NUMBER_WORDS:
        return DIGITS | ends, low.replace(",", "")
    if low in UNITS:
        return UNIT | ends, low
    if bare[0].isupper() and bare != bare.upper():
        return CAPITAL | ends, low
    return LITERAL | ends, low


Words = list[tuple[str, str | None]]


@lru_cache(100_000)
def short_chunk_kind(chunk: str) -> tuple[int, str]:
    return chunk_kind(chunk)


def read(text: str, wrapped: bool = False) -> tuple[Words, list[bool]]:
    """Template words, (placeholder, value) or (word, None), and which begin a sentence or a line; lines may be just wrapped."""
    words, begins, before, fresh = [], [], None, True
    for chunk, starts in chunks_of(text):
        fresh = fresh or (starts and not wrapped)
        kind, bare = (short_chunk_kind if len(chunk) <= LONG else chunk_kind)(chunk)
        ends, kind = kind & ENDS, kind & 7
        if kind != NOTHING:
            if kind == DIGITS:
                words.append(("<number>", bare))
            elif kind == UNIT and before == DIGITS:
                words.append(("<unit>", bare))
            elif kind == CAPITAL and not fresh:
                words.append(("<name>", bare))
            else:
                words.append((bare, None))
            begins.append(fresh)
            before = kind
        fresh = bool(ends) or (fresh and kind == NOTHING)
    return words, begins


def template(text: str, wrapped: bool = False) -> Words:
    """Template words. A line end starts a sentence, unless lines are just wrapped."""
    return read(text, wrapped)[0]


def chunks_of(text: str) -> Iterator[tuple[str, bool]]:
    """The chunks without white space, and whether each is the first of its line."""
    for line in text.splitlines():
        for i, chunk in enumerate(line.split(None)):
            yield chunk, i == 0


# window hashes


class Kinds(dict):
    """Chunk -> hash of its bare word with its kind in the low four bits. Bounded in bytes: the older half goes first."""

    held = 0

    def __missing__(self, chunk: bytes) -> int:
        kind, bare = chunk_kind(chunk.decode())
        code = (xxhash.xxh64_intdigest(bare) & ~15) | kind
        if len(chunk) <= LONG:
            self[chunk] = code
            self.held += len(chunk) + OVERHEAD
            if self.held > REMEMBERED:
                for old in list(islice(self, len(self) // 2)):
                    self.held -= len(old) + OVERHEAD
                    del self[old]
        return code


KINDS = Kinds()
FACTOR = 0x9E3779B97F4A7C15
#: What bytes are, as Python's `split` and `splitlines` have it: 1 parts chunks, 2 ends lines too.
BLANKS = bytes(2 if i in (10, 11, 12, 13, 28, 29, 30) else 1 if i in (9, 31, 32) else 0 for i in range(256))
#: Other white space; that with 2 ends lines.
WIDE = {"\x85": 2, "\u2028": 2, "\u2029": 2} | dict.fromkeys("\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", 1)


LEADS = bytes(any(c.encode()[0] == i for c in WIDE) for i in range(256))


def blanks(raw: bytes) -> np.ndarray:
    """For each byte of UTF-8 whether it is white space (1), or ends a line (2)."""
    found = np.frombuffer(bytearray(raw.translate(BLANKS)), np.uint8)
    if not raw.isascii():
        text = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(np.frombuffer(raw.translate(LEADS), np.uint8)[:-2])
        code = text[at].astype(np.int64) << 16 | text[at + 1].astype(np.int64) << 8 | text[at + 2]
        code = np.where(text[at] == 0xC2, code & ~255, code)
        for wide, kind in WIDE.items():
            size = len(wide.encode())
            for place in at[code == int.from_bytes(wide.encode().ljust(3, b"\0"))]:
                found[place : place + size] = kind
    return found


def runs(of: np.ndarray) -> np.ndarray:
    """For each element of a sorted array the place of the first that equals it."""
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), of[1:] != of[:-1]]))
    return np.repeat(starts.astype(np.int32), np.diff(starts, append=len(of)))


class Coded:
    """The words of many texts one after the other: codes, of which text, and which begin a sentence or a line.

    Texts of 2 GB and more together are beyond it; places have four bytes each.
    """

    def __init__(self, texts: list[str], kinds: Kinds | None = None):
        kinds = KINDS if kinds is None else kinds
        raw = "\n".join([*texts, ""]).encode()
        bounds = np.cumsum([len(t) + 1 if t.isascii() else len(t.encode()) + 1 for t in texts])
        blank = blanks(raw)
        inside = blank == 0
        edges = edges_of(inside).astype(np.int32)
        first, end = edges[::2], edges[1::2]
        offsets = np.zeros(len(first) + 1, np.int32)
        np.cumsum(end - first, out=offsets[1:])
        data = np.frombuffer(raw, np.uint8)[inside]
        chunks = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        known = np.fromiter(map(kinds.__getitem__, chunks.dictionary.to_pylist()), np.uint64, len(chunks.dictionary))
        codes = known[chunks.indices.to_numpy()] if len(first) else np.zeros(0, np.uint64)
        del raw, inside, offsets, data, chunks, known  # arrays as long as the texts or their words go when they are used up
        upto = np.searchsorted(first, bounds.astype(np.int32))
        of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(upto, prepend=0))
        lines = np.searchsorted(np.flatnonzero(blank == 2).astype(np.int32), first).astype(np.int32)  # how many ended before
        del blank, edges, first, end
        place = np.arange(len(codes), dtype=np.int32)
        begun = np.maximum.accumulate(np.where(np.diff(lines, prepend=np.int32(-1)) != 0, place, -1)) if len(codes) else place
        own = runs(of)  # the first chunk of the text
        kinds, ends = (codes & np.uint64(7)).astype(np.int8), (codes & np.uint64(ENDS)) != 0
        solid = kinds != NOTHING
        # fresh: what stood last, other than chunks without a word, ended a sentence; such a chunk may itself end one
        last = np.maximum.accumulate(np.where(solid | ends, place, -1)) if len(codes) else place
        previous = np.concatenate([np.full(1, -1, np.int32), last[:-1]])[: len(codes)]
        fresh = (previous < own) | ends[previous] if len(codes) else np.zeros(0, bool)
        # a line that starts with chunks without a word stays fresh until its first word, unless something else was said
        self.by_line = (fresh | (previous < begun))[solid]
        del own, last, previous, begun, lines, place
        self.fresh, self.of, kinds = fresh[solid], of[solid], kinds[solid]
        self.codes = codes[solid] & ~np.uint64(15)
        self.own = runs(self.of)
        after_number = np.concatenate([[False], kinds[:-1] == DIGITS])[: len(kinds)] & (np.arange(len(kinds)) > self.own)
        self.codes[kinds == DIGITS] = PLACEHOLDERS["number"]
        self.codes[(kinds == UNIT) & after_number] = PLACEHOLDERS["unit"]
        self.capital = kinds == CAPITAL

    def readings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Codes and beginnings of the template, of the one with wrapped lines, and of the literal reading by either."""
        name = np.uint64(PLACEHOLDERS["name"])
        for begins in (self.by_line, self.fresh):
            yield np.where(self.capital & ~begins, name, self.codes), begins
            yield self.codes, begins

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Text and hash of the windows of every reading: WINDOW words, short sentences and lines, short texts."""
        texts, base = np.arange(len(self.of)) == self.own, None
        for codes, begins in self.readings():
            yield from whole_windows(codes, self.of, None if base is None else codes != base)  # only what the first reading lacks
            base = codes if base is None else base
            yield from short_windows(codes, self.of, begins)
            yield from short_windows(codes, self.of, texts, 1)


def mixed(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash of `size` codes from each of `starts` on."""
    found = np.full(len(starts), size, np.uint64)
    for i in range(size):
        found = (found ^ (found >> np.uint64(29))) * np.uint64(FACTOR) + codes[starts + i]
    return found ^ (found >> np.uint64(32))


def whole_windows(codes: np.ndarray, of: np.ndarray, among: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows that lie in one text; with `among`, those that hold one of these words."""
    if len(codes) < WINDOW:
        return
    within = of[: 1 - WINDOW] == of[WINDOW - 1 :]
    if among is not None:
        if not among.any():
            return
        upto = np.concatenate([[0], np.cumsum(among, dtype=np.int32)])
        within &= upto[WINDOW:] > upto[:-WINDOW]
    for at in range(0, len(within), BLOCK):
        starts = np.flatnonzero(within[at : at + BLOCK]) + at
        if len(starts):
            yield of[starts], mixed(codes, starts, WINDOW)


def short_windows(codes: np.ndarray, of: np.ndarray, begins: np.ndarray, least: int = INSIDE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stretches from one beginning to the next that have `least` words or more, but fewer than a window."""
    starts = np.flatnonzero(begins)
    sizes = np.diff(starts, append=len(codes))
    for size in range(least, WINDOW):
        own = starts[sizes == size]
        yield of[own], mixed(codes, own, size)


def hashed(codes: np.ndarray) -> np.ndarray:
    """A hash of each window of WINDOW codes, in order; of the whole if there are fewer, nothing without any."""
    size = min(WINDOW, len(codes))
    return mixed(codes, np.arange(len(codes) - size + 1), size) if size else codes


def window_hashes(text: str) -> np.ndarray:
    return hashed(next(Coded([text]).readings())[0])


def item_readings(text: str) -> list[np.ndarray]:
    """The distinct windows of every reading of an item that differs; also its first one with the first word as a name."""
    found, name = [], np.uint64(PLACEHOLDERS["name"])
    for codes, _ in Coded([text]).readings():
        found.append(hashed(codes))
        if len(codes) and codes[0] not in PLACEHOLDERS.values():
            found.append(hashed(np.concatenate([[name], codes[1:]]).astype(np.uint64))[:1])
    return list({h.tobytes(): h for h in map(np.unique, found)}.values())


def item_windows(items: DataFrame) -> DataFrame:
    """item, reading, h for the distinct windows of every reading of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, h.view(np.int64)) for i, t in zip(batch["item"].to_pylist(), batch["text"].to_pylist()) for k, h in enumerate(item_readings(t))]
            item, reading, found = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(reading, pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["item", "reading", "h"])

    return items.select("item", "text").mapInArrow(run, "item long, reading int, h array<bigint>").select("item", "reading", F.explode("h").alias("h"))


def telling(windows: DataFrame, share: float) -> DataFrame:
    """item, h: of each reading of an item the rarest n - k + 1 windows, where k of n make the share."""
    often = windows.groupBy("h").agg(F.count("*").alias("_often"))
    rank = F.row_number().over(Window.partitionBy("item", "reading").orderBy("_often", "h"))
    rows = windows.join(often, "h").withColumn("_rank", rank).withColumn("_n", F.count("*").over(Window.partitionBy("item", "reading")))
    return rows.filter(F.col("_rank") <= F.col("_n") - F.ceil(F.col("_n") * share - 1e-9) + 1).select("item", "h").distinct()


def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two entries of the bitmap that stand for a hash."""
    mask = np.uint64((1 << BITMAP) - 1)
    return hashes & mask, hashes >> np.uint64(32) & mask


def bitmap_of(wanted: DataFrame) -> np.ndarray:
    low, high = F.col("h"), F.shiftrightunsigned("h", 32)
    entry = F.explode(F.array(*(x.bitwiseAND((1 << BITMAP) - 1).cast("int") for x in (low, high))))
    entries = wanted.select(entry.alias("entry")).distinct().toPandas()["entry"].to_numpy()  # 2 ** BITMAP at most
    bitmap = np.zeros(1 << BITMAP, bool)
    bitmap[entries] = True
    return bitmap


class Wanted:
    """The bitmap, and what a worker remembers of chunks: that goes with the broadcast, so later steps have its room."""

    def __init__(self, bitmap: np.ndarray):
        self.bitmap, self.kinds = bitmap, Kinds()

    def __reduce__(self):
        return Wanted, (self.bitmap,)


def document_hits(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, _key, text, h: documents with windows whose hash is among `wanted`, or only looks so in the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(Wanted(bitmap_of(wanted)))

    def found_in(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        of, hashes = [], []
        for at, h in Coded(texts, shared.value.kinds).windows():
            for side in (0, 1):
                hit = shared.value.bitmap[places(h)[side]]
                at, h = at[hit], h[hit]
            of.append(at)
            hashes.append(h)
        of, hashes = np.concatenate(of), np.concatenate(hashes)
        for text in np.unique(of):
            yield int(text), np.unique(hashes[of == text]).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in slices(whole, "text", TOGETHER)):
            at, found = [], []
            for text, h in found_in([t or "" for t in batch["text"].to_pylist()]):
                at.append(text)
                found.append(h)
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept["doc_id"], kept["_key"], kept["text"], pa.array(found, pa.list_(pa.int64()))], ["doc_id", "_key", "text", "h"])

    return docs.select("doc_id", "_key", "text").mapInArrow(lean(run), "doc_id long, _key long, text string, h array<bigint>")


# word by word


class Codes(dict):
    """Template word -> code, for the readings of one text."""

    def __missing__(self, word: str) -> int:
        code = self[word] = word_code(word)
        return code


class Reading:
    """Template words with an index of their windows by hash."""

    def __init__(self, words: Words, begins: list[bool], known: Codes | None = None):
        self.words, self.begins, self.known = words, begins, Codes() if known is None else known
        self.names = [w for w, _ in words]
        codes = np.fromiter(map(self.known.__getitem__, self.names), np.uint64, len(words))
        starts = np.arange(max(0, len(words) - WINDOW + 1))
        hashes = mixed(codes, starts, WINDOW)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.sorted = hashes, hashes[self.order]
        ends = [*np.flatnonzero(begins)[1:].tolist(), len(words)]
        self.short: dict[tuple, list[int]] = defaultdict(list)  # short sentences and lines; a whole short text
        for start, end in zip(np.flatnonzero(begins).tolist(), ends):
            if INSIDE <= end - start < WINDOW:
                self.short[tuple(self.names[start:end])].append(start)
        if 0 < len(words) < WINDOW and 0 not in self.short[tuple(self.names)]:
            self.short[tuple(self.names)].append(0)

    def places(self, window: tuple, code: int | None = None) -> list[int]:
        """Where a window's names stand, in order; `code` is its hash, if known."""
        if len(window) < WINDOW:
            return self.short.get(window, [])
        if code is None:
            code = mixed(np.fromiter(map(word_code, window), np.uint64, WINDOW), np.zeros(1, np.int64), WINDOW)[0]
        low, high = np.searchsorted(self.sorted, code), np.searchsorted(self.sorted, code, "right")
        return [p for p in self.order[low:high].tolist() if tuple(self.names[p : p + WINDOW]) == window]

    def shared(self, other: Reading) -> np.ndarray:
        """Which windows of another reading may be among these, by hash."""
        at = np.searchsorted(self.sorted, other.hashes)
        return self.sorted[np.minimum(at, len(self.sorted) - 1)] == other.hashes if len(self.sorted) else np.zeros(len(other.hashes), bool)

    def literal(self) -> Reading:
        """The same with names as words."""
        return Reading([(value, None) if word == "<name>" else (word, value) for word, value in self.words], self.begins, self.known)


def word_code(word: str) -> int:
    return PLACEHOLDERS.get(word[1:-1], 0) if word[:1] == "<" and word[1:-1] in PLACEHOLDERS else xxhash.xxh64_intdigest(word)


def readings_of(text: str) -> list[list[Reading]]:
    """The template and, if lines may be wrapped, the one that says so; each with its literal reading if it has names."""
    plain, wrapped = read(text), read(text, True)
    known = Codes()
    found = [Reading(*x, known) for x in ([plain] if plain == wrapped else [plain, wrapped])]
    return [[r, r.literal()] if "<name>" in r.names else [r] for r in found]


@lru_cache(1_024)
def short_item_readings(text: str) -> list[list[Reading]]:
    return readings_of(text)


Found = tuple[float, int, int, bool]


def compare(doc: list[Reading], item: list[Reading], share: float = SHARE) -> Found | None:
    """The best place of the item in the document, by either reading: share of its windows, first word, word after the last, whether slots differ.

    Places with less than `share` are not looked at further.
    """
    found = [placed(doc[0], item[0], share)]
    if len(doc) > 1 or len(item) > 1:
        found.append(placed(doc[-1], item[-1], share))
    return max((f for f in found if f), key=lambda f: f[0], default=None)


def placed(doc: Reading, item: Reading, share: float) -> Found | None:
    """compare() by one reading: the document's index says where each window of the item stands."""
    size = min(WINDOW, len(item.words))
    if not size or len(doc.words) < size or (size < INSIDE and len(doc.words) != size):
        return None
    mine = item.names
    windows: dict[tuple, int] = {}
    for q in range(len(mine) - size + 1):
        windows.setdefault(tuple(mine[q : q + size]), q)
    if size < WINDOW:
        hits = [(p - q, p, q) for window, q in windows.items() for p in doc.places(window)]
    else:
        here = set(np.flatnonzero(doc.shared(item)).tolist())
        hits = [(p - q, p, q) for window, q in windows.items() if q in here for p in doc.places(window, item.hashes[q])]
    # the first word as a name: any name where the item uses it as one, else the same word
    first = item.words[0]
    if first[1] is None:
        free = ("<name>", first[0]) in item.words
        named = doc.places(("<name>", *mine[1:size]))
        hits += [(p, p, 0) for p in named if free or doc.words[p][1] == first[0]]
    hits.sort()
    slack, best = size + len(mine) // 10, None
    shifts = np.array([h[0] for h in hits], np.int64)
    counts = Counter(shifts.tolist())
    done: set[int] = set()
    for shift, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if shift in done:
            continue
        near = hits[np.searchsorted(shifts, shift - slack) : np.searchsorted(shifts, shift + slack, "right")]
        done.update(h[0] for h in near if abs(h[0] - shift) <= 1)
        # as it stands, then with words left out or put in
        for some in ([h for h in near if h[0] == shift], near):
            if len({q for _, _, q in some}) >= share * len(windows) - 1e-9:
                found = filled(doc.words, item.words, some, size)
                if found and (best is None or found[0] / len(windows) > best[0]):
                    best = (found[0] / len(windows), *found[1:])
    return best


def filled(doc, item, hits, size: int) -> tuple[int, int, int, bool] | None:
    """How many distinct windows of the item fill its slots consistently, from where to where, and with other values or not."""
    def slot(p: int, q: int) -> tuple[str, str | None]:
        """The item's word there; its first one as a name where the document has a name."""
        return ("<name>", item[0][0]) if q == 0 and item[0][1] is None and doc[p][0] == "<name>" else item[q]

    votes: dict[tuple, Counter] = defaultdict(Counter)
    for _, p, q in hits:
        for i in range(size):
            kind, value = slot(p + i, q + i)
            if value is not None:
                votes[kind, value][doc[p + i][1]] += 1
    taken, chosen = set(), {}
    ranked = sorted(((n, key, value) for key, c in votes.items() for value, n in c.items()), key=lambda x: (-x[0], x[1], x[2]))
    for _, key, value in ranked:
        if key not in chosen and (key[0], value) not in taken:
            chosen[key] = value
            taken.add((key[0], value))
    fit = [(p, q) for _, p, q in hits if all((s := slot(p + i, q + i))[1] is None or chosen.get(s) == doc[p + i][1] for i in range(size))]
    if not fit:
        return None
    return len({q for _, q in fit}), min(p for p, _ in fit), max(p for p, _ in fit) + size, any(k[1] != v for k, v in chosen.items())


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, _key (hash of the text), item_id, share, first_word, end_word, reparameterised: items found in documents.

    Null and empty texts, of documents or items, have no words and never match. An item of three or four words must be a
    sentence or a line of its own, a shorter one matches only documents that have just its template. Items with equal
    texts are all named. Rows equal in doc_id and text count once; a doc_id may be null. Texts are read whole.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_key", F.xxhash64("text"))
    named = stored(benchmark.filter("text IS NOT NULL").select("item_id", "text", F.xxhash64("text").alias("item")).distinct(), "item-ids")
    items = stored(named.select("item", "text").distinct(), "items")
    wanted = stored(telling(item_windows(items), share), "item-windows")
    hits = stored(document_hits(keyed, wanted), "leak-hits")  # whole texts, of documents that share a telling window
    pairs = hits.select("doc_id", "_key", F.explode("h").alias("h")).join(wanted, "h").select("doc_id", "_key", "item").distinct()
    # a document that shares windows with very many items is several rows
    count = pairs.groupBy("doc_id", "_key").agg(F.ceil(F.count("*") / ITEMS).cast("long").alias("rows")).filter("rows > 1")
    count = stored(count, "leak-counts").withColumnsRenamed({"doc_id": "_id", "_key": "_k"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k"))
    block = F.pmod(F.xxhash64("item"), F.coalesce("rows", F.lit(1))).alias("_block")
    asked = pairs.join(count, same, "left").select("doc_id", "_key", block, "item").join(items, "item")
    asked = asked.groupBy("doc_id", "_key", "_block").agg(F.collect_list(F.struct("item", F.col("text").alias("item_text"))).alias("items"))
    asked = stored(asked, "leak-candidates").withColumnsRenamed({"doc_id": "_id", "_key": "_k"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # its items and their texts may be many
                texts = readings_of(doc["text"])
                for item in doc["items"]:
                    text = item["item_text"]
                    wanted = short_item_readings(text) if len(text) <= 10_000 else readings_of(text)
                    every = [f for words in texts for other in wanted if (f := compare(words, other, share))]
                    found = max(every, key=lambda f: f[0], default=None)
                    if found and found[0] >= share - 1e-9:
                        rows.append((doc["doc_id"], doc["_key"], item["item"], *found))
            columns = list(zip(*rows)) or [()] * len(LEAK_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, LEAK_ARROW)], schema=LEAK_ARROW)

    both = hits.join(asked, same).select("doc_id", "_key", "text", "items")
    found = both.mapInArrow(lean(run), "doc_id long, _key long, item long, share double, first_word long, end_word long, reparameterised boolean").distinct()
    return found.join(named.select("item", "item_id"), "item").select("doc_id", "_key", "item_id", "share", "first_word", "end_word", "reparameterised")


LEAK_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("_key", pa.int64()), ("item", pa.int64()), ("share", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("reparameterised", pa.bool_())]
)


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of `docs` that hold no item of the benchmark, with their own columns."""
    found = stored(leaks(docs, benchmark, share).select("doc_id", "_key").distinct(), "leaks")
    held = docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64(docs["text"]) == found["_key"])
    return docs.join(found, held, "left_anti")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("_key")


QUERIES = {"op5_benchmark_decontamination": (op5_benchmark_decontamination, None)}
