"""Phrase collocations by direct-address tiling.

Words that occur often enough get ids by frequency, per language. Pairs of ids are counted in tiles: the pairs of the most
frequent ids in a grid of square tiles, each a dense array that `bincount` fills by address; all others in sparse tiles,
sorted coordinates with counts. Frequent pairs get ids by frequency in their turn, and the next word makes pairs of these
again: so three words are a pair of pairs' ids and words, and so on.

Texts are read once, into chunks of bounded size: a dictionary of words and a row of codes. Nothing of the corpus is
broadcast: a chunk asks for the ids of its own words by a join, later for the ids of its own pairs by tile. Counts of
chunks meet tile by tile in rounds of `FAN`, so that also a tile that every chunk fills is summed by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from webtables.llm.common import documents, full_text, stored
from webtables.llm.units import edges_of, slices

#: Bytes of text in a chunk, about.
CHUNK = 2 << 20
#: Ids on a side of a dense tile (2 to this power), and tiles on a side of the grid.
BITS, GRID = 11, 4
SIDE = 1 << BITS
#: Pairs in a dense tile from which a chunk counts it by address.
BY_ADDRESS = SIDE * SIDE // 32
#: Words of the corpus for each sparse tile; chunks whose counts meet in one task.
SPARSE, FAN = 8_000_000, 128
#: Bits of a word's id in a key; a phrase's id has the rest of 63.
WORD_BITS = 28

#: What becomes of each byte: A-Z in lower case, tabs as blanks, ends of pieces as line ends.
BYTES = np.arange(256, dtype=np.uint8)
BYTES[65:91] += 32
BYTES[9] = 32
BYTES[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 10


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from -1 on, in the smallest width that holds them."""
    most = int(values.max(initial=-1)) + 1
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w) or w == 8)
    narrow = values.astype(f"<u{width}")
    narrow += 1  # -1 wraps around to 0
    return bytes([width]) + zstandard.compress(narrow, 1)


def unpack(blob: bytes) -> np.ndarray:
    values = np.frombuffer(zstandard.decompress(memoryview(blob)[1:]), f"<u{blob[0]}").astype(np.int64)
    values -= 1
    return values


def rows_in(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows, one at a time: each holds a chunk or a tile."""
    return ({c: batch.column(c)[i].as_py() for c in batch.schema.names} for i in range(batch.num_rows))


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=0))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob))


def tokens(text: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of UTF-8 bytes, and which of them begin a piece."""
    text = BYTES[text]
    inside = (text != 32) & (text != 10)
    edges = edges_of(inside)
    starts, ends = edges[::2], edges[1::2]
    breaks = np.flatnonzero(text == 10)
    piece = np.searchsorted(breaks, starts)
    fresh = np.diff(piece, prepend=-1) != 0
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text[inside]))])
    return words, fresh


def with_breaks(codes: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Codes with -1 between pieces."""
    return np.insert(codes.astype(np.int64), np.flatnonzero(fresh), -1)


CHUNKS = "chunk long, lang string, tokens long, words array<string>, counts array<long>, codes binary"


def chunker(size: int):
    def row(chunk: int, lang: str, parts: list[bytes]) -> pa.RecordBatch:
        words, fresh = tokens(np.frombuffer(b"\n".join(parts), np.uint8))
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        counts = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int64)
        columns = [[chunk], [lang], [len(codes)], [coded.dictionary], [counts], [pack(with_breaks(codes, fresh))]]
        types = [pa.int64(), pa.string(), pa.int64(), None, None, pa.binary()]
        lists = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        columns = [lists(c[0] if isinstance(c[0], pa.Array) else pa.array(c[0])) if t is None else pa.array(c, t) for c, t in zip(columns, types)]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "lang", "tokens", "words", "counts", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        for batch in (some for whole in batches for some in slices(whole, "text", max(1, size // 4))):  # a batch may hold many chunks
            for lang in pc.unique(batch.column("lang")).to_pylist():
                texts = batch.column("text").filter(pc.equal(batch.column("lang"), lang))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0].as_buffer().to_pybytes()
                held.setdefault(lang, []).append(joined)
                sizes[lang] = sizes.get(lang, 0) + len(joined)
            while sum(sizes.values()) > 2 * size or max(sizes.values(), default=0) > size:
                lang = max(sizes, key=sizes.get)
                yield row(chunk, lang, held.pop(lang))
                del sizes[lang]
                chunk += 1
        for lang, parts in held.items():
            yield row(chunk, lang, parts)
            chunk += 1

    return run


def grade(n: Column) -> Column:
    """Classes of frequency, in the order of frequency: each count by itself, large ones 64 to a doubling."""
    return F.when(n < 1024, n).otherwise((F.floor(F.log2(n / 1024.0) * 64) + 1024).cast("long")).cast("long")


def grades(n: np.ndarray) -> np.ndarray:
    return np.where(n < 1024, n, np.floor(np.log2(np.maximum(n, 1) / 1024.0) * 64).astype(np.int64) + 1024)


def places(sizes: DataFrame) -> DataFrame:
    """lang, grade, part, skip: how many of the language come before, by falling grade, then part; `sizes` has their counts n."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda w: F.coalesce(F.sum("n").over(before(w)), F.lit(0))
    wholes = sizes.groupBy("lang", "grade").agg(F.sum("n").alias("n")).select("lang", "grade", upto(Window.partitionBy("lang").orderBy(F.desc("grade"))).alias("above"))
    parts = sizes.select("lang", "grade", "part", upto(Window.partitionBy("lang", "grade").orderBy("part")).alias("beside"))
    return parts.join(wholes, ["lang", "grade"]).select("lang", "grade", "part", (F.col("above") + F.col("beside")).alias("skip"))


def vocabulary(chunks: DataFrame, least: int) -> DataFrame:
    """lang, word, n, id of the words that occur `least` times, ids from 0 by falling frequency."""
    said = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    # words of one small count are many, so they are numbered in parts
    said = stored(said.filter(F.col("n") >= least).withColumn("grade", grade(F.col("n"))).withColumn("part", F.when(F.col("n") < 1024, F.pmod(F.xxhash64("word"), F.lit(64))).otherwise(0).cast("long")), "phrase-words")
    skip = places(said.groupBy("lang", "grade", "part").agg(F.count("*").alias("n")))
    inside = F.row_number().over(Window.partitionBy("lang", "grade", "part").orderBy(F.desc("n"), "word")) - 1
    return said.withColumn("_at", inside).join(skip, ["lang", "grade", "part"]).select("lang", "word", "n", (F.col("_at") + F.col("skip")).cast("long").alias("id"))


def known_words(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """chunk, lang, tokens, ids: each chunk's words as ids, -1 for rare words and between pieces."""
    asked = chunks.select("chunk", "lang", F.posexplode("words").alias("code", "word"))
    told = asked.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("chunk").alias("asks"), "code", "id")

    def ids(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = unpack(left["codes"][0].as_py())
        of = np.full(int(codes.max(initial=-1)) + 2, -1, np.int64)  # the last one for -1
        of[right["code"].to_numpy()] = right["id"].to_numpy()
        blob = pack(of[codes])
        return pa.table({"chunk": left["chunk"], "lang": left["lang"], "tokens": left["tokens"], "ids": pa.array([blob], pa.binary())})

    by_chunk = chunks.select("chunk", "lang", "tokens", "codes").groupBy("chunk")
    return by_chunk.cogroup(told.groupBy("asks")).applyInArrow(ids, "chunk long, lang string, tokens long, ids binary")


def tile_counts(a: np.ndarray, b: np.ndarray, sparse: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(tile, sorted keys, counts) of pairs: dense tiles by their number in the grid, sparse ones after them."""
    tile = np.where((a < GRID * SIDE) & (b < GRID * SIDE), (a >> BITS) * GRID + (b >> BITS), GRID * GRID).astype(np.uint8)
    *dense, rest = np.bincount(tile, minlength=GRID * GRID + 1)
    for t, n in enumerate(dense):
        if n:
            own = tile == t
            key = ((a[own] & (SIDE - 1)) << BITS) | (b[own] & (SIDE - 1))
            if n >= BY_ADDRESS:
                counts = np.bincount(key, minlength=SIDE * SIDE)
                keys = np.flatnonzero(counts)
                yield t, keys, counts[keys]
            else:
                yield t, *np.unique(key, return_counts=True)
    if rest:
        own = tile == GRID * GRID
        keys, counts = np.unique((a[own] << WORD_BITS) | b[own], return_counts=True)
        block = (keys >> (WORD_BITS + BITS)) * 40_503 + ((keys & ((1 << WORD_BITS) - 1)) >> BITS) * 10_007
        part = (block ^ (block >> 7)) % sparse
        for p in np.unique(part):
            yield GRID * GRID + int(p), keys[part == p], counts[part == p]


def ends(tile: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that the keys of a tile stand for."""
    if tile < GRID * GRID:
        return (keys >> BITS) + (tile // GRID) * SIDE, (keys & (SIDE - 1)) + (tile % GRID) * SIDE
    return keys >> WORD_BITS, keys & ((1 << WORD_BITS) - 1)


COUNTED = "chunk long, lang string, tile long, keys binary, counts binary"


def table_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def counter(words: int, sparse: dict[str, int]):
    """Pairs of a phrase of `words` - 1 words and the word behind it, in each chunk; both the phrase and the one that ends with that word are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_in(batch):
                phrases, ids = unpack(row["phrases"]), unpack(row["ids"])
                a, b = phrases[: 1 - words], ids[words - 1 :]
                good = (a >= 0) & (phrases[1 : len(a) + 1] >= 0) & (b >= 0)
                if good.any() and (int(ids.max()) >> WORD_BITS or int(phrases.max()) >> (63 - WORD_BITS)):
                    raise OverflowError("more words or phrases than keys can tell apart")
                a, b = a[good], b[good]
                chunk, lang = row["chunk"], row["lang"]
                del phrases, ids, good, row
                for tile, keys, counts in tile_counts(a, b, sparse[lang]):
                    yield table_of(COUNTED, [(chunk, lang, tile, pack_keys(keys), pack(counts))])

    return run


def summed(tile: int, blobs: Iterator[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    if tile < GRID * GRID:
        total = np.zeros(SIDE * SIDE, np.int64)
        for keys, counts in blobs:
            total[unpack_keys(keys)] += unpack(counts)
        keys = np.flatnonzero(total)
        return keys, total[keys]
    held, more = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0
    for blob in blobs:
        held.append((unpack_keys(blob[0]), unpack(blob[1])))
        more += len(held[-1][0])
        if 2 * more >= len(held[0][0]):  # the sum so far is sorted again only when it has grown by half
            held, more = [added(held)], 0
    return added(held)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of sorted batches by equal `names`; each group must be used up before the next."""
    from itertools import groupby

    rows = (row for batch in batches for row in rows_in(batch))
    return groupby(rows, lambda r: tuple(r[n] for n in names))


def total(counted: DataFrame, chunks: dict[str, int], least: int) -> DataFrame:
    """lang, tile, keys, counts of all chunks together, those of `least` and more; `chunks`: how many each language has."""
    most = max(chunks.values(), default=1)
    while True:
        most = -(-most // FAN)
        least_now = least if most == 1 else 1

        def add(batches: Iterator[pa.RecordBatch], least_now: int = least_now) -> Iterator[pa.RecordBatch]:
            for (lang, tile, part), rows in groups(batches, ["lang", "tile", "part"]):
                keys, counts = summed(tile, ((r["keys"], r["counts"]) for r in rows))
                often = counts >= least_now
                if often.any():
                    yield table_of(COUNTED, [(part, lang, tile, pack_keys(keys[often]), pack(counts[often]))])

        keyed = counted.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(most)).cast("long"))
        ordered = keyed.select("lang", "tile", "part", "keys", "counts").repartition("lang", "tile", "part").sortWithinPartitions("lang", "tile", "part")
        counted = stored(ordered.mapInArrow(add, COUNTED), "phrase-sums")
        if most == 1:
            return counted.select("lang", "tile", "keys", "counts")


RANKED = "lang string, tile long, keys binary, counts binary, ids binary"


def ranked(frequent: DataFrame) -> DataFrame:
    """Tiles with an id for each pair, from 0 by falling frequency over all tiles of a language."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_in(batch):
                found, n = np.unique(grades(unpack(row["counts"])), return_counts=True)
                yield table_of("lang string, grade long, part long, n long", [(row["lang"], int(g), row["tile"], int(c)) for g, c in zip(found, n)])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_in(batch):
                of = grades(unpack(row["counts"]))
                order = np.argsort(-of, kind="stable")
                found, start, n = np.unique(-of[order], return_index=True, return_counts=True)
                skip = {g["grade"]: g["skip"] for g in row["skips"]}
                ids = np.empty(len(of), np.int64)
                for g, s, c in zip(found.tolist(), start.tolist(), n.tolist()):
                    ids[order[s : s + c]] = skip[-g] + np.arange(c)
                yield table_of(RANKED, [(row["lang"], row["tile"], row["keys"], row["counts"], pack(ids))])

    skips = places(frequent.select("lang", "tile", "counts").mapInArrow(sizes, "lang string, grade long, part long, n long"))
    by_tile = skips.groupBy("lang", F.col("part").alias("tile")).agg(F.collect_list(F.struct("grade", "skip")).alias("skips"))
    return stored(frequent.join(by_tile, ["lang", "tile"]).mapInArrow(number, RANKED), "phrase-ranks")


def pair_rows(tiles: DataFrame) -> DataFrame:
    """lang, a, b, n, id of every pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_in(batch):
                a, b = ends(row["tile"], unpack_keys(row["keys"]))
                columns = [a, b, unpack(row["counts"]), unpack(row["ids"])]
                for i in range(0, len(a), 100_000):
                    part = [pa.array(c[i : i + 100_000]) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(part[0]), pa.string()), *part], names=["lang", "a", "b", "n", "id"])

    return tiles.mapInArrow(run, "lang string, a long, b long, n long, id long")


def known_phrases(chunks: DataFrame, counted: DataFrame, tiles: DataFrame, words: int, of: dict[str, int]) -> DataFrame:
    """`chunks` with the ids of their frequent phrases of `words` words where each begins, else -1.

    A tile goes once to each group of `FAN` chunks that counted pairs in it; their answers go back to the chunks.
    """
    parts = F.coalesce(*(F.when(F.col("lang") == lang, -(-n // FAN)) for lang, n in of.items()), F.lit(1)) if len(of) <= 50 else F.lit(-(-max(of.values()) // FAN))
    asked = counted.select("lang", "tile", F.pmod(F.xxhash64("chunk"), parts.cast("long")).alias("part"), "chunk", "keys", F.lit(None).cast("binary").alias("ids"))
    told = tiles.select("lang", "tile", F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("part"), F.lit(None).cast("long").alias("chunk"), "keys", "ids")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, tile, _), rows in groups(batches, ["lang", "tile", "part"]):
            keys, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for row in rows:  # the tile comes first
                if row["chunk"] is None:
                    keys, ids = unpack_keys(row["keys"]), unpack(row["ids"])
                    continue
                if not len(keys):
                    continue
                own = unpack_keys(row["keys"])
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[at] == own
                if hit.any():
                    yield table_of("asks long, tile long, keys binary, ids binary", [(row["chunk"], tile, pack_keys(own[hit]), pack(ids[at[hit]]))])

    ordered = asked.unionByName(told).repartition("lang", "tile", "part").sortWithinPartitions("lang", "tile", "part", F.col("chunk").asc_nulls_first())
    answers = ordered.mapInArrow(answer, "asks long, tile long, keys binary, ids binary")

    def ids(left: pa.Table, right: pa.Table) -> pa.Table:
        old, word = unpack(left["phrases"][0].as_py()), unpack(left["ids"][0].as_py())
        keys, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row in right.to_pylist():
            a, b = ends(row["tile"], unpack_keys(row["keys"]))
            keys.append((a << WORD_BITS) | b)
            found.append(unpack(row["ids"]))
        keys, found = np.concatenate(keys), np.concatenate(found)
        new = np.full(len(old), -1, np.int64)
        a, b = old[: 1 - words], word[words - 1 :]
        good = np.flatnonzero((a >= 0) & (b >= 0)) if len(b) else np.zeros(0, np.int64)
        if len(good) and len(keys):
            at = pc.index_in(pa.array((a[good] << WORD_BITS) | b[good]), pa.array(keys))
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            new[good[hit]] = found[at.drop_null().to_numpy()]
        return pa.table({"chunk": left["chunk"], "lang": left["lang"], "tokens": left["tokens"], "ids": left["ids"], "phrases": pa.array([pack(new)], pa.binary())})

    return chunks.groupBy("chunk").cogroup(answers.groupBy("asks")).applyInArrow(ids, "chunk long, lang string, tokens long, ids binary, phrases binary")


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of every phrase of 1 to `longest` words that occurs `least` times, and (lang, total) of all words.

    Case of A-Z does not count; pieces end at `.,;:!?` and line ends, words at blanks and tabs; occurrences may overlap.
    Null texts are empty, a null lang is `und`; repeated rows count each time. Texts are never cut, whatever their length.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), full_text().alias("text"))
    chunks = stored(texts.mapInArrow(chunker(chunk), CHUNKS), "phrase-chunks")
    totals = stored(chunks.groupBy("lang").agg(F.sum("tokens").alias("total"), F.count("*").alias("chunks")), "phrase-totals")
    sizes = {r["lang"]: (r["total"], r["chunks"]) for r in totals.collect()}  # languages
    of, sparse = {lang: n for lang, (_, n) in sizes.items()}, {lang: -(-max(1, t) // SPARSE) for lang, (t, _) in sizes.items()}
    words = stored(vocabulary(chunks, least), "phrase-vocabulary")
    known = stored(known_words(chunks, words), "phrase-ids").withColumn("phrases", F.col("ids"))
    levels = [words.select("lang", "id", F.col("word").alias("phrase"), F.lit(1).alias("k"), F.col("n").alias("f"))]
    for k in range(2, longest + 1):
        counted = stored(known.mapInArrow(counter(k, sparse), COUNTED), "phrase-pairs")
        tiles = ranked(total(counted, of, least))
        pairs = pair_rows(tiles).join(levels[-1].select("lang", F.col("id").alias("a"), F.col("phrase").alias("begin")), ["lang", "a"])
        pairs = pairs.join(levels[0].select("lang", F.col("id").alias("b"), F.col("phrase").alias("end")), ["lang", "b"])
        levels.append(stored(pairs.select("lang", "id", F.concat_ws(" ", "begin", "end").alias("phrase"), F.lit(k).alias("k"), F.col("n").alias("f")), "phrase-level"))
        if k < longest:
            # stored, so that no task has the Python workers of this step and of the next count at once
            known = stored(known_phrases(known, counted, tiles, k, of), "phrase-ids")
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.select("lang", "phrase", "k", "f"), totals.select("lang", "total")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2_000, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to `longest` words, as `phrase_counts` counts them.

    A phrase is scored by its weakest cut into a first part (l times) and a rest (r times): floor(1,000,000 a a / (l r)),
    exact up to 10^15 occurrences; of equal cuts the first counts. A phrase goes if a longer one that contains it occurs
    at least `share` percent as often. Order: score, then a, both falling, then the phrase's bytes. An empty table has none.
    """
    counts, totals = phrase_counts(docs, longest, least, chunk)
    several = counts.filter("k > 1").withColumn("words", F.split("phrase", " "))
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = several.select("lang", "phrase", "k", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    f = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    cuts = cuts.join(f("first", "l"), ["lang", "first"]).join(f("rest", "r"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("a15", wide("a")).withColumn("l15", wide("l")).withColumn("r15", wide("r"))
    cuts = cuts.withColumn("score", F.expr("(CAST(1000000 AS DECIMAL(7,0)) * (a15 * a15)) div (l15 * r15)").cast("long"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"))
    # the most that a longer phrase has of each phrase inside it
    inner = several.filter("k > 2").select("lang", "f", "k", "words", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("n"))
    inner = inner.select("lang", "f", "n", "words", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("n") + 1)).alias("at"))
    inner = inner.groupBy("lang", part(F.col("at"), F.col("n")).alias("phrase")).agg(F.max("f").alias("inside"))
    scored = scored.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("inside") < share * F.col("a"), F.lit(True)))
    rows = scored.select("lang", "phrase", "a", "least.l", "least.r", "least.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each part, then the first of these
    some = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    best = some.filter(F.col("_at") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals.withColumnRenamed("total", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir).select("lang", "text"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
said AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM lists UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lists UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lists),
f AS (SELECT lang, k, phrase, count(*) AS f FROM said GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
several AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, f AS a, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS rest FROM several UNION ALL
  SELECT lang, phrase, f, 2, w[1] || ' ' || w[2], w[3] FROM several WHERE k = 3),
scored AS (
  SELECT c.*, x.f AS l, y.f AS r, (1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, phrase, max(f) AS inside FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM several WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM several WHERE k = 3)
  GROUP BY lang, phrase),
kept AS (SELECT w.* FROM weakest w LEFT JOIN inner_ i ON i.lang = w.lang AND i.phrase = w.phrase WHERE i.inside IS NULL OR 100 * i.inside < 50 * w.a),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT p.lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM placed p JOIN totals t ON t.lang = p.lang WHERE rank <= 2000
"""

QUERIES = {"op13_phrase_collocations": (op13_phrase_collocations, OP13_SQL)}
