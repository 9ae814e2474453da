"""Token ids in binary files of patched frame-of-reference blocks.

A file holds segments in document order, each with at least one whole document and about a million ids. A segment is
magic, number of ids, number of blocks, the start of every block, then the blocks. A block has 128 ids: its minimum;
the width, in bits, that a given share of the differences from the minimum fit; the low bits of all differences,
packed at that width; and a list of exceptions, positions and whole differences, for those that do not fit.

The files are written through Spark as Parquet, one row per segment with the bytes as a binary column and the ids and
lengths of its documents beside them, so that any store works and a failed task leaves nothing behind.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from webtables.llm.common import documents
from webtables.llm.units import PATTERN, Units, byte_symbols, slices
from webtables.session import scratch_path

MAGIC = b"PFR1"
BLOCK = 128
LANES = 64  # values that fill a whole number of 64-bit words at any width
#: Share of a block's differences that its width fits.
FITTING = 0.9
#: Ids after which a segment ends with the document.
SEGMENT = 1 << 20


# blocks


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values (uint64, each below 2 ** width) as rows of BLOCK * width / 8 bytes, first value lowest."""
    lanes = np.ascontiguousarray(values.reshape(-1, LANES).T)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(LANES):
        word, shift = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").reshape(len(values), -1).view(np.uint8)


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """The inverse of `pack`."""
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(-1, width).T)
    lanes, mask = np.empty((LANES, words.shape[1]), np.uint64), np.uint64((1 << width) - 1)
    for i in range(LANES):
        word, shift = divmod(i * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | words[word + 1] << np.uint64(64 - shift)
        lanes[i] = value & mask
    return np.ascontiguousarray(lanes.T).reshape(len(packed), BLOCK)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)  # exact: values have 32 bits at most


HEAD = 6  # of a block: minimum (4 bytes), width, number of exceptions


def write_segment(ids: np.ndarray, fitting: float = FITTING) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    if n:
        full[n:] = ids[-1]  # fills the last block without widening it
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    over = full - low[:, None]
    at = max(0, int(np.ceil(fitting * BLOCK)) - 1)
    widths = bit_lengths(np.partition(over, at, axis=1)[:, at])
    odd = over > ((1 << widths) - 1).astype(np.uint32)[:, None]
    exceptions = odd.sum(axis=1)
    packed_bytes = widths * BLOCK // 8
    sizes = HEAD + packed_bytes + 5 * exceptions
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.zeros(int(ends[-1]) if blocks else 0, np.uint8)
    out[starts[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[starts + 4], out[starts + 5] = widths, exceptions
    for width in np.unique(widths[widths > 0]).tolist():
        which = np.flatnonzero(widths == width)
        kept = over[which].astype(np.uint64) & np.uint64((1 << width) - 1)
        out[starts[which][:, None] + (HEAD + np.arange(BLOCK * width // 8))] = pack(kept, width)
    block, position = np.nonzero(odd)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    lists = starts + HEAD + packed_bytes
    out[lists[block] + rank] = position
    out[(lists[block] + exceptions[block] + 4 * rank)[:, None] + np.arange(4)] = over[block, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    return MAGIC + struct.pack("<II", n, blocks) + starts.astype("<u4").tobytes() + out.tobytes()


def read_segment(data: bytes) -> np.ndarray:
    """The ids of a segment, as little-endian 32-bit integers."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n, blocks = struct.unpack_from("<II", data, 4)
    starts = np.frombuffer(data, "<u4", blocks, 12).astype(np.int64)
    body = np.frombuffer(data, np.uint8, offset=12 + 4 * blocks)
    number = lambda at: np.ascontiguousarray(body[at[:, None] + np.arange(4)]).view("<u4").ravel()
    low, widths, exceptions = number(starts), body[starts + 4].astype(np.int64), body[starts + 5].astype(np.int64)
    over = np.zeros((blocks, BLOCK), np.uint32)
    for width in np.unique(widths[widths > 0]).tolist():
        which = np.flatnonzero(widths == width)
        over[which] = unpack(body[starts[which][:, None] + (HEAD + np.arange(BLOCK * width // 8))], width)
    block = np.repeat(np.arange(blocks), exceptions)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    lists = starts + HEAD + widths * BLOCK // 8
    over[block, body[lists[block] + rank]] = number(lists[block] + exceptions[block] + 4 * rank)
    return (over + low[:, None]).ravel()[:n].astype("<u4")


# ids


class Library:
    """Ids of units from the tokenizers library.

    Simple units are single words already, so the library's model gets them as they are, in the characters that its
    byte-level step would make of them; odd ones, and all of a tokenizer whose words are not known, go through all steps.
    """

    def __init__(self, library: Tokenizer):
        self.library = library
        library.no_truncation()
        library.no_padding()
        self.model = library.model
        held = json.loads(library.to_str())
        steps = [held["normalizer"] or {}, *(held["normalizer"] or {}).get("normalizers", [])]
        cuts = [held["pre_tokenizer"] or {}, *(held["pre_tokenizer"] or {}).get("pretokenizers", [])]
        known = (
            held["model"]["type"] == "BPE"
            and {x.get("type") for x in cuts} == {"Sequence", "Split", "ByteLevel"}
            and PATTERN in [x.get("pattern", {}).get("Regex") for x in cuts]
            and not any(x.get("add_prefix_space") for x in cuts)
            and any(x.get("type") == "Lowercase" for x in steps)
        )
        self.shown = {b: s for s, b in byte_symbols().items()}
        self.units = Units(self.learn, known)

    def words(self, units: pa.Array) -> list[list[int]]:
        as_bytes = lambda word: word.lower().encode().decode("latin-1").translate(self.shown)
        tokens = self.model.tokenize
        return [[t.id for t in tokens(word if word.isascii() else as_bytes(word))] for word in units.cast(pa.string()).to_pylist()]

    def learn(self, units: pa.Array, odd: bool) -> tuple[np.ndarray, np.ndarray]:
        whole = lambda unit: self.library.encode(unit.decode(), add_special_tokens=False).ids
        each = list(map(whole, units.to_pylist())) if odd else self.words(units)
        return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))


#: Of this worker: tokenizer (as JSON) -> its units.
WORKERS: dict[str, Units] = {}


def units_of(tokenizer: Broadcast) -> Units:
    if tokenizer.value not in WORKERS:
        WORKERS.clear()
        WORKERS[tokenizer.value] = Library(Tokenizer.from_str(tokenizer.value)).units
    return WORKERS[tokenizer.value]


SEGMENTS = "part int, seq long, doc_ids array<bigint>, counts array<bigint>, n long, data binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, fitting: float = FITTING) -> None:
    """Encode whole texts (null: empty), end each document with `end_id`, write them to `path` by ascending doc_id.

    A null doc_id comes first; rows that repeat a doc_id are documents of their own, by text. An empty table gives
    files without segments.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = docs.sparkSession.sparkContext.broadcast(file.read())  # bounded: the vocabulary
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, part = units_of(tokenizer), TaskContext.get().partitionId()
        seq, held, size, doc_ids = 0, [], 0, []

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            columns = [[part], [seq], [doc_ids], [[len(x) // 4 for x in held]], [len(ids)], [write_segment(ids, fitting)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        for batch in (some for whole in batches for some in slices(whole, "text")):
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), units.encode([t or b"" for t in batch["text"].to_pylist()])):
                doc_ids.append(doc_id)
                held.append(ids + end)
                size += len(held[-1]) // 4
                if size >= SEGMENT:
                    yield segment()
                    seq, held, size, doc_ids = seq + 1, [], 0, []
        if held:
            yield segment()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = read_segment(batch["data"][row].as_py()).tobytes()
                counts = batch["counts"][row].values.to_numpy()
                ends = np.cumsum(counts) * 4
                sums = [zlib.crc32(memoryview(ids)[e - 4 * c : e]) for e, c in zip(ends.tolist(), counts.tolist())]
                of = lambda name: pa.array([batch[name][row].as_py()] * len(counts), batch[name].type)
                yield pa.RecordBatch.from_arrays(
                    [of("part"), of("seq"), batch["doc_ids"][row].values, pa.array(ends // 4 - counts), pa.array(counts), pa.array(sums, pa.int64())],
                    ["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    segments = spark.read.schema(SEGMENTS).parquet(path)
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sizes = segments.select("part", "seq", "n")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # one row per file
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(F.lit(0)).orderBy("part")), F.lit(0)).alias("of_part"))
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n").over(before("part").orderBy("seq")), F.lit(0)).alias("of_segment"))
    starts = starts.join(parts, "part").select("part", "seq", (F.col("of_part") + F.col("of_segment")).alias("first"))
    found = segments.select("part", "seq", "doc_ids", "counts", "data").mapInArrow(run, "part int, seq long, doc_id long, within long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2, path)
    return read_token_files(spark, path)


QUERIES = {"op7_token_files": (op7_token_files, None)}
