"""BPE encoding and decoding by an automaton over tokens, compiled from the merges.

The automaton starts with one state in which any base symbol (a byte, or a byte that ends a word) may follow any other.
Each merge (a, b) -> c, in order, inserts a gadget: arcs labelled a now lead to a copy of their state that lacks the
arc b, and every state with an arc a gets an arc c to where b led. In the end it accepts exactly one token sequence of
every word: the one that BPE gives. States are not copied in full: all arcs of one label lead to the same state, so a
state is known by that label, and what it lacks by its own gadgets and, before they came, by those of the state it was
copied from. Whether a state has an arc is read from the gadgets once, then from the table of transitions.

Encoding follows arcs whose labels spell the word; decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from webtables.llm.common import documents, free_name, lean, widened
from webtables.llm.units import PATTERN, Units, byte_symbols, slices

#: Entries of a worker's table of transitions before it starts anew (two numbers each).
TRANSITIONS = 1_000_000
#: Ids that are decoded at a time.
PIECE = 1 << 18
#: Bytes of texts that are encoded at a time, and bytes of units that a worker remembers; both halve what one needs beside the tables.
TOGETHER, HELD = 2 << 20, 12 << 20
START = -1
NEVER = 1 << 60
#: Below this code point, splitting in Python agrees with the tokenizers library whatever Unicode versions they know.
PLAIN = "ɐ"


class Automaton:
    """Deterministic automaton over token ids; its only accepted spelling of a word is the word's BPE tokens."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        to_byte = byte_symbols()
        self.size = max(vocabulary.values()) + 1
        self.inner: dict[str, int] = {}  # spelling (a byte as one character) -> token within a word
        self.final: dict[str, int] = {}  # the same, of tokens that end a word
        made = [0] * self.size  # the step at which an arc label came to be; 0: base symbol
        left, copied = [START] * self.size, [START] * self.size
        self.made, self.left, self.copied, self.lacks = made, left, copied, {}
        arcs = {t for s, t in vocabulary.items() if len(s.removesuffix(suffix)) == 1}
        for step, (a, b) in enumerate(merges, 1):
            x, y, z = vocabulary[a], vocabulary[b], vocabulary[a.removesuffix(suffix) + b]
            if x not in arcs or y not in arcs or not self.leads(x, y):
                continue  # earlier merges never leave the two side by side
            if z in arcs:
                raise ValueError(f"two merges make {a + b!r}")
            arcs.add(z)
            self.lacks[x * self.size + y] = step
            made[z], left[z], copied[z] = step, x, y
        for spelling, token in vocabulary.items():
            if token in arcs:
                bare = spelling.removesuffix(suffix)
                (self.final if spelling != bare else self.inner)["".join(chr(to_byte[c]) for c in bare)] = token
        self.longest = max(map(len, [*self.inner, *self.final]))

    def lost(self, state: int, arc: int) -> int:
        """The step at which the state lost the arc."""
        before, size = NEVER, self.size
        while state != START:
            step = self.lacks.get(state * size + arc, NEVER)
            if step < before:
                return step
            before, state = min(before, self.made[state]), self.copied[state]
        return NEVER

    def leads(self, state: int, arc: int) -> bool:
        """Whether the state has the arc: it never lost it, and had the arc beside which it was made when that came.

        A merge of a symbol with itself takes the arc from its state before it adds the new one, hence <=.
        """
        step = NEVER - 1
        while True:
            if self.lost(state, arc) <= step:
                return False
            step = self.made[arc]
            if step == 0:
                return True
            arc = self.left[arc]


class Encoder:
    """Text to ids as the tokenizers library gives them, for tokenizers of the kind of `word_bpe_49k.json`.

    It is broadcast: its size is that of the vocabulary file. Workers keep what they have found about chunks.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.json = file.read()
        held = json.loads(self.json)
        model = held["model"]
        vocabulary = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(vocabulary, merges, model["end_of_word_suffix"])
        self.special = {x["content"]: x["id"] for x in held["added_tokens"]}
        names = {i: s for s, i in (vocabulary | self.special).items()}
        self.labels = [names.get(i, "").encode() for i in range(max(names) + 1)]
        pattern = next(x["pattern"]["Regex"] for x in held["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern, self.to_byte = pattern, byte_symbols()
        self._forget()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("json", "automaton", "special", "labels", "pattern", "to_byte")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self.library = None
        self.words = regex.compile(self.pattern)
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.table: dict[int, bool] = {}
        self.units = Units(self.learn, self.pattern == PATTERN, HELD)

    # words

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk without special tokens, a byte as one character."""
        if chunk.isascii() or max(chunk) < PLAIN:
            return [w.encode().decode("latin-1") for w in self.words.findall(chunk.lower())]
        if self.library is None:  # the library's own Unicode tables
            self.library = Tokenizer.from_str(self.json)
        whole = self.library.normalizer.normalize_str(chunk)
        return ["".join(chr(self.to_byte[c]) for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(whole)]

    def arcs(self, word: str, at: int, state: int) -> Iterator[tuple[int, int]]:
        """Ends and labels of the arcs that the state has and the word goes on with, the longest first."""
        n, table, automaton = len(word), self.table, self.automaton
        for end in range(min(n, at + automaton.longest), at, -1):
            token = (automaton.final if end == n else automaton.inner).get(word[at:end])
            if token is not None:
                if state != START:
                    key = state * automaton.size + token
                    leads = table.get(key)
                    if leads is None:
                        if len(table) >= TRANSITIONS:
                            table.clear()
                        leads = table[key] = automaton.leads(state, token)
                    if not leads:
                        continue
                yield end, token

    def word(self, word: str) -> list[int]:
        """The tokens of the one path that spells the word."""
        path, ways, dead = [], [self.arcs(word, 0, START)], set()
        while True:
            for step in ways[-1]:
                if step not in dead:
                    break
            else:  # no arc goes on from here
                ways.pop()
                dead.add(path.pop())
                continue
            path.append(step)
            if step[0] == len(word):
                return [t for _, t in path]
            ways.append(self.arcs(word, *step))

    def learn(self, units: pa.Array, odd: bool) -> tuple[np.ndarray, np.ndarray]:
        each = list(map(self.chunk if odd else self.simple, units.to_pylist()))
        return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def chunk(self, chunk: bytes) -> list[int]:
        ids: list[int] = []
        for part in self.specials.split(chunk.decode()):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for word in self.split(part):
                    ids += self.word(word)
        return ids

    def simple(self, unit: bytes) -> list[int]:
        """The ids of a run of letters, of a digit or of a run of signs: it is one word."""
        word = unit.decode("latin-1") if unit.isascii() else unit.decode().lower().encode().decode("latin-1")
        return self.word(word)

    def encode_all(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers; no token, word or rule reaches over a unit's ends."""
        return self.units.encode(texts)

    def encode(self, text: bytes) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> Iterator[bytes]:
        """The labels of the ids with a space between them, in pieces."""
        labels, every = self.labels, np.frombuffer(ids, "<u4")
        for at in range(0, len(every), PIECE):
            yield (b" " if at else b"") + b" ".join(map(labels.__getitem__, every[at : at + PIECE].tolist()))


def shared_encoder(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(Encoder(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with `ids` (array of int) more, from whole texts, however long; null and empty texts have none.

    A column that has this name already is kept, the new one gets underscores in front.
    """
    encoder, name = shared_encoder(docs.sparkSession, path), free_name(docs, "ids")
    text = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in slices(whole, text, TOGETHER)):
            coded = encoder.value.encode_all([(t or "").encode() for t in batch.column(text).to_pylist()])
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in coded]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, name])

    return docs.mapInArrow(lean(run), widened(docs, name, "array<int>"))


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`rows` with `decoded` more: the text that the tokens in `ids` stand for, null if ids is null."""
    encoder, name = shared_encoder(rows.sparkSession, path), free_name(rows, "decoded")
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else b"".join(encoder.value.decode(np.array(x, "<u4").tobytes())).decode() for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, widened(rows, name, "string"))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the sha256 of ids and of decoded text; neither is ever held for more than one document."""
    encoder = shared_encoder(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in slices(whole, "text", TOGETHER)):
            counts, coded, decoded = [], [], []
            for ids in encoder.value.encode_all([t or b"" for t in batch["text"].to_pylist()]):
                digest = hashlib.sha256()
                for piece in encoder.value.decode(ids):
                    digest.update(piece)
                counts.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op6_bpe_automaton": (op6_bpe_automaton, None)}
