"""Many texts at a time to the stretches that a tokenizer treats alone, each different one looked at once.

A unit is a run of letters, a digit, or a run of signs, between which the tokenizers library cuts whatever stands beside
them; a stretch between white space with anything else in it (apostrophes, `<`, letters that are not Latin, signs
beyond ASCII) is one unit as a whole. Splitting, counting and placing is done on the bytes of all texts together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
#: Fixed value: the words of the tokenizers whose units are known; they have lower case, too.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: What each byte is. Lead bytes 0xC3 to 0xC8 begin Latin letters, which are in their Unicode normal form; the others are odd.
KIND = np.full(256, ODD, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[[ord(c) for c in "'<"]] = ODD
KIND[[ord(c) for c in " \t\n\r\v\f"]] = SPACE
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[ord("A") : ord("Z") + 1] = KIND[ord("a") : ord("z") + 1] = LETTER
KIND[0x80:0xC0] = KIND[0xC3:0xC9] = LETTER
#: The characters in that range that are no letters or have no lower case of one letter: lead byte, second byte.
EXCEPT = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of texts that are split at a time, and of one unit that is worth remembering.
TOGETHER, LONG = 4 << 20, 64
#: Bytes that a worker remembers, and of them for each unit besides the unit and its ids (offsets, lengths, hits).
HELD, OVERHEAD = 24 << 20, 24


def byte_symbols() -> dict[str, int]:
    """Vocabulary symbol -> byte: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def edges_of(inside: np.ndarray) -> np.ndarray:
    """Where runs of true values begin and end, in turn: `np.diff` would make eight bytes of each value."""
    change = np.empty(len(inside) + 1, bool)
    change[0], change[-1] = (inside[0], inside[-1]) if len(inside) else (False, False)
    np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    return np.flatnonzero(change)


def split(raw: bytes, finer: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The units of UTF-8 bytes that end with white space: values (ASCII in lower case, unless odd), starts, and which are odd.

    Without `finer` every stretch between white space is a unit as it is.
    """
    text = np.frombuffer(raw, np.uint8)
    kind = np.frombuffer(bytearray(raw.translate(KIND.tobytes())), np.uint8)
    if finer:
        for lead, second in EXCEPT:
            if bytes([lead, second]) in raw:
                at = np.flatnonzero(text == lead)
                kind[at[text[at + 1] == second]] = ODD
    strange = np.flatnonzero(kind == ODD) if finer else np.zeros(0, np.int64)
    inside = kind != SPACE
    lower = np.frombuffer(raw.translate(LOWER.tobytes()), np.uint8)
    if len(strange) or not finer:  # a stretch with anything odd in it is odd as a whole
        edges = edges_of(inside)
        if finer:
            which = np.unique(np.searchsorted(edges, strange, "right") - 1)
            mark = np.zeros(len(text), np.int8)
            mark[edges[which]] = 1
            mark[edges[which + 1]] -= 1
            whole = np.cumsum(mark, dtype=np.int8).view(bool)
        else:
            whole = inside
        kind[whole] = ODD
        lower = np.where(whole, text, lower)
    new = kind[1:] != kind[:-1]
    new |= kind[1:] == DIGIT
    starts = np.flatnonzero(np.concatenate([inside[:1], new & inside[1:]]))
    ends = np.flatnonzero(new & inside[:-1]) + 1
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(lower[inside])]), starts, kind[starts] == ODD


def spread(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units one after the other, from those of the different units, and where each unit's end."""
    first, own = np.cumsum(lengths) - lengths, lengths[codes]
    upto = np.cumsum(own)
    total = int(upto[-1]) if len(upto) else 0
    return ids[np.repeat(first[codes] - (upto - own), own) + np.arange(total)], upto


def slices(batch: pa.RecordBatch, column: int | str, size: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """A batch in pieces whose texts have about `size` bytes together, so that little of it is held as Python objects."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        before = int(upto[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(upto, before + size, "right")))
        yield batch.slice(first, end - first)
        first = end


class Units:
    """Texts to ids, with a memory of units that is bounded in bytes.

    `learn` gives the ids and their number for units, odd ones or others. What it has given is remembered; when the memory
    is full, the half that was asked for least goes. Long units are not kept.
    """

    def __init__(self, learn: Callable[[pa.Array, bool], tuple[np.ndarray, np.ndarray]], finer: bool = True, held: int = HELD):
        self.learn, self.finer, self.most = learn, finer, held
        self.known = pa.array([], pa.binary())
        self.ids, self.lengths, self.hits = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def size(self) -> int:
        return self.known.nbytes + self.ids.nbytes + OVERHEAD * len(self.known)

    def remember(self, units: pa.Array, ids: np.ndarray, lengths: np.ndarray, hits: np.ndarray) -> None:
        short = np.flatnonzero(pc.binary_length(units).to_numpy() <= LONG)
        ids, _ = spread(ids, lengths, short)
        self.known = pa.concat_arrays([self.known, units.take(pa.array(short))])
        self.ids, self.lengths, self.hits = np.r_[self.ids, ids], np.r_[self.lengths, lengths[short]], np.r_[self.hits, hits[short]]
        while self.size() > self.most:
            keep = np.sort(np.argsort(-self.hits, kind="stable")[: len(self.hits) // 2])
            self.known = pa.concat_arrays([self.known.take(pa.array(keep))])
            self.ids, _ = spread(self.ids, self.lengths, keep)
            self.lengths, self.hits = self.lengths[keep], self.hits[keep] // 2

    def together(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text, all texts at once."""
        values, starts, odd = split(b"\n".join(texts) + b"\n", self.finer)
        ends = np.cumsum([len(t) + 1 for t in texts])
        found = pc.index_in(values, self.known)
        codes = found.fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(codes < 0)
        ids, lengths = self.ids, self.lengths
        known = len(lengths)
        if len(new):
            coded = values.take(pa.array(new)).dictionary_encode()
            which, fresh = coded.indices.to_numpy(), coded.dictionary
            strange = np.zeros(len(fresh), bool)
            strange[which] = odd[new]
            place = np.empty(len(fresh), np.int64)
            at = known
            for kind in (False, True):
                own = np.flatnonzero(strange == kind)
                if len(own):
                    more, n = self.learn(fresh.take(pa.array(own)), kind)
                    ids, lengths = np.concatenate([ids, more]), np.concatenate([lengths, n])
                    place[own] = at + np.arange(len(own))
                    at += len(own)
            codes[new] = place[which]
        placed, upto = spread(ids, lengths, codes)
        hits = np.bincount(codes, minlength=len(lengths))
        self.hits = self.hits + hits[:known]
        if len(new):
            order = np.argsort(place)
            self.remember(fresh.take(pa.array(order)), ids[len(self.ids) :], lengths[known:], hits[known:])
        data = placed.astype("<u4", copy=False).tobytes()
        at = 0
        for end in (np.r_[0, upto][np.searchsorted(starts, ends)] * 4).tolist():
            yield data[at:end]
            at = end

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text, texts of about TOGETHER bytes at a time."""
        at = 0
        while at < len(texts):
            first, size = at, 0
            while at < len(texts) and (at == first or size + len(texts[at]) <= TOGETHER):
                size += len(texts[at])
                at += 1
            yield from self.together(texts[first:at])
