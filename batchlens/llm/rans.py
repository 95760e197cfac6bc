"""Static range asymmetric numeral system over interleaved lanes, in numpy.

A block holds whole documents.  Its ids are cut into segments; each segment is
coded on its own by ``LANES`` interleaved states (id i goes to lane i mod
LANES), so the stored states are checkpoints from which any segment can be
decoded alone, and each segment has a checksum of its ids.  All blocks share
one frequency table.  Layout, little endian: magic, counts of documents, ids
and segments; per document: a flag for a null id, the id, its number of ids;
per segment: number of 32-bit words, checksum; states of all segments; words;
checksum of everything before.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

MAGIC = b"RAN1"
LANES = 512
SEGMENT = 1 << 17
PRECISION = 20
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sQQQ")
_WORD = np.uint64(32)
_P = np.uint64(PRECISION)


@dataclass
class Table:
    """Frequencies (summing to 2 ** PRECISION), their running sums, and the id of each slot."""

    frequency: np.ndarray
    start: np.ndarray
    symbol: np.ndarray | None = None


def table(counts: np.ndarray) -> Table:
    """Scale counts to the precision; every id that occurs keeps at least one slot."""
    total, slots = int(counts.sum()), 1 << PRECISION
    if not total:
        return Table(np.zeros(len(counts), dtype=np.uint64), np.zeros(len(counts), dtype=np.uint64))
    scaled = np.where(counts > 0, np.maximum(1, np.floor(counts * (slots / total))), 0).astype(np.int64)
    excess = int(scaled.sum()) - slots
    if excess < 0:
        scaled[int(scaled.argmax())] -= excess
    while excess > 0:  # frequent ids give the slots that rare ones were granted
        top = np.argsort(-scaled, kind="stable")[: max(1, min(excess, int((scaled > 1).sum())))]
        give = np.minimum(scaled[top] - 1, np.maximum(1, scaled[top] * excess // slots))
        give = np.minimum(give, np.maximum(0, excess - (np.cumsum(give) - give)))
        scaled[top] -= give
        excess -= int(give.sum())
    return Table(scaled.astype(np.uint64), (np.cumsum(scaled) - scaled).astype(np.uint64))


def slots_of(shared: Table) -> np.ndarray:
    """The id each slot belongs to."""
    return np.repeat(np.arange(len(shared.frequency), dtype=np.uint32), shared.frequency.astype(np.int64))


def encode_segment(ids: np.ndarray, shared: Table) -> tuple[np.ndarray, np.ndarray]:
    """Final lane states and the words, in reading order."""
    frequency, start = shared.frequency[ids], shared.start[ids]
    limit = frequency << np.uint64(31 - PRECISION + 32)
    state = np.full(LANES, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    for at in range((len(ids) - 1) // LANES * LANES, -1, -LANES) if len(ids) else ():
        f = frequency[at:at + LANES]
        x = state[: len(f)]
        full = x >= limit[at:at + LANES]
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> _WORD, x)
        times = x // f
        state[: len(f)] = (times << _P) + (x - times * f) + start[at:at + LANES]
    return state, np.concatenate(words[::-1]) if words else np.zeros(0, dtype=np.uint32)


def decode_segment(state: np.ndarray, words: np.ndarray, n: int, shared: Table) -> np.ndarray:
    ids = np.empty(n, dtype=np.uint32)
    state, at, mask = state.copy(), 0, np.uint64((1 << PRECISION) - 1)
    for first in range(0, n, LANES):
        x = state[: min(LANES, n - first)]
        slot = x & mask
        found = shared.symbol[slot]
        ids[first:first + LANES] = found
        x = shared.frequency[found] * (x >> _P) + slot - shared.start[found]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << _WORD) | words[at:at + len(low)]
            at += len(low)
        state[: len(x)] = x
    return ids


def encode_block(owners: list, sizes: np.ndarray, ids: np.ndarray, shared: Table) -> bytes:
    """A block of documents: their ids (None allowed), their numbers of token ids, all token ids."""
    coded = [encode_segment(ids[at:at + SEGMENT], shared) for at in range(0, len(ids), SEGMENT)]
    sums = [zlib.crc32(ids[at:at + SEGMENT].astype("<u4").tobytes()) for at in range(0, len(ids), SEGMENT)]
    body = b"".join([
        _HEAD.pack(MAGIC, len(owners), len(ids), len(coded)),
        np.array([o is None for o in owners], dtype=np.uint8).tobytes(),
        np.array([o or 0 for o in owners], dtype="<i8").tobytes(),
        np.asarray(sizes, dtype="<u8").tobytes(),
        np.array([len(w) for _, w in coded], dtype="<u8").tobytes(),
        np.array(sums, dtype="<u4").tobytes(),
        *(s.astype("<u8").tobytes() for s, _ in coded),
        *(w.astype("<u4").tobytes() for _, w in coded),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


class Block:
    """Reader of one encoded block."""

    def __init__(self, data: bytes, shared: Table):
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("block checksum differs")
        magic, docs, self.n_ids, self.segments = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a block of this format")
        self.shared, at = shared, _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += found.nbytes
            return found

        missing = take("u1", docs)
        self.owners = [None if m else int(o) for m, o in zip(missing, take("<i8", docs), strict=True)]
        self.sizes = take("<u8", docs).astype(np.int64)
        words, self.sums = take("<u8", self.segments).astype(np.int64), take("<u4", self.segments)
        self.states = take("<u8", self.segments * LANES).reshape(-1, LANES)
        self.ends = np.cumsum(words)
        self.words = take("<u4", int(self.ends[-1]) if len(words) else 0)

    def segment(self, number: int) -> np.ndarray:
        """Token ids of one segment, decoded from its checkpoint."""
        n = min(SEGMENT, self.n_ids - number * SEGMENT)
        begin = int(self.ends[number - 1]) if number else 0
        ids = decode_segment(self.states[number], self.words[begin:int(self.ends[number])], n, self.shared)
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.sums[number]:
            raise ValueError("segment checksum differs")
        return ids

    def ids(self) -> np.ndarray:
        return np.concatenate([self.segment(i) for i in range(self.segments)]) if self.segments else np.zeros(0, dtype=np.uint32)
