"""Byte-level BPE by a hierarchical-bitmap rank queue.

Symbols form a linked list over positions.  The queue has one bucket of
positions per merge rank and a three-level bitmap of non-empty buckets; finding
the first set bit gives the next rank.  Entries whose pair has changed since
are stale and skipped when their bucket is taken.

``merge_one`` runs the queue over a single pre-token and costs about the same
per byte however long it is.  ``merge_many`` runs one queue over many
pre-tokens at once and merges a whole bucket with array operations; where a
merge makes a pair of lower rank than itself, which only such a pre-token's own
order resolves, that pre-token is done again by ``merge_one``.

Texts are cut at single spaces after non-space characters (always a pre-token
border of the pattern) and a worker keeps the ids of a bounded number of pieces.

Defined results: null and empty texts have no ids and decode to no bytes;
repeated rows give repeated results; null ids are kept; an empty table gives an
empty result; columns other than id and text are ignored; control strings of
vocabularies are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from batchlens.llm.common import bytes_of, held, id_type, slices
from batchlens.llm.words import PieceTable

#: Texts are encoded in slices of this many bytes, so that one queue serves many new pieces.
SLICE = 4 << 20
#: Pre-tokens above this many bytes get a queue of their own.
LONG = 1 << 16
NONE = np.int32(2**31 - 1)


class RankQueue:
    """Buckets of positions by rank; a bitmap over 2 ** 18 ranks in three levels of 64 bits."""

    def __init__(self) -> None:
        self.buckets: dict[int, list] = {}
        self.low, self.mid, self.top = [0] * 4096, [0] * 64, 0

    def bucket(self, rank: int) -> list:
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        return found

    def first(self) -> int:
        """The lowest rank with a bucket, -1 if there is none."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        return b << 6 | (word & -word).bit_length() - 1

    def remove(self, rank: int) -> list:
        self.low[rank >> 6] &= ~(1 << (rank & 63))
        if not self.low[rank >> 6]:
            self.mid[rank >> 12] &= ~(1 << (rank >> 6 & 63))
            if not self.mid[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))
        return self.buckets.pop(rank)


class Ranks:
    """A rank file: token bytes and their ranks, with a lookup for pairs of tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}
        self.tokens = [b""] * (max(self.of.values()) + 1)
        for token, rank in self.of.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.of[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = {}
        for token, rank in self.of.items():
            for at in range(1, len(token)):
                left, right = self.of.get(token[:at]), self.of.get(token[at:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, NONE where they don't merge."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def merge_one(self, data: bytes) -> list[int]:
        """Token ids of one pre-token, merged one pair at a time: lowest rank first, then leftmost."""
        n = len(data)
        symbol = self.bytes[np.frombuffer(data, dtype=np.uint8)].tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        rank, pairs, queue = [-1] * n, self.pairs, RankQueue()

        def enter(at: int) -> None:
            to = after[at]
            rank[at] = found = pairs.get(symbol[at] << 32 | symbol[to], -1) if to >= 0 else -1
            if found >= 0:
                heappush(queue.bucket(found), at)

        for at in range(n - 1):
            enter(at)
        while (low := queue.first()) >= 0:
            bucket = queue.buckets[low]
            at = heappop(bucket)
            if not bucket:
                queue.remove(low)
            if rank[at] != low:
                continue  # stale
            gone = after[at]
            symbol[at], after[at], rank[gone] = low, after[gone], -1
            if after[at] >= 0:
                before[after[at]] = at
            enter(at)
            if before[at] >= 0:
                enter(before[at])
            symbol[gone] = -1
        return [s for s in symbol if s >= 0]

    def merge_many(self, pretokens: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each (non-empty) pre-token."""
        sizes = np.fromiter(map(len, pretokens), dtype=np.int64, count=len(pretokens))
        ends = np.cumsum(sizes)
        begins = ends - sizes
        owner = np.repeat(np.arange(len(pretokens), dtype=np.int32), sizes)
        symbol = self.bytes[np.frombuffer(b"".join(pretokens), dtype=np.uint8)]
        n = len(symbol)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[begins] = -1
        rank = np.full(n, NONE, dtype=np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.pair(symbol[inner], symbol[inner + 1])
        queue, redo = RankQueue(), set()

        def enter(at: np.ndarray) -> None:
            """Put positions into the buckets of their ranks."""
            at = at[rank[at] != NONE]
            if not len(at):
                return
            at = at[np.argsort(rank[at], kind="stable")]
            kinds = rank[at]
            cuts = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
            edges = [0, *cuts.tolist(), len(at)]
            for a, b, kind in zip(edges, edges[1:], kinds[edges[:-1]].tolist(), strict=False):
                queue.bucket(kind).append(at[a:b])

        enter(inner)
        while (low := queue.first()) >= 0:
            parts = queue.remove(low)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            at = at[rank[at] == low]  # others are stale
            if len(at) > 1:  # of a chain of overlapping pairs every second one merges, from the left
                start = np.concatenate([[True], after[at[:-1]] != at[1:]])
                if not start.all():
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at], rank[gone] = low, NONE
            symbol[gone] = -1
            to = after[gone]
            after[at] = to
            right = to >= 0
            before[to[right]] = at[right]
            rank[at] = NONE
            right_of = at[right]
            left = before[at]
            left_of = left[left >= 0]
            changed = np.concatenate([right_of, left_of]) if len(left_of) else right_of
            if len(changed):
                found = self.pair(symbol[changed], symbol[after[changed]])
                rank[changed] = found
                if (found < low).any():
                    redo.update(owner[changed[found < low]].tolist())
                enter(np.unique(changed))
        alive = symbol >= 0
        ids = symbol[alive].astype("<u4").tobytes()
        stops = np.concatenate([[0], np.cumsum(alive)[ends - 1]]).tolist() if n else [0]
        out = [ids[4 * a:4 * b] for a, b in zip(stops, stops[1:], strict=False)]
        for i in redo:
            out[i] = np.array(self.merge_one(pretokens[i]), dtype="<u4").tobytes()
        return out

    def encode(self, pretokens: list[bytes]) -> list[bytes]:
        """Ids of each pre-token; one that is itself a token needs no merging."""
        known = [self.of.get(p) for p in pretokens]
        rest = [p for p, k in zip(pretokens, known, strict=True) if k is None and len(p) <= LONG]
        merged = dict(zip(rest, self.merge_many(rest), strict=True))
        return [
            np.array([k], dtype="<u4").tobytes() if k is not None
            else merged[p] if len(p) <= LONG else np.array(self.merge_one(p), dtype="<u4").tobytes()
            for p, k in zip(pretokens, known, strict=True)
        ]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


class TextCoder:
    """Ids of texts by a rank file and a pre-token pattern; all new pieces of some texts share one queue."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.split = Ranks(path), regex.compile(pattern).findall
        self.table = PieceTable(self._learn)

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        cut = [[t.encode() for t in self.split(p.decode("utf-8", "replace"))] for p in pieces]
        new = list({t for parts in cut for t in parts})
        ids = dict(zip(new, self.ranks.encode(new), strict=True))
        return [b"".join(map(ids.__getitem__, parts)) for parts in cut]

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        ids, ends = self.table.encode(texts)
        return (ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))


def coder(path: str, pattern: str) -> TextCoder:
    """One coder per file and worker process."""
    return held(("bpe", path, pattern), lambda: TextCoder(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): little-endian 32-bit ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            found = [ids.tobytes() for ids in coder(path, pattern).encode(bytes_of(part))]
            yield pa.record_batch([part.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, ids binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and decoded again from its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            made, sizes, ids_sha, decoded_sha = coder(path, pattern), [], [], []
            for ids in made.encode(bytes_of(part)):
                sizes.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded_sha.append(hashlib.sha256(made.ranks.decode(ids)).hexdigest())
            columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
