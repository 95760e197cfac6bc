"""Alignment of the tokens that two tokenizers make of the same texts.

Tokenizer A reads a space and the text, tokenizer B, which adds that space, the
text; both cut the same bytes.  Per batch, ``merge_asof`` keyed by document
finds for each token start the token of the other side that covers it, in both
directions; the union are the pairs of overlapping tokens (links).  Places
where tokens of both sides end cut a document into groups.

How often two ids are linked is counted over the whole corpus.  Tasks write
their documents in blocks with the block's distinct id pairs; pairs meet their
corpus-wide counts by a join, and the answers return to their block, which is
bounded however often a pair occurs.  Nothing about single links is shuffled.

Defined results: null and empty texts, and texts whose joined tokens differ
from space and text on either side, have no tokens; repeated rows count and
appear as often as they are there; null ids are kept; an empty table gives an
empty result; columns other than id and text are ignored; strings of special
tokens inside texts are ordinary text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.llm.common import bytes_of, held, id_type, slices
from batchlens.llm.sentence_pieces import Model
from batchlens.llm.words import LETTERS, TextCoder
from batchlens.session import LoopState

#: Texts are aligned in slices of this many bytes.
SLICE = 1 << 20
#: A block ends with the slice that brings it to so many pairs of a document and an id pair.
BLOCK_PAIRS = 1_500_000
FACTS = ("n_a", "n_b", "n_groups", "n_links")


class Aligned(NamedTuple):
    """Tokens of some documents side by side; arrays per token, per link and per document."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    counts_a: np.ndarray
    counts_b: np.ndarray
    link_a: np.ndarray  # places in ids_a and ids_b
    link_b: np.ndarray
    group_a: np.ndarray  # groups are numbered through all documents
    group_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray


class Spelled:
    """Byte strings by number, joined with array operations."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array(list(map(len, strings)), dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def join(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        done = np.cumsum(size)
        return self.flat[np.repeat(self.first[numbers] - (done - size), size) + np.arange(int(done[-1]) if len(done) else 0)]


class Pair:
    """Two tokenizers and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = TextCoder(path_a), Model(path_b)
        byte = {letter: i for i, letter in enumerate(LETTERS)}
        entries = json.loads(self.a.library.to_str())["model"]["vocab"]
        bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            if all(c in byte for c in entry):
                bytes_a[i] = bytes(map(byte.__getitem__, entry))
        pieces = self.b.library
        bytes_b = [pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(pieces.get_piece_size())]
        for value, i in self.b.bytes.items():
            bytes_b[i] = bytes([value])
        self.n_a, self.n_b = len(bytes_a), len(bytes_b)
        self.bytes_a, self.bytes_b = Spelled(bytes_a), Spelled(bytes_b)
        # decimal ids with the sign that follows: a comma, or what ends the tokens of a group on that side
        self.shown = Spelled([f"{i}{sign}".encode() for n, signs in ((self.n_a, ",|"), (self.n_b, ",;")) for sign in signs for i in range(n)])

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides and their number per text; none for texts that either side doesn't give back."""
        spaced = [b" " + t if t else t for t in texts]
        ids_a, stops_a = self.a.encode(spaced)
        found = self.b.encode(texts)
        whole = np.frombuffer(b"".join(spaced), dtype=np.uint8)
        sides, differ = [], False
        for ids, stops, spell in ((ids_a, np.maximum.accumulate(stops_a), self.bytes_a), (found.ids, found.stops, self.bytes_b)):
            sides.append((ids.astype(np.int64), np.diff(stops, prepend=0), spell))
            differ = differ or not np.array_equal(spell.join(sides[-1][0]), whole)
        if differ:
            fine = np.ones(len(texts), dtype=bool)
            for ids, counts, spell in sides:
                made = spell.join(ids).tobytes()
                at = np.concatenate([[0], np.cumsum(spell.size[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
                fine &= [made[x:y] == t for x, y, t in zip(at, at[1:], spaced, strict=False)]
            sides = [(ids[np.repeat(fine, counts)], np.where(fine, counts, 0), spell) for ids, counts, spell in sides]
        (ids_a, counts_a, _), (ids_b, counts_b, _) = sides
        return ids_a, counts_a, ids_b, counts_b

    def align(self, texts: list[bytes]) -> Aligned:
        ids_a, counts_a, ids_b, counts_b = self.tokens(texts)
        n = len(texts)
        doc_a, doc_b = np.repeat(np.arange(n, dtype=np.int32), counts_a), np.repeat(np.arange(n, dtype=np.int32), counts_b)
        size_a, size_b = self.bytes_a.size[ids_a], self.bytes_b.size[ids_b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        a = pd.DataFrame({"doc": doc_a, "at": end_a - size_a, "a": np.arange(len(ids_a))}, copy=False)
        b = pd.DataFrame({"doc": doc_b, "at": end_b - size_b, "b": np.arange(len(ids_b))}, copy=False)
        cover_b = pd.merge_asof(a, b, on="at", by="doc")["b"].to_numpy()
        cover_a = pd.merge_asof(b, a, on="at", by="doc")["a"].to_numpy()
        other = np.flatnonzero(a["at"].to_numpy()[cover_a] != b["at"].to_numpy()) if len(cover_a) else cover_a.astype(np.int64)  # links of equal starts are there already
        link_a, link_b = np.concatenate([np.arange(len(ids_a)), cover_a[other]]), np.concatenate([cover_b, other])
        # places where tokens of both sides end; a token's group is the number of such places before its end
        ends = np.zeros((2, int(size_a.sum()) + 1), dtype=bool)
        ends[0, end_a] = ends[1, end_b] = True
        both = ends[0] & ends[1]
        before = np.cumsum(both) - both
        closes = np.flatnonzero(both[end_a])
        return Aligned(ids_a, ids_b, counts_a, counts_b, link_a.astype(np.int64), link_b.astype(np.int64), before[end_a], before[end_b],
                       np.bincount(doc_a[closes], minlength=n), np.bincount(doc_a[link_a.astype(np.int64)], minlength=n))

    def group_digests(self, found: Aligned) -> list[str]:
        """sha256 of each document's groups as text; '' for documents without tokens."""
        ga, gb = found.group_a, found.group_b
        groups = int(ga[-1]) + 1 if len(ga) else 0
        in_a, in_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        last_a, last_b = np.append(ga[1:] != ga[:-1], True)[:len(ga)], np.append(gb[1:] != gb[:-1], True)[:len(gb)]
        order = np.empty(len(ga) + len(gb), dtype=np.int64)
        # a token stands behind those of its own side and those of the other side in earlier groups (A comes first in a group)
        order[np.arange(len(ga)) + (np.cumsum(in_b) - in_b)[ga]] = found.ids_a + np.where(last_a, self.n_a, 0)
        order[np.arange(len(gb)) + np.cumsum(in_a)[gb]] = found.ids_b + np.where(last_b, self.n_b, 0) + 2 * self.n_a
        text = memoryview(self.shown.join(order))
        at = np.concatenate([[0], np.cumsum(self.shown.size[order])])[np.concatenate([[0], np.cumsum(found.counts_a + found.counts_b)])].tolist()
        return [hashlib.sha256(text[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(at, at[1:], strict=False)]


def pair_of(path_a: str, path_b: str) -> Pair:
    """One pair of tokenizers per two files and worker process."""
    return held(("align", path_a, path_b), lambda: Pair(path_a, path_b))


class Block:
    """Documents of a task with the id pairs linked in each."""

    def __init__(self, ids: pa.DataType, n_a: int, n_b: int):
        self.n_a, self.n_b = n_a, n_b  # ids of both sides are below these
        self.id_type, self.doc_ids, self.facts, self.hashes = ids, [], [], []
        self.pairs, self.times, self.per_doc, self.size = [], [], [], 0

    def add(self, doc_ids: pa.Array, found: Aligned, hashes: list[str]) -> None:
        n = len(hashes)
        doc = np.repeat(np.arange(n), found.counts_a)[found.link_a]
        code = (doc * self.n_a + found.ids_a[found.link_a]) * self.n_b + found.ids_b[found.link_b]
        code.sort()
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])[:len(code)])
        rest, id_b = np.divmod(code[first], self.n_b)
        doc, id_a = np.divmod(rest, self.n_a)
        self.pairs.append(id_a << 32 | id_b)
        self.times.append(np.diff(first, append=len(code)))
        self.per_doc.append(np.bincount(doc, minlength=n))
        self.doc_ids.append(doc_ids)
        self.facts.append(np.stack([found.counts_a, found.counts_b, found.n_groups, found.n_links]))
        self.hashes += hashes
        self.size += len(first)

    def batch(self, number: int) -> pa.RecordBatch:
        """One row: the block's distinct pairs, frequent ones first, with their counts, and per document which of them it has how often."""
        pair, times = np.concatenate(self.pairs), np.concatenate(self.times)
        distinct, back = np.unique(pair, return_inverse=True)
        total = np.bincount(back, weights=times, minlength=len(distinct)).astype(np.int64)
        order = np.argsort(-total, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        place, per_doc = place[back], np.concatenate(self.per_doc)
        owner = np.repeat(np.arange(len(per_doc)), per_doc)
        sort = np.lexsort((place, owner))
        place, times = place[sort], times[sort]
        step = np.diff(place, prepend=0)
        begins = np.cumsum(per_doc) - per_doc
        step[begins[per_doc > 0]] = place[begins[per_doc > 0]]
        facts = np.concatenate(self.facts, axis=1)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        docs = pa.StructArray.from_arrays(
            [pa.concat_arrays([a.cast(self.id_type) for a in self.doc_ids]), *(pa.array(f) for f in facts), pa.array(self.hashes, pa.string()), pa.array(per_doc)],
            names=["doc_id", *FACTS, "groups_sha256", "n_pairs"])
        columns = [pa.array([number], pa.int64()), one(pa.array(distinct[order])), one(pa.array(total[order])), one(docs),
                   pa.array([planes(step)], pa.binary()), pa.array([planes(times)], pa.binary())]
        return pa.record_batch(columns, names=["block", "pairs", "counts", "docs", "steps", "times"])


def planes(values: np.ndarray) -> bytes:
    """32-bit values, all lowest bytes first and so on, which compresses well."""
    return np.ascontiguousarray(values, dtype="<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(block, pairs, counts, docs, steps, times): aligned documents in blocks of bounded size."""
    kind = id_type(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, None
        for part in slices(batches, limit=SLICE):
            made = pair_of(path_a, path_b)
            found = made.align(bytes_of(part))
            block = block or Block(part.column("doc_id").type, made.n_a, made.n_b)
            block.add(part.column("doc_id"), found, made.group_digests(found))
            if block.size >= BLOCK_PAIRS:
                yield block.batch(number)
                number, block = number + 1, None
        if block:
            yield block.batch(number)

    facts = ", ".join(f"{f}: long" for f in FACTS)
    return docs.select("doc_id", "text").mapInArrow(
        run, f"block long, pairs array<long>, counts array<long>, docs array<struct<doc_id: {kind}, {facts}, groups_sha256: string, n_pairs: long>>, "
             "steps binary, times binary")


def pair_counts(made: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair corpus-wide, and whether no other A id has more with that B id."""
    counts = made.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    with_b = counts.withColumn("id_b", F.col("pair").bitwiseAND((1 << 32) - 1))
    most = with_b.groupBy("id_b").agg(F.max("n").alias("most"))  # one row per piece of the vocabulary at most
    return with_b.join(most, "id_b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _sums(block: pa.Table, answers: pa.Table) -> pa.Table:
    """One row per document of a block from the counts of the block's pairs."""
    docs = block.column("docs").combine_chunks().flatten()
    n, best = np.zeros(answers.num_rows, dtype=np.int64), np.zeros(answers.num_rows, dtype=bool)
    place = answers.column("place").to_numpy()
    n[place], best[place] = answers.column("n").to_numpy(), answers.column("best").to_numpy()
    step, times = from_planes(block.column("steps")[0].as_py()), from_planes(block.column("times")[0].as_py())
    per_doc = docs.field("n_pairs").to_numpy()
    owner = np.repeat(np.arange(len(per_doc)), per_doc)
    run = np.cumsum(step)
    begins = np.cumsum(per_doc) - per_doc
    before = np.concatenate([[0], run])[begins]  # steps start anew with every document
    at = run - before[owner]
    sums = [np.zeros(len(per_doc), dtype=np.int64) for _ in range(2)]
    for out, values in zip(sums, (np.where(best[at], times, 0), n[at] * times), strict=True):
        done = np.concatenate([[0], np.cumsum(values)])
        out[:] = done[begins + per_doc] - done[begins]
    names = ["doc_id", *FACTS]
    return pa.table([*(docs.field(f) for f in names), pa.array(sums[0]), pa.array(sums[1]), docs.field("groups_sha256")],
                    names=[*names, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    ``n_best`` counts links whose id pair is the most frequent of its B id
    corpus-wide (ties included), ``count_sum`` adds the corpus-wide counts of
    the id pairs of all links.
    """
    state = LoopState(docs.sparkSession, "align")
    made, _ = state.save(blocks(docs, path_a, path_b))
    counts, _ = state.save(pair_counts(made))
    asked = made.select(F.col("block").alias("home"), F.posexplode("pairs").alias("place", "pair"))
    answers = asked.join(counts, "pair").select("home", "place", "n", "best")
    facts = ", ".join(f"{f} long" for f in FACTS)
    return made.select("block", "docs", "steps", "times").groupBy("block").cogroup(answers.groupBy("home")).applyInArrow(
        _sums, f"doc_id {id_type(docs)}, {facts}, n_best long, count_sum long, groups_sha256 string")
