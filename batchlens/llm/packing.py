"""Packing of token sequences by cutting-stock column generation.

Every document's ids (its text's and the end id) are cut into pieces of the
sequence length and one shorter rest.  A histogram of piece lengths (at most
one bin per length, whatever the corpus) goes to the driver.  Lengths are
rounded up to size classes; a linear program over packing patterns is solved by
column generation, where a knapsack dynamic program over the dual prices finds
the next pattern.  Patterns are used a whole number of times; what rounding
leaves over (a bounded number of pieces per class) goes first-fit decreasing.
Pieces are ranked inside their class by range partitioning, and a rank tells
the sequence, so no group is gathered in one place.

Defined results: a null or empty text is the end id alone; repeated rows and
repeated ids are packed once per row; null ids are kept; an empty table gives
an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchlens.functions.ranking import group_index
from batchlens.llm.common import bytes_of, id_type, slices
from batchlens.llm.words import coder
from batchlens.session import LoopState

LENGTH = 4096
#: Sizes are whole units of this many tokens, in at most this many classes.
UNIT = 4
CLASSES = 224
#: Bound on simplex steps; the plan is usable after any number of them.
STEPS = 4000


def cut_pieces(docs: DataFrame, path: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): one row per piece of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end_id], dtype="<u4").tobytes()
        for part in slices(batches):
            owner, start, size, crc, total = [], [], [], [], []
            all_ids, ends = coder(path).encode(bytes_of(part))
            for row, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                ids = all_ids[a:b].tobytes() + last
                for at in range(0, len(ids), 4 * length):
                    piece = ids[at:at + 4 * length]
                    owner.append(row)
                    start.append(at // 4)
                    size.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
            columns = [part.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, size, crc, total))]
            yield pa.record_batch(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, start long, length long, ids_crc32 long, doc_tokens long")


@dataclass
class Plan:
    """``kind`` maps a length to its class; slots of class k are numbered from ``origin[k]``.

    Run i covers slots from ``first[i]``; every ``per[i]`` of them go to one
    more sequence from ``base[i]`` on.
    """

    kind: np.ndarray
    origin: np.ndarray
    first: np.ndarray
    base: np.ndarray
    per: np.ndarray
    sequences: int


def classes(counts: np.ndarray, unit: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each length, and the size of each class in units: about equally many pieces per class."""
    units = -(-np.arange(len(counts)) // unit)
    weight = np.bincount(units, counts)
    used = np.flatnonzero(weight)
    if len(used) > most:
        share = np.cumsum(weight[used])
        cuts = np.searchsorted(share, share[-1] * np.arange(1, most + 1) / most - 1e-9)
        used = used[np.unique(np.minimum(cuts, len(used) - 1))]
    return np.minimum(np.searchsorted(used, units), max(0, len(used) - 1)), used


def best_pattern(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the multiset of classes with the highest total price that fits."""
    good = np.flatnonzero(prices > 1e-12)
    pattern = np.zeros(len(sizes), dtype=np.int64)
    if not len(good):
        return 0.0, pattern
    size, price = sizes[good], prices[good]
    reach = np.searchsorted(size, np.arange(room + 1), side="right")
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for space in range(1, room + 1):
        value[space] = value[space - 1]
        if n := reach[space]:
            offers = value[space - size[:n]] + price[:n]
            top = int(offers.argmax())
            if offers[top] > value[space]:
                value[space], choice[space] = offers[top], top
    space = room
    while space > 0:
        if choice[space] < 0:
            space -= 1
            continue
        pattern[good[choice[space]]] += 1
        space -= int(size[choice[space]])
    return float(value[room]), pattern


def generate(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one per row) and how often each is used, fractionally, to meet the demand exactly."""
    n = len(sizes)
    patterns = np.diag(room // sizes)
    inverse = np.diag(1.0 / (room // sizes))
    used = inverse @ demand
    for _ in range(STEPS):
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(sizes, prices, room)
        if value <= 1 + 1e-7:
            break
        way = inverse @ pattern
        ratios = np.full(n, np.inf)
        np.divide(used, way, out=ratios, where=way > 1e-10)
        leave = int(ratios.argmin())
        step = ratios[leave]
        used = used - step * way
        used[leave] = step
        patterns[leave] = pattern
        row = inverse[leave] / way[leave]
        inverse -= np.outer(way, row)
        inverse[leave] = row
    return patterns, np.maximum(used, 0)


def first_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> list[np.ndarray]:
    """Patterns for the leftover pieces, largest first into the first sequence with space."""
    space, made = np.zeros(0, dtype=np.int64), []
    for k in range(len(sizes) - 1, -1, -1):
        todo = int(left[k])
        for at in np.flatnonzero(space >= sizes[k]):
            if not todo:
                break
            take = min(todo, int(space[at] // sizes[k]))
            made[at][k] += take
            space[at] -= take * sizes[k]
            todo -= take
        while todo:
            take = min(todo, int(room // sizes[k]))
            pattern = np.zeros(len(sizes), dtype=np.int64)
            pattern[k] = take
            made.append(pattern)
            space = np.append(space, room - take * sizes[k])
            todo -= take
    return made


def plan(counts: np.ndarray, unit: int = UNIT, most: int = CLASSES) -> Plan:
    """The packing plan for a histogram: ``counts[n]`` pieces of n tokens, n up to the sequence length."""
    kind, sizes = classes(counts, unit, most)
    room = (len(counts) - 1) // unit
    demand = np.bincount(kind, counts, minlength=len(sizes)).astype(np.int64)[: len(sizes)]
    origin = np.concatenate([[0], np.cumsum(demand)])
    if not len(sizes):
        return Plan(kind, origin, *(np.zeros(0, dtype=np.int64),) * 3, 0)
    patterns, used = generate(sizes, demand.astype(float), room)
    whole = np.floor(used + 1e-6).astype(np.int64)
    while ((left := demand - whole @ patterns) < 0).any():  # only where the sum of rounding errors reaches one
        whole[np.argmax((whole > 0) * (patterns[:, left < 0].sum(axis=1) > 0))] -= 1
    rest = first_fit(sizes, left, room)
    rows = [(p, int(n)) for p, n in zip(patterns, whole, strict=True) if n] + [(p, 1) for p in rest]
    filled, first, base, per, sequence = origin[:-1].copy(), [], [], [], 0
    for pattern, times in rows:
        for k in np.flatnonzero(pattern):
            first.append(filled[k])
            base.append(sequence)
            per.append(pattern[k])
            filled[k] += times * pattern[k]
        sequence += times
    order = np.argsort(first, kind="stable")
    return Plan(kind, origin, *(np.array(c, dtype=np.int64)[order] for c in (first, base, per)), sequence)


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """The pieces with sequence_id and offset; ``pieces`` is read twice, so hand in a written table."""
    counts = np.zeros(length + 1, dtype=np.int64)
    for row in pieces.groupBy("length").count().collect():  # one row per length at most
        counts[row["length"]] = row["count"]
    made = plan(counts)

    @F.pandas_udf("int")
    def kind(size: pd.Series) -> pd.Series:
        return pd.Series(made.kind[size.to_numpy()], dtype="int32")

    @F.pandas_udf("long")
    def sequence(k: pd.Series, rank: pd.Series) -> pd.Series:
        slot = made.origin[k.to_numpy()] + rank.to_numpy()
        run = np.searchsorted(made.first, slot, side="right") - 1
        return pd.Series(made.base[run] + (slot - made.first[run]) // made.per[run])

    order = ["length", "doc_id", "start", "ids_crc32"]
    ranked = group_index(pieces.withColumn("_kind", kind("length")), ["_kind"], order, "_rank")
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranked.withColumn("sequence_id", sequence("_kind", "_rank"))
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
        .drop("_kind", "_rank")
    )


def pack_documents(docs: DataFrame, path: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces, _ = LoopState(docs.sparkSession, "pieces").save(cut_pieces(docs, path, end_id, length))
    return pack(pieces, length)
