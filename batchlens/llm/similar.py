"""Near-duplicate groups by the similarity of word shingles.

Two texts are linked when the Jaccard similarity of their sets of five-word
shingles is at least 0.8; groups are the connected components of the links.

Candidates come from prefix filtering, which misses no pair: all sets are
ordered alike, and of two sets with that similarity the first
n - ceil(0.8 n) + 1 shingles of either hold a common one.  The order puts
shingles that more rows hold later, as far as broadcast filters of bounded
size know them, so that shared passages rarely bring texts together; it
decides the work, never the result.  Where the places of the first common
shingle leave too few shingles to share, a pair is left out.  Members of a
meeting are compared with its smallest member first.  Rounds then compare the
members of meetings that hold several groups with one member of the largest
group there, as long as this brings groups together; only the pairs across
groups that are left in the end are all compared.

Defined results: words are told apart by white space and lower-cased; fewer
words than a shingle make one shingle of all of them; texts without words are
equal to one another; shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.llm import rolling
from batchlens.llm.common import bytes_of, id_type, let_go, signed, slices
from batchlens.llm.components import components
from batchlens.llm.words import piece_hashes
from batchlens.session import LoopState

SHINGLE = 5
#: Least similarity of a link, in tenths.
TENTHS = 8
#: Texts are cut into shingles in slices of this many bytes.
SLICE = 1 << 20
#: Numbers of rows from which on a shingle comes later in a prefix.
LEVELS = (2, 16, 256)
#: Most bits of a filter of repeated shingles, and those one task fills.
FILTER_BITS, CHUNK_BITS = 1 << 28, 1 << 20
#: Most rounds that compare members of mixed meetings with one member of the largest group, and the share of pairs that a round must leave at most for another one.
TURNS, SHRINKS = 12, 0.8
#: Pairs across groups for each member of a mixed meeting that are compared without further rounds.
FEW = 8
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[*range(9, 14), 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, computed for all texts together."""
    none = np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    white = _WHITE[raw]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    if not len(starts):
        return [none] * len(texts)
    stops = np.flatnonzero(white & np.concatenate([[False], ~white[:-1]]))
    size = stops - starts
    inside = np.flatnonzero(~white)
    word_starts = np.cumsum(size) - size
    words = piece_hashes(_LOWER[raw[inside]], word_starts, size)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, begins)  # first word of each text
    out = []
    whole = words
    for _ in range(SHINGLE - 1):  # hashes of one, two, ... five words from each word on
        whole = rolling.join(whole[:-1], words[len(words) - len(whole) + 1:]) if len(whole) > 1 else none
    for x, y in zip(first.tolist(), first[1:].tolist(), strict=False):
        if y - x >= SHINGLE:
            out.append(np.unique(whole[x:y - SHINGLE + 1]))
        elif y > x:
            one = words[x:x + 1].copy()
            for k in range(x + 1, y):
                one = rolling.join(one, words[k:k + 1])
            out.append(rolling.mix(one + np.uint64(y - x)))
        else:
            out.append(none)
    return out


def repeated_shingles(docs: DataFrame, state: LoopState) -> list[bytes]:
    """Bloom filters of the shingles that at least 2, 16 and 256 rows hold (``LEVELS``).

    A filter has sixteen bits a shingle, but never more than ``FILTER_BITS``; a
    full one would order shingles by hash alone.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in slices(batches, limit=SLICE):
            values, counts = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *shingle_sets(bytes_of(part))]), return_counts=True)
            yield pa.record_batch([pa.array(signed(values)), pa.array(counts.astype(np.int32))], names=["shingle", "n"])

    counted = docs.select("text").mapInArrow(count, "shingle long, n int").groupBy("shingle").agg(F.sum("n").alias("n"))
    seen, facts = state.save_counting(counted.where(F.col("n") >= LEVELS[0]), **{f"at_least_{least}": F.col("n") >= least for least in LEVELS})
    sizes = [min(FILTER_BITS, max(CHUNK_BITS, 1 << (16 * facts[f"at_least_{least}"]).bit_length())) for least in LEVELS]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, n = batch.column("shingle").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            for level, (least, bits) in enumerate(zip(LEVELS, sizes, strict=True)):
                spots = np.unique(np.concatenate(bloom_spots(shingles[n >= least], bits)))
                columns = [np.full(len(spots), level), spots // CHUNK_BITS, spots % CHUNK_BITS]
                yield pa.record_batch([pa.array(c.astype(np.int32)) for c in columns], names=["level", "chunk", "spot"])

    def fill(group: pa.Table) -> pa.Table:
        out, spots = np.zeros(CHUNK_BITS // 8, dtype=np.uint8), group.column("spot").to_numpy()
        np.bitwise_or.at(out, spots >> 3, (1 << (spots & 7)).astype(np.uint8))
        return pa.table({"level": group.column("level")[:1], "chunk": group.column("chunk")[:1], "bits": pa.array([out.tobytes()], pa.binary())})

    spots = seen.mapInArrow(spread, "level int, chunk int, spot int")
    stored, _ = state.save(spots.groupBy("level", "chunk").applyInArrow(fill, "level int, chunk int, bits binary"))
    out = [np.zeros(bits // 8, dtype=np.uint8) for bits in sizes]
    for row in stored.toLocalIterator():  # FILTER_BITS for each level at most
        at = row["chunk"] * CHUNK_BITS // 8
        out[row["level"]][at:at + CHUNK_BITS // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    state.drop(seen)
    state.drop(stored)
    return [bits.tobytes() for bits in out]


def bloom_spots(shingles: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bits of the filter for each shingle: three, by different parts of its hash mixed anew."""
    more = rolling.mix(shingles * np.uint64(0xD6E8FEB86659FD93))
    return [(more >> np.uint64(shift) & np.uint64(bits - 1)).astype(np.int64) for shift in (0, 18, 36)]


def prefix(found: np.ndarray, filters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set and their places, those that more rows hold later; one is in the prefix of every set similar enough.

    Of these only shingles are returned that another set may have.
    """
    n = len(found)
    size = n - -(-TENTHS * n // 10) + 1 if n else 0
    level = np.zeros(n, dtype=np.int8)
    for bits in filters:
        inside = np.ones(n, dtype=bool)
        for spots in bloom_spots(found, 8 * len(bits)):
            inside &= bits[spots >> 3] >> (spots & 7).astype(np.uint8) & 1 == 1
        level += inside
    first = np.argsort(level, kind="stable")[:size]
    at = np.flatnonzero(level[first] > 0)
    return found[first[at]], at


def keyed(docs: DataFrame, repeated) -> DataFrame:
    """(doc_id, row_hash, cls, size, first, at): rows with the hash and size of their shingle set, its prefix and the places of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        filters = [np.frombuffer(bits, dtype=np.uint8) for bits in repeated.value]
        for part in slices(batches, limit=SLICE):
            sets = shingle_sets(bytes_of(part))
            cls = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            first = [prefix(s, filters) for s in sets]
            shingles = pa.array([f.view(np.int64) for f, _ in first], pa.list_(pa.int64()))
            at = pa.array([a.astype(np.int32) for _, a in first], pa.list_(pa.int32()))
            yield pa.record_batch([part.column("doc_id"), part.column("row_hash"), pa.array(cls), pa.array([len(s) for s in sets], pa.int32()), shingles, at], names=["doc_id", "row_hash", "cls", "size", "first", "at"])

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_hash"))
    return rows.mapInArrow(run, f"doc_id {id_type(docs)}, row_hash long, cls long, size int, first array<long>, at array<int>")


def sets_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(cls, sh, h): the shingle sets of the given rows (row_hash, cls), and how many shingles begin with each six bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            sets = shingle_sets(bytes_of(part))
            counts = [np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=64) for s in sets]
            yield pa.record_batch([part.column("cls"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], names=["cls", "sh", "h"])

    texts = docs.select("text", F.xxhash64("doc_id", "text").alias("row_hash")).join(rows, "row_hash").dropDuplicates(["cls"])
    return texts.select("cls", "text").mapInArrow(run, "cls long, sh array<long>, h array<int>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs that are similar enough."""
    # two sets share at most the lesser count of each beginning: pairs that this rules out need no sets
    counts = pairs.join(sets.select(F.col("cls").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("cls").alias("b"), F.col("h").alias("hb")), "b")
    total = lambda h: F.aggregate(h, F.lit(0), lambda x, y: x + y)
    most = total(F.zip_with("ha", "hb", lambda x, y: F.least(x, y)))
    pairs = counts.where((10 + TENTHS) * most >= TENTHS * (total(F.col("ha")) + total(F.col("hb")))).select("a", "b")
    both = pairs.join(sets.select(F.col("cls").alias("a"), F.col("sh").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("sh").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(10 * shared >= TENTHS * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def may_link(size_x: str, at_x: str, size_y: str, at_y: str) -> Column:
    """Whether two sets can be similar enough whose first common shingle stands at these places.

    All that they share stands from there on.  Similar sets pass at their first
    common shingle, so a pair may be left out wherever it fails.
    """
    rest = F.least(F.col(size_x) - F.col(at_x), F.col(size_y) - F.col(at_y))
    return (10 + TENTHS) * rest >= TENTHS * (F.col(size_x) + F.col(size_y))


def mixed_meetings(meetings: DataFrame, links: DataFrame, turn: int, state: LoopState) -> tuple[DataFrame, int, float]:
    """(shingle, cls, size, at, component, largest) of meetings that hold several groups, their rows, and how many pairs across groups they have.

    ``largest`` is the group with most members there, with one of them that
    differs from turn to turn.
    """
    now = components(links, "similar-stars").select(F.col("node").alias("cls"), "component")
    met, _ = state.save(meetings.select("shingle", "cls", "size", "at").join(now, "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    pick = F.min_by(F.struct("cls", "size", "at"), F.xxhash64("cls", F.lit(turn))).alias("pick")
    present = met.groupBy("shingle", "component").agg(F.count("*").cast("double").alias("n"), pick)
    largest = F.max_by(F.struct("component", "pick"), F.struct("n", "component")).alias("largest")
    across = present.groupBy("shingle").agg(((F.sum("n") ** 2 - F.sum(F.col("n") ** 2)) / 2).alias("across"), largest).where("across > 0")
    across, facts = state.save_summing(across, across=F.col("across"))
    left, members = state.save(met.join(across.select("shingle", "largest"), "shingle").select("shingle", "cls", "size", "at", "component", "largest"))
    for table in (met, across):
        state.drop(table)
    return left, members, facts["across"]


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, component): the group of every row."""
    state = LoopState(docs.sparkSession, "similar")
    repeated = docs.sparkSession.sparkContext.broadcast(repeated_shingles(docs, state))
    rows, _ = state.save(keyed(docs, repeated))
    repeated.unpersist()
    one = rows.groupBy("cls").agg(F.min_by(F.struct("row_hash", "size", "first", "at"), "row_hash").alias("r")).select("cls", "r.*")
    met = one.select("cls", "size", F.explode(F.arrays_zip("first", "at")).alias("f")).select("cls", "size", F.col("f.first").alias("shingle"), "f.at")
    shared = rows.select("cls", "size", F.explode(F.arrays_zip("first", "at")).alias("f")).groupBy(F.col("f.first").alias("shingle")).agg(
        F.min(F.struct("cls", "size", "f.at")).alias("least"), F.max("cls").alias("most")).where("least.cls < most")
    meetings, _ = state.save(met.join(shared.select("shingle", "least"), "shingle").select("shingle", "cls", "size", "at", "least"))
    used = meetings.select("cls").distinct().join(one.select("cls", "row_hash"), "cls")
    sets, _ = state.save(sets_of(docs, used))
    hung = meetings.where((F.col("cls") != F.col("least.cls")) & may_link("size", "at", "least.size", "least.at"))
    star, _ = state.save(verified(hung.select(F.col("least.cls").alias("a"), F.col("cls").alias("b")).distinct(), sets))
    links, before = star, float("inf")
    for turn in range(TURNS):
        left, members, open_pairs = mixed_meetings(meetings, links, turn, state)
        if open_pairs <= FEW * members or open_pairs > SHRINKS * before or turn == TURNS - 1:
            break
        before = open_pairs
        hung = left.where((F.col("component") != F.col("largest.component")) & may_link("size", "at", "largest.pick.size", "largest.pick.at"))
        ends = F.col("cls"), F.col("largest.pick.cls")
        asked = hung.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).distinct()
        longer, _ = state.save(links.unionByName(verified(asked, sets)))
        for table in (links, left):
            state.drop(table)
        links = longer
    x, y = (left.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in ("cls", "size", "at", "component"))) for side in "xy")
    pairs = x.join(y, "shingle").where((F.col("cls_x") < F.col("cls_y")) & (F.col("component_x") != F.col("component_y")) & may_link("size_x", "at_x", "size_y", "at_y"))
    more = verified(pairs.select(F.col("cls_x").alias("a"), F.col("cls_y").alias("b")).distinct(), sets)
    links, _ = state.save(links.unionByName(more))
    for table in (sets, left, meetings):
        state.drop(table)
    final = components(links, "similar-groups")
    return rows.join(final.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", "row_hash", F.coalesce("component", "cls").alias("component"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group, all columns: that with the smallest id (null ids last), one of equal rows."""
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")
    first = groups(docs).groupBy("component").agg(F.min_by("row_hash", rank).alias("row_hash")).select("row_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("row_hash"))
    return rows.join(first, "row_hash", "left_semi").dropDuplicates(["row_hash"]).select("row.*")
