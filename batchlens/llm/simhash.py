"""SimHash near-duplicate groups over tables of pivot distances.

A fingerprint has 64 bits; bit i is set when more than half of the document's
shingle hashes have it set.  Two fingerprints are linked when at most two bits
differ; groups are the connected components of the links.

Links are found from Hamming distances to fixed reference fingerprints.  One
reference is zero; every other one has its bits inside one of four 16-bit
blocks, so its distance minus the distance to zero depends on that block alone.
At most two blocks can differ between linked fingerprints, so linked
fingerprints agree in those offsets for at least two blocks: rows meet on the
offsets of block pairs, pairs with a coordinate difference above two are
discarded, and survivors are verified bit by bit.  A meeting with too many
fingerprints is not paired at all: its members meet again on all fingerprints
one flipped bit away, where two of them share a row exactly when they are
linked, and only the smallest member of each such meeting is linked to.

Defined results: a text that is null, empty or without words has fingerprint
zero and is linked like any other; fewer words than a shingle make one shingle
of all of them; rows with the same text share a fingerprint; every input row
gives one output row (repeated rows included); rows with a null id are grouped,
but their id is never a component id; an empty table gives an empty result;
columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.llm.common import bytes_of, id_type, let_go, slices
from batchlens.llm.components import components
from batchlens.session import LoopState

SEED = 42
MAX_BITS = 2
BLOCKS = 4
REFERENCES_PER_BLOCK = 12
#: Up to this many fingerprints of one meeting are paired; larger meetings go by flipped bits.
PAIRED = 32
_CHUNK = 255 * 128


def fingerprint(data: bytes, shingle: int) -> int:
    """The unsigned fingerprint of one text."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist()
    total, ones = len(starts), np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, _CHUNK):
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        if whole:
            ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > total).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, row_hash, fp): one row per input row, the fingerprint as a signed long; row_hash is of id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in bytes_of(part)], dtype=np.uint64)
            yield pa.record_batch([part.column("doc_id"), part.column("row_hash"), pa.array(found.view(np.int64))], names=["doc_id", "row_hash", "fp"])

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_hash"))
    return rows.mapInArrow(run, f"doc_id {id_type(docs)}, row_hash long, fp long")


def references() -> list[list[int]]:
    """Reference fingerprints by block, from a fixed rule: pseudo-random halves of the block's bits."""
    drawn = np.random.default_rng(SEED).integers(1, 1 << 16, size=(BLOCKS, REFERENCES_PER_BLOCK))
    return [[int(v) << (16 * block) for v in row] for block, row in enumerate(drawn)]


def _long(value: int) -> Column:
    return F.lit(value - (1 << 64) if value >= 1 << 63 else value).cast("long")


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, zero, d): distance to zero, and the distances to all other references as one array."""
    far = [F.bit_count(F.col("fp").bitwiseXOR(_long(v))) for row in references() for v in row]
    return fps.select("fp", F.bit_count("fp").alias("zero"), F.array(*far).alias("d"))


def links(fps: DataFrame, state: LoopState) -> DataFrame:
    """(a, b): links among distinct fingerprints whose components equal those of all links."""
    table = pivot_table(fps)
    offset = [
        [F.element_at("d", block * REFERENCES_PER_BLOCK + i + 1) - F.col("zero") for i in range(REFERENCES_PER_BLOCK)] for block in range(BLOCKS)
    ]
    meetings = [
        F.xxhash64(F.lit(n), *offset[x], *offset[y]) for n, (x, y) in enumerate(combinations(range(BLOCKS), BLOCKS - MAX_BITS))
    ]
    met, _ = state.save(table.select("fp", F.explode(F.array(*meetings)).alias("meeting")))
    sizes = met.groupBy("meeting").agg(F.count("*").alias("n")).where("n > 1")
    few, many = sizes.where(F.col("n") <= PAIRED).select("meeting"), sizes.where(F.col("n") > PAIRED).select("meeting")
    left = met.join(few, "meeting", "left_semi")
    pairs = left.withColumnRenamed("fp", "a").join(left.withColumnRenamed("fp", "b"), "meeting").where("a < b").select("a", "b").distinct()
    # the table of a pair: coordinates follow from the fingerprints, so they are not carried through the join
    apart = [F.abs(F.bit_count("a") - F.bit_count("b"))]
    apart += [F.abs(F.bit_count(F.col("a").bitwiseXOR(_long(v))) - F.bit_count(F.col("b").bitwiseXOR(_long(v)))) for row in references() for v in row]
    close = pairs.where(F.greatest(*apart) <= MAX_BITS).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    dense = met.join(many, "meeting", "left_semi").select("fp").distinct()
    near = F.array(F.lit(0).cast("long"), *(_long(1 << i) for i in range(64)))
    flipped = dense.select("fp", F.explode(near).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("spot"))
    least = flipped.groupBy("spot").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    star = flipped.join(least, "spot").where("fp <> a").select("a", F.col("fp").alias("b"))
    return close.unionByName(star.distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, row_hash, fp, component, component_id): the group of every row, and its smallest id."""
    state = LoopState(docs.sparkSession, "simhash")
    rows, _ = state.save(fingerprints(docs, shingle))
    groups = components(links(rows.select("fp").distinct(), state), "simhash-groups")
    named = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(first, "component").select("fp", "component", "component_id"), "fp").select("doc_id", "row_hash", "fp", "component", "component_id")


def keep_first(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """One row of each group, all columns: that with the smallest id (null ids last), one of equal rows."""
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")
    first = near_duplicates(docs, shingle).groupBy("component").agg(F.min_by("row_hash", rank).alias("row_hash")).select("row_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("row_hash"))
    return rows.join(first, "row_hash", "left_semi").dropDuplicates(["row_hash"]).select("row.*")
