"""Token-id files: range-coded blocks in ascending document order, written and read by Spark.

Texts are encoded once and their ids stored compactly.  Id counts are summed
per task, then over tasks, into one shared frequency table (one entry per
vocabulary id, so of fixed size).  The stored ids are range-partitioned by
document id; each task writes its documents as blocks of about ``BLOCK`` ids
(see ``rans``).  A file is a Parquet container whose rows are blocks, so any
store that Spark writes will do, and blocks are decoded in parallel.

Defined results: null and empty texts are the end id alone; null document ids
come first and are kept; rows that repeat an id are written one after the other
(ordered by checksum); an empty table gives no block; columns other than id and
text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from batchlens.llm import rans
from batchlens.llm.common import bytes_of, slices
from batchlens.llm.words import coder
from batchlens.session import LoopState

#: A block ends with the document that reaches this many ids.
BLOCK = 1 << 19


@dataclass
class TokenFiles:
    """Written blocks (part, first, n_docs, n_ids, payload) and the frequency table they share."""

    blocks: DataFrame
    shared: rans.Table


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id long, crc long, ids binary): little-endian ids, 16 bits wide where the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_coder, last = coder(path), np.array([end_id], dtype="<u4").tobytes()
        kind = width(text_coder.library.get_vocab_size())
        for part in slices(batches):
            all_ids, ends = text_coder.encode(bytes_of(part))
            ids = [all_ids[a:b].tobytes() + last for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            packed = [np.frombuffer(i, dtype="<u4").astype(kind).tobytes() for i in ids]
            columns = [part.column("doc_id").cast(pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(packed, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "crc", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, crc long, ids binary")


def width(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def count_ids(encoded: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each vocabulary id occurs."""
    kind = width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, dtype=np.int64)
        for part in slices(batches, "ids"):
            counts += np.bincount(np.frombuffer(b"".join(part.column("ids").to_pylist()), dtype=kind), minlength=vocabulary)
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(seen), pa.array(counts[seen])], names=["id", "n"])

    total = np.zeros(vocabulary, dtype=np.int64)
    for row in encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[row["id"]] = row["n"]
    return total


def write(docs: DataFrame, path: str, end_id: int) -> TokenFiles:
    """Encode all documents and write them as blocks, ascending by document id."""
    spark = docs.sparkSession
    state = LoopState(spark, "tokens")
    vocabulary = max(coder(path).library.get_vocab_size(), end_id + 1)
    kind = width(coder(path).library.get_vocab_size())
    encoded, _ = state.save(encode(docs, path, end_id))
    shared = rans.table(count_ids(encoded, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 0
        owners, pieces, held = [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(pieces)
            payload = rans.encode_block(owners, np.array([len(p) for p in pieces]), ids, shared)
            columns = [pa.array([v], t) for v, t in ((part, pa.int32()), (first, pa.int64()), (len(owners), pa.int64()), (len(ids), pa.int64()), (payload, pa.binary()))]
            return pa.record_batch(columns, names=["part", "first", "n_docs", "n_ids", "payload"])

        for batch in batches:
            for owner, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                owners.append(owner)
                pieces.append(np.frombuffer(data.as_buffer(), dtype=kind))
                held += len(pieces[-1])
                if held >= BLOCK:
                    yield block()
                    first, owners, pieces, held = first + held, [], [], 0
        if owners:
            yield block()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(parts, "doc_id", "crc").sortWithinPartitions("doc_id", "crc")
    blocks, _ = state.save(ordered.mapInArrow(run, "part int, first long, n_docs long, n_ids long, payload binary"))
    state.drop(encoded)
    return TokenFiles(blocks, shared)


def read(files: TokenFiles) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): every document decoded from the written blocks."""
    shared = files.shared
    sizes = files.blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per written partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_slots = rans.Table(shared.frequency, shared.start, rans.slots_of(shared))
        for batch in batches:
            for at, payload in zip(batch.column("at").to_pylist(), batch.column("payload"), strict=True):
                block = rans.Block(payload.as_py(), with_slots)
                ids = block.ids().astype("<u4").tobytes()
                ends = np.cumsum(block.sizes)
                begins = ends - block.sizes
                found = [ids[4 * b:4 * e] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(block.owners, pa.int64()), pa.array(at + begins), pa.array(block.sizes),
                    pa.array([zlib.crc32(f) for f in found], pa.int64()), pa.array(found, pa.binary()),
                ]
                yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    placed = files.blocks.join(offsets, "part").select((F.col("offset") + F.col("first")).alias("at"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
