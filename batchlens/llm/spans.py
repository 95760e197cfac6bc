"""Packed rows of array operators, and the spans that documents get back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.llm.common import let_go

#: A row of a document is known by two hashes of its id and text; rows equal in both columns share spans.
KEY = ["u1", "u2"]
SPAN = "u1 long, u2 int, first long, last long"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("u1", F.xxhash64("doc_id", "text")).withColumn("u2", F.hash("text", "doc_id"))


def bucket_count(spark: SparkSession) -> int:
    """Groups follow the number of shuffle partitions, which follows the data."""
    return max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def packed(bucket: np.ndarray, buckets: int, columns: dict[str, np.ndarray], ragged: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> Iterator[dict]:
    """One row of bytes per bucket: ``columns`` by entry, ``ragged`` as (values, how many of them each entry has)."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    flat = {name: (values, np.cumsum(size) - size, size) for name, (values, size) in (ragged or {}).items()}
    for b in np.flatnonzero(np.diff(edges)).tolist():
        rows = order[edges[b]:edges[b + 1]]
        row = {"bucket": b} | {name: values[rows].tobytes() for name, values in columns.items()}
        for name, (values, first, size) in flat.items():
            spots = np.arange(int(size[rows].sum())) + np.repeat(first[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows])
            row[name] = values[spots].tobytes()
        yield row


def unpacked(table: pa.Table, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """The entries of all rows of one bucket."""
    return {name: np.frombuffer(b"".join(v or b"" for v in table.column(name).to_pylist()), dtype=kind) for name, kind in kinds.items()}


def span_batch(u1: np.ndarray, u2: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(u1, pa.int64()), pa.array(u2, pa.int32()), pa.array(first.astype(np.int64)), pa.array(last.astype(np.int64))]
    return pa.record_batch(arrays, names=["u1", "u2", "first", "last"])


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(rest, text, spans) per row: its other columns, and a list of (first, last), null where it has none."""
    # equal rows send equal spans; one of each is kept before a row's spans meet
    lists = spans.distinct().groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    rest = F.struct(*(F.col(c) for c in docs.columns if c != "text"))
    rows = docs.select(rest.alias("rest"), "text", F.xxhash64("doc_id", "text").alias("u1"), F.hash("text", "doc_id").alias("u2"))
    return rows.join(lists, KEY, "left").select("rest", "text", "spans")


def covered(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n units lie in a span [first, last)."""
    edge = np.zeros(n + 1, dtype=np.int32)
    for s in spans or ():
        edge[s["first"]] += 1
        edge[s["last"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def over_buckets(rows: DataFrame, buckets: int, fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``fn`` on the rows of each bucket; a task streams over its buckets one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            ids = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and ids[a] != now:
                    yield from fn(pa.Table.from_batches(held))
                    held = []
                now = ids[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from fn(pa.Table.from_batches(held))

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)
