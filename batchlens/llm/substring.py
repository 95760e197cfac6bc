"""Removal of repeated word sequences by prefix-partitioned suffix trees.

A word is removed when a window of ``WINDOW`` words covers it whose word
sequence also starts anywhere else.  Each window is a prefix of the suffix at
its first word.  Suffixes can only meet in a tree if they share a prefix; they
are split into memory-sized groups by the least ``GRAM``-word string within
reach, which equal windows share, at whatever depth it lies (so the shared
prefix has between GRAM and WINDOW words).  Within a group, the suffixes that
pass through one node at depth WINDOW are those with equal window hashes;
nodes with two or more suffixes are the deep internal nodes, and neighbouring
suffixes at such nodes form the maximal repeats.

A task first resolves its own texts: windows that it holds twice are marked at
once and only one of each is sent on, so a passage that a third of all rows
share, or a text copied thousands of times, reaches its group once per task.

Defined results: null, empty and white-space texts have no words; texts of less
than a window keep all words; rows that repeat id and text are repeats of one
another; null ids are kept; an empty table gives an empty result; columns other
than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from batchlens.llm import rolling, spans
from batchlens.llm.common import bytes_of, let_go, slices
from batchlens.session import LoopState

WINDOW = 35
GRAM = 12
SLICE = 6 << 20
PORTION = 1 << 20
#: Words of a text that are hashed at once; longer texts go in overlapping parts.
PART = 500_000
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = 0x5851F42D4C957F2D
_POWERS = np.array([pow(_R, i, 1 << 64) for i in range(64)], dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of joined texts."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start
    inside = np.flatnonzero(~space)
    size = stop - start
    place = inside - np.repeat(start, size)
    values = (raw[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63]
    if size.max() > 64:  # powers repeat in very long words; the round number keeps their later bytes apart
        late = np.flatnonzero(place >= 64)
        values[late] = rolling.mix(values[late] + (place[late] >> 6).astype(np.uint64))
    first = np.cumsum(size) - size
    return rolling.mix(np.add.reduceat(values, first) + size.astype(np.uint64)), start


def parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """(row, first word, text) of whole texts, or of overlapping parts of very long ones."""
    rows, base, out = [], [], []
    for row, data in enumerate(bytes_of(batch)):
        if len(data) <= 2 * SLICE:
            rows.append(row)
            base.append(0)
            out.append(data)
            continue
        words = data.split()
        for at in range(0, max(1, len(words) - WINDOW + 1), PART):
            yield np.array([row]), np.array([at]), [b" ".join(words[at:at + PART + WINDOW - 1])]
    if rows:
        yield np.array(rows), np.array(base), out


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, window hash, group hash) of every window of some texts."""
    hashes, sizes, at = [], [], 0
    ends = np.cumsum([len(t) + 1 for t in texts])
    while at < len(texts):  # bytes are looked at in small portions
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, side="right")))
        some, start = word_hashes(b" ".join(texts[at:stop]))
        begin = ends[at:stop] - [len(t) + 1 for t in texts[at:stop]] - (ends[at - 1] if at else 0)
        hashes.append(some)
        sizes.append(np.diff(np.searchsorted(start, begin), append=len(start)))
        at = stop
    hashes, sizes = np.concatenate(hashes), np.concatenate(sizes)
    end_word = np.cumsum(sizes)
    first_word = end_word - sizes
    eight = rolling.double(hashes, 3)
    four_more = rolling.cover(eight, 8, GRAM)
    whole = rolling.cover(rolling.double(eight, 2, 8), 32, WINDOW)
    anchor = rolling.anchors(four_more, WINDOW - GRAM + 1)[: len(whole)]
    count = np.maximum(0, end_word - first_word - WINDOW + 1)
    text = np.repeat(np.arange(len(texts)), count)
    spot = rolling.spread(first_word, count)
    return text, spot - np.repeat(first_word, count), whole[spot], four_more[anchor[spot]]


def group_suffixes(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed runs of windows by group, and the spans that tasks resolved on their own (bucket -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in slices(batches, limit=SLICE):
            u1, u2 = part.column("u1").to_numpy(), part.column("u2").to_numpy()
            rows: list[dict] = []
            for row, base, texts in parts(part):
                text, first, node, group = windows(texts)
                twice, chosen = rolling.repeated(node)
                owner, first = row[text], first + base[text]
                at, size = _stretches(np.flatnonzero(twice), owner, first)
                if len(at):
                    row_of = owner[at]
                    rows.append({"bucket": -1 - (int(u1[row_of[0]]) & 0xFFFF)} | {
                        "u1": u1[row_of].tobytes(), "u2": u2[row_of].tobytes(), "first": first[at].astype(np.uint32).tobytes(),
                        "size": size.astype(np.uint32).tobytes(),
                    })
                single = np.flatnonzero(~twice)
                at, size = _stretches(single, owner, first, group)
                row_of, bucket = owner[at], (group[at] >> np.uint64(11)) % np.uint64(buckets)
                columns = {"u1": u1[row_of], "u2": u2[row_of], "first": first[at].astype(np.uint32), "size": size.astype(np.uint32)}
                rows += spans.packed(bucket.astype(np.int64), buckets, columns, {"nodes": (node[single], size)})
                shared = np.flatnonzero(chosen)
                rows += spans.packed(((group[shared] >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64), buckets, {"shared": node[shared]})
            if rows:
                kinds = {"bucket": pa.int32()} | {n: pa.binary() for n in ("u1", "u2", "first", "size", "nodes", "shared")}
                yield pa.record_batch([pa.array([r.get(n) for r in rows], k) for n, k in kinds.items()], names=list(kinds))

    names = "u1 binary, u2 binary, first binary, size binary, nodes binary, shared binary"
    return spans.keyed(docs).drop("doc_id").mapInArrow(run, f"bucket int, {names}")


def _stretches(chosen: np.ndarray, owner: np.ndarray, first: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chosen windows as stretches of neighbours of one text: index of the first one, number of windows."""
    step = first[chosen] - np.arange(len(chosen))
    begin, size = rolling.runs(owner[chosen], step, *(m[chosen] for m in more))
    return chosen[begin], size


def deep_nodes(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Spans of the windows that pass through a node with two or more suffixes."""
    kinds = {"u1": "i8", "u2": "i4", "first": "u4", "size": "u4", "nodes": "u8", "shared": "u8"}
    entry = spans.unpacked(table, kinds)
    first, size = entry["first"].astype(np.int64), entry["size"].astype(np.int64)
    if table.column("bucket")[0].as_py() < 0:  # resolved before
        yield spans.span_batch(entry["u1"], entry["u2"], first, first + size + WINDOW - 1)
        return
    owned = len(entry["nodes"])
    twice, _ = rolling.repeated(np.concatenate([entry["nodes"], entry["shared"]]))
    run = np.repeat(np.arange(len(size)), size)
    start = rolling.spread(first, size)
    at, n = _stretches(np.flatnonzero(twice[:owned]), run, start)
    if len(at):
        yield spans.span_batch(entry["u1"][run[at]], entry["u2"][run[at]], start[at], start[at] + n + WINDOW - 1)


def repeats(docs: DataFrame) -> DataFrame:
    """(u1, u2, first, last): word spans covered by repeated windows; spans of one row may overlap."""
    buckets = spans.bucket_count(docs.sparkSession)
    return spans.over_buckets(group_suffixes(docs, buckets), buckets, deep_nodes, spans.SPAN)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(rest, text, n_words, n_removed, kept_sha256, kept): every row with ``rest`` of its columns and its text without repeated words."""
    # written first: the windows' shuffle files, the larger part, go before the texts are shuffled
    stored, _ = LoopState(docs.sparkSession, "repeats").save(repeats(docs))
    found = spans.with_spans(docs, stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            total, removed, kept, sha = [], [], [], []
            for data, found in zip(bytes_of(part), part.column("spans").to_pylist(), strict=True):
                words = data.split()
                gone = spans.covered(len(words), found)
                left = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if found else b" ".join(words)
                total.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(left)
                sha.append(hashlib.sha256(left).hexdigest())
            columns = [part.column("rest"), part.column("text"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.record_batch(columns, names=["rest", "text", "n_words", "n_removed", "kept_sha256", "kept"])

    schema = StructType([found.schema["rest"], StructField("text", StringType())]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept", "string")
    return found.mapInArrow(run, schema)


def clean(docs: DataFrame) -> DataFrame:
    """All columns; texts that lose words are their kept words joined by spaces, others stay as they are."""
    made = remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return made.select(*(text.alias("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))
