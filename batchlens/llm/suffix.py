"""Removal of repeated byte strings by prefix-free parsing.

A byte is removed when a ``LENGTH``-byte string covers it that also starts
anywhere else.  A rolling hash over ``GRAM`` bytes sets triggers: a position is
one when its hash is the least within reach of some LENGTH-byte string.  A
string's own least position is its trigger, so equal strings have their
triggers at the same place, and strings that share a trigger form one stretch:
the phrase.  Phrases overlap by LENGTH - 1 bytes, so that none is a prefix of
another's parse and no string is lost between two of them.

The corpus is parsed into phrase hashes.  Equal phrases are one dictionary
entry: if it occurs twice, all strings of all its occurrences are repeats, and
the parse alone says so; for highly repetitive text that is nearly all there is
to do.  Phrases that occur once but whose trigger gram occurs elsewhere are
fetched from their texts and compared inside their gram's group by the sorted
hashes of their strings, together with one copy of each repeated entry.

A task resolves its own texts first: of a phrase that it holds many times one
entry is sent on.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH
are kept whole; rows that repeat id and text are repeats of one another; null
ids are kept; an empty table gives an empty result; columns other than id and
text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.llm import rolling, spans
from batchlens.llm.common import bytes_of, id_type, let_go, slices
from batchlens.session import LoopState

LENGTH = 400
GRAM = 32
#: Bytes hashed at once; longer texts go in overlapping parts.
SLICE = 2 << 20
#: Strings of one group compared at once; larger groups go by slices of trigger distances.
COMPARED = 2 << 20

PARSE = {"key": "u8", "phrase": "u8", "u1": "i8", "u2": "i4", "first": "i8", "size": "u4", "reach": "u4", "many": "u1"}
DETAIL = {"key": "u8", "u1": "i8", "u2": "i4", "first": "i8", "size": "u4", "reach": "u4"}


def _levels(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all GRAM-byte and of all 256-byte strings."""
    hashes = rolling.mix(raw.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    grams = rolling.double(hashes, 5)
    return grams, rolling.double(grams, 3, GRAM)


def phrases(data: bytes, begin: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Phrases of joined texts: text number, first string's start, number of strings, trigger's distance, gram and phrase hash."""
    raw = np.frombuffer(data, dtype=np.uint8)
    grams, wide = _levels(raw)
    trigger = rolling.anchors(grams, LENGTH - GRAM + 1)
    count = np.maximum(0, end - begin - LENGTH + 1)
    spot = rolling.spread(begin, count)
    text = np.repeat(np.arange(len(begin)), count)
    at = trigger[spot]
    run, size = rolling.runs(text, at)
    first, at, text = spot[run], at[run], text[run]
    last = first + size - 1 + LENGTH  # end of the phrase; at most LENGTH - GRAM + LENGTH bytes, so three wide strings cover it
    middle = np.minimum(first + 256, last - 256)
    whole = rolling.join(rolling.join(wide[first], wide[middle]), wide[last - 256])
    whole = rolling.join(whole, ((last - first) << 16 | (at - first)).astype(np.uint64))
    return {"text": text, "first": first - begin[text], "size": size, "reach": at - first, "key": grams[at], "phrase": whole}


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    return b"".join(texts), ends - sizes, ends


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(row, first byte, text) of whole texts, or of overlapping parts of long ones."""
    rows, out = [], []
    for row, data in enumerate(bytes_of(batch)):
        if len(data) <= SLICE:
            rows.append(row)
            out.append(data)
            continue
        for at in range(0, len(data) - LENGTH + 1, SLICE):
            yield np.array([row]), np.array([at]), [data[at:at + SLICE + LENGTH - 1]]
    if rows:
        yield np.array(rows), np.zeros(len(rows), dtype=np.int64), out


def _binary(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32()} | {n: pa.binary() for n in names}
    return pa.record_batch([pa.array([r.get(n) for r in rows], k) for n, k in kinds.items()], names=list(kinds))


def _schema(names: list[str]) -> str:
    return ", ".join(["bucket int", *(f"{n} binary" for n in names)])


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(13)) % np.uint64(buckets)).astype(np.int64)


def parse(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed phrases by the bucket of their trigger gram; bucket below zero: phrases known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in slices(batches, limit=SLICE):
            u1, u2 = part.column("u1").to_numpy(), part.column("u2").to_numpy()
            rows: list[dict] = []
            for row, base, texts in _parts(part):
                found = phrases(*_joined(texts))
                twice, chosen = rolling.repeated(found["phrase"])
                owner = row[found["text"]]
                entry = {
                    "key": found["key"], "phrase": found["phrase"], "u1": u1[owner], "u2": u2[owner], "first": found["first"] + base[found["text"]],
                    "size": found["size"].astype(np.uint32), "reach": found["reach"].astype(np.uint32), "many": chosen.astype(np.uint8),
                }
                known = np.flatnonzero(twice)
                if len(known):
                    rows.append({"bucket": -1 - (int(u1[owner[known[0]]]) & 0xFFFF)} | {n: v[known].tobytes() for n, v in entry.items()})
                sent = np.flatnonzero(~twice | chosen)
                rows += spans.packed(_bucket(entry["key"][sent], buckets), buckets, {n: v[sent] for n, v in entry.items()})
            if rows:
                yield _binary(rows, list(PARSE))

    return spans.keyed(docs).drop("doc_id").mapInArrow(run, _schema(list(PARSE)))


def dictionary(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Phrases of one bucket: those that repeat, and those to be compared within their gram's group."""
    entry = spans.unpacked(table, PARSE)
    if table.column("bucket")[0].as_py() < 0:  # resolved by its task
        full, detail = np.ones(len(entry["key"]), dtype=bool), np.zeros(len(entry["key"]), dtype=bool)
    else:
        again, chosen = rolling.repeated(entry["phrase"])
        many = entry["many"] > 0
        full = again & ~many  # (a task has marked its own occurrences of what it holds many times)
        once = ~again & ~many
        _, group = np.unique(entry["key"], return_inverse=True)
        single = np.bincount(group, once) > 0  # groups with a phrase that occurs once
        distinct = once | (chosen | (many & ~again))
        shared = np.bincount(group, distinct) > 1
        detail = distinct & single[group] & shared[group]
    for kind, which in ((0, full), (1, detail)):
        rows = np.flatnonzero(which)
        if len(rows):
            columns = {n: entry[n][rows] for n in ("u1", "u2", "first", "size", "reach")} | {"key": entry["key"][rows].view(np.int64)}
            yield pa.record_batch([pa.array([kind] * len(rows), pa.int32()), *(pa.array(v.astype(np.int64)) for v in columns.values())], names=["kind", *columns])


def fetch(docs: DataFrame, wanted: DataFrame, buckets: int) -> DataFrame:
    """The bytes of phrases that must be compared, packed by the bucket of their gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            found: dict[str, list] = {n: [] for n in ("key", "u1", "u2", "first", "size", "reach")}
            texts: list[bytes] = []
            owners = zip(part.column("u1").to_pylist(), part.column("u2").to_pylist(), bytes_of(part), part.column("phrases").to_pylist(), strict=True)
            for u1, u2, data, asked in owners:
                for p in asked:
                    for name, value in (("u1", u1), ("u2", u2), *((n, p[n]) for n in ("key", "first", "size", "reach"))):
                        found[name].append(value)
                    texts.append(data[p["first"]:p["first"] + p["size"] - 1 + LENGTH])
            entry = {n: np.array(v, dtype="i8" if n == "key" else DETAIL[n]) for n, v in found.items()}
            entry["key"] = entry["key"].view(np.uint64)
            raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            rows = list(spans.packed(_bucket(entry["key"], buckets), buckets, entry, {"bytes": (raw, sizes)}))
            if rows:
                yield _binary(rows, [*DETAIL, "bytes"])

    asked = wanted.groupBy(*spans.KEY).agg(F.collect_set(F.struct("key", "first", "size", "reach")).alias("phrases"))
    # one of several equal rows answers
    texts = spans.keyed(docs).drop("doc_id").join(asked, spans.KEY).dropDuplicates(spans.KEY)
    return texts.mapInArrow(run, _schema([*DETAIL, "bytes"]))


def _string_hashes(data: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hashes of the LENGTH-byte strings at ``begin``, begin + 1, ... (``count`` of them) of every phrase."""
    out = []
    edges = np.concatenate([[0], np.cumsum(count + LENGTH - 1)])
    cuts = np.searchsorted(edges, np.arange(0, int(edges[-1]), SLICE // 2)) if len(begin) else np.zeros(0, dtype=np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(begin)], strict=True):
        if a == b:
            continue
        size = count[a:b] + LENGTH - 1
        _, wide = _levels(data[rolling.spread(begin[a:b], size)])
        strings = rolling.cover(wide, 256, LENGTH)
        out.append(strings[rolling.spread(np.cumsum(size) - size, count[a:b])])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Spans of strings that occur twice among the fetched phrases of a bucket."""
    entry = spans.unpacked(table, DETAIL | {"bytes": "u1"})
    size, reach = entry["size"].astype(np.int64), entry["reach"].astype(np.int64)
    begin = np.cumsum(size + LENGTH - 1) - (size + LENGTH - 1)
    order = np.argsort(entry["key"], kind="stable")
    load = np.cumsum(size[order])
    at = 0
    while at < len(order):
        # whole groups up to the limit, or one group that is larger
        stop = int(np.searchsorted(load, (load[at - 1] if at else 0) + COMPARED, side="right"))
        keys = entry["key"][order]
        if stop < len(order):
            begin_of = int(np.searchsorted(keys, keys[stop]))
            stop = begin_of if begin_of > at else int(np.searchsorted(keys, keys[stop], side="right"))
        rows = order[at:stop]
        at = stop
        strings = int(size[rows].sum())
        steps = -(-strings // COMPARED)
        low, high = int((reach[rows] - size[rows] + 1).min()), int(reach[rows].max())
        width = -(-(high - low + 1) // steps)
        for near in range(low, high + 1, width):  # equal strings have their trigger at the same distance
            skip = np.maximum(0, reach[rows] - (near + width - 1))
            stay = np.minimum(size[rows] - 1, reach[rows] - near) - skip + 1
            some = np.flatnonzero(stay > 0)
            run, count = rows[some], stay[some]
            hashes = _string_hashes(entry["bytes"], begin[run] + skip[some], count)
            twice, _ = rolling.repeated(hashes)
            owner = np.repeat(np.arange(len(run)), count)
            start = rolling.spread(entry["first"][run] + skip[some], count)
            chosen = np.flatnonzero(twice)
            first, n = rolling.runs(owner[chosen], start[chosen] - np.arange(len(chosen)))
            if len(first):
                spot = chosen[first]
                yield spans.span_batch(entry["u1"][run[owner[spot]]], entry["u2"][run[owner[spot]]], start[spot], start[spot] + n + LENGTH - 1)


def repeats(docs: DataFrame) -> DataFrame:
    """(u1, u2, first, last): byte spans covered by repeated strings; spans of one row may overlap."""
    state = LoopState(docs.sparkSession, "parse")
    buckets = spans.bucket_count(docs.sparkSession)
    schema = "kind int, u1 long, u2 long, first long, size long, reach long, key long"
    found, _ = state.save(spans.over_buckets(parse(docs, buckets), buckets, dictionary, schema))
    found = found.withColumn("u2", F.col("u2").cast("int"))
    known = found.where("kind = 0").select(*spans.KEY, "first", (F.col("first") + F.col("size") + LENGTH - 1).alias("last"))
    fetched = fetch(docs, found.where("kind = 1"), 4 * buckets)
    return known.unionByName(spans.over_buckets(fetched, 4 * buckets, compare, spans.SPAN))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary): every row without its repeated bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            total, removed, stretches, kept, sha = [], [], [], [], []
            for data, found in zip(bytes_of(part), part.column("spans").to_pylist(), strict=True):
                gone = spans.covered(len(data), found)
                left = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes() if found else data
                total.append(len(data))
                removed.append(int(gone.sum()))
                stretches.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(left)
                sha.append(hashlib.sha256(left).hexdigest())
            columns = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in (total, removed, stretches)), pa.array(sha, pa.string()), pa.array(kept, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = spans.with_spans(docs.select("doc_id", "text"), repeats(docs)).select("rest.doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {id_type(docs)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
