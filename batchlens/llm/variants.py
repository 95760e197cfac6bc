"""Spelling variants: words that differ by one code point, grouped under a much more frequent one.

The vocabulary is counted with ordinary aggregates.  Neighbours are found by
probing: every deletion and replacement of one code point is generated as a
64-bit hash, which follows from the word's hash in constant time, and tested
against blocked Bloom filters, one shard per word length, that every task has
by broadcast.  Only positives are shuffled to an exact join with the vocabulary,
and the joined words are compared as text, so neither a false positive nor two
words of one hash matter.  An insertion is the deletion of the other word, and a
replacement is generated from both words, so each pair needs no other edit.

A filter takes a fixed number of bytes per word.  All filters of one round stay
below ``ROUND_BYTES``; a larger vocabulary is filtered in several rounds, each
over its own part of the hashes, so that the broadcast never grows and no
candidate is lost.

Defined results: null and empty texts have no words; repeated rows count as
often as they are there; a null id stands as an empty string in the digest that
decides which runs lose a code point; an empty table gives an empty result;
columns other than id and text are ignored; ties go to the word that is
smallest in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.llm import rolling
from batchlens.llm.common import let_go, signed
from batchlens.session import LoopState

#: Maximal runs of letters; shorter ones can't become words.
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a code point.
DAMAGED = 31
SHORTEST, LEAST_COUNT, FACTOR = 7, 2, 10
#: Longer words share a shard.
LONGEST_SHARD = 64
#: Bits set per word in one block of eight 64-bit values, and words per block.
PROBES, BLOCK_WORDS = 6, 8
WORDS_PER_BLOCK = 28
#: Bytes of all filters of one round.
ROUND_BYTES = 24 << 20
#: Blocks that one task fills.
CHUNK = 4096
#: Code points whose edits are generated together.
LETTER_SLICE = 10_000
#: Words a task probes for.
TASK_WORDS = 20_000
_MIX = [np.uint64(v) for v in np.random.default_rng(12).integers(1, 1 << 63, size=3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): lower-cased runs of letters, one in ``DAMAGED`` without one code point."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{shortest},}}"), F.lit(0))).alias("run"))
    digest = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    marked = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run")).withColumn("h", digest)
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = marked.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def code_points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, one after the other, and their number per word."""
    sizes = pa.compute.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype="<u4").astype(np.uint64), sizes


def letter_values(points: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What a code point at a place adds to the hash of its word."""
    return rolling.mix(points * _MIX[0] + place.astype(np.uint64) * _MIX[1] + _MIX[2])


def finish(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of words from the sums of their letters' values and their sizes."""
    return rolling.mix(rolling.mix(sums + sizes.astype(np.uint64) * _MIX[1]))


def running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values, dtype=np.uint64)])


def word_hashes(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    done = running(letter_values(points, np.arange(len(points)) - np.repeat(starts, sizes)))
    return finish(done[starts + sizes] - done[starts], sizes)


class Layout(NamedTuple):
    """Blocks of each shard (a word length) in one round, where a shard's blocks start, and the number of rounds."""

    blocks: np.ndarray
    first: np.ndarray
    rounds: int

    @classmethod
    def of(cls, counts: dict[int, int]) -> Layout:
        """For so many words of each length; lengths from ``LONGEST_SHARD`` on come as one."""
        words = np.zeros(LONGEST_SHARD + 1, dtype=np.int64)
        for size, n in counts.items():
            words[min(size, LONGEST_SHARD)] += n
        rounds = max(1, -(-int(words.sum()) * BLOCK_WORDS * 8 // (WORDS_PER_BLOCK * ROUND_BYTES)))
        blocks = -(-words // (WORDS_PER_BLOCK * rounds))
        return cls(blocks, np.cumsum(blocks) - blocks, rounds)

    @property
    def total(self) -> int:
        return int(self.blocks.sum())

    def round_of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(self.rounds)).astype(np.int32)

    def block_of(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Block of each hash in its round, -1 where the shard is empty."""
        shard = np.minimum(sizes, LONGEST_SHARD)
        blocks = self.blocks[shard]
        inside = ((hashes >> np.uint64(32)) * blocks.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        return np.where(blocks > 0, self.first[shard] + inside, -1)


def probe_codes(hashes: np.ndarray) -> np.ndarray:
    """Nine bits for each probe: which of the block's values, and which bit of it."""
    return rolling.mix(hashes * _MIX[2])


def filter_chunks(hashed: DataFrame) -> DataFrame:
    """(round, chunk, bits): the filters' bits, ``CHUNK`` blocks at a time."""

    def fill(group: pa.Table) -> pa.Table:
        bits = np.zeros(CHUNK * BLOCK_WORDS, dtype=np.uint64)
        codes = probe_codes(group.column("h").to_numpy().view(np.uint64))
        base = group.column("block").to_numpy() % CHUNK * BLOCK_WORDS
        for i in range(PROBES):
            nine = codes >> np.uint64(9 * i)
            np.bitwise_or.at(bits, base + (nine & np.uint64(7)).astype(np.int64), np.uint64(1) << (nine >> np.uint64(3) & np.uint64(63)))
        return pa.table({"round": group.column("round")[:1], "chunk": group.column("chunk")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    rows = hashed.select("round", F.floor(F.col("block") / CHUNK).cast("long").alias("chunk"), "block", "h")
    return rows.groupBy("round", "chunk").applyInArrow(fill, "round int, chunk long, bits binary")


class Filters:
    """The filters of one round."""

    def __init__(self, layout: Layout, number: int, bits: np.ndarray):
        self.layout, self.number, self.bits = layout, number, bits

    def positive(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be those of words of these sizes."""
        block = self.layout.block_of(hashes, sizes)
        able = np.flatnonzero(block >= 0 if self.layout.rounds == 1 else (block >= 0) & (self.layout.round_of(hashes) == self.number))
        base, codes = block[able] * BLOCK_WORDS, probe_codes(hashes[able])
        for i in range(PROBES):
            nine = codes >> np.uint64(9 * i)
            on = self.bits[base + (nine & np.uint64(7)).astype(np.int64)] >> (nine >> np.uint64(3) & np.uint64(63)) & np.uint64(1) == 1
            able, base, codes = able[on], base[on], codes[on]
        return able


def edits(points: np.ndarray, sizes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, hash, size) of candidates: deletions, and replacements by a larger letter, in slices of bounded size.

    Of equal letters in a row the last one is deleted, so no word comes twice.
    """
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(points)) - starts[word]
    here, moved = running(letter_values(points, place)), running(letter_values(points, place - 1))
    ends = starts + sizes
    whole = here[ends] - here[starts]
    same = np.zeros(len(points), dtype=bool)
    same[:-1] = (points[1:] == points[:-1]) & (word[1:] == word[:-1])
    for low in range(0, len(points), LETTER_SLICE):
        at = np.arange(low, min(low + LETTER_SLICE, len(points)))
        gone = at[~same[at]]
        w = word[gone]
        yield w, finish(here[gone] - here[starts[w]] + moved[ends[w]] - moved[gone + 1], sizes[w] - 1), sizes[w] - 1
        spots, back = np.unique(place[at], return_inverse=True)
        table = letter_values(np.tile(alphabet, (len(spots), 1)), np.repeat(spots[:, None], len(alphabet), axis=1))
        letter, to = np.nonzero(alphabet[None, :] > points[at][:, None])
        w = word[at[letter]]
        yield w, finish((whole[word[at]] - (here[at + 1] - here[at]))[letter] + table[back[letter], to], sizes[w]), sizes[w]


def hashed_words(words: DataFrame, layout: Layout) -> DataFrame:
    """(word, n, h, round, block) of a vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            points, sizes = code_points(batch.column("word"))
            h = word_hashes(points, sizes)
            columns = [batch.column("word"), batch.column("n"), pa.array(signed(h)), pa.array(layout.round_of(h)), pa.array(layout.block_of(h, sizes))]
            yield pa.record_batch(columns, names=["word", "n", "h", "round", "block"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, h long, round int, block long")


def positives(hashed: DataFrame, filters, alphabet: list[int]) -> DataFrame:
    """(source, candidate): hashes of words and of those of their edits that the broadcast filters have."""
    letters = np.array(sorted(alphabet), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, number, data = filters.value
        probe = Filters(layout, number, np.frombuffer(data, dtype=np.uint64))
        for batch in batches:
            points, sizes = code_points(batch.column("word"))
            h = batch.column("h").to_numpy()
            for word, made, size in edits(points, sizes, letters):
                hit = probe.positive(made, size)
                if len(hit):
                    yield pa.record_batch([pa.array(h[word[hit]]), pa.array(signed(made[hit]))], names=["source", "candidate"])

    return hashed.select("word", "h").mapInArrow(run, "source long, candidate long").distinct()


def near_pairs(state: LoopState, hashed: DataFrame, layout: Layout, words: int) -> DataFrame:
    """(a, a_n, b, b_n): every pair of near words once, the longer or (of equal length) smaller one first."""
    spark = hashed.sparkSession
    # at most one row per letter of the class
    alphabet = [ord(r[0]) for r in hashed.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()]
    dealt = hashed.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), words // TASK_WORDS + 1), "h")
    chunks, _ = state.save(filter_chunks(hashed), parts=["round"])
    found = []
    for number in range(layout.rounds):
        bits = np.zeros(-(-layout.total // CHUNK) * CHUNK * BLOCK_WORDS, dtype=np.uint64)  # ROUND_BYTES, rounded up per shard and chunk
        for row in chunks.where(F.col("round") == number).select("chunk", "bits").toLocalIterator():
            at = row["chunk"] * CHUNK * BLOCK_WORDS
            bits[at:at + CHUNK * BLOCK_WORDS] = np.frombuffer(row["bits"], dtype=np.uint64)
        sent = spark.sparkContext.broadcast((layout, number, bits.tobytes()))
        found.append(state.save(positives(dealt, sent, alphabet))[0])
        sent.unpersist()
    a, b = hashed.select("h", F.col("word").alias("a"), F.col("n").alias("a_n")), hashed.select("h", F.col("word").alias("b"), F.col("n").alias("b_n"))
    met = state.union_of(found).join(b.withColumnRenamed("h", "candidate"), "candidate").join(a.withColumnRenamed("h", "source"), "source")
    longer = F.length("a") - F.length("b")
    return met.where((F.levenshtein("a", "b", 1) == 1) & ((longer == 1) | (longer == 0) & (F.col("a") < F.col("b")))).select("a", "a_n", "b", "b_n")


def group_variants(docs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    A word's form is its most frequent near word if that occurs at least
    ``factor`` times as often; its root is the end of the chain of forms.
    """
    state = LoopState(docs.sparkSession, "variants")
    words, total = state.save(vocabulary(docs))
    counts = words.groupBy(F.least(F.length("word"), F.lit(LONGEST_SHARD)).alias("size")).count().collect()  # one row per shard
    layout = Layout.of({r["size"]: r["count"] for r in counts})
    hashed, _ = state.save(hashed_words(words, layout))
    pairs, _ = state.save(near_pairs(state, hashed, layout, total))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best"))
    wide = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best.near", (-F.col("best.k")).alias("near_n"))
    strong = F.col("near_n") >= factor * F.col("n")
    formed, _ = state.save(wide.select(
        "word", F.when(strong, F.col("near")).alias("form"), "n", "n_near", F.when(strong, F.col("near_n")).alias("form_n")))
    ends = roots(state, formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(state: LoopState, links: DataFrame) -> DataFrame:
    """Ends of chains (word, root), whose steps double in length every round; counts grow along a chain, so it has no cycle."""
    now, _ = state.save(links)
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after, facts = state.save_counting(step, moved=F.col("moved"))
        if not facts["moved"]:
            return now.select("word", "root")
        state.drop(now)
        now = after
