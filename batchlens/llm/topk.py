"""Exact top-k search by inner product with pivot-table elimination.

Components are turned into floor(64 * x); the score is the integer inner
product.  Distances of all vectors to ``PIVOTS`` fixed pivots form the pivot
table.  For a query and a candidate the largest coordinate difference of their
table rows is a lower bound of their distance, and with both norms an upper
bound of their score.  Candidates are packed into blocks of neighbours (by
nearest pivot); for a block the intervals of its coordinates give a bound
first.  Blocks, and candidates within a block, are evaluated in bound order
until no bound reaches the query's k-th best score.  A bounded sample, from
which the pivots are chosen as well, gives every query a first such score.

Query blocks meet candidate blocks in a grid: a task holds one query block and
a bounded number of candidate blocks, and the k best per task are merged.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do null ids; rows that repeat an id count once (the smallest
vector); a shorter vector counts as filled up with zeros; ties go to the
smaller id; a query with fewer than k candidates returns all; an empty table
gives an empty result; other columns are ignored.  Scores must fit a long; they are exact beyond 2^53
as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchlens.session import LoopState

SCALE = 64
PIVOTS = 24
#: Rows of the bounded sample (first by a hash of the id).
SAMPLE = 1024
QUERY_BLOCK = 512
CANDIDATE_BLOCK = 1024
#: Candidate blocks per task.
STRIPE = 16
#: Candidates evaluated between two looks at the bounds.
TILE = 256
#: Whole numbers below this are exact as doubles.
EXACT = 2.0**53
#: The score of no candidate.
NONE = np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    """Not null and without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): integer vectors, one per id."""
    ints = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    valid = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    return valid.select(F.col(id_col).alias("vec_id"), ints.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(lists, width: int, kind: type = np.float64) -> np.ndarray:
    """Rows filled up with zeros."""
    out = np.zeros((len(lists), width), dtype=kind)
    for row, v in zip(out, lists, strict=True):
        row[: len(v)] = v
    return out


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Far-apart sample vectors: each next one is the farthest from those chosen."""
    if not len(sample):
        return sample
    chosen = [int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    near = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def upper(query_norm: np.ndarray, norm: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Bound of the score from squared norms and a lower bound of the distance, with room for rounding."""
    top = (query_norm + norm - gap**2) / 2
    return top + 1e-9 * (query_norm + norm) + 1e-6


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in floating point where every partial sum is exact there, else in whole numbers."""
    largest = [float(np.abs(side.astype(np.float64)).max(initial=0)) for side in (q, x)]
    if largest[0] * largest[1] * q.shape[1] < EXACT and max(largest) < EXACT:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, ``NONE`` where there are fewer."""
    if scores.shape[1] < k:
        scores = np.pad(scores, ((0, 0), (0, k - scores.shape[1])), constant_values=NONE)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k:]


def search(q_id: np.ndarray, q: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], pivots: np.ndarray, k: int):
    """(query row, id, score) of candidates that can be among the k best; ``floor``: a score the k-th best is known to reach.

    Vectors and scores are whole numbers; bounds are floating point with room
    for rounding, also for that of a score they are compared with.
    """
    real = q.astype(np.float64)
    q_norm, q_far = (real**2).sum(axis=1), distances(real, pivots)
    top, reach = np.full((len(q), k), NONE), floor.copy()
    facts = [(ids, x, distances(x.astype(np.float64), pivots), (x.astype(np.float64) ** 2).sum(axis=1)) for ids, x in blocks]
    bounds = []
    for _, _, far, norm in facts:
        gap = np.maximum(q_far - far.max(axis=0), far.min(axis=0) - q_far).max(axis=1)
        bounds.append(upper(q_norm, norm.max(), np.maximum(gap, 0)))
    rows, found, scores = [], [], []
    for b in sorted(range(len(facts)), key=lambda i: -bounds[i].max()):
        live = np.flatnonzero(bounds[b] >= reach)
        if not len(live):
            continue
        ids, x, far, norm = facts[b]
        gap = np.zeros((len(live), len(x)))
        for p in range(far.shape[1]):
            np.maximum(gap, np.abs(q_far[live, p, None] - far[None, :, p]), out=gap)
        bound = upper(q_norm[live, None], norm[None], gap)
        order = np.argsort(-bound.max(axis=0), kind="stable")
        for at in range(0, len(order), TILE):
            tile = order[at:at + TILE]
            on = np.flatnonzero((bound[:, tile] >= reach[live, None]).any(axis=1))
            if not len(on):
                if (bound[:, order[at:]] < reach[live, None]).all():
                    break  # no bound left reaches a k-th best score
                continue
            who = live[on]
            score = inner(q[who], x[tile])
            score[q_id[who][:, None] == ids[tile][None]] = NONE
            top[who] = best(np.concatenate([top[who], score], axis=1), k)
            reach[who] = np.maximum(reach[who], top[who].min(axis=1))
            i, j = np.nonzero((score >= reach[who, None]) & (score > NONE))
            rows.append(who[i])
            found.append(ids[tile[j]])
            scores.append(score[i, j])
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    rows, found, scores = np.concatenate(rows), np.concatenate(found), np.concatenate(scores)
    keep = scores >= reach[rows]
    rows, found, scores = rows[keep], found[keep], scores[keep]
    order = np.lexsort((found, -scores, rows))
    rows, found, scores = rows[order], found[order], scores[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[place < k], found[place < k], scores[place < k]


def pack_blocks(vectors: DataFrame, size: int, pivots: np.ndarray, width: int) -> DataFrame:
    """(ids, x): blocks of up to ``size`` vectors that share a nearest pivot where possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v").to_pylist(), width, np.int64)
            ids = batch.column("vec_id").to_numpy()
            near = distances(x.astype(np.float64), pivots)
            order = np.lexsort((near.min(axis=1), near.argmin(axis=1)))
            for at in range(0, len(order), size):
                rows = order[at:at + size]
                yield pa.record_batch([pa.array([ids[rows].tobytes()]), pa.array([x[rows].tobytes()])], names=["ids", "x"])

    return vectors.mapInArrow(run, "ids binary, x binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest scores among all other vectors.

    ``vectors`` as of ``quantized``; ``is_query`` is a condition on vec_id.
    """
    spark = vectors.sparkSession
    state = LoopState(spark, "topk")
    rows, facts = state.save_summing(vectors, width=F.lit(0))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    head = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample, sample_ids = matrix([r["v"] for r in head], width, np.int64), np.array([r["vec_id"] for r in head], dtype=np.int64)
    pivots = choose_pivots(sample.astype(np.float64))
    result = "query_id long, vec_id long, score long"
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked, n_asked = state.save(pack_blocks(rows.where(is_query), QUERY_BLOCK, pivots, width).withColumn("q", F.monotonically_increasing_id()))
    held, n_held = state.save(pack_blocks(rows, CANDIDATE_BLOCK, pivots, width))
    stripes = max(1, -(-n_held // STRIPE))
    grid_q = asked.select("q", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), "ids", "x", F.lit(0).alias("kind"))
    numbers = asked.select("q")
    place = held.withColumn("stripe", F.pmod(F.xxhash64("ids"), F.lit(stripes)).cast("int"))
    # every candidate block goes to every query block: a query set against all rows, in blocks
    grid_c = place.join(numbers.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))), "stripe").select("q", "stripe", "ids", "x", F.lit(1).alias("kind"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [
            (kind, np.frombuffer(ids, dtype=np.int64), np.frombuffer(x, dtype=np.int64).reshape(-1, width))
            for kind, ids, x in zip(group["kind"], group["ids"], group["x"], strict=True)
        ]
        _, q_id, q = next(p for p in parts if p[0] == 0)
        known = inner(q, sample)
        known[q_id[:, None] == sample_ids[None]] = NONE
        floor = best(known, k).min(axis=1)
        row, found, score = search(q_id, q, floor, [(i, x) for kind, i, x in parts if kind], pivots, k)
        return pd.DataFrame({"query_id": q_id[row], "vec_id": found, "score": score})

    local = grid_q.unionByName(grid_c).groupBy("q", "stripe").applyInPandas(run, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
