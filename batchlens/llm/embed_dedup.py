"""Embedding near-duplicates by NN-descent.

Equal vectors are one class.  A first neighbour graph comes from random
projections: classes are sorted by the signs of their projections and compared
with those nearby in the order, over a few independent orders.  Rounds of
NN-descent then compare the neighbours of each class with one another (both
directions of the graph, new edges only) and keep each class's best.  A class
whose whole list lies above the threshold is saturated: its list is doubled.

Edges near or above the threshold group the classes.  The graph only gives a
first grouping: its lists are bounded, so links can be missing.  An exact step
then compares classes of different groups block by block, in a grid of bounded
tasks, and leaves out only block pairs whose bounds (angles to a pivot) forbid a
link; groups it links are joined.  Inside a group all pairs are compared in double precision, block by block, so that the number of links
is exact there and no pair of equal vectors is ever written out; each block
pair returns link counts and the stars of its own components.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; a shorter vector counts as filled up with zeros;
rows that repeat an id use the smallest of its vectors and give one result row
each; rows with a null id link with nothing and have no component; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.llm.components import components
from batchlens.llm.topk import matrix, usable
from batchlens.session import LoopState

THRESHOLD = 0.9
#: Neighbours kept at first, and at most for a saturated class; beyond, the exact comparison within groups takes over.
LIST, LONGEST = 8, 16
ORDERS = 4
BITS = 62
#: Classes compared with one another along an order; steps overlap by half.
STRETCH = 256
ROUNDS = 6
#: Rounds go on while more than this share of all list places changes.
CHANGED = 0.002
#: Members of a neighbourhood that are compared at once; larger ones are split.
MEMBERS = 96
#: Vectors of a group per block.
BLOCK = 512
#: Pivots that place vectors in blocks, and vectors of a stripe of the grid, at most; a table has this many stripes if its blocks allow.
PIVOTS, STRIPE, STRIPES = 512, 16384, 8
#: Added to bounds on angles, far above their rounding errors.
ANGLE_SLACK = 1e-3
#: Single-precision scores this far below the threshold still group two classes.
SLACK = 1e-4


def classes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, node): usable vectors, one per id; node is the smallest id with that vector."""
    fine = usable(F.col(vector_col)) & F.exists(vector_col, lambda x: x != 0)
    one = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).groupBy(F.col(id_col).alias("vec_id"))
    return one.agg(F.min(F.transform(vector_col, lambda x: x.cast("double"))).alias("v"))


def units(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Unit vectors of a batch, safe against overflow."""
    x = matrix(batch.column("v").to_pylist(), width)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def unit_table(nodes: DataFrame, width: int) -> DataFrame:
    """(node, copies, unit, exact): unit vectors as bytes in single and in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = units(batch, width)
            single, exact = [r.tobytes() for r in x.astype(np.float32)], [r.tobytes() for r in x]
            yield pa.record_batch([batch.column("node"), batch.column("copies"), pa.array(single, pa.binary()), pa.array(exact, pa.binary())], names=["node", "copies", "unit", "exact"])

    return nodes.select("node", "copies", "v").mapInArrow(run, "node long, copies long, unit binary, exact binary")


def stack(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, width)


def edges_of(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score.astype(np.float32))], names=["a", "b", "score"])


def along_order(table: DataFrame, width: int, seed: int, keep: int) -> DataFrame:
    """(a, b, score): best neighbours among those near in one order of projection signs."""
    plane = np.random.default_rng(seed).normal(size=(width, BITS)).astype(np.float32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            bits = stack(batch.column("unit"), "<f4", width) @ plane > 0
            yield pa.record_batch([pa.array(bits @ weights), batch.column("node"), batch.column("unit")], names=["spot", "node", "unit"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.zeros(0, dtype=np.int64), np.zeros((0, width), dtype=np.float32)

        def best(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            score = x @ x.T
            np.fill_diagonal(score, -2)
            n = min(keep, len(ids) - 1)
            near = np.argpartition(-score, n - 1, axis=1)[:, :n]
            return edges_of(np.repeat(ids, n), ids[near].ravel(), np.take_along_axis(score, near, axis=1).ravel())

        last = False
        for batch in batches:
            ids = np.concatenate([ids, batch.column("node").to_numpy()])
            x = np.concatenate([x, stack(batch.column("unit"), "<f4", width)])
            at = 0
            while len(ids) - at >= STRETCH:
                yield best(ids[at:at + STRETCH], x[at:at + STRETCH])
                at, last = at + STRETCH // 2, True
            ids, x = ids[at:], x[at:]
        if len(ids) > (STRETCH // 2 if last else 1):
            yield best(ids, x)

    signed = table.select("node", "unit").mapInArrow(sign, "spot long, node long, unit binary")
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return signed.repartitionByRange(parts, "spot").sortWithinPartitions("spot", "node").mapInArrow(compare, "a long, b long, score float")


def best_lists(scored: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """(a, k, near): the k best distinct neighbours of each class as structs (score, b, fresh); ``lengths`` gives k where it isn't LIST."""
    one = scored.groupBy("a", "b").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    lists = one.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("score", "b", "fresh")), asc=False).alias("near"))
    lists = lists.join(lengths, "a", "left") if lengths is not None else lists.withColumn("k", F.lit(None).cast("int"))
    lists = lists.withColumn("k", F.coalesce("k", F.lit(LIST)))
    return lists.select("a", "k", F.slice("near", 1, F.col("k")).alias("near"))


def descend(graph: DataFrame, table: DataFrame, width: int, turn: int) -> DataFrame:
    """(a, b, score): pairs found among neighbours of neighbours that improve a list; large neighbourhoods are split anew in each ``turn``."""
    flat = graph.select("a", F.explode("near").alias("e")).select("a", "e.b", "e.fresh")
    both = flat.unionByName(flat.select(F.col("b").alias("a"), F.col("a").alias("b"), "fresh"))
    both = both.groupBy(F.col("a").alias("hub"), F.col("b").alias("node")).agg(F.max("fresh").alias("fresh"))
    sizes = both.groupBy("hub").agg(F.count("*").alias("n"), F.max("fresh").alias("any")).where("any AND n > 1")
    parts = F.ceil(F.col("n") / MEMBERS)
    both = both.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node", F.lit(turn)), parts).alias("part"), "node", "fresh")
    last, full = F.element_at("near", -1)["score"], F.size("near") >= F.col("k")
    # a list above the threshold takes links only, and none once it is as long as may be: its group is compared exactly later
    bar = F.when(last >= THRESHOLD, F.when(full & (F.col("k") >= LONGEST), 2.0).when(full, last).otherwise(THRESHOLD - SLACK)).when(full, last).otherwise(-2.0)
    worst = graph.select(F.col("a").alias("node"), bar.cast("float").alias("worst"))
    members = both.join(table.select("node", "unit").join(worst, "node", "left"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
            hub, part, node = (batch.column(n).to_numpy() for n in ("hub", "part", "node"))
            fresh = batch.column("fresh").to_numpy(zero_copy_only=False)
            worst = batch.column("worst").fill_null(-2).to_numpy()
            x = stack(batch.column("unit"), "<f4", width)
            cuts = [0, *(np.flatnonzero((hub[1:] != hub[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(hub)]
            a, b, s = [], [], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo < 2:
                    continue
                score = x[lo:hi] @ x[lo:hi].T
                np.fill_diagonal(score, -3)
                i, j = np.nonzero((score > worst[lo:hi, None]) & (fresh[lo:hi, None] | fresh[None, lo:hi]))
                a.append(node[lo + i])
                b.append(node[lo + j])
                s.append(score[i, j])
            if not a:
                return edges_of(*(np.zeros(0),) * 3)
            return edges_of(np.concatenate(a), np.concatenate(b), np.concatenate(s))

        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            hub, part = batch.column("hub").to_numpy(), batch.column("part").to_numpy()
            at = int(np.flatnonzero((hub != hub[-1]) | (part != part[-1]))[-1]) + 1 if ((hub != hub[-1]) | (part != part[-1])).any() else 0
            if at:
                yield pairs(batch.slice(0, at))
            held = batch.slice(at)
        if held is not None and held.num_rows:
            yield pairs(held)

    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = members.repartition(n, "hub", "part").sortWithinPartitions("hub", "part")
    return placed.select("hub", "part", "node", "fresh", "unit", "worst").mapInArrow(run, "a long, b long, score float")


def neighbour_graph(table: DataFrame, n: int, width: int, state: LoopState) -> DataFrame:
    """(a, k, near): the refined graph."""
    scored = [along_order(table, width, seed, LIST) for seed in range(ORDERS)]
    union = scored[0]
    for more in scored[1:]:
        union = union.unionByName(more)
    union = union.withColumn("fresh", F.lit(True))
    graph, _ = state.save(best_lists(union))
    for turn in range(ROUNDS):
        old = graph.select("a", F.explode("near").alias("e")).select("a", "e.b", "e.score", F.lit(False).alias("fresh"))
        found = descend(graph, table, width, turn).withColumn("fresh", F.lit(True))
        full = F.size("near") >= F.col("k")
        saturated = full & (F.element_at("near", -1)["score"] >= THRESHOLD) & (F.col("k") < LONGEST)
        longer = graph.select("a", F.when(saturated, F.least(F.col("k") * 2, F.lit(LONGEST))).otherwise(F.col("k")).alias("k"))
        refined, facts = state.save_summing(best_lists(old.unionByName(found), longer), fresh=F.size(F.filter("near", lambda e: e["fresh"])))
        state.drop(graph)
        graph = refined
        if facts["fresh"] <= CHANGED * n * LIST:
            break
    return graph


def groups_of(graph: DataFrame) -> DataFrame:
    """(node, component) over edges near or above the threshold."""
    close = graph.select("a", F.explode("near").alias("e")).where(F.col("e.score") >= THRESHOLD - SLACK)
    return components(close.select("a", F.col("e.b").alias("b")), "embed-groups")


def least_labels(link: np.ndarray, label_x: np.ndarray, label_y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Components of a block pair: the least label among linked ones, until nothing changes."""
    top = np.iinfo(np.int64).max
    while True:
        new_y = np.minimum(label_y, np.where(link, label_x[:, None], top).min(axis=0))
        new_x = np.minimum(label_x, np.where(link, new_y[None], top).min(axis=1))
        if same:
            new_x = new_y = np.minimum(new_x, new_y)
        if (new_x == label_x).all() and (new_y == label_y).all():
            return label_x, label_y
        label_x, label_y = new_x, new_y


def cross_links(table: DataFrame, groups: DataFrame, n: int, width: int, state: LoopState) -> DataFrame:
    """(a, b): edges that join all groups with a link between them; a class without a group is one of its own.

    Vectors are placed with their nearest pivot and blocks are cut from them.
    Stripes of blocks meet in a grid, one bounded task for each pair of stripes.
    """
    head = table.orderBy(F.xxhash64("node"), "node").select("unit").limit(max(1, min(PIVOTS, n // BLOCK))).collect()
    pivots = np.frombuffer(b"".join(r["unit"] for r in head), dtype="<f4").reshape(-1, width)
    stripes = min(max(-(-n // STRIPE), STRIPES), max(1, n // BLOCK))
    slack, far = max(SLACK, 2e-7 * width), float(np.arccos(THRESHOLD)) + ANGLE_SLACK

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = stack(batch.column("unit"), "<f4", width) @ pivots.T
            cell = score.argmax(axis=1)
            angle = np.arccos(np.clip(score.max(axis=1), -1, 1))
            yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32()), pa.array(angle, pa.float32())], names=["node", "component", "unit", "cell", "angle"])

    member = table.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "unit")
    placed, _ = state.save(member.mapInArrow(place, "node long, component long, unit binary, cell int, angle float"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    placed = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    stripe = F.pmod(F.xxhash64("cell", "part"), F.lit(stripes)).cast("int")
    # each stripe meets every other one and itself: the grid cell is the pair of their numbers
    other = F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("other")
    dealt = placed.select("component", "unit", "cell", "angle", "part", stripe.alias("stripe"), other)
    dealt = dealt.select(F.least("stripe", "other").alias("x"), F.greatest("stripe", "other").alias("y"), "stripe", "cell", "part", "component", "angle", "unit")

    def met(side: list[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Edges among the blocks of one grid cell."""
        all_ = pa.Table.from_batches(side).combine_chunks().to_batches()[0]
        x, y, stripe, cell, part, component, angle = (all_.column(c).to_numpy() for c in ("x", "y", "stripe", "cell", "part", "component", "angle"))
        unit = stack(all_.column("unit"), "<f4", width)
        starts = np.append(0, np.flatnonzero((stripe[1:] != stripe[:-1]) | (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1)
        ends = np.append(starts[1:], len(cell))
        low, high = np.minimum.reduceat(angle, starts), np.maximum.reduceat(angle, starts)
        home, of = cell[starts], stripe[starts]
        between = np.arccos(np.clip(pivots[home] @ pivots[home].T, -1, 1))
        between[home[:, None] == home[None]] = 0
        # least angle by the triangle inequality, from either end
        least = np.maximum(between - high[:, None] - high[None], np.maximum(low[:, None] - between - high[None], low[None] - between - high[:, None]))
        within = x[0] == y[0]
        allowed = (least <= far) & (within | (of[:, None] != of[None]))
        for i, j in zip(*np.nonzero(np.triu(allowed)), strict=True):
            p, q = slice(starts[i], ends[i]), slice(starts[j], ends[j])
            link = unit[p] @ unit[q].T >= THRESHOLD - slack
            if link.any():
                link &= component[p, None] != component[None, q]
                if link.any():
                    for label, old in zip(least_labels(link, component[p], component[q], i == j), (component[p], component[q]), strict=True):
                        yield old[label != old], label[label != old]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def edges() -> Iterator[pa.RecordBatch]:
            for a, b in met(held):
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            x, y = batch.column("x").to_numpy(), batch.column("y").to_numpy()
            cuts = [0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), len(x)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and (held[0].column("x")[0].as_py(), held[0].column("y")[0].as_py()) != (x[lo], y[lo]):
                    yield from edges()
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from edges()

    grid = dealt.repartition(max(stripes * (stripes + 1) // 2, 1), "x", "y").sortWithinPartitions("x", "y", "stripe", "cell", "part")
    return grid.mapInArrow(run, "a long, b long").distinct()


def joined_groups(table: DataFrame, groups: DataFrame, cross: DataFrame) -> DataFrame:
    """(node, component): groups with those that ``cross`` links made one."""
    merged = components(cross, "embed-cross").select(F.col("node").alias("component"), F.col("component").alias("merged"))
    every = table.select("node").join(groups.select("node", "component", F.lit(True).alias("grouped")), "node", "left")
    every = every.withColumn("component", F.coalesce("component", "node")).join(merged, "component", "left")
    return every.where("grouped OR merged IS NOT NULL").select("node", F.coalesce("merged", "component").alias("component"))


def exact_links(table: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """(kind, a, b): kind 0, class a has b links to other classes' vectors (to be summed); kind 1, an edge of a star over linked classes."""
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    member = groups.join(sizes, "component").join(table.select("node", "copies", "exact"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # blocks are evenly filled by hash, so their number of vectors is bounded
    blocks = member.groupBy("component", "blocks", block.alias("block")).agg(F.collect_list(F.struct("node", "copies", "exact")).alias("m"))
    # each block goes to the keys of all its pairs, so that those of a large group spread over tasks
    left = blocks.select("component", F.col("block").alias("x"), F.explode(F.sequence("block", (F.col("blocks") - 1).cast("int"))).alias("y"), F.col("m").alias("mx"))
    right = blocks.select("component", F.explode(F.sequence(F.lit(0), "block")).alias("x"), F.col("block").alias("y"), F.col("m").alias("my"))
    met = left.join(right, ["component", "x", "y"]).select((F.col("x") == F.col("y")).alias("same"), "mx", "my")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def side(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = np.frombuffer(b"".join(r["exact"] for r in rows), dtype="<f8").reshape(-1, width)
            return np.array([r["node"] for r in rows]), np.array([r["copies"] for r in rows]), x

        for batch in batches:
            kinds, a, b = [], [], []
            for same, mx, my in zip(batch.column("same").to_pylist(), batch.column("mx"), batch.column("my"), strict=True):
                id_x, n_x, x = side(mx.as_py())
                id_y, n_y, y = side(my.as_py())
                link = x @ y.T >= THRESHOLD
                if same:
                    np.fill_diagonal(link, False)
                counts = [(id_x, link @ n_y)] + ([] if same else [(id_y, n_x @ link)])
                for ids, count in counts:
                    kinds.append(np.zeros(len(ids), dtype=np.int32))
                    a.append(ids)
                    b.append(count)
                label_x, label_y = least_labels(link, id_x, id_y, same)
                for ids, label in ((id_x, label_x), (id_y, label_y)):
                    moved = ids != label
                    kinds.append(np.ones(int(moved.sum()), dtype=np.int32))
                    a.append(ids[moved])
                    b.append(label[moved])
            if kinds:
                yield pa.record_batch([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["kind", "a", "b"])

    return met.mapInArrow(run, "kind int, a long, b long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every input row."""
    spark = vectors.sparkSession
    state = LoopState(spark, "embed")
    rows, _ = state.save(classes(vectors, id_col, vector_col))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    nodes = rows.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    member, _ = state.save(rows.join(nodes, "v").select("vec_id", "node", "copies"))
    table, n = state.save(unit_table(nodes, width))
    groups, _ = state.save(groups_of(neighbour_graph(table, n, width, state)))
    cross, _ = state.save(cross_links(table, groups, n, width, state))
    groups, _ = state.save(joined_groups(table, groups, cross))
    links, _ = state.save(exact_links(table, groups, width))
    counts = links.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    joined = components(links.where("kind = 1").select("a", "b"), "embed-components")
    found = member.join(counts, "node", "left").join(joined, "node", "left")
    found = found.select(
        "vec_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"),
    )
    every = vectors.select(F.col(id_col).alias("vec_id")).join(found, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
