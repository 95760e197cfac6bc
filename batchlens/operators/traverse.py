"""Bounded reachability and level waves over edge tables.

Loops keep their state in written tables (``LoopState``), never materialise
paths, and stop when a round adds nothing.  The driver sees row counts only.
Several traversals share one loop: ``keys`` name the columns that tell them
apart (a root, a run, a scenario); edges that differ per traversal carry those
columns too (``edge_keys``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.session import LoopState, plan_by_row_size


#: Links that ``topological_levels`` writes anew when half of them are used up.
REWRITTEN = 500_000


def flip(edges: DataFrame) -> DataFrame:
    """The same edges walked backwards."""
    return edges.withColumnsRenamed({"src_id": "_s", "dst_id": "src_id"}).withColumnRenamed("_s", "dst_id")


def reachable(
    edges: DataFrame, roots: DataFrame, keys: Sequence[str] = ("root",), min_hops: int = 0, max_hops: int | None = None,
    direction: str = "down", scope: DataFrame | None = None, edge_keys: Sequence[str] = (), scope_keys: Sequence[str] = (),
    targets: DataFrame | None = None, most: int | None = None, per_links: int = 0, callers: bool = False,
) -> DataFrame | None:
    """(keys, node, distance): fewest hops from each traversal's roots.

    ``roots`` has the keys and ``node``.  With ``min_hops=1`` a root itself
    appears only when a cycle leads back to it.  ``scope`` (column ``node``)
    must hold every node of a path; with ``scope_keys`` it differs per
    traversal.  Without ``max_hops`` the walk ends when nothing new is found.

    With ``targets`` (column ``node``) only nodes from which a target can still
    be reached are visited: one walk back from all targets together finds how
    far each node is from the nearest, and the walks forward stay inside that
    set and, with ``max_hops``, inside what the hops that are left allow.

    With ``most`` the walk is given up, and the result is None, as soon as it
    has written more rows than that, or than that for every ``per_links`` links.

    With ``callers`` each row also tells its ``caller``: of the nodes one hop
    nearer that lead to it the lowest one, null for a root.
    """
    plan_by_row_size(roots.sparkSession)
    state = LoopState(roots.sparkSession, "reach")
    keys, edge_keys = list(keys), list(edge_keys)
    links = flip(edges) if direction == "up" else edges
    links = links.select(*edge_keys, "src_id", "dst_id")
    start = roots.select(*keys, "node")
    inside = None
    if scope is not None:
        inside = scope.select(*scope_keys, "node").distinct()
        start = start.join(inside, [*scope_keys, "node"], "left_semi")
    if scope_keys:
        inside, _ = state.save(inside)
    elif scope is not None:
        links = links.join(inside.withColumnRenamed("node", "src_id"), "src_id", "left_semi")
        links = links.join(inside.withColumnRenamed("node", "dst_id"), "dst_id", "left_semi")
    links = links.distinct()
    if targets is not None:
        links, _ = state.save(links)
        ahead = reachable(links, targets.select("node"), (), max_hops=max_hops, direction="up").withColumnRenamed("distance", "to_go")
        links = links.join(ahead.withColumnRenamed("node", "dst_id"), "dst_id")
        start = start.join(ahead, "node", "left_semi")
    links, n_links = state.save(links)
    pruned = targets is not None and max_hops is not None
    start = start.distinct().withColumn("distance", F.lit(0))
    frontier, grown = state.save(start.withColumn("caller", F.lit(None).cast(links.schema["src_id"].dataType)) if callers else start)
    seen = [frontier] if min_hops == 0 else []
    depth, total = 0, grown
    while grown and (max_hops is None or depth < max_hops):
        if most is not None and total > most * (max(1, n_links / per_links) if per_links else 1):
            return None
        depth += 1
        step = (
            frontier.select(*keys, F.col("node").alias("src_id"))
            .join(links.where(F.col("to_go") <= max_hops - depth) if pruned else links, [*edge_keys, "src_id"])
            .select(*keys, F.col("dst_id").alias("node"), "src_id")
        )
        step = step.groupBy(*keys, "node").agg(F.min("src_id").alias("caller")) if callers else step.select(*keys, "node").distinct()
        if scope_keys:
            step = step.join(inside, [*scope_keys, "node"], "left_semi")
        if seen:
            step = step.join(state.union_of(seen).select(*keys, "node"), [*keys, "node"], "left_anti")
        frontier, grown = state.save(step.select(*keys, "node", F.lit(depth).alias("distance"), *(["caller"] if callers else [])))
        total += grown
        if grown:
            seen.append(frontier)
    for table in (links, inside) if scope_keys else (links,):
        state.drop(table)  # the result reads the rounds only
    return state.union_of(seen) if seen else frontier


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in a node set (column ``node``)."""
    ids = nodes.select("node").distinct()
    return edges.join(ids.withColumnRenamed("node", "src_id"), "src_id", "left_semi").join(
        ids.withColumnRenamed("node", "dst_id"), "dst_id", "left_semi"
    )


def path_edges(edges: DataFrame, reach: DataFrame, max_hops: int | None = None, keys: Sequence[str] = ("root",), direction: str = "down") -> DataFrame:
    """Edges on a path (of at most ``max_hops``, if given) from each traversal's roots."""
    near = (reach if max_hops is None else reach.where(F.col("distance") < max_hops)).select(*keys, "node")
    end = "src_id" if direction == "down" else "dst_id"
    return near.withColumnRenamed("node", end).join(edges.select("src_id", "dst_id"), end).select(*keys, "src_id", "dst_id").distinct()


def topological_levels(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = (), edge_keys: Sequence[str] = (), induced: bool = False,
) -> DataFrame:
    """(keys, node, level, in_cycle): level is the longest path from a source.

    Nodes on or behind a cycle are never freed; they come last, one level
    after all others, flagged.  ``condense.strong_components`` tells the two
    apart.

    Every link carries the number of predecessors of its end.  A round takes
    the links that leave the nodes freed last, subtracts them from what is left
    of their ends' numbers, and frees those that reach zero.  Besides the links
    it reads only the counters of nodes that wait for further predecessors.
    Many links (``REWRITTEN``) are written anew without those used up once half of
    them are, so that later rounds don't read and shuffle them again.

    ``induced`` edges carry all keys, are distinct and have both ends among the
    nodes, so that neither has to be found out again.
    """
    plan_by_row_size(nodes.sparkSession)
    state = LoopState(nodes.sparkSession, "levels")
    keys, edge_keys = list(keys), list(edge_keys)
    todo, _ = state.save(nodes.select(*keys, "node").distinct())
    links = edges.select(*edge_keys, "src_id", "dst_id")
    if not induced:  # edges per traversal, both ends present
        ends = todo.withColumnRenamed("node", "src_id")
        links = links.distinct().join(ends, [*edge_keys, "src_id"]).join(
            todo.withColumnRenamed("node", "dst_id"), [*keys, "dst_id"], "left_semi"
        ).select(*keys, "src_id", "dst_id")
    needs = links.groupBy(*keys, "dst_id").agg(F.count("*").alias("needs"))
    links, n_links = state.save(links.join(needs, [*keys, "dst_id"]))
    heads = links.select(*keys, F.col("dst_id").alias("node")).distinct()
    first = todo.join(heads, [*keys, "node"], "left_anti").select(
        *keys, "node", F.lit(0).cast("bigint").alias("waits"), F.lit(0).cast("bigint").alias("lost"), F.lit(0).alias("level"))
    terms = {"freed": F.col("freed").cast("int"), "lost": F.col("lost")}
    touched, counts = state.save_summing(first.withColumn("freed", F.lit(True)), ["freed"], **terms)
    rounds, depth, used, since = [], 0, 0, 0
    while counts["freed"]:
        rounds.append(touched)
        depth += 1
        last = touched.where("freed").select(*keys, F.col("node").alias("src_id"))
        lost = links.join(last, [*keys, "src_id"], "left_semi").groupBy(*keys, F.col("dst_id").alias("node")).agg(
            F.count("*").alias("lost"), F.max("needs").alias("needs")
        )
        waiting = touched.where("NOT freed").select(*keys, "node", "waits")
        left = F.coalesce("waits", "needs") - F.coalesce("lost", F.lit(0))
        after = waiting.join(lost, [*keys, "node"], "full").select(
            *keys, "node", left.alias("waits"), F.coalesce("lost", F.lit(0)).alias("lost"), F.lit(depth).alias("level"))
        touched, counts = state.save_summing(after.withColumn("freed", F.col("waits") == 0), ["freed"], **terms)
        used += counts["lost"]
        if n_links > REWRITTEN and 2 * used >= n_links and counts["freed"]:
            gone = state.union_of(rounds[since:], "freed=true").select(*keys, F.col("node").alias("src_id"))
            kept, n_links = state.save(links.join(gone, [*keys, "src_id"], "left_anti"))
            state.drop(links)
            links, used, since = kept, 0, len(rounds)
    state.drop(links)
    ordered = (state.union_of(rounds, "freed=true") if rounds else touched).select(*keys, "node", "level")
    rest = todo.join(ordered, [*keys, "node"], "left_anti").withColumn("level", F.lit(depth))
    return ordered.withColumn("in_cycle", F.lit(False)).unionByName(rest.withColumn("in_cycle", F.lit(True)))


def ancestors(parents: DataFrame, starts: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """(keys, node, distance) of everything on the parent chain of each traversal's start; and the rounds it took.

    ``parents`` (keys, node, parent) has one parent per node at most and no
    cycle.  In every round each node found so far also takes the jump over the
    round's links, which lead twice as far as those of the round before; so
    every distance is met once, by its binary digits.
    """
    state = LoopState(parents.sparkSession, "chain")
    keys = list(keys)
    jump, left = state.save(parents.select(*keys, "node", "parent"))
    found, _ = state.save(starts.select(*keys, "node", F.lit(0).cast("bigint").alias("distance")))
    rounds = 0
    while left:
        far = found.join(jump, [*keys, "node"]).select(*keys, F.col("parent").alias("node"), (F.col("distance") + (1 << rounds)).alias("distance"))
        after, _ = state.save(found.unionByName(far))
        on = jump.select(*keys, F.col("node").alias("parent"), F.col("parent").alias("next"))
        longer, left = state.save(jump.join(on, [*keys, "parent"]).select(*keys, "node", F.col("next").alias("parent")))
        state.drop(found)
        state.drop(jump)
        found, jump, rounds = after, longer, rounds + 1
    return found, rounds


def waves(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str], gathered: dict[str, Column], solved: dict[str, Column],
    edge_keys: Sequence[str] = (), state: LoopState | None = None, repeats_count: bool = True,
) -> DataFrame:
    """Solve a recurrence over a graph one level at a time, all traversals together.

    ``nodes`` has the keys, ``node``, ``level`` and inputs.  For each level,
    ``gathered`` aggregates the solved columns of a node's predecessors
    (src_id of ``edges``), then ``solved`` computes the node's own columns from
    its inputs and those aggregates.  Each node is visited once.  An edge given
    several times is taken once; without ``repeats_count`` (aggregates such as
    the maximum, which repeats don't change) it is not searched for.  Edges with
    the levels of their ends (``_from``, ``_to``) carry all keys and have both ends among the nodes.

    Inputs and links are stored by level, so a level reads its own slice of
    both, and of earlier results only the levels that lead into it.
    """
    plan_by_row_size(nodes.sparkSession)
    state = state or LoopState(nodes.sparkSession, "waves")
    keys, edge_keys = list(keys), list(edge_keys)
    inputs, _ = state.save(nodes, ["level"])
    placed = inputs.select(*keys, "node", "level")
    known = "_to" in edges.columns
    links = edges.select(*edge_keys, "src_id", "dst_id", *(["_from", "_to"] if known else []))
    if repeats_count:
        links = links.distinct()
    if not known:
        links = links.join(placed.withColumnsRenamed({"node": "dst_id", "level": "_to"}), [*edge_keys, "dst_id"])
        links = links.join(placed.withColumnsRenamed({"node": "src_id", "level": "_from"}), [*keys, "src_id"])
    links, _ = state.save(links.where("_from < _to").select(*keys, "src_id", "dst_id", "_from", "_to"), ["_to"])
    top = inputs.agg(F.max("level")).first()[0]
    leads: dict[int, list[int]] = {}
    for row in links.select("_from", "_to").distinct().collect():  # pairs of levels, few however many links there are
        leads.setdefault(row["_to"], []).append(row["_from"])
    results: list[DataFrame] = []
    for level in range(0, -1 if top is None else top + 1):
        here = inputs.where(F.col("level") == level).select(*nodes.columns)
        if level in leads:
            before = state.union_of([results[n] for n in sorted(leads[level])]).select(*keys, F.col("node").alias("src_id"), *solved)
            into = links.where(F.col("_to") == level).select(*keys, "src_id", "dst_id")
            facts = into.join(before, [*keys, "src_id"]).groupBy(*keys, F.col("dst_id").alias("node")).agg(
                *(c.alias(n) for n, c in gathered.items())
            )
            here = here.join(facts, [*keys, "node"], "left")
        else:
            here = here.select("*", *(F.lit(None).cast("bigint").alias(n) for n in gathered))
        saved, _ = state.save(here.select(*nodes.columns, *(c.alias(n) for n, c in solved.items())))
        results.append(saved)
    if not results:
        return inputs.select(*nodes.columns, *(F.lit(None).cast("bigint").alias(n) for n in solved))
    state.drop(links)
    state.drop(inputs)
    return state.union_of(results)
