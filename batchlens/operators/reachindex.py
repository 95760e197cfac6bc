"""Answers whether one node leads to another, for asked pairs, without the closure.

The graph is condensed (``condense``) and every component gets labels whose
size does not depend on the graph:

* its level, and for several hash orders the least and the largest value of
  everything at or below it.  A component that leads to another has a higher
  level and values that enclose the other's; most pairs fail one of these and
  are done.
* its interval in a spanning forest that takes one predecessor per component.
  A component whose interval holds the other's start leads to it.

Pairs that neither label decides are searched, all together, one hop a round
from their first end; a search enters a node only if the labels let it lead to
the second end and ends when the forest decides.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchlens.operators.condense import numbered, strong_components
from batchlens.operators.traverse import waves
from batchlens.session import LoopState

#: Hash orders; each adds a least and a largest value to every label.
ORDERS = 3


class ReachIndex(NamedTuple):
    members: DataFrame  # node, component (a number)
    labels: DataFrame  # component, level, tree, start, size, lo0, hi0, ...
    links: DataFrame  # src, dst: between components


def reach_index(nodes: DataFrame, edges: DataFrame) -> ReachIndex:
    """Labels of all nodes (column ``node``) and of the ends of ``edges``; built once, asked often.

    Bounds and sizes are gathered upwards level by level, starts handed down.
    Components below one predecessor get their places from a window over that
    predecessor's children, so a forest parent's fan-out is one group.
    """
    state = LoopState(nodes.sparkSession, "index")
    everything = nodes.select("node").unionByName(edges.select(F.col("src_id").alias("node"))).unionByName(edges.select(F.col("dst_id").alias("node"))).distinct()
    names, edges = numbered(everything, edges)
    members, _ = state.save(strong_components(names.select(F.col("n").alias("node")), edges))
    src = members.select(F.col("node").alias("src_id"), F.col("component").alias("src"))
    dst = members.select(F.col("node").alias("dst_id"), F.col("component").alias("dst"))
    links, _ = state.save(edges.select("src_id", "dst_id").join(src, "src_id").join(dst, "dst_id").where("src <> dst").select("src", "dst").distinct())
    at, _ = state.save(members.where("node = component").select("node", "level"))
    # the forest: the predecessor whose hash, mixed with the node's, is least, so that no predecessor draws all
    parent, _ = state.save(links.groupBy("dst").agg(F.min_by("src", F.struct(F.xxhash64("src", "dst"), "src")).alias("parent")))

    up = links.select(F.col("dst").alias("src_id"), F.col("src").alias("dst_id"))
    values = {f"v{i}": F.xxhash64("node", F.lit(i)) for i in range(ORDERS)}
    own = at.select("node", "level", *(v.alias(n) for n, v in values.items()))
    gathered = {f"{k}_{i}": f(f"{k}{i}") for i in range(ORDERS) for k, f in (("lo", F.min), ("hi", F.max))}
    solved = {f"{k}{i}": f(F.col(f"v{i}"), F.coalesce(F.col(f"{k}_{i}"), F.col(f"v{i}"))) for i in range(ORDERS) for k, f in (("lo", F.least), ("hi", F.greatest))}
    bounds = waves(own, up, [], gathered, solved)
    tree_up = parent.select(F.col("dst").alias("src_id"), F.col("parent").alias("dst_id"))
    size = waves(at, tree_up, [], {"below": F.sum("size")}, {"size": (F.lit(1) + F.coalesce("below", F.lit(0))).cast("bigint")})
    size, _ = state.save(size.select("node", "level", "size"))

    w = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    placed = size.join(parent.withColumnRenamed("dst", "node"), "node").select("node", (F.lit(1) + F.coalesce(F.sum("size").over(w), F.lit(0))).alias("step"))
    top = at.agg(F.max("level")).first()[0] or 0
    downward = size.join(placed, "node", "left").select("node", (F.lit(top) - F.col("level")).alias("level"), F.coalesce("step", F.lit(0)).cast("bigint").alias("step"))
    tree_down = tree_up.select(F.col("dst_id").alias("src_id"), F.col("src_id").alias("dst_id"))
    starts = waves(downward, tree_down, [], {"from_start": F.max("start"), "from_tree": F.max("tree")}, {
        "start": (F.coalesce("from_start", F.lit(0)) + F.col("step")).cast("bigint"), "tree": F.coalesce("from_tree", "node")})
    labels = bounds.select("node", *solved).join(size, "node").join(starts.select("node", "start", "tree"), "node")
    labels, _ = state.save(labels.withColumnRenamed("node", "component"))
    members, _ = state.save(names.join(members.select(F.col("node").alias("n"), "component"), "n").select("node", "component"))
    return ReachIndex(members, labels, links)


def _verdict() -> Column:
    """True or false where labels a.* and b.* decide whether a leads to b, else null."""
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    inside = (a("tree") == b("tree")) & (b("start") >= a("start")) & (b("start") < a("start") + a("size"))
    outside = a("level") <= b("level")
    for i in range(ORDERS):
        outside = outside | (b(f"lo{i}") < a(f"lo{i}")) | (b(f"hi{i}") > a(f"hi{i}"))
    return F.when(a("component") == b("component"), True).when(inside, True).when(outside, False)


class Answers(NamedTuple):
    pairs: DataFrame  # src_id, dst_id, reachable
    searched: int  # pairs that the labels left open
    visited: int  # rows the search wrote


def reaches(index: ReachIndex, pairs: DataFrame) -> Answers:
    """For each distinct pair (src_id, dst_id): does a path lead from the first to the second?

    A node leads to itself.  Pairs with an unknown end are not reachable.
    """
    state = LoopState(pairs.sparkSession, "asked")
    asked, _ = state.save(pairs.select("src_id", "dst_id").distinct())
    known = (
        asked.join(index.members.select(F.col("node").alias("src_id"), F.col("component").alias("src")), "src_id")
        .join(index.members.select(F.col("node").alias("dst_id"), F.col("component").alias("dst")), "dst_id")
    )
    ends = known.select("src", "dst").distinct()

    def judged(df: DataFrame) -> DataFrame:
        """(src, dst, at) with what the labels say of at leading to dst."""
        a, b = index.labels.alias("a"), index.labels.alias("b")
        return df.join(a, F.col("at") == F.col("a.component")).join(b, F.col("dst") == F.col("b.component")).select("src", "dst", "at", _verdict().alias("found"))

    first, counts = state.save_counting(judged(ends.withColumn("at", F.col("src"))), open=F.col("found").isNull())
    searched = visited = counts["open"]
    decided, front, seen = [first.where("found").select("src", "dst")], first.where("found IS NULL").select("src", "dst", "at"), []
    while counts["open"]:
        seen.append(front)
        steps = front.withColumnRenamed("at", "from").join(index.links.select(F.col("src").alias("from"), F.col("dst").alias("next")), "from")
        steps = steps.select("src", "dst", F.col("next").alias("at")).distinct()
        if seen[1:]:  # a longer way may come back to a node; never to the first, as components have no cycle
            steps = steps.join(state.union_of(seen[1:]), ["src", "dst", "at"], "left_anti")
        now, counts = state.save_counting(judged(steps).where("found IS NULL OR found"), open=F.col("found").isNull())
        won, _ = state.save(now.where("found").select("src", "dst").distinct())
        decided.append(won)
        front, counts["open"] = state.save(now.where("found IS NULL").select("src", "dst", "at").join(won, ["src", "dst"], "left_anti"))
        visited += counts["open"]
    yes = decided[0]
    for more in decided[1:]:
        yes = yes.unionByName(more)
    yes = yes.distinct().withColumn("reachable", F.lit(True))
    answers = known.join(yes, ["src", "dst"], "left").select("src_id", "dst_id", F.coalesce("reachable", F.lit(False)).alias("reachable"))
    return Answers(asked.join(answers, ["src_id", "dst_id"], "left").select("src_id", "dst_id", F.coalesce("reachable", F.lit(False)).alias("reachable")), searched, visited)
