"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.session import LoopState


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b).

    Only nodes with an edge to another node appear.  Each round hangs every
    node on the smallest of its neighbours, first the larger neighbours, then
    the smaller ones; the number of rounds grows with the logarithm of the
    largest component.  Group minima are combined before the shuffle and the
    joins are plain equi-joins, so a node with very many edges is split by AQE.
    """
    state = LoopState(edges.sparkSession, label)
    lower = F.least("a", "b").alias("v")
    upper = F.greatest("a", "b").alias("u")
    now, facts = _save(state, edges.where(F.col("a") != F.col("b")).select(upper, lower).distinct())
    while facts["n"]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(first, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(first.select("u", F.col("m").alias("v"))).distinct()
        )
        before, old = facts, now
        now, facts = _save(state, small)
        state.drop(old)
        if facts == before:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _save(state: LoopState, edges: DataFrame):
    """Write the edges; their number and an order-free checksum tell whether a round changed them."""
    return state.save_summing(edges, check=F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))
