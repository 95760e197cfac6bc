"""Dependency chains, group execution flow and job-internal step flow."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.functions.ranking import group_index
from batchlens.operators.traverse import flip, path_edges, reachable


class Flow(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    summary: DataFrame


def context_job_names(sics: DataFrame, job: DataFrame) -> DataFrame:
    """Job name of each context: its job, else the name without its prefix, else blank."""
    names = job.select(F.col("id").alias("job_id"), F.col("name").alias("found"))
    bare = F.when(F.col("name").startswith("Context_"), F.expr("substring(name, 9)")).otherwise("")
    return sics.join(names, "job_id", "left").select(
        F.col("id").alias("node"), F.col("name").alias("context_name"), F.coalesce("found", bare).alias("job_name"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
    )


def job_dependency_chain(sics: DataFrame, job: DataFrame, edges: DataFrame, job_name: str | None = None, max_hops: int | None = None) -> Flow:
    """Everything up- and downstream of each context of a job (or of every job).

    Nodes carry TARGET, UPSTREAM or DOWNSTREAM, in that precedence.
    """
    jobs = job if job_name is None else job.where(F.col("name") == job_name)
    targets = sics.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi").select(
        F.col("id").alias("root"), F.col("id").alias("node")
    )
    down = reachable(edges, targets, min_hops=1, max_hops=max_hops)
    up = reachable(edges, targets, min_hops=1, max_hops=max_hops, direction="up")
    ranked = (
        targets.withColumn("rank", F.lit(0))
        .unionByName(up.select("root", "node", F.lit(1).alias("rank")))
        .unionByName(down.select("root", "node", F.lit(2).alias("rank")))
        .groupBy("root", "node").agg(F.min("rank").alias("rank"))
    )
    tag = F.when(F.col("rank") == 0, "TARGET").when(F.col("rank") == 1, "UPSTREAM").otherwise("DOWNSTREAM")
    nodes = ranked.join(context_job_names(sics, job), "node").select("root", "node", "context_name", "job_name", tag.alias("direction"), "enabled")
    start = targets.withColumn("distance", F.lit(0))
    links = path_edges(edges, start.unionByName(down), max_hops).unionByName(
        path_edges(edges, start.unionByName(up), max_hops, direction="up")
    ).distinct()
    summary = nodes.groupBy("root").agg(
        F.count("*").alias("total_contexts"), F.count_if(F.col("direction") == "UPSTREAM").alias("upstream_job_count"),
        F.count_if(F.col("direction") == "DOWNSTREAM").alias("downstream_job_count"),
    )
    return Flow(nodes, links, summary)


def jobgroup_execution_flow(
    sics: DataFrame, job: DataFrame, entry: DataFrame, edges: DataFrame, group_id: str | None = None, max_hops: int | None = None
) -> Flow:
    """Contexts reachable from a group's entries, by distance, with an order index."""
    starts = entry if group_id is None else entry.where(F.col("job_group_id") == group_id)
    roots = starts.select("job_group_id", F.col("sic_id").alias("node"))
    reach = reachable(edges, roots, ["job_group_id"], max_hops=max_hops)
    ordered = group_index(reach, ["job_group_id"], ["distance", "node"], "order_index")
    nodes = ordered.join(context_job_names(sics, job), "node").select(
        "job_group_id", "node", "context_name", "job_name", "enabled", "distance", "order_index"
    )
    links = path_edges(edges, reach, max_hops, ["job_group_id"])
    summary = nodes.groupBy("job_group_id").agg(F.count("*").alias("node_count"), F.max("distance").alias("max_distance"))
    return Flow(nodes, links, summary)


def job_step_flow(nodes: DataFrame, edges: DataFrame, job_entry: DataFrame, job_id: str | None = None, max_hops: int | None = None) -> Flow:
    """Steps, blocks and decisions reachable from a job's entry, with counts per label."""
    starts = job_entry if job_id is None else job_entry.where(F.col("job_id") == job_id)
    roots = starts.select("job_id", F.col("node_id").alias("node"))
    reach = reachable(edges, roots, ["job_id"], max_hops=max_hops)
    facts = nodes.select(F.col("id").alias("node"), "label", "name", F.coalesce("step_kind", F.lit("")).alias("step_kind"),
                         F.coalesce("block_type", F.lit("")).alias("block_type"))
    found = reach.join(facts, "node").select("job_id", "node", "label", "name", "step_kind", "block_type", "distance")
    status = edges.select("src_id", "dst_id", F.coalesce("on_status", F.lit("DEFAULT")).alias("on_status")).distinct()
    links = path_edges(edges, reach, max_hops, ["job_id"]).join(status, ["src_id", "dst_id"])
    summary = found.groupBy("job_id").agg(
        F.count("*").alias("node_count"), F.count_if(F.col("label") == "Step").alias("step_count"),
        F.count_if(F.col("label") == "Decision").alias("decision_count"), F.count_if(F.col("label") == "Block").alias("block_count"),
    )
    return Flow(found, links, summary)


def terminal_step_paths(edges: DataFrame, job_entry: DataFrame) -> DataFrame:
    """Nodes between a job's entry and each node without successor, by distance.

    Paths are not listed one by one: the rows of one (job, sink) are the nodes
    on any of its paths.
    """
    roots = job_entry.select("job_id", F.col("node_id").alias("node"))
    down = reachable(edges, roots, ["job_id"], max_hops=None)
    sinks = down.join(edges.select(F.col("src_id").alias("node")).distinct(), "node", "left_anti")
    back = reachable(flip(edges), sinks.select("job_id", F.col("node").alias("sink"), "node"), ["job_id", "sink"], max_hops=None)
    return back.drop("distance").join(down, ["job_id", "node"]).select("job_id", "sink", "node", "distance")
