"""Critical path of every group run at once, by waves over topological levels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.operators.traverse import ancestors, flip, reachable, topological_levels, waves
from batchlens.session import LoopState

RUN = ["jge_id"]
#: Positions of a path that are joined in one group.
STRETCH = 1000


class CriticalPaths(NamedTuple):
    metrics: DataFrame  # per run and context: es, ef, ls, lf, slack, on the longest path or not
    paths: DataFrame  # per run, ordered positions of the longest path
    runs: DataFrame  # per run: completion, buffer, path text and hash
    skipped: DataFrame  # runs without a result, with the reason


def representative_runs(runs: DataFrame) -> DataFrame:
    """One context run per group run and context: finished ones first, then the longest, then the lowest id."""
    finished = F.col("status").isin("COMPLETED", "SUCCESS") & F.col("duration_ms").isNotNull()
    dur = F.coalesce("duration_ms", F.lit(0))
    return runs.groupBy("jge_id", "sic_id").agg(
        F.min_by(F.struct(F.col("id").alias("jce_id"), dur.alias("dur")), F.struct(~finished, -dur, "id")).alias("b")
    ).select("jge_id", "sic_id", "b.*")


def group_duration_sla(sla: DataFrame) -> DataFrame:
    """Smallest duration limit of each group; whether it is enabled does not matter."""
    return sla.where(F.col("owner_type") == "JOB_GROUP").groupBy(F.col("owner_id").alias("job_group_id")).agg(
        F.min("duration_ms").alias("group_sla_ms")
    )


def group_edges(edges: DataFrame, sics: DataFrame) -> DataFrame:
    """Edges with both ends in the same group."""
    of = sics.select("id", "job_group_id")
    return (
        edges.select("src_id", "dst_id").join(of.select(F.col("id").alias("src_id"), "job_group_id"), "src_id")
        .join(of.select(F.col("id").alias("dst_id"), "job_group_id"), ["dst_id", "job_group_id"])
        .select("src_id", "dst_id")
    )


def run_edges(best: DataFrame, within: DataFrame) -> DataFrame:
    """Edges of each run: both ends executed in it."""
    ran = best.select("jge_id", "sic_id")
    return (
        ran.withColumnRenamed("sic_id", "src_id").join(within, "src_id")
        .join(ran.withColumnRenamed("sic_id", "dst_id"), ["jge_id", "dst_id"], "left_semi")
        .select("jge_id", "src_id", "dst_id")
    )


def entry_reachable(jge: DataFrame, entry: DataFrame, links: DataFrame) -> DataFrame:
    """Contexts reachable from the entries of each run; entries that did not run stay."""
    roots = jge.select(F.col("id").alias("jge_id"), "job_group_id").join(entry, "job_group_id").select(
        "jge_id", F.col("sic_id").alias("node")
    )
    return reachable(links, roots, RUN, max_hops=None, edge_keys=RUN)


def run_levels(reach: DataFrame, links: DataFrame, sics: DataFrame, within: DataFrame, state: LoopState) -> DataFrame:
    """Level of each node of each run.

    The levels of the definition graph also order every run, which holds a
    part of it.  Only runs that touch a definition cycle are levelled one by
    one, since a context that did not run may break the cycle.
    """
    base, _ = state.save(topological_levels(sics.select(F.col("id").alias("node")), within))
    placed, _ = state.save(reach.select("jge_id", "node").join(base, "node"))
    cyclic, found = state.save(placed.where("in_cycle").select("jge_id").distinct())
    if not found:
        return placed
    again = topological_levels(
        placed.join(cyclic, "jge_id", "left_semi").select("jge_id", "node"), links.join(cyclic, "jge_id", "left_semi"), RUN, RUN
    )
    return placed.join(cyclic, "jge_id", "left_anti").unionByName(again, allowMissingColumns=True)


def critical_paths(jge: DataFrame, runs: DataFrame, sics: DataFrame, entry: DataFrame, edges: DataFrame, sla: DataFrame) -> CriticalPaths:
    """Forward and backward pass, slack and longest path of all group runs."""
    state = LoopState(jge.sparkSession, "cpm")
    best, _ = state.save(representative_runs(runs))
    within, _ = state.save(group_edges(edges, sics))
    links, _ = state.save(run_edges(best, within))
    reach = entry_reachable(jge, entry, links)
    levelled, _ = state.save(run_levels(reach, links, sics, within, state))
    cyclic = levelled.where("in_cycle").select("jge_id").distinct()
    entered = reach.select("jge_id").distinct()
    skipped = jge.select(F.col("id").alias("jge_id")).join(entered, "jge_id", "left_anti").withColumn(
        "reason", F.lit("no node reachable from an entry")
    ).unionByName(cyclic.withColumn("reason", F.lit("graph is not acyclic")))

    of_run = jge.select(F.col("id").alias("jge_id"), "job_group_id", "business_date")
    starts = entry.select("job_group_id", F.col("sic_id").alias("node")).withColumn("is_entry", F.lit(True))
    nodes = (
        levelled.join(cyclic, "jge_id", "left_anti").select("jge_id", "node", "level")
        .join(best.withColumnRenamed("sic_id", "node"), ["jge_id", "node"], "left")
        .join(of_run.select("jge_id", "job_group_id"), "jge_id")
        .join(starts, ["job_group_id", "node"], "left")
        .select("jge_id", "node", "level", "job_group_id", "jce_id", F.coalesce("dur", F.lit(0)).cast("bigint").alias("dur"),
                F.coalesce("is_entry", F.lit(False)).alias("is_entry"))
    )
    es = F.when(F.col("is_entry"), F.lit(0)).otherwise(F.coalesce("max_ef", F.lit(0))).cast("bigint")
    forward = waves(nodes, links, RUN, {"max_ef": F.max("ef")}, {"es": es, "ef": es + F.col("dur")}, RUN)

    ends = forward.join(
        links.join(reach.select("jge_id", F.col("node").alias("dst_id")), ["jge_id", "dst_id"], "left_semi")
        .select("jge_id", F.col("src_id").alias("node")).distinct(), ["jge_id", "node"], "left_anti",
    )
    done = ends.groupBy("jge_id").agg(
        F.max("ef").alias("completion_ms"), F.min_by("node", F.struct(-F.col("ef"), "node")).alias("end_node")
    )
    totals = done.join(of_run, "jge_id").join(group_duration_sla(sla), "job_group_id", "left")
    limited = F.col("group_sla_ms") > 0
    totals, _ = state.save(totals.select(
        "jge_id", "job_group_id", "business_date", "group_sla_ms", "completion_ms", "end_node",
        F.when(limited, F.col("group_sla_ms")).otherwise(F.col("completion_ms")).alias("project_finish_ms"),
        F.when(limited, F.col("group_sla_ms") - F.col("completion_ms")).alias("total_buffer_ms"),
    ))
    top = forward.agg(F.max("level")).first()[0] or 0
    back_nodes = forward.join(totals.select("jge_id", "project_finish_ms"), "jge_id").withColumn("level", F.lit(top) - F.col("level"))
    lf = F.coalesce("min_ls", "project_finish_ms").cast("bigint")
    backward = waves(back_nodes, flip(links), RUN, {"min_ls": F.min("ls")}, {"lf": lf, "ls": lf - F.col("dur")}, RUN)

    # the predecessor with the largest finish is a node's parent; the path is the parent chain of the end node
    into = links.join(forward.select("jge_id", F.col("node").alias("src_id"), "ef"), ["jge_id", "src_id"])
    parent = into.groupBy("jge_id", F.col("dst_id").alias("node")).agg(F.min_by("src_id", F.struct(-F.col("ef"), "src_id")).alias("parent"))
    walked, _ = ancestors(parent, totals.select("jge_id", F.col("end_node").alias("node")), RUN)
    depth = walked.groupBy("jge_id").agg(F.max("distance").alias("last"))
    paths = walked.join(depth, "jge_id").select("jge_id", "node", (F.col("last") - F.col("distance")).alias("position"))
    paths, _ = state.save(paths)
    text = path_texts(paths)
    per_run = totals.drop("end_node").join(text, "jge_id").withColumn("signature_hash", F.sha2("path_text", 256))
    on_path = paths.select("jge_id", "node", F.lit(True).alias("on_path"))
    metrics = backward.join(on_path, ["jge_id", "node"], "left").select(
        "jge_id", "node", "jce_id", "dur", "es", "ef", "ls", "lf", (F.col("ls") - F.col("es")).alias("slack"),
        F.coalesce("on_path", F.lit(False)).alias("is_longest"),
    )
    return CriticalPaths(metrics, paths, per_run, skipped)


def path_texts(paths: DataFrame) -> DataFrame:
    """(jge_id, path_text): names in order, joined by arrows.

    Stretches of ``STRETCH`` positions become text each for itself, so no task
    sorts a whole long path; a run's text is made of its few stretches.
    """
    def ordered(by: str, text: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, text))), lambda s: s[text]), "->")

    stretch = paths.groupBy("jge_id", F.floor(F.col("position") / STRETCH).alias("stretch")).agg(ordered("position", "node").alias("names"))
    return stretch.groupBy("jge_id").agg(ordered("stretch", "names").alias("path_text"))


def cpm_tables(result: CriticalPaths) -> dict[str, DataFrame]:
    """The three stored tables: per run, per context run, and per group path signature."""
    per_run = result.runs.select(
        F.concat(F.lit("CPC_"), "jge_id").alias("cpc_id"), "jge_id", "completion_ms", "total_buffer_ms",
        F.col("path_text").alias("signature_text"), "signature_hash",
    )
    per_context = result.metrics.where(F.col("jce_id").isNotNull()).select(
        F.concat(F.lit("CPI_"), "jce_id").alias("cpi_id"), "jge_id", "jce_id", F.col("node").alias("sic_id"),
        "es", "ef", "ls", "lf", "slack", "dur", "is_longest",
    )
    signatures = result.runs.groupBy("job_group_id", "signature_hash").agg(
        F.min("path_text").alias("signature_text"), F.count_distinct("jge_id").alias("occurrence_count"),
        F.min("business_date").alias("first_seen"), F.max("business_date").alias("last_seen"),
    ).withColumn("cps_id", F.concat_ws("_", F.lit("CPS"), "job_group_id", "signature_hash"))
    return {"calculated": per_run, "instance": per_context, "signature": signatures}


def merge_signatures(stored_links: DataFrame, new_runs: DataFrame) -> DataFrame:
    """Add only (run, signature) links not stored yet, so a repeated load counts once."""
    fresh = new_runs.select("job_group_id", "jge_id", "signature_hash", "path_text", "business_date")
    return stored_links.unionByName(fresh.join(stored_links, ["jge_id", "signature_hash"], "left_anti"))


def critical_path_view(result: CriticalPaths, jge: DataFrame, runs: DataFrame, job: DataFrame, run_id: str | None = None) -> DataFrame:
    """Context runs of computed group runs with slack and critical flag (one run or all)."""
    wanted = jge if run_id is None else jge.where(F.col("id") == run_id)
    facts = cpm_tables(result)["instance"].select("jce_id", "slack", "is_longest")
    names = job.select(F.col("id").alias("job_id"), F.col("name").alias("job_name"))
    return (
        wanted.select(F.col("id").alias("jge_id"))
        .join(runs.select("jge_id", F.col("id").alias("jce_id"), "job_id", "status", "duration_ms"), "jge_id")
        .join(facts, "jce_id", "left").join(names, "job_id", "left")
        .select("jge_id", "jce_id", "job_name", "status", "duration_ms", "slack", F.coalesce("is_longest", F.lit(False)).alias("is_longest"))
    )


def critical_path_summary(result: CriticalPaths, view: DataFrame) -> DataFrame:
    """Per run: contexts, critical count, completion and path."""
    counts = view.groupBy("jge_id").agg(F.count("*").alias("total_contexts"), F.count_if("is_longest").alias("critical_count"))
    return counts.join(result.runs.select("jge_id", "completion_ms", "total_buffer_ms", "path_text", "signature_hash"), "jge_id", "left")
