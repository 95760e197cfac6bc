"""Catalog, topology and lineage questions.

Details with many parts come back as flat rows (owner, relation, item ...), one
relation after the other, so relations never multiply each other and no owner
has to fit one array.  Every function takes one name or id, or None for all.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.operators.traverse import reachable

def _only(df: DataFrame, column: str, value: str | None) -> DataFrame:
    return df if value is None else df.where(F.col(column) == value)


def _rel(df: DataFrame, owner: str, relation: str, item: Column, name: Column, detail: Column | None = None) -> DataFrame:
    text = F.lit(None).cast("string") if detail is None else detail.cast("string")
    return df.select(
        F.col(owner).alias("owner_id"), F.lit(relation).alias("relation"), item.alias("item_id"), name.alias("item_name"), text.alias("detail")
    ).distinct()


def _stack(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(F.col("id").alias(f"{prefix}_id"), F.col("name").alias(f"{prefix}_name"))


def list_job_groups(job_group: DataFrame, has_job: DataFrame, job: DataFrame) -> DataFrame:
    """Groups with their jobs (one row each) and the number of jobs."""
    counts = has_job.groupBy("job_group_id").agg(F.count("*").alias("job_count"))
    groups = job_group.select(F.col("id").alias("job_group_id"), F.col("name").alias("job_group_name"), "enabled", "priority")
    return (
        groups.join(counts, "job_group_id", "left").join(has_job, "job_group_id", "left").join(_named(job, "job"), "job_id", "left")
        .select("job_group_id", "job_group_name", "enabled", "priority", F.coalesce("job_count", F.lit(0)).alias("job_count"), "job_name")
    )


def search_jobs(job: DataFrame, pattern: str) -> DataFrame:
    """Jobs whose name contains the text, in any case."""
    return job.where(F.lower("name").contains(pattern.lower())).select("id", "name", "type", "enabled").orderBy("name")


def _resources(require: DataFrame, resource: DataFrame, owner_type: str) -> DataFrame:
    return require.where(F.col("owner_type") == owner_type).join(
        resource.select(F.col("id").alias("resource_id"), F.col("name").alias("resource_name"), F.col("type").alias("resource_type")), "resource_id"
    )


def _tags(has_tag: DataFrame, tag: DataFrame, owner_type: str) -> DataFrame:
    return has_tag.where(F.col("owner_type") == owner_type).join(_named(tag, "tag"), "tag_id")


def job_group_detail(t, group_id: str | None = None) -> DataFrame:
    """Jobs, service levels, resources, calendars and tags of a group."""
    jobs = t.has_job.join(_named(t.job, "job"), "job_id")
    slas = t.sla.where(F.col("owner_type") == "JOB_GROUP")
    cals = t.calendar_rule_assoc.where(F.col("context_type") == "JOB_GROUP").join(t.business_calendar, "rule_id")
    return _only(_stack(
        _rel(jobs, "job_group_id", "JOB", F.col("job_id"), F.col("job_name")),
        _rel(slas, "owner_id", "SLA", F.col("sla_id"), F.col("sla_name"), F.col("sla_type")),
        _rel(_resources(t.require_resource, t.resource, "JOB_GROUP"), "owner_id", "RESOURCE", F.col("resource_id"), F.col("resource_name"), F.col("resource_type")),
        _rel(cals, "context_id", "CALENDAR", F.col("rule_id"), F.col("evaluator_fn"), F.col("rule_type")),
        _rel(_tags(t.has_tag, t.tag, "JOB_GROUP"), "owner_id", "TAG", F.col("tag_id"), F.col("tag_name")),
    ), "owner_id", group_id)


def step_op_counts(step: DataFrame, step_op: DataFrame) -> DataFrame:
    counts = step_op.groupBy(F.col("step_id").alias("id")).agg(F.count("*").alias("n"))
    return step.join(counts, "id", "left").withColumn("db_operation_count", F.coalesce("n", F.lit(0))).drop("n")


def _job_slas(t) -> DataFrame:
    ctx = t.sic.select(F.col("id").alias("owner_id"), "job_id", F.col("name").alias("context_name"))
    return t.sla.where(F.col("owner_type") == "SIC").join(ctx, "owner_id")


def job_detail(t, job_id: str | None = None) -> DataFrame:
    """Steps with operation counts, service levels by context, resources, listeners, tags and repository of a job."""
    steps = step_op_counts(t.step, t.step_op)
    return _only(_stack(
        _rel(steps, "job_id", "STEP", F.col("id"), F.col("name"), F.col("db_operation_count")),
        _rel(_job_slas(t), "job_id", "SLA", F.col("sla_id"), F.col("sla_name"), F.col("context_name")),
        _rel(_resources(t.require_resource, t.resource, "JOB"), "owner_id", "RESOURCE", F.col("resource_id"), F.col("resource_name"), F.col("resource_type")),
        _rel(t.listener, "job_id", "LISTENER", F.col("id"), F.col("bean"), F.col("scope")),
        _rel(_tags(t.has_tag, t.tag, "JOB"), "owner_id", "TAG", F.col("tag_id"), F.col("tag_name")),
        _rel(t.job, "id", "REPOSITORY", F.col("git_repo"), F.col("source_file")),
    ), "owner_id", job_id)


class JobDetail(NamedTuple):
    job: DataFrame  # one row per job and group
    steps: DataFrame  # one row per step
    slas: DataFrame  # one row per context and service level


#: Columns of a job that not every source has.
GIT_COLUMNS = ("description", "git_branch", "git_updated_by", "git_updated_at", "git_last_commit")


def job_detail_frames(t, job_id: str | None = None) -> JobDetail:
    """Everything of a job's own, its steps' and its service levels' columns; columns a source lacks are null."""
    extra = [F.col(c) if c in t.job.columns else F.lit(None).cast("string").alias(c) for c in GIT_COLUMNS]
    steps_of = t.step.groupBy("job_id").agg(F.count("*").alias("step_count"))
    groups = t.has_job.join(t.job_group.select(F.col("id").alias("job_group_id"), F.col("name").alias("job_group")), "job_group_id").select("job_id", "job_group")
    job = t.job.select(F.col("id").alias("job_id"), "name", "type", "enabled", "restartable", "source_file", "git_repo", *extra).join(groups, "job_id", "left")
    job = job.join(steps_of, "job_id", "left").withColumn("step_count", F.coalesce("step_count", F.lit(0)))

    classes = t.step_class.groupBy(F.col("step_id").alias("id")).agg(
        *(F.min(F.when(F.col("role") == role, F.col("class_fqn"))).alias(f"{role}_class") for role in ("tasklet", "reader", "processor", "writer")))
    kinds = t.step_resource.join(t.resource.select(F.col("id").alias("resource_id"), "type"), "resource_id").groupBy(F.col("step_id").alias("id")).agg(
        F.count_if(F.col("type") == "PROCEDURE").alias("procedure_call_count"), F.count_if(F.col("type") == "SHELL_SCRIPT").alias("shell_execution_count"))
    counts = ["db_operation_count", "procedure_call_count", "shell_execution_count"]
    steps = step_op_counts(t.step, t.step_op).join(classes, "id", "left").join(kinds, "id", "left").fillna(0, counts)
    steps = steps.select("job_id", F.col("id").alias("step_id"), "name", "step_kind", "tasklet_class", "reader_class", "processor_class", "writer_class", *counts)

    slas = _job_slas(t).select("job_id", F.col("owner_id").alias("sic_id"), "sla_id", F.col("sla_name").alias("name"), F.col("sla_type").alias("type"), "duration_ms", "time_ms")
    return JobDetail(_only(job, "job_id", job_id), _only(steps, "job_id", job_id), _only(slas, "job_id", job_id))


def job_steps(t, job_id: str | None = None) -> DataFrame:
    """Steps with operation counts and the classes behind each role."""
    classes = t.java_class.select(
        F.col("fqn").alias("class_fqn"), F.col("name").alias("class_name"),
        (F.lower("name").contains("dao") | F.lower("name").contains("repository")).alias("is_dao_class"),
        F.lower("name").contains("shell").alias("is_shell_class"),
    )
    roles = t.step_class.select(F.col("step_id").alias("id"), "role", "class_fqn").join(classes, "class_fqn")
    return _only(step_op_counts(t.step, t.step_op).join(roles, "id", "left").select(
        "job_id", F.col("id").alias("step_id"), F.col("name").alias("step_name"), "step_order", "step_kind", "db_operation_count",
        "role", "class_fqn", "is_dao_class", "is_shell_class",
    ), "job_id", job_id)


def job_topology(t, job_id: str | None = None) -> DataFrame:
    """Structure of a job: flow nodes, entry, contexts, rules of context and group scope, levels, resources, listeners, tags."""
    ctx = t.sic.select(F.col("id").alias("sic_id"), F.col("name").alias("context_name"), "job_id", "job_group_id")
    own = t.calendar_rule_assoc.where(F.col("context_type") == "SIC").withColumnRenamed("context_id", "sic_id").join(ctx, "sic_id")
    grp = t.calendar_rule_assoc.where(F.col("context_type") == "JOB_GROUP").withColumnRenamed("context_id", "job_group_id").join(ctx, "job_group_id")
    return _only(_stack(
        _rel(t.flow_node, "job_id", "FLOW_NODE", F.col("id"), F.col("name"), F.col("label")),
        _rel(t.job_entry, "job_id", "ENTRY", F.col("node_id"), F.lit(None).cast("string")),
        _rel(ctx, "job_id", "CONTEXT", F.col("sic_id"), F.col("context_name"), F.col("job_group_id")),
        _rel(own, "job_id", "RULE_CONTEXT", F.col("rule_id"), F.col("sic_id"), F.col("rule_type")),
        _rel(grp, "job_id", "RULE_GROUP", F.col("rule_id"), F.col("job_group_id"), F.col("rule_type")),
        _rel(_job_slas(t), "job_id", "SLA", F.col("sla_id"), F.col("sla_name"), F.col("context_name")),
        _rel(_resources(t.require_resource, t.resource, "JOB"), "owner_id", "RESOURCE", F.col("resource_id"), F.col("resource_name"), F.col("resource_type")),
        _rel(t.listener, "job_id", "LISTENER", F.col("id"), F.col("bean"), F.col("scope")),
        _rel(_tags(t.has_tag, t.tag, "JOB"), "owner_id", "TAG", F.col("tag_id"), F.col("tag_name")),
    ), "owner_id", job_id)


def _entry_points(t, job_id: str | None, with_tests: bool = False) -> DataFrame:
    """Methods of the classes behind each step."""
    steps = _only(t.step, "job_id", job_id).select(F.col("id").alias("step_id"), "job_id")
    classes = t.java_class if with_tests else t.java_class.where(~F.col("is_test"))
    return (
        t.step_class.join(steps, "step_id").join(classes.select(F.col("fqn").alias("class_fqn")), "class_fqn", "left_semi")
        .join(t.java_method.select(F.col("fqn").alias("entry_fqn"), "class_fqn"), "class_fqn")
        .select("job_id", "step_id", "class_fqn", "entry_fqn").distinct()
    )


def _call_edges(calls: DataFrame) -> DataFrame:
    return calls.select(F.col("src_fqn").alias("src_id"), F.col("dst_fqn").alias("dst_id"))


def _below(t, entries: DataFrame, min_hops: int, max_hops: int, targets: DataFrame | None = None) -> DataFrame:
    """Methods below each entry method; each entry is walked once, however many steps share it.

    With ``targets`` (column method_fqn) only chains that lead to one are followed.
    """
    roots = entries.select(F.col("entry_fqn").alias("root"), F.col("entry_fqn").alias("node")).distinct()
    wanted = None if targets is None else targets.select(F.col("method_fqn").alias("node")).distinct()
    reach = reachable(_call_edges(t.calls), roots, min_hops=min_hops, max_hops=max_hops, targets=wanted)
    return reach.select(F.col("root").alias("entry_fqn"), F.col("node").alias("method_fqn"), "distance")


def step_call_hierarchy(t, job_id: str | None = None, max_calls: int = 3) -> DataFrame:
    """Methods at most three calls below a step's classes with their operation counts."""
    entries = _entry_points(t, job_id)
    ops = t.db_operation.groupBy("method_fqn").agg(F.count("*").alias("db_operation_count"))
    found = entries.join(_below(t, entries, 0, max_calls), "entry_fqn").groupBy("job_id", "step_id", "class_fqn", "method_fqn").agg(
        F.min("distance").alias("distance")
    )
    return found.join(ops, "method_fqn", "left").withColumn("db_operation_count", F.coalesce("db_operation_count", F.lit(0)))


def job_operations(t, job_id: str | None = None) -> DataFrame:
    """Steps with at least one operation."""
    kinds = t.step_resource.join(t.resource.select(F.col("id").alias("resource_id"), "type"), "resource_id").groupBy(F.col("step_id").alias("id")).agg(
        F.count_if(F.col("type") == "PROCEDURE").alias("procedure_call_count"),
        F.count_if(F.col("type") == "SHELL_SCRIPT").alias("shell_execution_count"),
        F.count_if(F.col("type") == "SQL_SCRIPT").alias("sql_file_count"),
    )
    names = ["procedure_call_count", "shell_execution_count", "sql_file_count"]
    counted = step_op_counts(t.step, t.step_op).join(kinds, "id", "left").fillna(0, names)
    total = F.col("db_operation_count") + F.col(names[0]) + F.col(names[1]) + F.col(names[2])
    return _only(counted.where(total > 0).select("job_id", F.col("id").alias("step_id"), "step_kind", "db_operation_count", *names), "job_id", job_id)


def dynamic_step_resources_view(t, job_id: str | None = None) -> DataFrame:
    """Shell, procedure and SQL resources of dynamic jobs' steps, in step order."""
    dynamic = t.job.where(F.coalesce("type", F.lit("dynamic_job")) == "dynamic_job").select(F.col("id").alias("job_id"))
    steps = t.step.join(dynamic, "job_id", "left_semi").select("job_id", F.col("id").alias("step_id"), "step_order")
    res = t.resource.select(F.col("id").alias("resource_id"), F.col("name").alias("resource_name"), F.col("type").alias("resource_type"))
    direct = t.step_resource.join(res, "resource_id").where(F.col("resource_type").isin("SHELL_SCRIPT", "PROCEDURE", "FUNCTION"))
    shells = direct.where(F.col("resource_type") == "SHELL_SCRIPT").select("step_id", F.col("resource_id").alias("script_id"))
    sql = shells.join(t.script_sql, "script_id").select("step_id", F.col("sql_id").alias("resource_id")).join(res, "resource_id")
    used = direct.select("step_id", "resource_id", "resource_name", "resource_type").unionByName(
        sql.select("step_id", "resource_id", "resource_name", "resource_type")
    ).distinct()
    return _only(steps.join(used, "step_id", "left"), "job_id", job_id).orderBy("job_id", "step_order", "resource_id")


def job_data_footprint(t, job_id: str | None = None) -> DataFrame:
    """Job- and group-level resources and the steps with database operations."""
    grp = _resources(t.require_resource, t.resource, "JOB_GROUP").withColumnRenamed("owner_id", "job_group_id").join(t.has_job, "job_group_id")
    steps = step_op_counts(t.step, t.step_op).where(F.col("db_operation_count") > 0)
    return _only(_stack(
        _rel(_resources(t.require_resource, t.resource, "JOB"), "owner_id", "RESOURCE_JOB", F.col("resource_id"), F.col("resource_name"), F.col("resource_type")),
        _rel(grp, "job_id", "RESOURCE_GROUP", F.col("resource_id"), F.col("resource_name"), F.col("resource_type")),
        _rel(steps, "job_id", "STEP", F.col("id"), F.col("name"), F.col("db_operation_count")),
    ), "owner_id", job_id)


def resource_blast_radius(resource: DataFrame, require: DataFrame, resource_id: str | None = None) -> DataFrame:
    """Number of groups, jobs and contexts that need each resource."""
    counts = require.groupBy("resource_id").agg(
        *(F.count_if(F.col("owner_type") == k).alias(n) for k, n in (("JOB_GROUP", "group_count"), ("JOB", "job_count"), ("SIC", "context_count"))),
        F.count("*").alias("total"),
    )
    picked = _only(resource, "id", resource_id).select(F.col("id").alias("resource_id"), F.col("name").alias("resource_name"), "type")
    return picked.join(counts, "resource_id", "left").fillna(0, ["group_count", "job_count", "context_count", "total"])


def resource_dependents(require: DataFrame, resource_id: str | None = None) -> DataFrame:
    """Who needs each resource, one row each."""
    return _only(require, "resource_id", resource_id).select("resource_id", "owner_type", "owner_id").distinct()


def call_paths(t, job_id: str | None = None, max_calls: int = 4) -> DataFrame:
    """Methods one to four calls below the classes of a step."""
    entries = _entry_points(t, job_id, with_tests=True)
    return entries.join(_below(t, entries, 1, max_calls), "entry_fqn").select("job_id", "step_id", "class_fqn", "entry_fqn", "method_fqn", "distance")


def _chains(t, job_id: str | None, max_calls: int, with_tests: bool) -> DataFrame:
    """Entry methods that call something, with the methods of their chains (themselves included) that lead to a table operation."""
    entries = _entry_points(t, job_id, with_tests)
    entries = entries.join(t.calls.select(F.col("src_fqn").alias("entry_fqn")).distinct(), "entry_fqn", "left_semi")
    below = _below(t, entries, 0, max_calls, t.db_operation)
    return entries.join(below, "entry_fqn").select("job_id", "step_id", "class_fqn", "entry_fqn", "method_fqn")


def methods_with_db(t, job_id: str | None = None, max_calls: int = 4) -> DataFrame:
    """Operations of every method on a step's call chains: ``operation:table:confidence``."""
    detail = F.concat_ws(":", "operation_type", "table_name", F.coalesce("confidence", F.lit("MEDIUM")))
    ops = t.db_operation.select("method_fqn", detail.alias("db_detail"), F.col("table_name").alias("resource_name"))
    return _chains(t, job_id, max_calls, False).join(ops, "method_fqn")


def db_methods_without_resource(t, known_tables: DataFrame, job_id: str | None = None, max_calls: int = 4) -> DataFrame:
    """Per entry method: tables its chain uses, and operating methods none of whose tables is known."""
    chains = _chains(t, job_id, max_calls, True)
    used = t.db_operation.select("method_fqn", "table_name").distinct()
    known = used.join(known_tables.select("table_name").distinct(), "table_name", "left_semi")
    lacking = used.select("method_fqn").distinct().join(known.select("method_fqn"), "method_fqn", "left_anti")
    keys = ["job_id", "step_id", "class_fqn", "entry_fqn"]
    return (
        chains.join(known, "method_fqn").select(*keys, F.lit("RESOURCE").alias("kind"), F.col("table_name").alias("item"))
        .unionByName(chains.join(lacking, "method_fqn").select(*keys, F.lit("METHOD_WITHOUT_RESOURCE").alias("kind"), F.col("method_fqn").alias("item")))
        .distinct()
    )
