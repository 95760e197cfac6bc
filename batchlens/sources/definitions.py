"""Definition sheets (one table per sheet) to typed node and edge tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.functions.clock import parse_clock, parse_date


class Loaded(NamedTuple):
    rows: DataFrame
    rejected: DataFrame


def blank_to_null(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(col), F.lit(""))


def split_list(c: str | Column) -> Column:
    """Comma list to trimmed, non-empty items."""
    col = F.col(c) if isinstance(c, str) else c
    return F.filter(F.transform(F.split(col, ","), lambda x: F.trim(x)), lambda x: x != "")


def truthy(c: str) -> Column:
    return F.lower(F.trim(F.col(c).cast("string"))).isin("true", "yes", "1")


def load_tags(df: DataFrame) -> DataFrame:
    return df.where(F.col("id").isNotNull()).select(
        "id", "name", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("tagType", F.lit("")).alias("tag_type"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
    )


class Resources(NamedTuple):
    resources: DataFrame
    has_tag: DataFrame


def load_resources(first: DataFrame, sheet: DataFrame) -> Resources:
    """Resources of two sources; a name the first one has is not taken from the sheet."""
    fresh = sheet.join(first.select("name").distinct(), "name", "left_anti")
    merged = first.unionByName(fresh, allowMissingColumns=True)
    typed = merged.select(
        "id", "name", "type", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("checkInterval", F.lit(0)).cast("int").alias("check_interval"),
        "schemaName",
    )
    tags = merged.where(F.col("tagId").isNotNull()).select(
        F.col("id").alias("resource_id"), F.explode(split_list(F.regexp_replace("tagId", r"[\[\]]", ""))).alias("tag_id")
    ).distinct()
    return Resources(typed, tags)


def load_job_groups(df: DataFrame) -> DataFrame:
    return df.where(F.col("id").isNotNull()).select(
        "id", "name", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("enabled", F.lit(True)).alias("enabled")
    )


def job_group_successors(df: DataFrame) -> DataFrame:
    """Edges from the successor lists; both ends must be groups of the sheet."""
    ids = df.select("id").distinct()
    edges = df.where(F.col("successor").isNotNull()).select(F.col("id").alias("src_id"), F.explode(split_list("successor")).alias("dst_id"))
    return edges.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(
        ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi"
    ).distinct().select("src_id", "dst_id", F.lit("COMPLETED").alias("on_status"))


def load_jobs(df: DataFrame) -> DataFrame:
    return df.where(F.col("id").isNotNull() & F.col("name").isNotNull()).select(
        "id", "name", F.coalesce(blank_to_null("type"), F.lit("spring_xml_config_job")).alias("type"), F.coalesce("enabled", F.lit(True)).alias("enabled")
    ).dropDuplicates(["id"])


def job_group_association(df: DataFrame, job: DataFrame, groups: DataFrame) -> DataFrame:
    """Group to job, the job given by id or name: two equi joins instead of an OR."""
    asked = df.select(F.col("jobId").alias("ref"), F.col("jobGroupId").alias("job_group_id")).join(
        groups.select(F.col("id").alias("job_group_id")), "job_group_id", "left_semi"
    )
    by_id = asked.join(job.select(F.col("id").alias("ref"), F.col("id").alias("job_id")), "ref")
    by_name = asked.join(job.select(F.col("name").alias("ref"), F.col("id").alias("job_id")), "ref")
    return by_id.unionByName(by_name).select("job_group_id", "job_id").distinct()


def load_contexts(df: DataFrame, job: DataFrame, groups: DataFrame) -> DataFrame:
    """Contexts named after their job, with job (by name) and optional group."""
    jobs = job.select(F.col("name").alias("contextForEntityId"), F.col("id").alias("job_id"))
    known = groups.select(F.col("id").alias("jobGroupId"), F.col("id").alias("job_group_id"))
    return df.join(jobs, "contextForEntityId", "left").join(known, "jobGroupId", "left").select(
        "id", F.concat(F.lit("Context_"), "contextForEntityId").alias("name"), F.coalesce("enabled", F.lit(True)).alias("enabled"), "job_id", "job_group_id"
    )


class Successors(NamedTuple):
    precedes: DataFrame
    entry: DataFrame


def context_successors(df: DataFrame, groups: DataFrame) -> Successors:
    """Edges of SIMPLE (one) and PARALLEL (list) rows; entries of start rows that lead somewhere."""
    ids = df.select(F.col("id").alias("dst_id")).distinct()
    targets = F.when(F.col("block") == "PARALLEL", F.transform(F.split("successor", ","), lambda x: F.trim(x))).when(F.col("block") == "SIMPLE", F.array("successor"))
    edges = (
        df.where(F.col("successor").isNotNull()).select(F.col("id").alias("src_id"), "start", "jobGroupId", F.explode(targets).alias("dst_id"))
        .join(ids, "dst_id", "left_semi")
    )
    entry = edges.where(F.col("start").isNotNull()).select(F.col("jobGroupId").alias("job_group_id"), F.col("src_id").alias("sic_id")).distinct()
    entry = entry.join(groups.select(F.col("id").alias("job_group_id")), "job_group_id", "left_semi")
    return Successors(edges.select("src_id", "dst_id", F.lit("COMPLETED").alias("on_status")).distinct(), entry)


def resource_dependency(df: DataFrame, resource: DataFrame, owners: dict[str, DataFrame]) -> DataFrame:
    """Edges from groups, jobs and contexts to resources; ``owners`` maps contextType to its node table."""
    known = df.join(resource.select(F.col("id").alias("resourceId")), "resourceId", "left_semi")
    out = None
    for kind, nodes in owners.items():
        part = known.where(F.col("contextType") == kind).join(nodes.select(F.col("id").alias("requiresContextId")), "requiresContextId", "left_semi")
        part = part.select(F.lit(kind).alias("owner_type"), F.col("requiresContextId").alias("owner_id"), F.col("resourceId").alias("resource_id"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


SLA_OWNERS = ("JobGroup", "ScheduleInstanceContext", "Resource")


def load_slas(df: DataFrame) -> Loaded:
    """Service levels with their owner; rows of another owner type or with unreadable time are rejected."""
    typed = df.withColumn("time_ms", parse_clock(F.col("time")))
    reason = F.when(~F.coalesce(F.col("forEntityType").isin(*SLA_OWNERS), F.lit(False)), "unknown owner type").when(
        F.col("time").isNotNull() & F.col("time_ms").isNull(), "unreadable time"
    )
    judged = typed.withColumn("reason", reason)
    rows = judged.where(F.coalesce(F.col("reason") != "unknown owner type", F.lit(True))).select(
        "id", "name", F.coalesce("enabled", F.lit(True)).alias("enabled"), "type", F.col("durationMs").alias("duration_ms"), "time_ms",
        F.col("forEntityType").alias("owner_type"), F.col("forEntityId").alias("owner_id"),
    )
    return Loaded(rows, judged.where(F.col("reason").isNotNull()).select("id", "reason"))


class Steps(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def load_steps(
    steps: DataFrame, blocks: DataFrame, decisions: DataFrame, contains: DataFrame, entry: DataFrame, precedes: DataFrame, listeners: DataFrame,
) -> Steps:
    """Job-internal structure with defaults: counts 0, kinds blank.

    Nodes are keyed by name, blocks by id.  Edge sheets have
    srcLabel/srcKey/dstLabel/dstKey; ends that do not exist drop the edge.
    """
    def node(df: DataFrame, label: str, key: str) -> DataFrame:
        extra = {"stepKind": "step_kind", "block_type": "block_type"}
        cols = [F.coalesce(F.col(c), F.lit("")).alias(a) if c in df.columns else F.lit("").alias(a) for c, a in extra.items()]
        count = F.coalesce("stepDbOperationCount", F.lit(0)) if "stepDbOperationCount" in df.columns else F.lit(0)
        return df.select(F.lit(label).alias("label"), F.col(key).alias("key"), *cols, count.cast("bigint").alias("db_operation_count"))

    nodes = node(steps, "Step", "name").unionByName(node(blocks, "Block", "id")).unionByName(node(decisions, "Decision", "name")).unionByName(
        node(listeners, "Listener", "name")
    ).distinct()
    ends = nodes.select("label", "key")
    jobs = contains.where(F.col("srcLabel") == "Job").select(F.lit("Job").alias("label"), F.col("srcKey").alias("key")).distinct()
    ends = ends.unionByName(jobs)
    edges = None
    for kind, df in (("CONTAINS", contains), ("ENTRY", entry), ("PRECEDES", precedes)):
        part = df.select(F.lit(kind).alias("type"), "srcLabel", "srcKey", "dstLabel", "dstKey")
        edges = part if edges is None else edges.unionByName(part)
    has_listener = listeners.select(
        F.lit("HAS_LISTENER").alias("type"), "srcLabel", "srcKey", F.lit("Listener").alias("dstLabel"), F.col("name").alias("dstKey")
    )
    edges = edges.unionByName(has_listener)
    for side in ("src", "dst"):
        edges = edges.join(ends.select(F.col("label").alias(f"{side}Label"), F.col("key").alias(f"{side}Key")), [f"{side}Label", f"{side}Key"], "left_semi")
    return Steps(nodes, edges.select("type", "srcLabel", "srcKey", "dstLabel", "dstKey").distinct())


def load_calendar_patterns(df: DataFrame) -> DataFrame:
    return df.where(blank_to_null("patternId").isNotNull()).select(
        F.col("patternId").alias("pattern_id"), F.col("matchExpression").alias("match_expression"), "name",
        F.coalesce(split_list("runtimeParams"), F.array().cast("array<string>")).alias("runtime_params"),
        F.coalesce(split_list("configParams"), F.array().cast("array<string>")).alias("config_params"),
        F.col("evaluatorFn").alias("evaluator_fn"), truthy("isActive").alias("is_active"), F.coalesce("version", F.lit(1)).cast("int").alias("version"),
    )


def load_holidays(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Holidays on days the calendar has, one per region, name and date."""
    return df.withColumn("holiday_date", parse_date(F.col("date").cast("string"))).join(
        calendar.select(F.col("d").alias("holiday_date")), "holiday_date", "left_semi"
    ).select("holiday_date", "region", "name").distinct()


def load_business_calendars(df: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rules with checked params (unreadable ones become ``{}``) and the evaluator of their pattern."""
    params = F.coalesce("params", F.lit("{}"))
    good = F.from_json(params, "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull() & F.trim(params).startswith("{")
    known = patterns.select(F.col("match_expression").alias("matchExpression"), "pattern_id", "evaluator_fn")
    return df.join(known, "matchExpression", "left").select(
        F.col("ruleId").alias("rule_id"), "name", blank_to_null("region").alias("region"),
        F.when(good, params).otherwise("{}").alias("params"), truthy("isActive").alias("is_active"), "pattern_id", "evaluator_fn",
    )


def calendar_associations(df: DataFrame) -> Loaded:
    """ALLOWS and DENIES edges per listed context; incomplete, mistyped or undecided rows are rejected."""
    t = df.select(
        *(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("id", "contextType", "requiresContextId")),
        F.upper(F.trim(F.coalesce("Allowed", F.lit("")))).alias("allowed"), F.coalesce(blank_to_null("action"), F.lit("SKIP")).alias("action"),
    )
    ids = split_list("requiresContextId")
    reason = (
        F.when((F.col("id") == "") | (F.col("contextType") == "") | (F.col("requiresContextId") == ""), "incomplete")
        .when(~F.col("contextType").isin("JobGroup", "ScheduleInstanceContext"), "unknown context type")
        .when(F.size(ids) == 0, "no context id").when(~F.col("allowed").isin("Y", "N"), "unknown decision")
    )
    judged = t.withColumn("reason", reason)
    rows = judged.where(F.col("reason").isNull()).select(
        F.when(F.col("contextType") == "JobGroup", "JOB_GROUP").otherwise("SIC").alias("context_type"), F.explode(ids).alias("context_id"),
        F.col("id").alias("rule_id"), F.when(F.col("allowed") == "Y", "ALLOWS").otherwise("DENIES").alias("rule_type"),
        F.when(F.col("allowed") == "N", F.col("action")).alias("action"),
    ).distinct()
    return Loaded(rows, judged.where(F.col("reason").isNotNull()).select("id", "requiresContextId", "reason"))


