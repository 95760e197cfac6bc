"""Jobs defined by rows of (job, step, order, key, value) instead of code."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.functions.ranking import group_index
from batchlens.sources.code import script_type

# fixed values: parameters a step row can carry
KEYS = ("DIR", "FILE", "PARAMS", "USER", "PROC_NAME", "PROC_SCHEMA", "PROC_PACKAGE", "PROC_PARAMS")


def parse_dynamic_jobs(rows: DataFrame) -> DataFrame:
    """One row per step with a column per parameter; the last value of a parameter wins. ``seq`` orders the rows."""
    step = ["JOB_NAME", "STEP_NAME"]
    clean = rows.withColumn("KEY_PARAM", F.upper(F.trim("KEY_PARAM")))
    last = clean.where(F.col("KEY_PARAM").isin(*KEYS)).groupBy(*step, "KEY_PARAM").agg(F.max_by("VALUE_PARAM", F.struct("seq", "VALUE_PARAM")).alias("v"))
    wide = last.groupBy(*step).pivot("KEY_PARAM", list(KEYS)).agg(F.first("v"))
    facts = clean.groupBy(*step).agg(F.min_by("STEP_KIND", "seq").alias("step_kind"), F.min("STEP_ORDER").alias("step_order"))
    renamed = [F.col(k).alias(k.lower()) for k in KEYS]
    return facts.join(wide, step, "left").select(F.col("JOB_NAME").alias("job_name"), F.col("STEP_NAME").alias("step_name"), "step_order", "step_kind", *renamed)


class Chain(NamedTuple):
    contains: DataFrame
    entry: DataFrame
    precedes: DataFrame


def dynamic_step_chain(steps: DataFrame) -> Chain:
    """Steps of each job in order: the first is the entry, neighbours precede each other."""
    placed = group_index(steps.select("job_name", "step_name", "step_order"), ["job_name"], ["step_order", "step_name"], "pos")
    here = placed.select("job_name", "pos", F.col("step_name").alias("src_step"))
    following = placed.select("job_name", (F.col("pos") - 1).alias("pos"), F.col("step_name").alias("dst_step"))
    return Chain(
        steps.select("job_name", "step_name").distinct(), placed.where("pos = 0").select("job_name", "step_name"),
        here.join(following, ["job_name", "pos"]).select("job_name", "src_step", "dst_step"),
    )


class StepResources(NamedTuple):
    resources: DataFrame
    edges: DataFrame


def dynamic_step_resources(steps: DataFrame) -> StepResources:
    """Resources a step uses by its kind, and the step to resource edges.

    Shell steps execute a script, file steps transfer a file, steps with a
    procedure name invoke it; other kinds stay steps only.
    """
    path = F.when(F.col("dir").isNotNull(), F.concat_ws("/", F.regexp_replace("dir", "/+$", ""), "file")).otherwise(F.col("file"))
    kind = F.upper(F.coalesce("step_kind", F.lit("")))
    none = F.lit(None).cast("string")
    shell = steps.where((kind == "SHELL_EXECUTION") & F.col("file").isNotNull()).select(
        "job_name", "step_name", F.lit("EXECUTES").alias("edge"), F.col("file").alias("name"), F.lit("SHELL_SCRIPT").alias("type"), path.alias("path"),
        script_type(F.col("file")).alias("script_type"), none.alias("schema_name"),
    )
    moved = steps.where((kind == "FTP_FILE_DOWNLOAD") & F.col("file").isNotNull()).select(
        "job_name", "step_name", F.lit("TRANSFERS").alias("edge"), F.col("file").alias("name"), F.lit("FILE").alias("type"), path.alias("path"),
        none.alias("script_type"), none.alias("schema_name"),
    )
    procs = steps.where(F.col("proc_name").isNotNull()).select(
        "job_name", "step_name", F.lit("INVOKES").alias("edge"), F.col("proc_name").alias("name"), F.lit("PROCEDURE").alias("type"), none.alias("path"),
        none.alias("script_type"), F.col("proc_schema").alias("schema_name"),
    )
    edges = shell.unionByName(moved).unionByName(procs)
    facts = F.min(F.struct("path", "script_type", "schema_name")).alias("f")
    resources = edges.groupBy("name", "type").agg(facts).select("name", "type", "f.*")
    return StepResources(resources, edges.select("job_name", "step_name", "edge", "name", "type").distinct())
