"""Run records to group runs, context runs and resource events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.functions.clock import business_date, ms_of_day, parse_timestamp
from batchlens.sources.definitions import Loaded, blank_to_null


def unique_lookup(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Keys with their value when there is exactly one, and the number of values."""
    return df.select(*keys, value).distinct().groupBy(*keys).agg(F.min(value).alias(out), F.count("*").alias(f"n_{out}"))


def typed_runs(runs: DataFrame, cutoff: int = 18) -> DataFrame:
    start, end = parse_timestamp(F.col("startTime").cast("string")), parse_timestamp(F.col("endTime").cast("string"))
    return runs.select(
        "id", blank_to_null("jobName").alias("job_name"), blank_to_null("jobGroupId").alias("given_group"), blank_to_null("jobContextId").alias("given_context"),
        start.alias("start_ts"), end.alias("end_ts"), "status", "exitCode", "exitMessage",
    ).withColumn("business_date", business_date(F.col("start_ts"), cutoff)).withColumn("execution_date", F.to_date("start_ts"))


def with_group(typed: DataFrame, sic: DataFrame, job: DataFrame, has_job: DataFrame) -> DataFrame:
    """Group of each run: given, else of its context, else of its job; null with a reason when none or several fit."""
    via_context = unique_lookup(sic.select(F.col("id").alias("given_context"), "job_group_id"), ["given_context"], "job_group_id", "ctx_group")
    pairs = has_job.join(job.select(F.col("id").alias("job_id"), F.col("name").alias("job_name")), "job_id")
    via_job = unique_lookup(pairs, ["job_name"], "job_group_id", "job_group")
    j = typed.join(via_context, "given_context", "left").join(via_job, "job_name", "left")
    by_context = F.col("given_context").isNotNull()
    hits = F.when(by_context, F.coalesce("n_ctx_group", F.lit(0))).otherwise(F.coalesce("n_job_group", F.lit(0)))
    group = F.when(F.col("given_group").isNotNull(), F.col("given_group")).when(hits == 1, F.when(by_context, F.col("ctx_group")).otherwise(F.col("job_group")))
    reason = F.when(F.col("given_group").isNotNull() | (hits == 1), F.lit(None)).when(hits == 0, "no group").otherwise("several groups")
    reason = F.when(F.col("start_ts").isNull(), "unreadable start").otherwise(reason)
    return j.withColumn("job_group_id", group).withColumn("reason", reason).drop("ctx_group", "n_ctx_group", "job_group", "n_job_group")


def derive_job_group_runs(runs: DataFrame, sic: DataFrame, job: DataFrame, has_job: DataFrame, cutoff: int = 18) -> Loaded:
    """One group run per group and business date; the first record's start counts."""
    g = with_group(typed_runs(runs, cutoff), sic, job, has_job)
    good = g.where(F.col("reason").isNull())
    first = F.min_by("start_ts", "id").alias("start_ts")
    rows = good.groupBy("job_group_id", "business_date").agg(first).select(
        F.concat_ws("_", "job_group_id", F.col("business_date").cast("string")).alias("id"), "job_group_id", "business_date",
        ms_of_day(F.col("start_ts")).alias("start_time_ms"), F.to_date("start_ts").alias("execution_date"),
    )
    return Loaded(rows, g.where(F.col("reason").isNotNull()).select("id", "reason"))


def derive_context_runs(runs: DataFrame, sic: DataFrame, job: DataFrame, has_job: DataFrame, cutoff: int = 18) -> Loaded:
    """Typed context runs linked to context, job and group run."""
    g = with_group(typed_runs(runs, cutoff), sic, job, has_job)
    names = sic.join(job.select(F.col("id").alias("job_id"), F.col("name").alias("job_name")), "job_id")
    one = unique_lookup(names.select("job_group_id", "job_name", F.col("id").alias("sic_id")), ["job_group_id", "job_name"], "sic_id", "found")
    j = g.join(one, ["job_group_id", "job_name"], "left")
    hits = F.coalesce("n_found", F.lit(0))
    reason = F.coalesce(
        "reason", F.when(F.col("given_context").isNotNull() | (hits == 1), F.lit(None)).when(hits == 0, "no context").otherwise("several contexts")
    )
    j = j.withColumn("reason", reason).withColumn("sic_id", F.coalesce("given_context", F.when(hits == 1, F.col("found"))))
    length = F.unix_millis("end_ts") - F.unix_millis("start_ts")
    jobs = job.select(F.col("name").alias("job_name"), F.col("id").alias("job_id"))
    rows = j.where(F.col("reason").isNull()).join(jobs, "job_name", "left").select(
        "id", F.concat_ws("_", "job_group_id", F.col("business_date").cast("string")).alias("jge_id"), "sic_id", "job_id", "job_group_id",
        "business_date", "execution_date", ms_of_day(F.col("start_ts")).alias("start_time_ms"), ms_of_day(F.col("end_ts")).alias("end_time_ms"),
        F.greatest(F.lit(0), F.coalesce(length, F.lit(0))).cast("bigint").alias("duration_ms"), "status",
        F.col("exitCode").alias("exit_code"), F.col("exitMessage").alias("exit_message"),
    )
    return Loaded(rows, j.where(F.col("reason").isNotNull()).select("id", "reason"))


def load_resource_events(df: DataFrame, resource: DataFrame) -> DataFrame:
    return df.join(resource.select(F.col("id").alias("resource_id")), "resource_id", "left_semi").select(
        "id", "resource_id", F.to_date("business_date").alias("business_date"), F.col("availability_time_ms").cast("bigint").alias("availability_time_ms"),
        F.col("size_mb").cast("double").alias("size_mb"),
    )


def resource_event_runs_group(rae: DataFrame, require: DataFrame, jge: DataFrame) -> DataFrame:
    """Events with the group runs of their date; late ones impacted the run."""
    needs = require.where(F.col("owner_type") == "JOB_GROUP").select("resource_id", F.col("owner_id").alias("job_group_id"))
    runs = jge.select(F.col("id").alias("jge_id"), "job_group_id", "business_date", "start_time_ms")
    return rae.join(needs, "resource_id").join(runs, ["job_group_id", "business_date"]).select(
        F.col("id").alias("rae_id"), "jge_id", (F.col("start_time_ms") < F.col("availability_time_ms")).alias("impacted")
    )


def resource_event_runs_context(rae: DataFrame, require: DataFrame, jce: DataFrame) -> DataFrame:
    """Events with the context runs of their date."""
    needs = require.where(F.col("owner_type") == "SIC").select("resource_id", F.col("owner_id").alias("sic_id"))
    runs = jce.select(F.col("id").alias("jce_id"), "sic_id", "business_date")
    return rae.join(needs, "resource_id").join(runs, ["sic_id", "business_date"]).select(F.col("id").alias("rae_id"), "jce_id")


RUN_TABLES = ("job_group_execution", "job_context_execution", "resource_availability_event", "critical_path_calculated")


def reset_instance_tables(root: str, tables: dict[str, DataFrame], only_dates: bool = False) -> None:
    """Replace run-layer tables under ``root``; definitions are not touched.

    Tables are partitioned by business date.  ``only_dates`` replaces just the
    dates present in the new rows.
    """
    for name, df in tables.items():
        if name not in RUN_TABLES:
            raise ValueError(f"{name} is not a run-layer table")
        mode = "dynamic" if only_dates else "static"
        df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("business_date").parquet(f"{root}/{name}")
