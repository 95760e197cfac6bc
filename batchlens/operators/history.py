"""Run-history questions over the context-run fact table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchlens.functions.clock import day_and_clock

FAILED, COMPLETED = "FAILED", "COMPLETED"


def since(runs: DataFrame, as_of: str, days: int) -> DataFrame:
    """Runs whose business date lies at most ``days`` before ``as_of``."""
    start = dt.date.fromisoformat(as_of) - dt.timedelta(days=days)
    return runs.where(F.col("business_date") >= F.lit(start))


def with_job_name(runs: DataFrame, job: DataFrame) -> DataFrame:
    return runs.join(job.select(F.col("id").alias("job_id"), F.col("name").alias("job_name")), "job_id")


def count_status(status: str):
    return F.count_if(F.col("status") == status)


def failed_jobs(runs: DataFrame, job: DataFrame, as_of: str, days: int = 7, limit: int = 10) -> DataFrame:
    """Newest failed runs with job name and message."""
    newest = (
        since(runs, as_of, days)
        .where(F.col("status") == FAILED)
        .join(job.select(F.col("id").alias("job_id"), F.col("name").alias("job_name")), "job_id")
        .orderBy(F.desc_nulls_first("business_date"), F.desc_nulls_first("start_time_ms"), "id")
        .limit(limit)
    )
    return newest.select(
        "job_name",
        F.col("id").alias("execution_id"),
        day_and_clock(F.col("business_date"), F.col("start_time_ms")).alias("start_time"),
        day_and_clock(F.col("business_date"), F.col("end_time_ms")).alias("end_time"),
        F.col("exit_message").alias("error_message"),
    )


def common_errors(runs: DataFrame, as_of: str, days: int = 30, limit: int = 10) -> DataFrame:
    """Most frequent failure messages."""
    return (
        since(runs, as_of, days)
        .where((F.col("status") == FAILED) & F.col("exit_message").isNotNull())
        .groupBy(F.col("exit_message").alias("error"))
        .agg(F.count("*").alias("occurrences"))
        .orderBy(F.desc("occurrences"), "error")
        .limit(limit)
    )


def execution_timeline(runs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Totals and failure rate per business date, newest first."""
    return (
        since(runs, as_of, days)
        .groupBy("business_date")
        .agg(
            F.count("*").alias("total_executions"),
            count_status(COMPLETED).alias("completed"),
            count_status(FAILED).alias("failed"),
        )
        .select(
            F.col("business_date").cast("string").alias("execution_date"),
            "total_executions",
            "completed",
            "failed",
            F.round(F.lit(100.0) * F.col("failed") / F.col("total_executions"), 2).alias("failure_rate"),
        )
        .orderBy(F.desc("execution_date"))
    )


def job_execution_history(
    runs: DataFrame, job: DataFrame, job_name: str, as_of: str, days: int = 30, limit: int = 50
) -> DataFrame:
    """Newest runs of one job, found by name."""
    wanted = job.where(F.col("name") == job_name).select(F.col("id").alias("job_id"))
    newest = (
        since(runs, as_of, days)
        .join(wanted, "job_id")
        .orderBy(F.desc_nulls_first("business_date"), F.desc_nulls_first("start_time_ms"), "id")
        .limit(limit)
    )
    return newest.select(
        F.col("id").alias("execution_id"),
        day_and_clock(F.col("business_date"), F.col("start_time_ms")).alias("start_time"),
        day_and_clock(F.col("business_date"), F.col("end_time_ms")).alias("end_time"),
        "status",
        "duration_ms",
        F.col("exit_message").alias("error_message"),
    )


def active_jobs(runs: DataFrame, job: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Run count and last business date of every job that ran."""
    per_job = since(runs, as_of, days).groupBy("job_id").agg(
        F.count("*").alias("execution_count"), F.max("business_date").alias("last_business_date")
    )
    return with_job_name(per_job, job).select(
        "job_id", "job_name", "execution_count", F.col("last_business_date").cast("string").alias("last_execution")
    ).orderBy(F.desc("last_execution"), "job_id")


def recent_group_runs(jge: DataFrame, runs: DataFrame, job: DataFrame, group_id: str, limit: int = 5) -> DataFrame:
    """The group's newest group runs, one row per context run in them."""
    newest = (
        jge.where(F.col("job_group_id") == group_id)
        .orderBy(F.desc("business_date"), F.desc_nulls_first("start_time_ms"), "id")
        .limit(limit)
        .select(F.col("id").alias("jge_id"), "job_group_id", "business_date", F.col("start_time_ms").alias("group_start_ms"))
    )
    inner = runs.where(F.col("job_group_id") == group_id).select(
        "jge_id", "job_id", F.col("id").alias("execution_id"), "status", "duration_ms"
    )
    names = job.select(F.col("id").alias("job_id"), F.col("name").alias("job_name"))
    return newest.join(inner, "jge_id", "left").join(names, "job_id", "left").drop("job_id")


def group_health(runs: DataFrame, job: DataFrame, has_job: DataFrame, group_id: str) -> DataFrame:
    """Per job of a group: runs, success rate and durations (missing durations count as 0)."""
    jobs = has_job.where(F.col("job_group_id") == group_id).select("job_id")
    filled = F.coalesce("duration_ms", F.lit(0))
    stats = runs.join(jobs, "job_id", "left_semi").groupBy("job_id").agg(
        F.count("*").alias("total"),
        count_status(COMPLETED).alias("completed"),
        count_status(FAILED).alias("failed"),
        F.avg(filled).alias("avg_duration_ms"),
        F.max(filled).alias("max_duration_ms"),
        F.min("duration_ms").alias("min_duration_ms"),
    )
    rate = F.round(F.col("completed") / F.col("total") * 1000) / 10
    return with_job_name(jobs.join(stats, "job_id", "left"), job).select(
        "job_id", "job_name", F.coalesce("total", F.lit(0)).alias("total"), "completed", "failed",
        rate.alias("success_rate"), F.round("avg_duration_ms", 3).alias("avg_duration_ms"),
        "max_duration_ms", "min_duration_ms",
    )
