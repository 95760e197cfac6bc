"""Durations, trends, baselines and anomalies."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchlens.functions.clock import DAY_MS, day_and_clock, ms_to_clock
from batchlens.operators.history import count_status, since, with_job_name

# fixed values: anomaly and trend defaults
ANOMALY_DAYS, ANOMALY_K, ANOMALY_MIN_SAMPLES = 30, 2.0, 5
TREND_MIN_POINTS, TREND_SLOPE_MS = 7, 500.0


def timed() -> Column:
    return F.col("duration_ms").isNotNull()


def job_performance(runs: DataFrame, job: DataFrame, as_of: str, days: int = 30, job_name: str | None = None) -> DataFrame:
    """Average/min/max seconds and status counts per job (one job or all)."""
    jobs = job if job_name is None else job.where(F.col("name") == job_name)
    stats = since(runs, as_of, days).where(timed()).groupBy("job_id").agg(
        F.avg("duration_ms").alias("avg_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
        F.count("*").alias("execution_count"),
        count_status("COMPLETED").alias("success_count"), count_status("FAILED").alias("failure_count"),
    )
    return with_job_name(stats, jobs).select(
        "job_name",
        (F.col("avg_ms") / 1000).alias("avg_duration_seconds"),
        (F.col("min_ms") / 1000).alias("min_duration_seconds"),
        (F.col("max_ms") / 1000).alias("max_duration_seconds"),
        "execution_count", "success_count", "failure_count",
    )


def duration_timeseries(runs: DataFrame, job: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Average duration and run count per job and business date."""
    daily = since(runs, as_of, days).where(timed()).groupBy("job_id", "business_date").agg(
        F.avg("duration_ms").alias("avg_duration_ms"), F.count("*").alias("execution_count")
    )
    return with_job_name(daily, job).select(
        "job_name", F.col("business_date").cast("string").alias("business_date"), "avg_duration_ms", "execution_count"
    )


def duration_trend(
    runs: DataFrame, job: DataFrame, as_of: str, days: int = 30,
    min_points: int = TREND_MIN_POINTS, slope_ms: float = TREND_SLOPE_MS,
) -> DataFrame:
    """Slope of the daily average over the point index, per job, with a label."""
    daily = duration_timeseries(runs, job, as_of, days)
    points = daily.withColumn("x", F.row_number().over(Window.partitionBy("job_name").orderBy("business_date")) - 1)
    fit = points.groupBy("job_name").agg(
        F.count("*").alias("data_points"),
        F.regr_slope(F.col("avg_duration_ms"), F.col("x").cast("double")).alias("slope"),
    )
    label = (
        F.when(F.col("data_points") < min_points, "insufficient_data")
        .when(F.col("slope") > slope_ms, "deteriorating")
        .when(F.col("slope") < -slope_ms, "improving")
        .otherwise("stable")
    )
    return fit.select("job_name", "data_points", F.round("slope", 2).alias("slope_ms_per_day"), label.alias("trend"))


def slow_jobs(
    runs: DataFrame, job: DataFrame, as_of: str, threshold_minutes: float = 10, days: int = 7, limit: int = 10
) -> DataFrame:
    """Longest runs above a threshold."""
    longest = (
        since(runs, as_of, days)
        .where(timed() & (F.col("duration_ms") > threshold_minutes * 60_000))
        .join(job.select(F.col("id").alias("job_id"), F.col("name").alias("job_name")), "job_id")
        .orderBy(F.desc("duration_ms"), "id")
        .limit(limit)
    )
    return longest.select(
        "job_name", F.col("id").alias("execution_id"),
        day_and_clock(F.col("business_date"), F.col("start_time_ms")).alias("start_time"),
        day_and_clock(F.col("business_date"), F.col("end_time_ms")).alias("end_time"),
        "status", F.expr("duration_ms div 1000").alias("duration_seconds"),
        F.round(F.col("duration_ms") / 60000.0, 2).alias("duration_minutes"),
    )


def compare_jobs(runs: DataFrame, job: DataFrame, as_of: str, names: list[str] | None = None, days: int = 30) -> DataFrame:
    """Failure rates and averages side by side, worst first."""
    jobs = job if names is None else job.where(F.col("name").isin(names))
    stats = since(runs, as_of, days).where(timed()).groupBy("job_id").agg(
        F.count("*").alias("executions"), count_status("FAILED").alias("failures"),
        (F.avg("duration_ms") / 1000).alias("avg_s"),
    )
    return with_job_name(stats, jobs).select(
        "job_name", "executions", "failures",
        F.round(F.lit(100.0) * F.col("failures") / F.col("executions"), 2).alias("failure_rate"),
        F.round("avg_s", 2).alias("avg_duration_seconds"),
        F.round(F.col("avg_s") / 60.0, 2).alias("avg_duration_minutes"),
    ).orderBy(F.desc("failure_rate"), F.desc("avg_duration_seconds"), "job_name")


def avg_duration(runs: DataFrame, sics: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Average duration and sample size per context; contexts without runs stay."""
    stats = since(runs, as_of, days).where(timed()).groupBy("sic_id").agg(
        F.avg("duration_ms").alias("avg_duration_ms"), F.count("*").alias("sample_size")
    )
    return sics.select(F.col("id").alias("sic_id")).join(stats, "sic_id", "left").withColumn(
        "sample_size", F.coalesce("sample_size", F.lit(0))
    )


def circular_mean_finish(runs: DataFrame, sics: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Mean finish time on the 24-hour circle, whole seconds, per context."""
    angle = F.col("end_time_ms") / float(DAY_MS) * F.lit(2.0) * F.pi()
    stats = since(runs, as_of, days).where(F.col("end_time_ms").isNotNull()).groupBy("sic_id").agg(
        F.avg(F.sin(angle)).alias("s"), F.avg(F.cos(angle)).alias("c"), F.count("*").alias("sample_count")
    )
    mean = F.atan2("s", "c")
    mean = F.when(mean < 0, mean + F.lit(2.0) * F.pi()).otherwise(mean)
    # rounding may land on a full turn, which is midnight
    seconds = F.pmod(F.floor(F.floor(mean / (F.lit(2.0) * F.pi()) * DAY_MS) / 1000), F.lit(86_400))
    joined = sics.select(F.col("id").alias("sic_id")).join(stats, "sic_id", "left")
    return joined.select(
        "sic_id", F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        (seconds * 1000).alias("finish_ms"), ms_to_clock(seconds * 1000).alias("avg_finish_time"),
    )


def _moments(value: Column) -> list[Column]:
    """Exact count, sum and sum of squares of an integer column."""
    v = value.cast("decimal(19,0)")
    return [F.count(value).alias("n"), F.sum(v).alias("s"), F.sum((v * v).cast("decimal(38,0)")).alias("q")]


def _mean_std(n: Column, s: Column, q: Column) -> tuple[Column, Column]:
    """Mean and sample deviation from moments; one sample has deviation 0, none has null.

    With a whole number m near the mean and r = s - n m, the squared distances
    add up to q - n m m - 2 m r - r r / n.  All but the last term, which is
    below the others, are whole and subtracted as decimals, so equal leading
    digits of the moments cost nothing.
    """
    nd = n.cast("double")
    mean = s.cast("double") / nd
    whole, m = n.cast("decimal(19,0)"), F.floor(mean).cast("decimal(19,0)")
    r = (s - (whole * m).cast("decimal(38,0)")).cast("decimal(38,0)")
    apart = (q - ((whole * m).cast("decimal(38,0)") * m).cast("decimal(38,0)") - (m * r * 2).cast("decimal(38,0)")).cast("double")
    var = F.greatest((apart - r.cast("double") * r.cast("double") / nd) / (nd - 1), F.lit(0.0))
    return F.when(n > 0, mean), F.when(n > 1, F.sqrt(var)).when(n == 1, 0.0)


def anomaly_baseline(runs: DataFrame, sics: DataFrame, business_date: str, days: int = ANOMALY_DAYS) -> DataFrame:
    """Mean, sample deviation and count over the ``days`` before a date, per context."""
    day = dt.date.fromisoformat(business_date)
    past = runs.where(
        (F.col("business_date") >= F.lit(day - dt.timedelta(days=days))) & (F.col("business_date") < F.lit(day)) & timed()
    )
    m = past.groupBy("sic_id").agg(*_moments(F.col("duration_ms")))
    mean, std = _mean_std(F.col("n"), F.col("s"), F.col("q"))
    return sics.select(F.col("id").alias("sic_id")).join(m, "sic_id", "left").select(
        "sic_id", mean.alias("hist_avg_ms"), std.alias("hist_std_ms"), F.coalesce("n", F.lit(0)).alias("hist_sample_count")
    )


def rolling_baseline(runs: DataFrame, days: int = ANOMALY_DAYS) -> DataFrame:
    """The baseline of every (context, business date) that ran, in one pass.

    Runs are reduced to one row per context and day before the range window,
    so a context with very many runs costs the window no more than its days.
    """
    daily = runs.where(timed()).groupBy("sic_id", "business_date").agg(*_moments(F.col("duration_ms")))
    w = Window.partitionBy("sic_id").orderBy(F.unix_date("business_date")).rangeBetween(-days, -1)
    over = daily.select(
        "sic_id", "business_date", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("n"), F.sum("s").over(w).alias("s"), F.sum("q").over(w).alias("q")
    )
    mean, std = _mean_std(F.col("n"), F.col("s"), F.col("q"))
    return over.select(
        "sic_id", "business_date", mean.alias("hist_avg_ms"), std.alias("hist_std_ms"), F.col("n").alias("hist_sample_count")
    )


def anomaly_columns(
    actual: Column, avg: Column, std: Column, samples: Column,
    k: float = ANOMALY_K, min_samples: int = ANOMALY_MIN_SAMPLES,
) -> dict[str, Column]:
    """Anomaly verdict of a run against its baseline; null below the sample minimum."""
    enough = (samples >= min_samples) & avg.isNotNull() & actual.isNotNull()
    return {
        "is_duration_anomaly": F.when(enough, actual > avg + F.lit(k) * F.coalesce(std, F.lit(0.0))),
        "anomaly_deviation_factor": F.when(enough & (avg > 0), F.round(actual / avg, 3)),
        "hist_avg_int_ms": avg.cast("bigint"),
        "hist_std_int_ms": F.when(std != 0, std.cast("bigint")),
    }


def duration_anomaly(runs: DataFrame, days: int = ANOMALY_DAYS, k: float = ANOMALY_K, min_samples: int = ANOMALY_MIN_SAMPLES) -> DataFrame:
    """Every timed run judged against the baseline of its context and date."""
    joined = runs.where(timed()).select("id", "sic_id", "business_date", "duration_ms").join(
        rolling_baseline(runs, days), ["sic_id", "business_date"]
    )
    cols = anomaly_columns(F.col("duration_ms"), F.col("hist_avg_ms"), F.col("hist_std_ms"), F.col("hist_sample_count"), k, min_samples)
    return joined.select(
        F.col("id").alias("execution_id"), "sic_id", "business_date", "duration_ms", "hist_sample_count",
        *(c.alias(n) for n, c in cols.items()),
    )
