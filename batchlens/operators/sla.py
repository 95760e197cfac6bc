"""Service levels: coverage, observed breaches and the combined run analysis."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.functions.clock import DAY_MS
from batchlens.operators.performance import anomaly_columns, rolling_baseline
from batchlens.session import LoopState

RUN_COLS = ("execution_id", "execution_status", "execution_date", "start_time_ms", "end_time_ms", "duration_ms")


def enabled(flag: str = "enabled") -> Column:
    """A missing flag counts as enabled."""
    return F.coalesce(F.col(flag), F.lit(True))


def sla_for_contexts(sics: DataFrame, sla: DataFrame) -> DataFrame:
    """Enabled service levels of each context: its own and its group's."""
    on = sla.where(enabled()).drop("enabled")
    ids = sics.select(F.col("id").alias("sic_id"), "job_group_id")
    own = ids.join(on.where(F.col("owner_type") == "SIC"), F.col("sic_id") == F.col("owner_id"))
    group = ids.join(on.where(F.col("owner_type") == "JOB_GROUP"), F.col("job_group_id") == F.col("owner_id"))
    cols = ["sic_id", "owner_type", "owner_id", "owner_name", "sla_id", "sla_name", "sla_type",
            F.col("duration_ms").alias("sla_duration_ms"), F.col("time_ms").alias("sla_time_ms")]
    return own.select(*cols).unionByName(group.select(*cols)).distinct()


def latest_runs(jge: DataFrame, runs: DataFrame, first: str, last: str, latest_by: str = "clock") -> DataFrame:
    """Newest run of each context per business date.

    ``clock`` compares start times of day only (missing first), so a start on
    the evening before beats one after midnight; ``execution`` compares
    execution date and start.  Ties go to the lower id.
    """
    days = jge.where(F.col("business_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    r = days.select(F.col("id").alias("jge_id"), F.col("business_date").alias("group_date")).join(
        runs.drop("business_date"), "jge_id"
    )
    order = [F.col("start_time_ms").isNotNull(), -F.col("start_time_ms"), F.col("id")]
    if latest_by == "execution":
        order.insert(0, -F.unix_date("execution_date"))
    best = F.min_by(
        F.struct(
            F.col("id").alias("execution_id"), F.col("status").alias("execution_status"),
            F.coalesce("execution_date", "group_date").alias("execution_date"), "start_time_ms", "end_time_ms", "duration_ms",
        ),
        F.struct(*order),
    )
    return r.groupBy("sic_id", F.col("group_date").alias("business_date")).agg(best.alias("b")).select("sic_id", "business_date", "b.*")


def latest_runs_for(contexts: DataFrame, latest: DataFrame) -> DataFrame:
    """The same for a given set of (sic_id, business_date), keeping misses."""
    return contexts.select("sic_id", "business_date").join(latest, ["sic_id", "business_date"], "left")


def date_scope(plan: DataFrame, latest: DataFrame) -> DataFrame:
    """Planned or executed contexts per date, with the run if there was one."""
    planned = plan.where("should_run").select("sic_id", "business_date", F.lit(True).alias("p"))
    return planned.join(latest, ["sic_id", "business_date"], "full_outer").select(
        "sic_id", "business_date", F.coalesce("p", F.lit(False)).alias("planned_for_date"),
        F.col("execution_id").isNotNull().alias("has_actual_execution"), *RUN_COLS,
    )


def observed_columns() -> dict[str, Column]:
    """Verdict of a run against one service level, over the columns of both."""
    duration = F.coalesce("duration_ms", F.lit(0))
    threshold = F.coalesce("sla_duration_ms", F.lit(0))
    kind = F.upper(F.coalesce("sla_type", F.lit("")))
    over = (kind == "RELATIVE") & (threshold > 0) & (duration > threshold)
    deadline = F.unix_date("business_date").cast("bigint") * DAY_MS + F.col("sla_time_ms")
    end = F.when(duration != 0, F.unix_date("execution_date").cast("bigint") * DAY_MS + F.col("start_time_ms") + duration)
    timed = (kind == "ABSOLUTE") & end.isNotNull() & deadline.isNotNull()
    late = timed & (end > deadline)
    computable = F.when(kind == "RELATIVE", threshold > 0).when(kind == "ABSOLUTE", timed).otherwise(threshold > 0)
    late, over = F.coalesce(late, F.lit(False)), F.coalesce(over, F.lit(False))
    return {
        "breached": over | late,
        "meets_sla": computable & ~(over | late),
        "breach_reason": F.when(over, "duration_threshold_breach").when(late, "absolute_time_breach")
        .when(computable, "within_sla").otherwise("no_computable_threshold"),
        "breach_by_ms": F.when(over, duration - threshold).otherwise(0),
        "sla_deadline": F.when(kind == "ABSOLUTE", F.timestamp_millis(deadline)),
    }


def observed_sla(scope: DataFrame, slas: DataFrame) -> DataFrame:
    """Every run judged against every service level of its context."""
    rows = scope.where("has_actual_execution").join(slas, "sic_id")
    return rows.select("*", *(c.alias(n) for n, c in observed_columns().items()))


def sla_coverage(scope: DataFrame, slas: DataFrame) -> DataFrame:
    """One row per context, date and service level: evaluated, not executed, or none defined."""
    rows = scope.join(slas, "sic_id", "left")
    no_sla, no_run = F.col("sla_id").isNull(), ~F.col("has_actual_execution")
    v = observed_columns()
    judged = ~no_sla & ~no_run
    return rows.select(
        "*",
        F.when(F.col("has_actual_execution"), F.coalesce("duration_ms", F.lit(0))).alias("actual_duration_ms"),
        F.when(no_sla, "no_sla_defined").when(no_run, "sla_defined_no_execution").otherwise("evaluated").alias("sla_coverage"),
        F.when(judged, v["meets_sla"]).alias("meets_sla"),
        F.when(judged, v["breached"]).alias("breached"),
        F.when(no_sla, "no_sla_defined").when(no_run, "no_execution_data").otherwise(v["breach_reason"]).alias("breach_reason"),
        F.when(judged, v["breach_by_ms"]).otherwise(0).alias("breach_by_ms"),
        F.when(judged, v["sla_deadline"]).alias("sla_deadline"),
    ).drop("duration_ms")


class Breaches(NamedTuple):
    results: DataFrame
    relationships: DataFrame
    summary: DataFrame


def precedes_per_date(edges: DataFrame, contexts: DataFrame) -> DataFrame:
    """Edges with both ends among the contexts of a date (sic_id, business_date)."""
    ids = contexts.select("sic_id", "business_date").distinct()
    return (
        ids.withColumnRenamed("sic_id", "src_id").join(edges.select("src_id", "dst_id"), "src_id")
        .join(ids.withColumnRenamed("sic_id", "dst_id"), ["dst_id", "business_date"], "left_semi")
        .select("business_date", "src_id", "dst_id")
    )


def execution_breach(
    plan: DataFrame, jge: DataFrame, runs: DataFrame, sics: DataFrame, sla: DataFrame, edges: DataFrame,
    first: str, last: str, as_of: str,
) -> Breaches:
    """Service-level and duration verdicts of every planned or executed context per date."""
    if last > as_of:
        raise ValueError("observed breaches need dates up to today; use the delay projection for later ones")
    scope, _ = LoopState(plan.sparkSession, "breach").save(date_scope(plan, latest_runs(jge, runs, first, last)))
    covered = sla_coverage(scope, sla_for_contexts(sics, sla))
    base = baseline_on_dates(runs, scope.where("has_actual_execution").select("sic_id", "business_date"))
    rows = covered.join(base, ["sic_id", "business_date"], "left")
    samples = F.coalesce("hist_sample_count", F.lit(0))
    verdict = anomaly_columns(F.col("actual_duration_ms"), F.col("hist_avg_ms"), F.col("hist_std_ms"), samples)
    results = rows.select(
        *covered.columns, samples.alias("hist_sample_count"), *(c.alias(n) for n, c in verdict.items())
    )
    planned = plan.where("should_run").select("sic_id", "business_date")
    rel = precedes_per_date(edges, planned)
    counts = results.groupBy("business_date").agg(
        F.count_if(F.col("breached").isNotNull()).alias("sla_evaluated_count"),
        F.count_if("breached").alias("breach_count"), F.count_if("meets_sla").alias("met_count"),
        F.count_if(F.col("breach_reason") == "no_sla_defined").alias("no_sla_defined_count"),
        F.count_if(F.col("breach_reason") == "no_execution_data").alias("no_execution_count"),
        F.count_if("is_duration_anomaly").alias("anomaly_count"),
    )
    totals = scope.groupBy("business_date").agg(
        F.count_if("planned_for_date").alias("eligible_sic_count"), F.count_if("has_actual_execution").alias("executed_sic_count"),
        F.count_if(F.col("planned_for_date") & ~F.col("has_actual_execution")).alias("not_executed_count"),
    )
    links = rel.groupBy("business_date").agg(F.count("*").alias("relationship_count"))
    summary = totals.join(counts, "business_date").join(links, "business_date", "left").fillna(0, ["relationship_count"])
    return Breaches(results, rel, summary)


def baseline_on_dates(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Baselines for (sic_id, business_date) pairs that ran."""
    return rolling_baseline(runs).join(wanted.distinct(), ["sic_id", "business_date"], "left_semi")


def missing_sla(scope: DataFrame, slas: DataFrame) -> DataFrame:
    """Contexts in scope that no enabled service level covers."""
    return scope.join(slas.select("sic_id").distinct(), "sic_id", "left_anti").withColumn("coverage_status", F.lit("missing_sla"))


def job_graph(
    plan: DataFrame, jge: DataFrame, runs: DataFrame, sics: DataFrame, job: DataFrame, job_group: DataFrame, edges: DataFrame,
    first: str, last: str, as_of: str, group: str | None = None,
) -> Breaches:
    """Planned and actual contexts per date with the edges among them.

    Past dates compare schedule and runs, today shows runs so far, later dates
    show the schedule only.  Returns (nodes, relationships, summary).
    """
    day = F.col("business_date")
    today = F.lit(as_of).cast("date")
    groups = job_group if group is None else job_group.where((F.col("id") == group) | (F.col("name") == group))
    named = (
        sics.select(F.col("id").alias("sic_id"), F.col("name").alias("sic_name"), "job_id", "job_group_id")
        .join(job.select(F.col("id").alias("job_id"), F.col("name").alias("job_name")), "job_id")
        .join(groups.select(F.col("id").alias("job_group_id"), F.col("name").alias("job_group_name")), "job_group_id")
    )
    past = latest_runs(jge, runs, first, min(last, as_of))
    scope = date_scope(plan, past)
    mode = F.when(day < today, "schedule_vs_actual").when(day == today, "actual").otherwise("schedule")
    # edges, counts and the analysis all read the nodes: written once
    nodes, _ = LoopState(plan.sparkSession, "graph").save(scope.join(named, "sic_id").withColumn("graph_mode", mode))
    rel = precedes_per_date(edges, nodes)
    links = rel.groupBy("business_date").agg(F.count("*").alias("relationship_count"))
    summary = nodes.groupBy("business_date", "graph_mode").agg(
        F.count_if("planned_for_date").alias("eligible_count"), F.count_if("has_actual_execution").alias("actual_count"),
        F.count("*").alias("node_count"),
    ).join(links, "business_date", "left").fillna(0, ["relationship_count"])
    return Breaches(nodes, rel, summary)


def job_execution_analysis(graph: Breaches, breaches: Breaches) -> Breaches:
    """Graph nodes with run time, delay, breach and anomaly facts.

    A context with several service levels shows its worst breach (then the
    lowest level id).  Delay is the run time beyond average plus deviation.
    """
    worst = breaches.results.groupBy("sic_id", "business_date").agg(
        F.min_by(
            F.struct(
                "actual_duration_ms", "breached", "breach_by_ms", "sla_id", "sla_name", "sla_type", "meets_sla",
                "is_duration_anomaly", "anomaly_deviation_factor", "hist_avg_int_ms", "hist_std_int_ms", "hist_sample_count",
            ),
            F.struct(~F.coalesce("breached", F.lit(False)), -F.coalesce("breach_by_ms", F.lit(0)), F.coalesce("sla_id", F.lit(""))),
        ).alias("w")
    ).select("sic_id", "business_date", "w.*")
    nodes = graph.results.drop("duration_ms").join(worst, ["sic_id", "business_date"], "left")
    delay = F.col("actual_duration_ms") - F.col("hist_avg_int_ms") - F.col("hist_std_int_ms")
    nodes = nodes.select(
        "sic_id", "business_date", "job_name", "job_group_id", "graph_mode", "planned_for_date", "execution_status",
        F.col("actual_duration_ms").alias("execution_time_ms"), delay.alias("execution_delay_ms"),
        F.col("breached").alias("sla_breach"), F.when(F.col("breached"), F.col("breach_by_ms")).otherwise(0).alias("sla_delay_ms"),
        "sla_id", "sla_name", "sla_type", "meets_sla", "is_duration_anomaly", "anomaly_deviation_factor",
        F.col("hist_avg_int_ms").alias("hist_avg_ms"), F.col("hist_std_int_ms").alias("hist_std_ms"), "hist_sample_count",
    )
    executed = F.col("execution_time_ms").isNotNull()
    summary = nodes.groupBy("business_date").agg(
        F.count("*").alias("total_sics"), F.count_if(executed).alias("executed_count"), F.count_if(~executed).alias("not_executed_count"),
        F.count_if("sla_breach").alias("breach_count"), F.count_if("is_duration_anomaly").alias("anomaly_count"),
        F.count_if("meets_sla").alias("meets_sla_count"),
    )
    return Breaches(nodes, graph.relationships, summary)


def sla_configuration(sics: DataFrame, sla: DataFrame, require: DataFrame, resource: DataFrame, group: str | None = None) -> DataFrame:
    """Service levels of groups and their contexts, with the resource a relative one waits for."""
    own = sics.select(F.col("id").alias("owner_id"), "job_group_id")
    ctx = sla.where(F.col("owner_type") == "SIC").join(own, "owner_id")
    grp = sla.where(F.col("owner_type") == "JOB_GROUP").withColumn("job_group_id", F.col("owner_id"))
    rows = grp.unionByName(ctx)
    if group is not None:
        rows = rows.where(F.col("job_group_id") == group)
    needs = require.select("owner_type", "owner_id", "resource_id").join(
        resource.select(F.col("id").alias("resource_id"), F.col("name").alias("resource_name")), "resource_id"
    )
    relative = needs.withColumn("sla_type", F.lit("RELATIVE"))
    return rows.join(relative, ["owner_type", "owner_id", "sla_type"], "left").select(
        "job_group_id", "owner_type", "owner_id", "sla_id", "sla_type", "duration_ms", "time_ms", "enabled", "resource_id", "resource_name"
    )
