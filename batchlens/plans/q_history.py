"""Run-history queries."""

from batchlens.operators import history as h
from batchlens.plans.registry import query
from batchlens.plans.sqltext import day_clock, since
from batchlens.sources.testdata import AS_OF

START, END = day_clock("business_date", "start_time_ms"), day_clock("business_date", "end_time_ms")


@query("x1_failed_jobs", f"""
    SELECT j.name AS job_name, e.id AS execution_id, {START} AS start_time, {END} AS end_time, exit_message AS error_message
    FROM {{jce}} e JOIN {{job}} j ON e.job_id = j.id WHERE status = 'FAILED' AND {since(7)}
    ORDER BY business_date DESC, start_time_ms DESC, e.id LIMIT 10""")
def x1(t):
    return h.failed_jobs(t.jce, t.job, AS_OF)


@query("x2_common_errors", f"""
    SELECT exit_message AS error, count(*) AS occurrences FROM {{jce}}
    WHERE status = 'FAILED' AND exit_message IS NOT NULL AND {since(30)}
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def x2(t):
    return h.common_errors(t.jce, AS_OF)


@query("x3_execution_timeline", f"""
    SELECT cast(business_date AS varchar) AS execution_date, count(*) AS total_executions,
           count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed,
           round(100.0::double * count(*) FILTER (status = 'FAILED') / count(*), 2) AS failure_rate
    FROM {{jce}} WHERE {since(30)} GROUP BY business_date""")
def x3(t):
    return h.execution_timeline(t.jce, AS_OF)


@query("x4_job_execution_history", f"""
    SELECT e.id AS execution_id, {START} AS start_time, {END} AS end_time, status, duration_ms, exit_message AS error_message
    FROM {{jce}} e JOIN {{job}} j ON e.job_id = j.id WHERE j.name = 'LOAD_3' AND {since(30)}
    ORDER BY business_date DESC, start_time_ms DESC, e.id LIMIT 50""")
def x4(t):
    return h.job_execution_history(t.jce, t.job, "LOAD_3", AS_OF)


@query("x5_active_jobs", f"""
    SELECT j.id AS job_id, j.name AS job_name, count(*) AS execution_count, cast(max(business_date) AS varchar) AS last_execution
    FROM {{jce}} e JOIN {{job}} j ON e.job_id = j.id WHERE {since(30)} GROUP BY 1, 2""")
def x5(t):
    return h.active_jobs(t.jce, t.job, AS_OF)


@query("x6_recent_group_runs", """
    WITH newest AS (SELECT * FROM {jge} WHERE job_group_id = 'JG_3'
                    ORDER BY business_date DESC, start_time_ms DESC, id LIMIT 5)
    SELECT n.id AS jge_id, n.job_group_id, n.business_date, n.start_time_ms AS group_start_ms,
           e.id AS execution_id, e.status, e.duration_ms, j.name AS job_name
    FROM newest n LEFT JOIN {jce} e ON e.jge_id = n.id LEFT JOIN {job} j ON j.id = e.job_id""")
def x6(t):
    return h.recent_group_runs(t.jge, t.jce, t.job, "JG_3")


@query("x7_group_health", """
    SELECT j.id AS job_id, j.name AS job_name, count(e.id) AS total,
           CASE WHEN count(e.id) > 0 THEN count(*) FILTER (e.status = 'COMPLETED') END AS completed,
           CASE WHEN count(e.id) > 0 THEN count(*) FILTER (e.status = 'FAILED') END AS failed,
           round(count(*) FILTER (e.status = 'COMPLETED')::double / nullif(count(e.id), 0) * 1000) / 10 AS success_rate,
           round(avg(coalesce(e.duration_ms, 0)) FILTER (e.id IS NOT NULL), 3) AS avg_duration_ms,
           max(e.duration_ms) AS max_duration_ms, min(e.duration_ms) AS min_duration_ms
    FROM {has_job} h JOIN {job} j ON j.id = h.job_id LEFT JOIN {jce} e ON e.job_id = j.id
    WHERE h.job_group_id = 'JG_3' GROUP BY 1, 2""")
def x7(t):
    return h.group_health(t.jce, t.job, t.has_job, "JG_3")
