"""Service-level queries."""

from batchlens.operators import sla as s
from batchlens.plans.q_calendar import FIRST, LAST, plan
from batchlens.plans.registry import SHARED, query
from batchlens.sources.testdata import AS_OF

SHARED.update({
    "ctx_sla": """
        SELECT DISTINCT s.id AS sic_id, l.owner_type, l.owner_id, l.owner_name, l.sla_id, l.sla_name, l.sla_type, l.duration_ms AS sla_duration_ms, l.time_ms AS sla_time_ms
        FROM {sic} s JOIN {sla} l ON ((l.owner_type = 'SIC' AND l.owner_id = s.id) OR (l.owner_type = 'JOB_GROUP' AND l.owner_id = s.job_group_id))
        WHERE coalesce(l.enabled, true)""",
    "latest": f"""
        SELECT sic_id, business_date, id AS execution_id, status AS execution_status, execution_date, start_time_ms, end_time_ms, duration_ms
        FROM (SELECT *, row_number() OVER (PARTITION BY sic_id, business_date ORDER BY start_time_ms DESC NULLS FIRST, id) AS rn FROM {{jce}}
              WHERE business_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}') WHERE rn = 1""",
    "scope": """
        SELECT coalesce(p.sic_id, l.sic_id) AS sic_id, coalesce(p.business_date, l.business_date) AS business_date,
               p.sic_id IS NOT NULL AS planned_for_date, l.sic_id IS NOT NULL AS has_actual_execution,
               execution_id, execution_status, execution_date, start_time_ms, end_time_ms, duration_ms
        FROM (SELECT * FROM {plan} WHERE should_run) p FULL JOIN {latest} l ON l.sic_id = p.sic_id AND l.business_date = p.business_date""",
    "judged": """
        SELECT *, CASE WHEN sla_type = 'RELATIVE' THEN coalesce(duration_ms, 0) > sla_duration_ms
                       ELSE coalesce(duration_ms, 0) > 0 AND execution_date::timestamp + (start_time_ms + duration_ms) * INTERVAL 1 MILLISECOND
                                > business_date::timestamp + sla_time_ms * INTERVAL 1 MILLISECOND END AS hit,
               sla_type = 'RELATIVE' OR coalesce(duration_ms, 0) > 0 AS computable
        FROM {scope} LEFT JOIN {ctx_sla} USING (sic_id)""",
    "coverage": """
        SELECT sic_id, business_date, planned_for_date, has_actual_execution, execution_id, execution_status, execution_date, start_time_ms, end_time_ms,
               owner_type, owner_id, owner_name, sla_id, sla_name, sla_type, sla_duration_ms, sla_time_ms,
               CASE WHEN has_actual_execution THEN coalesce(duration_ms, 0) END AS actual_duration_ms,
               CASE WHEN sla_id IS NULL THEN 'no_sla_defined' WHEN NOT has_actual_execution THEN 'sla_defined_no_execution' ELSE 'evaluated' END AS sla_coverage,
               CASE WHEN sla_id IS NOT NULL AND has_actual_execution THEN computable AND NOT hit END AS meets_sla,
               CASE WHEN sla_id IS NOT NULL AND has_actual_execution THEN hit END AS breached,
               CASE WHEN sla_id IS NULL THEN 'no_sla_defined' WHEN NOT has_actual_execution THEN 'no_execution_data'
                    WHEN hit AND sla_type = 'RELATIVE' THEN 'duration_threshold_breach' WHEN hit THEN 'absolute_time_breach'
                    WHEN computable THEN 'within_sla' ELSE 'no_computable_threshold' END AS breach_reason,
               CASE WHEN has_actual_execution AND hit AND sla_type = 'RELATIVE' THEN duration_ms - sla_duration_ms ELSE 0 END AS breach_by_ms,
               CASE WHEN has_actual_execution AND sla_type = 'ABSOLUTE' THEN business_date::timestamp + sla_time_ms * INTERVAL 1 MILLISECOND END AS sla_deadline
        FROM {judged}""",
    "base": """
        SELECT d.sic_id, d.business_date, avg(h.duration_ms) AS m, count(h.duration_ms) AS n,
               CASE WHEN count(h.duration_ms) = 1 THEN 0.0::double ELSE stddev_samp(h.duration_ms) END AS sd
        FROM (SELECT DISTINCT sic_id, business_date FROM {jce}) d
        LEFT JOIN {jce} h ON h.sic_id = d.sic_id AND h.business_date >= d.business_date - 30 AND h.business_date < d.business_date GROUP BY 1, 2""",
    "breach": """
        SELECT c.*, coalesce(n, 0) AS hist_sample_count,
               CASE WHEN n >= 5 THEN actual_duration_ms > m + 2.0 * sd END AS is_duration_anomaly,
               CASE WHEN n >= 5 AND m > 0 THEN round(actual_duration_ms / m, 3) END AS anomaly_deviation_factor,
               cast(trunc(m) AS bigint) AS hist_avg_int_ms, CASE WHEN sd <> 0 THEN cast(trunc(sd) AS bigint) END AS hist_std_int_ms
        FROM {coverage} c LEFT JOIN (SELECT b.* FROM {base} b) b ON c.has_actual_execution AND b.sic_id = c.sic_id AND b.business_date = c.business_date""",
    "scope_edges": """
        SELECT a.business_date, e.src_id, e.dst_id FROM {scope} a JOIN {sic_precedes} e ON e.src_id = a.sic_id
        JOIN {scope} b ON b.sic_id = e.dst_id AND b.business_date = a.business_date""",
    "plan_edges": """
        SELECT a.business_date, e.src_id, e.dst_id FROM {plan} a JOIN {sic_precedes} e ON e.src_id = a.sic_id
        JOIN {plan} b ON b.sic_id = e.dst_id AND b.business_date = a.business_date WHERE a.should_run AND b.should_run""",
    "graph_nodes": f"""
        SELECT c.*, s.name AS sic_name, s.job_id, s.job_group_id, j.name AS job_name, g.name AS job_group_name,
               CASE WHEN c.business_date < DATE '{AS_OF}' THEN 'schedule_vs_actual' WHEN c.business_date = DATE '{AS_OF}' THEN 'actual' ELSE 'schedule' END AS graph_mode
        FROM {{scope}} c JOIN {{sic}} s ON s.id = c.sic_id JOIN {{job}} j ON j.id = s.job_id JOIN {{job_group}} g ON g.id = s.job_group_id""",
    "analysis": """
        SELECT g.sic_id, g.business_date, g.job_name, g.job_group_id, g.graph_mode, g.planned_for_date, g.execution_status,
               b.actual_duration_ms AS execution_time_ms, b.actual_duration_ms - b.hist_avg_int_ms - b.hist_std_int_ms AS execution_delay_ms,
               b.breached AS sla_breach, CASE WHEN b.breached THEN b.breach_by_ms ELSE 0 END AS sla_delay_ms, b.sla_id, b.sla_name, b.sla_type, b.meets_sla,
               b.is_duration_anomaly, b.anomaly_deviation_factor, b.hist_avg_int_ms AS hist_avg_ms, b.hist_std_int_ms AS hist_std_ms, b.hist_sample_count
        FROM {graph_nodes} g LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY sic_id, business_date
             ORDER BY coalesce(breached, false) DESC, breach_by_ms DESC, coalesce(sla_id, '')) AS rn FROM {breach}) b
             ON b.rn = 1 AND b.sic_id = g.sic_id AND b.business_date = g.business_date""",
})


def latest(t):
    return s.latest_runs(t.jge, t.jce, FIRST, LAST)


def scope(t):
    return s.date_scope(plan(t), latest(t))


def slas(t):
    return s.sla_for_contexts(t.sic, t.sla)


def breaches(t):
    return s.execution_breach(plan(t), t.jge, t.jce, t.sic, t.sla, t.sic_precedes, FIRST, LAST, AS_OF)


def graph(t, group=None):
    return s.job_graph(plan(t), t.jge, t.jce, t.sic, t.job, t.job_group, t.sic_precedes, FIRST, LAST, AS_OF, group)


@query("s1_sla_for_contexts", "SELECT * FROM {ctx_sla}")
def s1(t):
    return slas(t)


@query("s2_latest_run_per_context", "SELECT * FROM {latest}")
def s2(t):
    return latest(t)


@query("s2_latest_run_by_execution", f"""
    SELECT sic_id, business_date, id AS execution_id, status AS execution_status, execution_date, start_time_ms, end_time_ms, duration_ms
    FROM (SELECT *, row_number() OVER (PARTITION BY sic_id, business_date ORDER BY execution_date DESC, start_time_ms DESC NULLS FIRST, id) AS rn FROM {{jce}}
          WHERE business_date BETWEEN DATE '{FIRST}' AND DATE '{LAST}') WHERE rn = 1""")
def s2_execution(t):
    return s.latest_runs(t.jge, t.jce, FIRST, LAST, latest_by="execution")


@query("s2_latest_run_for_planned", "SELECT p.sic_id, p.business_date, l.* EXCLUDE (sic_id, business_date) FROM (SELECT * FROM {plan} WHERE should_run) p LEFT JOIN {latest} l USING (sic_id, business_date)")
def s2_for(t):
    return s.latest_runs_for(plan(t).where("should_run"), latest(t))


@query("s3_observed_sla", """
    SELECT c.sic_id, c.business_date, c.execution_id, c.sla_id, c.breached, c.meets_sla, c.breach_reason, c.breach_by_ms, c.sla_deadline
    FROM {coverage} c WHERE sla_coverage = 'evaluated'""")
def s3(t):
    return s.observed_sla(scope(t), slas(t)).select(
        "sic_id", "business_date", "execution_id", "sla_id", "breached", "meets_sla", "breach_reason", "breach_by_ms", "sla_deadline"
    )


@query("s4_sla_coverage", "SELECT * FROM {coverage}")
def s4(t):
    return s.sla_coverage(scope(t), slas(t))


@query("s5_sla_execution_breach", "SELECT * FROM {breach}")
def s5(t):
    return breaches(t).results


@query("s5_breach_relationships", "SELECT * FROM {plan_edges}")
def s5_rel(t):
    return breaches(t).relationships


@query("s5_breach_summary", """
    SELECT * FROM (SELECT business_date, count(*) FILTER (planned_for_date) AS eligible_sic_count, count(*) FILTER (has_actual_execution) AS executed_sic_count,
                   count(*) FILTER (planned_for_date AND NOT has_actual_execution) AS not_executed_count FROM {scope} GROUP BY 1) a
    JOIN (SELECT business_date, count(breached) AS sla_evaluated_count, count(*) FILTER (breached) AS breach_count, count(*) FILTER (meets_sla) AS met_count,
                 count(*) FILTER (breach_reason = 'no_sla_defined') AS no_sla_defined_count, count(*) FILTER (breach_reason = 'no_execution_data') AS no_execution_count,
                 count(*) FILTER (is_duration_anomaly) AS anomaly_count FROM {breach} GROUP BY 1) b USING (business_date)
    JOIN (SELECT s.business_date, count(e.src_id) AS relationship_count FROM (SELECT DISTINCT business_date FROM {scope}) s LEFT JOIN {plan_edges} e USING (business_date) GROUP BY 1) c USING (business_date)""")
def s5_summary(t):
    return breaches(t).summary


@query("s6_missing_sla", "SELECT *, 'missing_sla' AS coverage_status FROM {scope} WHERE sic_id NOT IN (SELECT sic_id FROM {ctx_sla})")
def s6(t):
    return s.missing_sla(scope(t), slas(t))


@query("s7_job_execution_analysis", "SELECT * FROM {analysis}")
def s7(t):
    return s.job_execution_analysis(graph(t), breaches(t)).results


@query("s7_analysis_summary", """
    SELECT business_date, count(*) AS total_sics, count(execution_time_ms) AS executed_count, count(*) - count(execution_time_ms) AS not_executed_count,
           count(*) FILTER (sla_breach) AS breach_count, count(*) FILTER (is_duration_anomaly) AS anomaly_count, count(*) FILTER (meets_sla) AS meets_sla_count
    FROM {analysis} GROUP BY 1""")
def s7_summary(t):
    return s.job_execution_analysis(graph(t), breaches(t)).summary


@query("s8_sla_configuration", """
    SELECT coalesce(c.job_group_id, l.owner_id) AS job_group_id, l.owner_type, l.owner_id, l.sla_id, l.sla_type, l.duration_ms, l.time_ms, l.enabled, q.resource_id, r.name AS resource_name
    FROM {sla} l LEFT JOIN {sic} c ON l.owner_type = 'SIC' AND c.id = l.owner_id
    LEFT JOIN {require_resource} q ON l.sla_type = 'RELATIVE' AND q.owner_type = l.owner_type AND q.owner_id = l.owner_id LEFT JOIN {resource} r ON r.id = q.resource_id""")
def s8(t):
    return s.sla_configuration(t.sic, t.sla, t.require_resource, t.resource)


@query("g3_job_graph_nodes", "SELECT * FROM {graph_nodes}")
def g3_nodes(t):
    return graph(t).results


@query("g3_job_graph_edges", "SELECT * FROM {scope_edges}")
def g3_edges(t):
    return graph(t).relationships


@query("g3_job_graph_summary", """
    SELECT business_date, graph_mode, count(*) FILTER (planned_for_date) AS eligible_count, count(*) FILTER (has_actual_execution) AS actual_count,
           count(*) AS node_count, any_value(k) AS relationship_count
    FROM {graph_nodes} LEFT JOIN (SELECT business_date AS bd, count(*) AS k FROM {scope_edges} GROUP BY 1) x ON x.bd = business_date GROUP BY 1, 2""")
def g3_summary(t):
    return graph(t).summary


@query("g3_job_graph_of_group", "SELECT * FROM {graph_nodes} WHERE job_group_id = 'JG_5'")
def g3_group(t):
    return graph(t, "NATION_5").results
