"""Critical path queries; every one covers all group runs."""

from batchlens.operators import cpm as c
from batchlens.plans.registry import SHARED, query

SHARED.update({
    "rep": """
        SELECT jge_id, sic_id, id AS jce_id, coalesce(duration_ms, 0) AS dur FROM (SELECT *, row_number() OVER (PARTITION BY jge_id, sic_id
            ORDER BY (status IN ('COMPLETED', 'SUCCESS') AND duration_ms IS NOT NULL) DESC, coalesce(duration_ms, 0) DESC, id) AS rn FROM {jce}) WHERE rn = 1""",
    "redge": """
        SELECT a.jge_id, e.src_id, e.dst_id FROM {rep} a JOIN {sic_precedes} e ON e.src_id = a.sic_id JOIN {rep} b ON b.jge_id = a.jge_id AND b.sic_id = e.dst_id
        JOIN {sic} x ON x.id = e.src_id JOIN {sic} y ON y.id = e.dst_id AND y.job_group_id = x.job_group_id""",
    "rstart": "SELECT g.id AS jge_id, e.sic_id AS node FROM {jge} g JOIN {entry} e USING (job_group_id)",
    "rreach": """ /*rec*/ SELECT jge_id, node, min(d) AS distance FROM (WITH RECURSIVE r AS (SELECT jge_id, node, 0 AS d FROM {rstart}
        UNION SELECT r.jge_id, e.dst_id, r.d + 1 FROM r JOIN {redge} e ON e.jge_id = r.jge_id AND e.src_id = r.node) SELECT * FROM r) GROUP BY 1, 2""",
    "rnode": "SELECT r.jge_id, r.node, p.jce_id, coalesce(p.dur, 0) AS dur, s.node IS NOT NULL AS is_entry FROM {rreach} r LEFT JOIN {rep} p ON p.jge_id = r.jge_id AND p.sic_id = r.node LEFT JOIN {rstart} s ON s.jge_id = r.jge_id AND s.node = r.node",
    "fwd": """ /*rec*/ SELECT n.jge_id, n.node, n.jce_id, n.dur, n.is_entry, max(w.es) AS es, max(w.es) + n.dur AS ef FROM (
        WITH RECURSIVE w AS (SELECT jge_id, node, cast(0 AS bigint) AS es, dur FROM {rnode} WHERE is_entry
            UNION SELECT w.jge_id, n.node, w.es + w.dur, n.dur FROM w JOIN {redge} e ON e.jge_id = w.jge_id AND e.src_id = w.node
                  JOIN {rnode} n ON n.jge_id = w.jge_id AND n.node = e.dst_id AND NOT n.is_entry) SELECT * FROM w) w
        JOIN {rnode} n ON n.jge_id = w.jge_id AND n.node = w.node GROUP BY 1, 2, 3, 4, 5""",
    "fin": """
        SELECT f.jge_id, g.job_group_id, g.business_date, l.duration_ms AS group_sla_ms, f.completion_ms, f.end_node,
               CASE WHEN l.duration_ms > 0 THEN l.duration_ms ELSE f.completion_ms END AS project_finish_ms,
               CASE WHEN l.duration_ms > 0 THEN l.duration_ms - f.completion_ms END AS total_buffer_ms
        FROM (SELECT jge_id, max(ef) AS completion_ms, arg_min(node, row(-ef, node)) AS end_node FROM {fwd} f
              WHERE NOT EXISTS (SELECT 1 FROM {redge} e WHERE e.jge_id = f.jge_id AND e.src_id = f.node) GROUP BY 1) f
        JOIN {jge} g ON g.id = f.jge_id LEFT JOIN (SELECT owner_id, min(duration_ms) AS duration_ms FROM {sla} WHERE owner_type = 'JOB_GROUP' GROUP BY 1) l ON l.owner_id = g.job_group_id""",
    "bwd": """ /*rec*/ SELECT jge_id, node, min(lf) AS lf FROM (
        WITH RECURSIVE w AS (SELECT f.jge_id, f.node, n.project_finish_ms AS lf, f.dur FROM {fwd} f JOIN {fin} n USING (jge_id)
                WHERE NOT EXISTS (SELECT 1 FROM {redge} e WHERE e.jge_id = f.jge_id AND e.src_id = f.node)
            UNION SELECT w.jge_id, f.node, w.lf - w.dur, f.dur FROM w JOIN {redge} e ON e.jge_id = w.jge_id AND e.dst_id = w.node
                  JOIN {fwd} f ON f.jge_id = w.jge_id AND f.node = e.src_id) SELECT * FROM w) GROUP BY 1, 2""",
    "parent": """
        SELECT e.jge_id, e.dst_id AS node, arg_min(e.src_id, row(-f.ef, e.src_id)) AS best FROM {redge} e JOIN {fwd} f ON f.jge_id = e.jge_id AND f.node = e.src_id GROUP BY 1, 2""",
    "walk": """ /*rec*/ SELECT jge_id, node, max(d) OVER (PARTITION BY jge_id) - d AS position FROM (
        WITH RECURSIVE w AS (SELECT jge_id, end_node AS node, 0 AS d FROM {fin}
            UNION ALL SELECT w.jge_id, p.best, w.d + 1 FROM w JOIN {parent} p ON p.jge_id = w.jge_id AND p.node = w.node) SELECT * FROM w)""",
    "ptext": "SELECT jge_id, string_agg(node, '->' ORDER BY position) AS path_text FROM {walk} GROUP BY 1",
    "perrun": "SELECT f.* EXCLUDE (end_node), t.path_text, sha256(t.path_text) AS signature_hash FROM {fin} f JOIN {ptext} t USING (jge_id)",
    "metric": """
        SELECT f.jge_id, f.node, f.jce_id, f.dur, f.es, f.ef, b.lf - f.dur AS ls, b.lf, b.lf - f.dur - f.es AS slack, w.node IS NOT NULL AS is_longest
        FROM {fwd} f JOIN {bwd} b USING (jge_id, node) LEFT JOIN {walk} w USING (jge_id, node)""",
})


def result(t):
    return c.critical_paths(t.jge, t.jce, t.sic, t.entry, t.sic_precedes, t.sla)


def links(t):
    return c.run_edges(c.representative_runs(t.jce), c.group_edges(t.sic_precedes, t.sic))


@query("c1_representative_run", "SELECT * FROM {rep}")
def c1(t):
    return c.representative_runs(t.jce)


@query("c2_group_duration_sla", "SELECT owner_id AS job_group_id, min(duration_ms) AS group_sla_ms FROM {sla} WHERE owner_type = 'JOB_GROUP' GROUP BY 1")
def c2(t):
    return c.group_duration_sla(t.sla)


@query("c3_entry_reachable", "SELECT * FROM {rreach}")
def c3(t):
    return c.entry_reachable(t.jge, t.entry, links(t))


@query("c4_cpm_forward", "SELECT jge_id, node, dur, es, ef FROM {fwd}")
def c4(t):
    return result(t).metrics.select("jge_id", "node", "dur", "es", "ef")


@query("c5_cpm_backward", "SELECT jge_id, node, ls, lf, slack FROM {metric}")
def c5(t):
    return result(t).metrics.select("jge_id", "node", "ls", "lf", "slack")


@query("c6_longest_path", "SELECT * FROM {walk}")
def c6(t):
    return result(t).paths


@query("c7_critical_path_signature", "SELECT jge_id, path_text, signature_hash FROM {perrun}")
def c7(t):
    return result(t).runs.select("jge_id", "path_text", "signature_hash")


@query("c8_critical_path_instances", "SELECT 'CPI_' || jce_id AS cpi_id, jge_id, jce_id, node AS sic_id, es, ef, ls, lf, slack, dur, is_longest FROM {metric} WHERE jce_id IS NOT NULL")
def c8_instances(t):
    return c.cpm_tables(result(t))["instance"]


@query("c8_critical_path_signatures", """
    SELECT 'CPS_' || job_group_id || '_' || signature_hash AS cps_id, job_group_id, signature_hash, min(path_text) AS signature_text,
           count(DISTINCT jge_id) AS occurrence_count, min(business_date) AS first_seen, max(business_date) AS last_seen FROM {perrun} GROUP BY 1, 2, 3""")
def c8_signatures(t):
    return c.cpm_tables(result(t))["signature"]


@query("c9_cpm_all_runs", "SELECT * FROM {perrun}")
def c9(t):
    return result(t).runs


@query("c10_critical_path_view", """
    SELECT e.jge_id, e.id AS jce_id, j.name AS job_name, e.status, e.duration_ms, m.slack, coalesce(m.is_longest, false) AS is_longest
    FROM {jce} e LEFT JOIN {metric} m ON m.jce_id = e.id LEFT JOIN {job} j ON j.id = e.job_id""")
def c10(t):
    return c.critical_path_view(result(t), t.jge, t.jce, t.job)


@query("c10_critical_path_summary", """
    SELECT v.jge_id, count(*) AS total_contexts, count(*) FILTER (m.is_longest) AS critical_count, any_value(p.completion_ms) AS completion_ms,
           any_value(p.total_buffer_ms) AS total_buffer_ms, any_value(p.path_text) AS path_text, any_value(p.signature_hash) AS signature_hash
    FROM {jce} v LEFT JOIN {metric} m ON m.jce_id = v.id LEFT JOIN {perrun} p ON p.jge_id = v.jge_id GROUP BY 1""")
def c10_summary(t):
    r = result(t)
    return c.critical_path_summary(r, c.critical_path_view(r, t.jge, t.jce, t.job))
