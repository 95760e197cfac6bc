"""Catalog, topology, lineage and interface-reference queries over everything registered."""

from pyspark.sql import functions as F

from batchlens.operators import catalog as c
from batchlens.operators import implements as im
from batchlens.plans.registry import SHARED, query

R_GROUP = "SELECT owner_id, 'RESOURCE' AS relation, r.id AS item_id, r.name AS item_name, r.type AS detail FROM {require_resource} q JOIN {resource} r ON r.id = q.resource_id WHERE owner_type = "
TAGS = "SELECT owner_id, 'TAG', g.id, g.name, NULL FROM {has_tag} h JOIN {tag} g ON g.id = h.tag_id WHERE owner_type = "
JOB_SLA = "SELECT s.job_id, 'SLA', l.sla_id, l.sla_name, s.name FROM {sla} l JOIN {sic} s ON l.owner_type = 'SIC' AND s.id = l.owner_id"

SHARED.update({
    "stepn": "SELECT s.*, (SELECT count(*) FROM {step_op} o WHERE o.step_id = s.id) AS db_operation_count FROM {step} s",
    "epoint": """
        SELECT DISTINCT s.job_id, s.id AS step_id, sc.class_fqn, m.fqn AS entry_fqn, c.is_test FROM {step} s JOIN {step_class} sc ON sc.step_id = s.id
        JOIN {java_class} c ON c.fqn = sc.class_fqn JOIN {java_method} m ON m.class_fqn = c.fqn""",
    "below": """ /*rec*/ SELECT root, node, min(d) AS distance, max(d) AS far FROM (
        WITH RECURSIVE b AS (SELECT DISTINCT entry_fqn AS root, entry_fqn AS node, 0 AS d FROM {epoint}
            UNION SELECT b.root, k.dst_fqn, b.d + 1 FROM b JOIN {calls} k ON k.src_fqn = b.node WHERE b.d < 4) SELECT * FROM b) GROUP BY 1, 2""",
    "vref": """
        SELECT r.class_fqn, r.ref, r.ref IN (SELECT fqn FROM {java_class}) OR (NOT contains(r.ref, '.') AND c.package || '.' || r.ref IN (SELECT fqn FROM {java_class})) AS resolved
        FROM (SELECT DISTINCT * FROM {implements_ref}) r JOIN {java_class} c ON c.fqn = r.class_fqn""",
    "vclass": """
        SELECT c.fqn, c.package, c.name, c.is_interface, count(r.ref) AS ref_count, count(*) FILTER (NOT r.resolved) AS missing_count,
               CASE WHEN count(*) FILTER (NOT r.resolved) > 0 THEN 'MISSING_REFERENCES' WHEN count(r.ref) > 0 THEN 'VALID' END AS status
        FROM {java_class} c LEFT JOIN {vref} r ON r.class_fqn = c.fqn GROUP BY 1, 2, 3, 4""",
})


@query("l1_list_job_groups", """
    SELECT g.id AS job_group_id, g.name AS job_group_name, g.enabled, g.priority, (SELECT count(*) FROM {has_job} h WHERE h.job_group_id = g.id) AS job_count, j.name AS job_name
    FROM {job_group} g LEFT JOIN {has_job} h ON h.job_group_id = g.id LEFT JOIN {job} j ON j.id = h.job_id""")
def l1(t):
    return c.list_job_groups(t.job_group, t.has_job, t.job)


@query("l2_search_jobs", "SELECT id, name, type, enabled FROM {job} WHERE name ILIKE '%load_1%'".replace("load_1", "load\\_1").replace("%'", "%' ESCAPE '\\'"))
def l2(t):
    return c.search_jobs(t.job, "load_1")


@query("l3_job_group_detail", f"""
    SELECT h.job_group_id AS owner_id, 'JOB' AS relation, j.id AS item_id, j.name AS item_name, NULL AS detail FROM {{has_job}} h JOIN {{job}} j ON j.id = h.job_id
    UNION SELECT owner_id, 'SLA', sla_id, sla_name, sla_type FROM {{sla}} WHERE owner_type = 'JOB_GROUP'
    UNION {R_GROUP} 'JOB_GROUP' UNION {TAGS} 'JOB_GROUP'
    UNION SELECT a.context_id, 'CALENDAR', a.rule_id, b.evaluator_fn, a.rule_type FROM {{calendar_rule_assoc}} a JOIN {{business_calendar}} b USING (rule_id) WHERE context_type = 'JOB_GROUP'""")
def l3(t):
    return c.job_group_detail(t)


@query("l4_job_detail", f"""
    SELECT job_id AS owner_id, 'STEP' AS relation, id AS item_id, name AS item_name, cast(db_operation_count AS varchar) AS detail FROM {{stepn}}
    UNION {JOB_SLA} UNION {R_GROUP} 'JOB' UNION {TAGS} 'JOB' UNION SELECT job_id, 'LISTENER', id, bean, scope FROM {{listener}}
    UNION SELECT id, 'REPOSITORY', git_repo, source_file, NULL FROM {{job}}""")
def l4(t):
    return c.job_detail(t)


@query("l4_job_columns", """
    SELECT j.id AS job_id, j.name, j.type, j.enabled, j.restartable, j.source_file, j.git_repo, g.name AS job_group, (SELECT count(*) FROM {step} s WHERE s.job_id = j.id) AS step_count
    FROM {job} j LEFT JOIN {has_job} h ON h.job_id = j.id LEFT JOIN {job_group} g ON g.id = h.job_group_id""")
def l4_job(t):
    return c.job_detail_frames(t).job.drop(*c.GIT_COLUMNS)


@query("l4_job_step_columns", """
    SELECT s.job_id, s.id AS step_id, s.name, s.step_kind, (SELECT min(class_fqn) FROM {step_class} x WHERE x.step_id = s.id AND role = 'tasklet') AS tasklet_class,
           (SELECT min(class_fqn) FROM {step_class} x WHERE x.step_id = s.id AND role = 'reader') AS reader_class, (SELECT min(class_fqn) FROM {step_class} x WHERE x.step_id = s.id AND role = 'processor') AS processor_class,
           (SELECT min(class_fqn) FROM {step_class} x WHERE x.step_id = s.id AND role = 'writer') AS writer_class, s.db_operation_count,
           (SELECT count(*) FROM {step_resource} q JOIN {resource} r ON r.id = q.resource_id WHERE q.step_id = s.id AND r.type = 'PROCEDURE') AS procedure_call_count,
           (SELECT count(*) FROM {step_resource} q JOIN {resource} r ON r.id = q.resource_id WHERE q.step_id = s.id AND r.type = 'SHELL_SCRIPT') AS shell_execution_count FROM {stepn} s""")
def l4_steps(t):
    return c.job_detail_frames(t).steps


@query("l4_job_sla_columns", """
    SELECT s.job_id, s.id AS sic_id, l.sla_id, l.sla_name AS name, l.sla_type AS type, l.duration_ms, l.time_ms FROM {sla} l JOIN {sic} s ON l.owner_type = 'SIC' AND s.id = l.owner_id""")
def l4_slas(t):
    return c.job_detail_frames(t).slas


@query("l5_job_steps", """
    SELECT s.job_id, s.id AS step_id, s.name AS step_name, s.step_order, s.step_kind, s.db_operation_count, k.role, k.class_fqn,
           lower(x.name) LIKE '%dao%' OR lower(x.name) LIKE '%repository%' AS is_dao_class, lower(x.name) LIKE '%shell%' AS is_shell_class
    FROM {stepn} s LEFT JOIN {step_class} k ON k.step_id = s.id LEFT JOIN {java_class} x ON x.fqn = k.class_fqn""")
def l5(t):
    return c.job_steps(t)


@query("l6_job_topology", f"""
    SELECT job_id AS owner_id, 'FLOW_NODE' AS relation, id AS item_id, name AS item_name, label AS detail FROM {{flow_node}}
    UNION SELECT job_id, 'ENTRY', node_id, NULL, NULL FROM {{job_entry}} UNION SELECT job_id, 'CONTEXT', id, name, job_group_id FROM {{sic}}
    UNION SELECT s.job_id, 'RULE_CONTEXT', a.rule_id, s.id, a.rule_type FROM {{calendar_rule_assoc}} a JOIN {{sic}} s ON a.context_type = 'SIC' AND s.id = a.context_id
    UNION SELECT s.job_id, 'RULE_GROUP', a.rule_id, s.job_group_id, a.rule_type FROM {{calendar_rule_assoc}} a JOIN {{sic}} s ON a.context_type = 'JOB_GROUP' AND s.job_group_id = a.context_id
    UNION {JOB_SLA} UNION {R_GROUP} 'JOB' UNION {TAGS} 'JOB' UNION SELECT job_id, 'LISTENER', id, bean, scope FROM {{listener}}""")
def l6(t):
    return c.job_topology(t)


@query("l7_step_call_hierarchy", """
    SELECT e.job_id, e.step_id, e.class_fqn, b.node AS method_fqn, min(b.distance) AS distance, (SELECT count(*) FROM {db_operation} d WHERE d.method_fqn = b.node) AS db_operation_count
    FROM {epoint} e JOIN {below} b ON b.root = e.entry_fqn WHERE NOT e.is_test AND b.distance <= 3 GROUP BY 1, 2, 3, 4""")
def l7(t):
    return c.step_call_hierarchy(t)


@query("l8_job_operations", """
    SELECT job_id, id AS step_id, step_kind, db_operation_count, p AS procedure_call_count, h AS shell_execution_count, q AS sql_file_count FROM (
        SELECT s.*, count(*) FILTER (r.type = 'PROCEDURE') AS p, count(*) FILTER (r.type = 'SHELL_SCRIPT') AS h, count(*) FILTER (r.type = 'SQL_SCRIPT') AS q
        FROM {stepn} s LEFT JOIN {step_resource} x ON x.step_id = s.id LEFT JOIN {resource} r ON r.id = x.resource_id GROUP BY ALL) WHERE db_operation_count + p + h + q > 0""")
def l8(t):
    return c.job_operations(t)


@query("l9_dynamic_step_resources_view", """
    WITH used AS (SELECT x.step_id, x.resource_id FROM {step_resource} x JOIN {resource} r ON r.id = x.resource_id AND r.type IN ('SHELL_SCRIPT', 'PROCEDURE', 'FUNCTION')
        UNION SELECT x.step_id, q.sql_id FROM {step_resource} x JOIN {script_sql} q ON q.script_id = x.resource_id JOIN {resource} z ON z.id = q.sql_id)
    SELECT s.job_id, s.id AS step_id, s.step_order, r.id AS resource_id, r.name AS resource_name, r.type AS resource_type
    FROM {step} s JOIN {job} j ON j.id = s.job_id AND j.type = 'dynamic_job' LEFT JOIN used u ON u.step_id = s.id LEFT JOIN {resource} r ON r.id = u.resource_id""")
def l9(t):
    return c.dynamic_step_resources_view(t)


@query("l10_job_data_footprint", """
    SELECT owner_id, 'RESOURCE_JOB' AS relation, r.id AS item_id, r.name AS item_name, r.type AS detail FROM {require_resource} q JOIN {resource} r ON r.id = q.resource_id WHERE owner_type = 'JOB'
    UNION SELECT h.job_id, 'RESOURCE_GROUP', r.id, r.name, r.type FROM {require_resource} q JOIN {resource} r ON r.id = q.resource_id JOIN {has_job} h ON q.owner_type = 'JOB_GROUP' AND h.job_group_id = q.owner_id
    UNION SELECT job_id, 'STEP', id, name, cast(db_operation_count AS varchar) FROM {stepn} WHERE db_operation_count > 0""")
def l10(t):
    return c.job_data_footprint(t)


@query("l11_resource_blast_radius", """
    SELECT r.id AS resource_id, r.name AS resource_name, r.type, count(*) FILTER (q.owner_type = 'JOB_GROUP') AS group_count, count(*) FILTER (q.owner_type = 'JOB') AS job_count,
           count(*) FILTER (q.owner_type = 'SIC') AS context_count, count(q.owner_id) AS total FROM {resource} r LEFT JOIN {require_resource} q ON q.resource_id = r.id GROUP BY 1, 2, 3""")
def l11(t):
    return c.resource_blast_radius(t.resource, t.require_resource)


@query("l11_resource_dependents", "SELECT DISTINCT resource_id, owner_type, owner_id FROM {require_resource}")
def l11_dependents(t):
    return c.resource_dependents(t.require_resource)


BELOW1 = """ below1 AS (SELECT entry_fqn AS root, node, min(d) AS distance FROM (
    WITH RECURSIVE b AS (SELECT DISTINCT e.entry_fqn, k.dst_fqn AS node, 1 AS d FROM {epoint} e JOIN {calls} k ON k.src_fqn = e.entry_fqn
        UNION SELECT b.entry_fqn, k.dst_fqn, b.d + 1 FROM b JOIN {calls} k ON k.src_fqn = b.node WHERE b.d < 4) SELECT * FROM b) GROUP BY 1, 2)"""


@query("l12_call_paths", f"WITH RECURSIVE {BELOW1} SELECT e.job_id, e.step_id, e.class_fqn, e.entry_fqn, b.node AS method_fqn, b.distance FROM {{epoint}} e JOIN below1 b ON b.root = e.entry_fqn")
def l12(t):
    return c.call_paths(t)


@query("l13_methods_with_db", """
    SELECT e.job_id, e.step_id, e.class_fqn, e.entry_fqn, b.node AS method_fqn, d.operation_type || ':' || d.table_name || ':' || d.confidence AS db_detail, d.table_name AS resource_name
    FROM {epoint} e JOIN {below} b ON b.root = e.entry_fqn JOIN {db_operation} d ON d.method_fqn = b.node WHERE NOT e.is_test AND e.entry_fqn IN (SELECT src_fqn FROM {calls})""")
def l13(t):
    return c.methods_with_db(t)


@query("l14_db_methods_without_resource", """
    WITH chain AS (SELECT e.job_id, e.step_id, e.class_fqn, e.entry_fqn, b.node FROM {epoint} e JOIN {below} b ON b.root = e.entry_fqn WHERE e.entry_fqn IN (SELECT src_fqn FROM {calls}))
    SELECT DISTINCT c.job_id, c.step_id, c.class_fqn, c.entry_fqn, 'RESOURCE' AS kind, d.table_name AS item FROM chain c JOIN {db_operation} d ON d.method_fqn = c.node AND d.table_name <> 'DYNAMIC_TABLE'
    UNION SELECT DISTINCT c.job_id, c.step_id, c.class_fqn, c.entry_fqn, 'METHOD_WITHOUT_RESOURCE', c.node FROM chain c
    JOIN (SELECT method_fqn FROM {db_operation} GROUP BY 1 HAVING count(*) FILTER (table_name <> 'DYNAMIC_TABLE') = 0) x ON x.method_fqn = c.node""")
def l14(t):
    known = t.db_operation.where(F.col("table_name") != "DYNAMIC_TABLE").select("table_name")
    return c.db_methods_without_resource(t, known)


def validated(t):
    return im.validate_implements(t.java_class, t.implements_ref)


@query("v1_missing_implements", "SELECT class_fqn, package, name, ref FROM {vref} JOIN {vclass} ON fqn = class_fqn WHERE NOT resolved")
def v1(t):
    return im.missing_implements(validated(t))


@query("v1_missing_by_reference", "SELECT ref, count(*) AS occurrences FROM {vref} WHERE NOT resolved GROUP BY 1")
def v1_by(t):
    return im.missing_by_reference(validated(t))


@query("v1_missing_one_interface", "SELECT class_fqn, package, name, ref FROM {vref} JOIN {vclass} ON fqn = class_fqn WHERE NOT resolved AND ref = 'Missing5'")
def v1_one(t):
    return im.missing_implements(validated(t), "Missing5")


@query("v2_valid_implements", "SELECT fqn, ref_count FROM {vclass} WHERE status = 'VALID' ORDER BY ref_count DESC, fqn LIMIT 50")
def v2(t):
    return im.valid_implements(validated(t))


@query("v3_suspicious_empty_implements", "SELECT fqn, name FROM {vclass} WHERE NOT is_interface AND ref_count = 0 AND (name LIKE '%Impl' OR name LIKE '%Implementation' OR name LIKE '%Default%')")
def v3(t):
    return im.suspicious_empty_implements(validated(t))


@query("v4_implements_status_summary", "SELECT status, count(*) AS class_count, array_to_string(list_sort(list(fqn))[1:5], ',') AS sample_classes FROM {vclass} GROUP BY 1")
def v4(t):
    return im.implements_status_summary(validated(t))


@query("v5_interfaces_without_implementation", "SELECT fqn, package FROM {vclass} WHERE is_interface AND fqn NOT IN (SELECT ref FROM {vref} WHERE class_fqn IN (SELECT fqn FROM {vclass} WHERE status = 'VALID'))")
def v5(t):
    return im.interfaces_without_implementation(validated(t))


@query("v6_abstract_targets_in_implements", """
    SELECT x.fqn, x.name, count(*) AS referenced_by_count FROM {vref} r JOIN {vclass} x ON x.fqn = r.ref AND NOT x.is_interface JOIN {vclass} s ON s.fqn = r.class_fqn AND s.status = 'VALID' GROUP BY 1, 2""")
def v6(t):
    full = t.implements_ref.join(t.java_class.select(F.col("fqn").alias("class_fqn"), "package"), "class_fqn")
    return im.abstract_targets_in_implements(validated(t))


@query("v7_implements_detail", "SELECT c.fqn, c.is_interface, c.status, r.ref, r.resolved FROM {vclass} c LEFT JOIN {vref} r ON r.class_fqn = c.fqn")
def v7(t):
    return im.implements_detail(validated(t))


@query("v8_packages_by_missing_pct", """
    SELECT package, count(*) AS total_classes, count(*) FILTER (status = 'MISSING_REFERENCES') AS missing_count,
           round(100.0::double * count(*) FILTER (status = 'MISSING_REFERENCES') / count(*), 2) AS missing_percentage
    FROM {vclass} GROUP BY 1 HAVING count(*) > 5 ORDER BY missing_percentage DESC, missing_count DESC, package LIMIT 20""")
def v8(t):
    return im.packages_by_missing_pct(validated(t))
