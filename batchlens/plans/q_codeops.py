"""Code-operation queries over the text and calls of all methods."""

from pyspark.sql import functions as F

from batchlens.operators import codeops as o
from batchlens.operators import codescan as c
from batchlens.operators import implements as im
from batchlens.plans.registry import SHARED, query

GREY = ("(CASE kind WHEN 'DB' THEN regexp_matches(upper(split_part(op, ':', 2)), 'UNKNOWN|DYNAMIC|PARAMETERIZED') WHEN 'PROC' THEN regexp_matches(upper(split_part(op, ':', 3)), 'UNKNOWN|DYNAMIC|PARAMETERIZED') "
        "WHEN 'SHELL' THEN regexp_matches(upper(split_part(op, ':', 2)), 'UNKNOWN|DYNAMIC|PARAMETERIZED|REMOTE_EXECUTION|VARIABLE|PLACEHOLDER|ERROR|EXCEPTION|UNABLE|FAILED|MISSING|NOT FOUND|INVALID|UNDEFINED|NULL|EMPTY') "
        "ELSE regexp_matches(upper(op), 'UNKNOWN|DYNAMIC|PARAMETERIZED') END)")

SHARED.update({
    "o_query": """
        SELECT fqn AS method_fqn, CASE kind WHEN 0 THEN 'SELECT a, b FROM s' || (method_key % 3) || '.tab' || (method_key % 40) || ' t1, other' || (method_key % 5) || ' o JOIN x.y.deep' || (method_key % 4) || ' d ON d.k = o.k WHERE t1.x = 1'
               WHEN 1 THEN 'DYNAMIC_SQL' ELSE 'SELECT x FROM const_tab' || (method_key % 10) || ' WHERE y = 1' END AS query FROM {method_source} WHERE kind IN (0, 1, 7)""",
    "o_shell": """
        SELECT fqn AS method_fqn, 'Runtime.exec' AS execution_method, '/opt/run' || (method_key % 20) || '.sh' AS script_name, 'HIGH' AS confidence, 'BASH' AS script_type, false AS further_analysis, 0 AS pos, NULL AS grey_area_reason FROM {method_source} WHERE kind = 4
        UNION ALL SELECT fqn, 'ProcessBuilder', 'DYNAMIC_PATH', 'LOW', 'SHELL', true, 0, 'DYNAMIC_PATH:String concatenation or formatting detected' FROM {method_source} WHERE kind = 5
        UNION ALL SELECT fqn, 'CommonsExec', 'PARAMETERIZED', 'LOW', 'SHELL', true, 0, 'PARAMETERIZED:Script path passed as parameter' FROM {method_source} WHERE kind = 6
        UNION ALL SELECT fqn, 'ProcessBuilder', 'deploy.py', 'HIGH', 'PYTHON', false, 0, NULL FROM {method_source} WHERE kind = 6""",
    "o_proc": """
        SELECT fqn AS method_fqn, CASE kind WHEN 3 THEN 'CallableStatement' ELSE 'SimpleJdbcCall' END AS call_type, CASE kind WHEN 2 THEN 'S1' WHEN 3 THEN 'sch' END AS schema_name, NULL AS catalog_name,
               CASE kind WHEN 3 THEN 'pkg' END AS package_name, CASE kind WHEN 2 THEN 'P' || (method_key % 30) WHEN 3 THEN 'proc' || (method_key % 30) ELSE 'DYNAMIC_PROCEDURE' END AS procedure_name, false AS is_function,
               CASE kind WHEN 2 THEN 'ORACLE' ELSE 'UNKNOWN' END AS database_type, CASE kind WHEN 2 THEN '.setString(' ELSE '' END AS parameters FROM {method_source} WHERE kind IN (2, 3, 5)""",
    "o_anc": """ /*rec*/ SELECT class_fqn, ancestor_fqn, min(depth) AS depth FROM (
        WITH RECURSIVE a AS (SELECT fqn AS class_fqn, fqn AS ancestor_fqn, 0 AS depth FROM {java_class}
            UNION SELECT a.class_fqn, e.parent_fqn, a.depth + 1 FROM a JOIN {extends} e ON e.child_fqn = a.ancestor_fqn WHERE a.depth < 10) SELECT * FROM a) GROUP BY 1, 2""",
    "o_entry": """
        SELECT step_id, method_fqn, depth FROM (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY depth, method_fqn) AS rn FROM (
            SELECT s.step_id, m.fqn AS method_fqn, min(a.depth) AS depth FROM {step_class} s JOIN {o_anc} a ON a.class_fqn = s.class_fqn
            JOIN {java_method} m ON m.class_fqn = a.ancestor_fqn AND ((s.step_kind = 'TASKLET' AND m.name = 'execute') OR (s.step_kind = 'CHUNK' AND m.name IN ('read', 'process', 'write'))) GROUP BY 1, 2))""",
    "o_walk": """ /*rec*/ SELECT step_id, node, min(d) AS distance FROM (
        WITH RECURSIVE b AS (SELECT step_id, method_fqn AS node, 0 AS d FROM {o_entry} UNION SELECT b.step_id, k.dst_fqn, b.d + 1 FROM b JOIN {calls} k ON k.src_fqn = b.node WHERE b.d < 20) SELECT * FROM b) GROUP BY 1, 2""",
    "o_own": """ /*rec*/ SELECT DISTINCT step_id, node FROM (
        WITH RECURSIVE b AS (SELECT s.step_id, m.fqn AS node, 0 AS d FROM {step_class} s JOIN {java_method} m ON m.class_fqn = s.class_fqn
            UNION SELECT b.step_id, k.dst_fqn, b.d + 1 FROM b JOIN {calls} k ON k.src_fqn = b.node WHERE b.d < 20) SELECT * FROM b)""",
    "o_gapwalk": """ /*rec*/ SELECT DISTINCT step_id, node FROM (
        WITH RECURSIVE b AS (SELECT s.step_id, m.fqn AS node, 0 AS d FROM {step_class} s JOIN {java_method} m ON m.class_fqn = s.class_fqn AND m.name IN ('execute', 'read', 'process', 'write')
            UNION SELECT b.step_id, k.dst_fqn, b.d + 1 FROM b JOIN {calls} k ON k.src_fqn = b.node WHERE b.d < 20) SELECT * FROM b)""",
    "o_reg": """
        SELECT i.fqn AS interface_fqn, count(DISTINCT c.fqn) AS impl_count, min(c.fqn) AS first_impl, CASE count(DISTINCT c.fqn) WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'multiple' END AS bucket
        FROM {java_class} i LEFT JOIN {implements_ref} r ON r.ref = i.fqn LEFT JOIN {java_class} c ON c.fqn = r.class_fqn AND NOT c.is_interface WHERE i.is_interface GROUP BY 1""",
    "o_inh": """
        SELECT class_fqn, name, arg_min(ancestor_fqn, row(depth, ancestor_fqn)) AS ancestor_fqn, min(depth) AS depth, arg_min(method_fqn, row(depth, ancestor_fqn)) AS method_fqn FROM (
            SELECT a.class_fqn, m.name, a.ancestor_fqn, a.depth, min(m.fqn) AS method_fqn FROM {o_anc} a JOIN {java_method} m ON m.class_fqn = a.ancestor_fqn GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""",
    "o_raw": """
        SELECT r.*, coalesce(g.first_impl, d) AS chosen, g.bucket FROM (SELECT r.*, coalesce(i.bean_class, v.rc, r.target_class) AS d FROM {raw_call} r
            LEFT JOIN {injected} i ON i.class_fqn = r.class_fqn AND i.field = r.field
            LEFT JOIN (SELECT class_fqn, name, arg_min(return_class, fqn) AS rc FROM {method_return} GROUP BY 1, 2) v ON v.class_fqn = r.via_class AND v.name = r.via_name) r
        LEFT JOIN {o_reg} g ON g.interface_fqn = r.d""",
    "o_res": "SELECT r.*, x.method_fqn AS dst_fqn, x.ancestor_fqn AS dst_class FROM {o_raw} r LEFT JOIN {o_inh} x ON x.class_fqn = r.chosen AND x.name = r.name",
    "o_touched": "SELECT DISTINCT b.step_id, m.kind FROM {manual_mapping} m JOIN {step_bean} b ON b.bean_id = m.bean_id",
})


def sourced(t):
    return t.method_source


def entries(t):
    return o.entry_methods(t.step_class, t.java_method, t.extends)


def registry(t):
    return o.interface_registry(t.java_class, t.extends, t.implements_ref)


def manual(t):
    return o.apply_manual(t.method_op, t.stored_step_op, t.manual_mapping, t.step_bean)


@query("o1_classify_dao", """
    SELECT c.fqn, NOT c.is_interface AND (lower(c.name) LIKE '%dao%' OR lower(c.name) LIKE '%repository%' OR (c.class_key % 2 = 0 AND EXISTS (SELECT 1 FROM {java_method} m WHERE m.class_fqn = c.fqn AND m.name IN ('find', 'save')))) AS is_dao
    FROM {java_class} c""")
def o1(t):
    return c.classify_dao(t.java_class, t.class_import, t.java_method)


@query("o2_detect_operation", """
    SELECT fqn AS method_fqn, CASE WHEN name = 'find' THEN 'SELECT' WHEN name = 'save' THEN 'INSERT' WHEN kind = 1 THEN 'INSERT' ELSE 'SELECT' END AS operation_type FROM {method_source} WHERE kind IN (0, 1, 7)""")
def o2(t):
    return c.detect_operation(sourced(t))


@query("o3_extract_query", "SELECT * FROM {o_query}")
def o3(t):
    return c.extract_query(sourced(t), t.sql_constant)


@query("o4_tables_in_sql", """
    SELECT fqn AS method_fqn, 'tab' || (method_key % 40) AS table_name, 's' || (method_key % 3) AS schema_name FROM {method_source} WHERE kind = 0
    UNION ALL SELECT fqn, 'other' || (method_key % 5), NULL FROM {method_source} WHERE kind = 0 UNION ALL SELECT fqn, 'deep' || (method_key % 4), 'y' FROM {method_source} WHERE kind = 0
    UNION ALL SELECT fqn, 'DYNAMIC_TABLE', NULL FROM {method_source} WHERE kind = 1 UNION ALL SELECT fqn, 'const_tab' || (method_key % 10), NULL FROM {method_source} WHERE kind = 7""")
def o4(t):
    return c.tables_in_sql(c.extract_query(sourced(t), t.sql_constant))


@query("o5_infer_table", """
    SELECT fqn AS method_fqn, CASE WHEN method_key % 6 = 1 THEN 'com.acme._order_item' WHEN kind = 0 THEN 's' || (method_key % 3) WHEN method_key % 6 IN (0, 2, 4) THEN 'UNKNOWN' WHEN method_key % 6 = 3 THEN 'trade_leg' ELSE 'cust_row' END AS table_name
    FROM {method_source}""")
def o5(t):
    return c.infer_table(sourced(t))


@query("o6_method_db_operations", """
    SELECT method_fqn, operation_type, table_name, confidence FROM {db_operation} d JOIN {method_source} s ON s.fqn = d.method_fqn WHERE s.kind NOT IN (0, 1, 7)
    UNION SELECT fqn, CASE WHEN name = 'find' THEN 'SELECT' WHEN name = 'save' THEN 'INSERT' ELSE 'SELECT' END, x.t, 'MEDIUM' FROM {method_source},
          LATERAL (SELECT 'TAB' || (method_key % 40) AS t WHERE kind = 0 UNION ALL SELECT 'OTHER' || (method_key % 5) WHERE kind = 0 UNION ALL SELECT 'DEEP' || (method_key % 4) WHERE kind = 0 UNION ALL SELECT 'CONST_TAB' || (method_key % 10) WHERE kind = 7) x""")
def o6(t):
    found = c.tables_in_sql(c.extract_query(sourced(t), t.sql_constant)).join(c.detect_operation(sourced(t)), "method_fqn").withColumn("confidence", F.lit("medium"))
    return o.method_db_operations(t.db_operation, found).operations


@query("o6_review_flags", "SELECT fqn AS method_fqn, kind = 1 AS further_analysis FROM {method_source} WHERE kind IN (0, 1, 7)")
def o6_flags(t):
    found = c.tables_in_sql(c.extract_query(sourced(t), t.sql_constant)).join(c.detect_operation(sourced(t)), "method_fqn").withColumn("confidence", F.lit("medium"))
    return o.method_db_operations(t.db_operation, found).flags


@query("o7_detect_procedure_calls", "SELECT * FROM {o_proc}")
def o7(t):
    return c.detect_procedure_calls(sourced(t)).withColumn("parameters", F.array_join("parameters", ","))


@query("o8_method_procedures", """
    SELECT method_fqn, coalesce(schema_name, 'UNKNOWN') || ':' || coalesce(package_name, 'NONE') || ':' || procedure_name || ':' || database_type || ':PROCEDURE:HIGH' AS op,
           procedure_name LIKE '%DYNAMIC%' AS further_analysis, procedure_name NOT LIKE '%DYNAMIC%' AS links FROM {o_proc}""")
def o8(t):
    return o.method_procedures(c.detect_procedure_calls(sourced(t)).withColumn("confidence", F.lit("HIGH")))


@query("o9_classify_shell_executor", """
    SELECT c.fqn, c.class_key % 5 = 0 AND EXISTS (SELECT 1 FROM {method_source} m WHERE m.class_fqn = c.fqn AND m.kind IN (4, 5, 6)) AS is_shell_executor FROM {java_class} c""")
def o9(t):
    return c.classify_shell_executor(t.java_class, t.class_import, sourced(t))


@query("o10_detect_shell", "SELECT * FROM {o_shell}")
def o10(t):
    return c.detect_shell(sourced(t))


@query("o10_detect_shell_by_rules", r"""
    WITH texts AS (SELECT fqn AS method_fqn, source || CASE WHEN kind = 4 THEN ' run(new String[]{"-x", "in ' || method_key || '.csv" , name});' ELSE '' END AS s FROM {method_source}),
    picked AS (SELECT *, list_filter(regexp_extract_all(s, '[\x22\x27]([^\x22\x27]+)[\x22\x27]', 1), lambda x: length(x) > 2 AND x[1] NOT IN ('-', '/'))[1] AS script_name,
               regexp_extract(s, 'new\s+String\[\]\s*\{([^}]+)\}', 1) AS given FROM texts),
    typed AS (SELECT *, lower(coalesce(script_name, s)) AS low FROM picked)
    SELECT method_fqn, CASE WHEN regexp_matches(s, '(Runtime\.getRuntime\(\)|RUNTIME|runtime|rt)\s*\.\s*exec\s*\(') THEN 'Runtime.exec' WHEN regexp_matches(s, 'new\s+ProcessBuilder\s*\(') THEN 'ProcessBuilder' ELSE 'CommonsExec' END AS execution_method,
           script_name, CASE WHEN regexp_matches(low, '\.sh|bash') THEN 'BASH' WHEN regexp_matches(low, '\.py|python') THEN 'PYTHON' WHEN regexp_matches(low, '\.ps1|powershell') THEN 'POWERSHELL'
           WHEN regexp_matches(low, '\.bat|cmd') THEN 'BATCH' WHEN regexp_matches(low, '\.pl|perl') THEN 'PERL' ELSE 'SHELL' END AS script_type,
           CASE WHEN given = '' THEN '' ELSE array_to_string(list_transform(string_split(given, ','), lambda x: trim(trim(x), chr(34) || chr(39))), '|') END AS arguments
    FROM typed WHERE regexp_matches(s, '\.\s*exec\s*\(|new\s+ProcessBuilder\s*\(|executor\.execute\s*\(|CommandLine\.parse\s*\(')""")
def o10_rules(t):
    more = F.concat(F.lit(' run(new String[]{"-x", "in '), "method_key", F.lit('.csv" , name});'))
    texts = sourced(t).withColumn("source", F.concat("source", F.when(F.col("kind") == 4, more).otherwise("")))
    return c.detect_shell_by_rules(texts).withColumn("arguments", F.array_join("arguments", "|"))


@query("o11_grey_scripts", """
    SELECT s.method_fqn, s.script_name, CASE WHEN s.script_name IN ('DYNAMIC_PATH', 'PARAMETERIZED') THEN true ELSE false END AS is_grey FROM {o_shell} s""")
def o11(t):
    j = c.detect_shell(sourced(t)).join(sourced(t).select(F.col("fqn").alias("method_fqn"), "source"), "method_fqn")
    return j.select("method_fqn", "script_name", c.is_grey_script(F.col("script_name"), F.col("source")).alias("is_grey"))


@query("o12_method_shell", """
    SELECT method_fqn, execution_method || ':' || script_name || ':' || confidence AS op, grey_area_reason, NOT further_analysis AS links,
           count(*) OVER (PARTITION BY method_fqn) AS execution_count, bool_or(further_analysis) OVER (PARTITION BY method_fqn) AS needs_review FROM {o_shell}""")
def o12(t):
    return o.method_shell(c.detect_shell(sourced(t)))


@query("o13_entry_methods", "SELECT * FROM {o_entry}")
def o13(t):
    return entries(t)


@query("o14_consolidate_step_ops", "SELECT DISTINCT w.step_id, m.kind, m.op FROM {o_walk} w JOIN {method_op} m ON m.method_fqn = w.node")
def o14(t):
    return o.consolidate_step_ops(entries(t), t.calls, t.method_op)


@query("o14_step_op_counts", """
    SELECT s.id AS step_id, k.kind, count(DISTINCT m.op) AS op_count FROM {step} s, (VALUES ('DB'), ('PROC'), ('SHELL'), ('SQL')) k(kind)
    LEFT JOIN {o_walk} w ON w.step_id = s.id LEFT JOIN {method_op} m ON m.method_fqn = w.node AND m.kind = k.kind GROUP BY 1, 2""")
def o14_counts(t):
    return o.step_op_counts(t.step, o.consolidate_step_ops(entries(t), t.calls, t.method_op))


@query("o15_consolidate_all_steps", f"""
    SELECT step_id, kind, op FROM {{stored_step_op}} WHERE NOT {GREY}
    UNION SELECT w.step_id, m.kind, m.op FROM {{o_walk}} w JOIN {{method_op}} m ON m.method_fqn = w.node WHERE NOT EXISTS (
        SELECT 1 FROM {{manual_mapping}} x JOIN {{step_bean}} b ON b.bean_id = x.bean_id WHERE x.method_fqn = w.node AND b.step_id = w.step_id)""")
def o15(t):
    level = t.manual_mapping.where("bean_id IS NOT NULL").select("method_fqn", "bean_id")
    return o.consolidate_all_steps(t.stored_step_op, entries(t), t.calls, t.method_op, level, t.step_bean)


@query("o16_resolve_method", """
    WITH asked AS (SELECT DISTINCT CASE WHEN method_key % 3 = 0 THEN fqn WHEN method_key % 3 = 1 THEN class_fqn || '.' || name ELSE class_fqn || '.nothing' END AS ref FROM {java_method})
    SELECT a.ref, coalesce(e.fqn, g.f) AS method_fqn, e.fqn IS NULL AND coalesce(g.n, 0) > 1 AS ambiguous FROM asked a LEFT JOIN {java_method} e ON e.fqn = a.ref
    LEFT JOIN (SELECT class_fqn || '.' || name AS ref, min(fqn) AS f, count(*) AS n FROM {java_method} GROUP BY 1) g ON g.ref = a.ref""")
def o16(t):
    k = F.col("method_key") % 3
    ref = F.when(k == 0, F.col("fqn")).when(k == 1, F.concat_ws(".", "class_fqn", "name")).otherwise(F.concat("class_fqn", F.lit(".nothing")))
    return o.resolve_method(t.java_method.select(ref.alias("ref")), t.java_method)


@query("o17_apply_manual_methods", f"""
    SELECT m.method_fqn, m.kind, m.op FROM {{method_op}} m LEFT JOIN (SELECT method_fqn, kind, bool_or(bean_id IS NOT NULL) AS g, bool_or(bean_id IS NULL) AS d FROM {{manual_mapping}} GROUP BY 1, 2) x
        ON x.method_fqn = m.method_fqn AND x.kind = m.kind
    WHERE NOT coalesce(x.g, false) AND NOT (coalesce(x.d, false) AND CASE m.kind WHEN 'SHELL' THEN m.op NOT LIKE 'RESOLVED%' WHEN 'PROC' THEN {GREY.replace('CASE kind', 'CASE m.kind')} ELSE false END)
    UNION SELECT method_fqn, kind, op FROM {{manual_mapping}} WHERE bean_id IS NULL AND kind <> 'DB'""".replace("(op,", "(m.op,").replace("upper(op)", "upper(m.op)"))
def o17(t):
    return manual(t).method_op


@query("o17_apply_manual_steps", f"""
    SELECT step_id, kind, op FROM {{stored_step_op}} s WHERE NOT ({GREY} AND EXISTS (SELECT 1 FROM {{o_touched}} x WHERE x.step_id = s.step_id AND x.kind = s.kind))
    UNION SELECT b.step_id, m.kind, m.op FROM {{manual_mapping}} m JOIN {{step_bean}} b ON b.bean_id = m.bean_id""")
def o17_steps(t):
    return manual(t).step_op


@query("o18_dismiss", f"""
    SELECT method_fqn, kind, op FROM {{method_op}} m WHERE NOT (EXISTS (SELECT 1 FROM {{manual_mapping}} x WHERE x.method_fqn = m.method_fqn AND x.kind = m.kind)
        AND CASE kind WHEN 'PROC' THEN {GREY} WHEN 'SHELL' THEN {GREY} AND op NOT LIKE 'RESOLVED%' ELSE false END)""")
def o18(t):
    return o.dismiss(t.method_op, t.manual_mapping)


@query("o19_rebuild_method_ops", """
    SELECT m.fqn AS method_fqn, d.operation_type || ':' || d.table_name || ':' || d.confidence AS op, count(d.method_fqn) OVER (PARTITION BY m.fqn) AS op_count
    FROM {java_method} m LEFT JOIN {db_operation} d ON d.method_fqn = m.fqn""")
def o19(t):
    return o.rebuild_method_ops(t.java_method, t.db_operation)


@query("o20_step_resource_links", """
    WITH x AS (SELECT step_id, kind, regexp_replace(op, '^RESOLVED:', '') AS op FROM {stored_step_op} WHERE NOT regexp_matches(op, 'UNKNOWN|DYNAMIC|PARAMETERIZED'))
    SELECT DISTINCT step_id, 'DB_OPERATION' AS edge, 'TABLE' AS resource_type, split_part(op, ':', 2) AS resource_name, CASE split_part(op, ':', 1) WHEN 'SELECT' THEN 'READ' ELSE 'INSERT' END AS operation, split_part(op, ':', 3) AS confidence FROM x WHERE kind = 'DB'
    UNION SELECT step_id, 'INVOKES', split_part(op, ':', 5), split_part(op, ':', 3), split_part(op, ':', 1), split_part(op, ':', 6) FROM x WHERE kind = 'PROC'
    UNION SELECT step_id, 'EXECUTES', 'SHELL_SCRIPT', CASE WHEN op LIKE 'RUNTIME%' THEN split_part(op, ':', 2) ELSE split_part(op, ':', 1) END, NULL, 'HIGH' FROM x WHERE kind = 'SHELL'
    UNION SELECT step_id, 'INVOKES', 'SQL_SCRIPT', split_part(op, ':', 1), NULL, 'HIGH' FROM x WHERE kind = 'SQL'""")
def o20(t):
    return o.step_resource_links(t.stored_step_op)


@query("o21_step_links_by_methods", "SELECT w.step_id, m.kind, m.op, min(m.method_fqn) AS method_fqn FROM {o_own} w JOIN {method_op} m ON m.method_fqn = w.node GROUP BY 1, 2, 3")
def o21(t):
    return o.step_links_by_methods(t.step_class, t.java_method, t.calls, t.method_op)


@query("o22_job_list", "SELECT id, name, type FROM {job} WHERE type = 'spring_xml_config_job'")
def o22(t):
    return o.job_list(t.job, ["spring_xml_config_job"])


@query("o22_repositories", "SELECT git_repo AS repository, count(*) AS job_count FROM {job} GROUP BY 1")
def o22_repositories(t):
    return o.repositories(t.job)


@query("o22_method_source", "SELECT fqn, class_fqn, source FROM {method_source}")
def o22_source(t):
    return o.method_source(sourced(t))


@query("o23_step_gap_counts", f"""
    SELECT s.job_id, s.id AS step_id, s.step_kind, (SELECT count(*) FROM {{stored_step_op}} x WHERE x.step_id = s.id AND kind <> 'SQL' AND {GREY}) AS gap_count FROM {{step}} s""")
def o23(t):
    return o.step_gap_counts(t.step, t.stored_step_op)


@query("o24_step_gaps", f"""
    SELECT w.step_id, lower(kind) AS category, op, m.method_fqn, j.further_analysis FROM {{o_gapwalk}} w JOIN {{method_op}} m ON m.method_fqn = w.node AND kind <> 'SQL' AND {GREY} JOIN {{java_method}} j ON j.fqn = m.method_fqn""")
def o24(t):
    return o.step_gaps(t.step_class, t.java_method, t.calls, t.method_op)


@query("o25_trace_unknown", f"SELECT w.step_id, w.node AS method_fqn, w.distance FROM {{o_walk}} w WHERE w.node IN (SELECT method_fqn FROM {{method_op}} WHERE {GREY})")
def o25(t):
    return o.trace_unknown(entries(t), t.calls, t.method_op).methods


@query("o25_trace_paths", f"""
    WITH RECURSIVE p AS (
        SELECT step_id, node AS method_fqn, distance AS position, node AS on_path FROM {{o_walk}} WHERE node IN (SELECT method_fqn FROM {{method_op}} WHERE {GREY})
        UNION ALL SELECT p.step_id, p.method_fqn, p.position - 1, (SELECT min(k.src_fqn) FROM {{calls}} k JOIN {{o_walk}} w ON w.step_id = p.step_id AND w.node = k.src_fqn AND w.distance = p.position - 1 WHERE k.dst_fqn = p.on_path)
        FROM p WHERE p.position > 0)
    SELECT step_id, method_fqn, position, on_path FROM p""")
def o25_paths(t):
    return o.trace_unknown(entries(t), t.calls, t.method_op).path


@query("o26_validate_implements", "SELECT fqn, package, name, is_interface, ref_count, missing_count, status FROM {vclass}")
def o26(t):
    return im.validate_implements(t.java_class, t.implements_ref).classes


@query("o27_extends_edges", "SELECT child_fqn, parent_fqn FROM {extends}")
def o27(t):
    return registry(t).extends


@query("o27_interface_registry", "SELECT * FROM {o_reg}")
def o27_registry(t):
    return registry(t).summary


@query("o28_inherited_method", "SELECT * FROM {o_inh}")
def o28(t):
    asked = t.java_class.select(F.col("fqn").alias("class_fqn"), F.explode(F.array(*(F.lit(n) for n in ("execute", "read", "process", "write", "find", "save")))).alias("name"))
    return o.inherited_method(asked, t.java_method, t.extends)


@query("o29_bean_lookup", "SELECT * FROM {bean} WHERE bean_id = 'bean_12'")
def o29(t):
    return o.bean_lookup(t.bean, bean_id="bean_12")


@query("o29_bean_stats", "SELECT count(*) AS total, count(*) FILTER (bean_class LIKE '%Dao') AS processed, count(*) FILTER (bean_class NOT LIKE '%Dao') AS pending FROM {bean}")
def o29_stats(t):
    return o.bean_stats(t.bean.withColumn("processed", F.col("bean_class").endswith("Dao")))


@query("o30_code_line_count", "SELECT fqn, 3 AS code_lines, class_fqn || '.' || name || '(List,Map)' AS method_key FROM {method_source}")
def o30(t):
    key = c.erased_key(F.concat("class_fqn", F.lit("."), "name", F.lit("(List<Map<String, X>>, Map<A, B>)")))
    return sourced(t).select("fqn", c.code_line_count(F.col("source")).alias("code_lines"), key.alias("method_key"))


@query("o31_step_bean_edges", """
    SELECT DISTINCT r.step_id, x.role, x.b || '___' || x.c AS composite_key FROM {role_bean} r, LATERAL (SELECT 'tasklet' AS role, tasklet_bean AS b, tasklet_class AS c UNION ALL SELECT 'reader', reader_bean, reader_class) x
    JOIN {bean} z ON z.bean_id = x.b AND z.bean_class = x.c""")
def o31(t):
    beans = t.bean.select(F.concat_ws("___", "bean_id", "bean_class").alias("composite_key"))
    return o.step_bean_edges(t.role_bean, beans, t.java_class).uses


@query("o31_implemented_by", """
    SELECT DISTINCT r.step_id, c.fqn AS class_fqn FROM {role_bean} r JOIN {java_class} c ON c.fqn IN (r.tasklet_class, r.reader_class, r.processor_class, r.writer_class)""")
def o31_implemented_by(t):
    beans = t.bean.select(F.concat_ws("___", "bean_id", "bean_class").alias("composite_key"))
    return o.step_bean_edges(t.role_bean, beans, t.java_class).implemented_by


@query("o31_unmatched_beans", """
    SELECT DISTINCT r.step_id, x.role, x.b || '___' || x.c AS composite_key FROM {role_bean} r, LATERAL (SELECT 'tasklet' AS role, tasklet_bean AS b, tasklet_class AS c UNION ALL SELECT 'reader', reader_bean, reader_class
        UNION ALL SELECT 'processor', processor_bean, processor_class) x WHERE x.b IS NOT NULL AND x.b || '___' || x.c NOT IN (SELECT bean_id || '___' || bean_class FROM {bean})""")
def o31_unmatched(t):
    beans = t.bean.select(F.concat_ws("___", "bean_id", "bean_class").alias("composite_key"))
    return o.step_bean_edges(t.role_bean, beans, t.java_class).unmatched


def resolved(t):
    return o.resolve_call_edges(t.raw_call, t.injected, t.java_class, t.method_return, t.extends, registry(t))


@query("o32_resolve_call_edges", """
    SELECT DISTINCT src_fqn, dst_fqn, bucket IS NOT NULL AND bucket <> 'single' AS requires_review, CASE bucket WHEN 'none' THEN 'no_implementation' WHEN 'multiple' THEN 'multiple_implementations' END AS review_reason,
           bucket IS NOT NULL AND bucket <> 'none' AS resolved_from_interface FROM {o_res} WHERE dst_fqn IS NOT NULL""")
def o32(t):
    return resolved(t).calls


@query("o32_uses_class", "SELECT DISTINCT class_fqn, coalesce(dst_class, chosen) AS target FROM {o_res} WHERE class_fqn <> coalesce(dst_class, chosen)")
def o32_uses(t):
    return resolved(t).uses_class
