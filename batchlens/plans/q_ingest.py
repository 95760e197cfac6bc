"""Loading queries: sheets, run records and repository files to typed tables."""

import uuid

from pyspark.sql import functions as F

from batchlens.functions import clock as ck
from batchlens.plans.q_calendar import days
from batchlens.plans.registry import SHARED, query
from batchlens.session import work_dir
from batchlens.sources import code as co
from batchlens.sources import definitions as d
from batchlens.sources import dynamic as dy
from batchlens.sources import runs as r
from batchlens.sources import upsert as up
from batchlens.sources.tree import write_tree

SHARED.update({
    "loaded_jobs": "SELECT id, name, coalesce(nullif(trim(type), ''), 'spring_xml_config_job') AS type, coalesce(enabled, true) AS enabled FROM {sheet_job} WHERE id IS NOT NULL AND name IS NOT NULL",
    "run_group": """
        SELECT *, CASE WHEN start_ts IS NULL THEN 'unreadable start' WHEN g IS NOT NULL THEN NULL WHEN n = 0 THEN 'no group' ELSE 'several groups' END AS reason FROM (
            SELECT e.*, CASE WHEN e.jobGroupId IS NOT NULL THEN 1 WHEN e.jobContextId IS NOT NULL THEN (SELECT count(DISTINCT job_group_id) FROM {sic} s WHERE s.id = e.jobContextId)
                        ELSE coalesce(hj.n, 0) END AS n,
                   CASE WHEN e.jobGroupId IS NOT NULL THEN e.jobGroupId WHEN e.jobContextId IS NOT NULL THEN (SELECT min(job_group_id) FROM {sic} s WHERE s.id = e.jobContextId)
                        WHEN hj.n = 1 THEN hj.g END AS g
            FROM (SELECT *, try_cast(startTime AS timestamp) AS start_ts, try_cast(endTime AS timestamp) AS end_ts FROM {sheet_run}) e
            LEFT JOIN (SELECT j.name, count(DISTINCT h.job_group_id) AS n, min(h.job_group_id) AS g FROM {has_job_one} h JOIN {job} j ON j.id = h.job_id GROUP BY 1) hj ON hj.name = e.jobName)""",
    "run_dated": "SELECT *, CASE WHEN hour(start_ts) >= 18 THEN cast(start_ts AS date) + 1 ELSE cast(start_ts AS date) END AS business_date FROM {run_group}",
    "run_sic": """
        SELECT x.*, coalesce(jobContextId, CASE WHEN m = 1 THEN f END) AS sic_id, coalesce(reason, CASE WHEN jobContextId IS NOT NULL OR m = 1 THEN NULL WHEN coalesce(m, 0) = 0 THEN 'no context' ELSE 'several contexts' END) AS why
        FROM {run_dated} x LEFT JOIN (SELECT s.job_group_id AS gg, j.name AS jn, count(*) AS m, min(s.id) AS f FROM {sic} s JOIN {job} j ON j.id = s.job_id GROUP BY 1, 2) u ON u.gg = x.g AND u.jn = x.jobName""",
    "ddl_expected": """
        SELECT path, 'TABLE' AS type, 'S' || (k % 3) AS schema_name, NULL AS package_name, 'T' || k AS name, 1 AS pos FROM {ddl_key}
        UNION ALL SELECT path, 'PACKAGE', 'S1', NULL, 'PKG' || k, 2 FROM {ddl_key} UNION ALL SELECT path, 'DATABASE_LINK', NULL, NULL, 'LNK' || p_partkey, 3 FROM {ddl_key}
        UNION ALL SELECT path, 'PROCEDURE', 'A', 'B', 'PROC' || p_partkey, 4 FROM {ddl_key} UNION ALL SELECT path, 'VIEW', NULL, NULL, 'V' || p_partkey, 5 FROM {ddl_key}""",
    "ddl_key": "SELECT 'db/f' || p_partkey || '.sql' AS path, p_partkey, CASE WHEN p_size = 10 THEN p_partkey - 1 ELSE p_partkey END AS k FROM part",
    "dyn": """
        SELECT JOB_NAME AS job_name, STEP_NAME AS step_name, min(STEP_ORDER) AS step_order, arg_min(STEP_KIND, seq) AS step_kind, """ + ", ".join(
        f"arg_max(VALUE_PARAM, row(seq, VALUE_PARAM)) FILTER (upper(trim(KEY_PARAM)) = '{k}') AS {k.lower()}" for k in dy.KEYS) + """ FROM {dynamic_row} GROUP BY 1, 2""",
    "dyn_edge": """
        SELECT job_name, step_name, CASE WHEN upper(step_kind) = 'SHELL_EXECUTION' THEN 'EXECUTES' ELSE 'TRANSFERS' END AS edge, file AS name, CASE WHEN upper(step_kind) = 'SHELL_EXECUTION' THEN 'SHELL_SCRIPT' ELSE 'FILE' END AS type
        FROM {dyn} WHERE file IS NOT NULL AND upper(step_kind) IN ('SHELL_EXECUTION', 'FTP_FILE_DOWNLOAD')
        UNION SELECT job_name, step_name, 'INVOKES', proc_name, 'PROCEDURE' FROM {dyn} WHERE proc_name IS NOT NULL""",
})


def context_sheet(t):
    return t.sheet_context.withColumnRenamed("start_flag", "start")


@query("i1_upsert_set", """
    SELECT coalesce(t.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.description ELSE t.description END AS description, t.enabled, n.tag_type
    FROM (SELECT 'TAG_' || p_partkey AS id, p_name AS description, p_size > 10 AS enabled FROM part) t
    FULL JOIN (SELECT id, description, tagType AS tag_type FROM {sheet_tag}) n ON n.id = t.id""")
def i1(t):
    target = t.part.select(F.concat(F.lit("TAG_"), "p_partkey").alias("id"), F.col("p_name").alias("description"), (F.col("p_size") > 10).alias("enabled"))
    return up.upsert(target, t.sheet_tag.select("id", "description", F.col("tagType").alias("tag_type")), ["id"], None)


@query("i1_upsert_coalesce", """
    SELECT coalesce(t.id, n.id) AS id, coalesce(t.mark, n.mark) AS mark FROM (SELECT 'TAG_' || p_partkey AS id, CASE WHEN p_size > 10 THEN p_name END AS mark FROM part) t
    FULL JOIN (SELECT 'TAG_' || o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS mark FROM orders GROUP BY 1) n ON n.id = t.id""")
def i1_coalesce(t):
    target = t.part.select(F.concat(F.lit("TAG_"), "p_partkey").alias("id"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("mark"))
    new = t.orders.select(F.concat(F.lit("TAG_"), "o_custkey").alias("id"), F.col("o_orderpriority").alias("mark"), F.col("o_orderkey").alias("n"))
    return up.upsert(target, new, ["id"], ["n"], "coalesce").select("id", "mark")


@query("i2_load_tags", "SELECT id, name, coalesce(description, '') AS description, coalesce(tagType, '') AS tag_type, coalesce(enabled, true) AS enabled FROM {sheet_tag}")
def i2(t):
    return d.load_tags(t.sheet_tag)


@query("i3_load_resources", """
    SELECT id, name, type, coalesce(enabled, true) AS enabled, coalesce(checkInterval, 0) AS check_interval, schemaName FROM {first_resource}
    UNION ALL SELECT id, name, type, coalesce(enabled, true), coalesce(checkInterval, 0), schemaName FROM {sheet_resource} WHERE name NOT IN (SELECT name FROM {first_resource})""")
def i3(t):
    return d.load_resources(t.first_resource, t.sheet_resource).resources


@query("i3_resource_tags", """
    SELECT 'R_' || p_partkey AS resource_id, 'TAG_' || (p_size + o) AS tag_id FROM part, (VALUES (0), (1)) v(o) WHERE p_size <= 25 AND p_size % 5 <> 0""")
def i3_tags(t):
    return d.load_resources(t.first_resource, t.sheet_resource).has_tag


@query("i4_load_job_groups", "SELECT id, name, coalesce(description, '') AS description, coalesce(enabled, true) AS enabled FROM {sheet_job_group}")
def i4(t):
    return d.load_job_groups(t.sheet_job_group)


@query("i5_job_group_successors", """
    SELECT 'CG_' || a.c_custkey AS src_id, 'CG_' || b.c_custkey AS dst_id, 'COMPLETED' AS on_status FROM customer a JOIN customer b ON b.c_custkey IN (a.c_custkey + 1, a.c_custkey + 5) WHERE a.c_custkey % 3 > 0""")
def i5(t):
    return d.job_group_successors(t.sheet_job_group)


@query("i6_load_jobs", "SELECT * FROM {loaded_jobs}")
def i6(t):
    return d.load_jobs(t.sheet_job)


@query("i7_job_group_association", "SELECT DISTINCT job_group_id, job_id FROM {has_job}")
def i7(t):
    return d.job_group_association(t.sheet_assoc, t.job, t.job_group)


@query("i8_load_contexts", """
    SELECT s.id, 'Context_' || s.contextForEntityId AS name, coalesce(s.enabled, true) AS enabled, j.id AS job_id, s.jobGroupId AS job_group_id
    FROM {sheet_context} s LEFT JOIN {job} j ON j.name = s.contextForEntityId""")
def i8(t):
    return d.load_contexts(context_sheet(t), t.job, t.job_group)


@query("i9_context_successors", """
    SELECT 'SIC_' || a.s_suppkey AS src_id, 'SIC_' || b.s_suppkey AS dst_id, 'COMPLETED' AS on_status FROM supplier a JOIN supplier b
    ON (a.s_suppkey % 4 = 0 AND b.s_suppkey = a.s_suppkey + 1) OR (a.s_suppkey % 4 = 1 AND b.s_suppkey IN (a.s_suppkey + 2, a.s_suppkey + 3))""")
def i9(t):
    return d.context_successors(context_sheet(t), t.job_group).precedes


@query("i9_context_entries", """
    SELECT DISTINCT 'JG_' || (a.s_suppkey % 25) AS job_group_id, 'SIC_' || a.s_suppkey AS sic_id FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1
    WHERE a.s_suppkey % 8 = 0 AND a.s_suppkey % 6 <> 5""")
def i9_entries(t):
    return d.context_successors(context_sheet(t), t.job_group).entry


@query("i10_resource_dependency", """
    SELECT DISTINCT contextType AS owner_type, requiresContextId AS owner_id, resourceId AS resource_id FROM {sheet_dependency} s JOIN {resource} r ON r.id = s.resourceId
    WHERE (contextType = 'Job' AND requiresContextId IN (SELECT id FROM {job})) OR (contextType = 'JobGroup' AND requiresContextId IN (SELECT id FROM {job_group}))
       OR (contextType = 'ScheduleInstanceContext' AND requiresContextId IN (SELECT id FROM {sic}))""")
def i10(t):
    return d.resource_dependency(t.sheet_dependency, t.resource, {"Job": t.job, "JobGroup": t.job_group, "ScheduleInstanceContext": t.sic})


@query("i11_parse_clock", """
    SELECT id, CASE time WHEN '07:00 AM' THEN 25200000 WHEN '5:30 pm' THEN 63000000 WHEN '07:15:20' THEN 26120000 END AS time_ms FROM {sheet_sla}""")
def i11(t):
    return t.sheet_sla.select("id", ck.parse_clock(F.col("time")).alias("time_ms"))


@query("i11_load_slas", """
    SELECT id, name, coalesce(enabled, true) AS enabled, type, durationMs AS duration_ms, CASE time WHEN '07:00 AM' THEN 25200000 WHEN '5:30 pm' THEN 63000000 WHEN '07:15:20' THEN 26120000 END AS time_ms,
           forEntityType AS owner_type, forEntityId AS owner_id FROM {sheet_sla} WHERE forEntityType <> 'Step'""")
def i11_slas(t):
    return d.load_slas(t.sheet_sla).rows


@query("i11_rejected_slas", "SELECT id, CASE WHEN forEntityType = 'Step' THEN 'unknown owner type' ELSE 'unreadable time' END AS reason FROM {sheet_sla} WHERE forEntityType = 'Step' OR time = 'at noon'")
def i11_rejected(t):
    return d.load_slas(t.sheet_sla).rejected


def loaded_steps(t):
    kind = {"Step": "Step", "Decision": "Decision", "Block": "Block"}
    key = {k: F.col("id") if k == "Block" else F.col("name") for k in kind}
    nodes = t.flow_node.select("id", "label", F.when(F.col("label") == "Block", F.col("id")).otherwise(F.col("name")).alias("key"))
    steps = t.flow_node.where("label = 'Step'").select("name", F.col("step_kind").alias("stepKind"))
    blocks = t.flow_node.where("label = 'Block'").select("id", "block_type")
    decisions = t.flow_node.where("label = 'Decision'").select("name")
    contains = t.flow_node.select(F.lit("Job").alias("srcLabel"), F.col("job_id").alias("srcKey"), F.col("label").alias("dstLabel"), key["Step"].alias("dstKey"))
    entry = t.job_entry.join(nodes.withColumnRenamed("id", "node_id"), "node_id").select(
        F.lit("Job").alias("srcLabel"), F.col("job_id").alias("srcKey"), F.col("label").alias("dstLabel"), F.col("key").alias("dstKey"))
    src = nodes.select(F.col("id").alias("src_id"), F.col("label").alias("srcLabel"), F.col("key").alias("srcKey"))
    dst = nodes.select(F.col("id").alias("dst_id"), F.col("label").alias("dstLabel"), F.col("key").alias("dstKey"))
    precedes = t.flow_edge.join(src, "src_id").join(dst, "dst_id").select("srcLabel", "srcKey", "dstLabel", "dstKey")
    listeners = t.listener.select(F.col("bean").alias("name"), F.lit("Job").alias("srcLabel"), F.col("job_id").alias("srcKey"))
    return d.load_steps(steps, blocks, decisions, contains, entry, precedes, listeners)


@query("i12_load_step_nodes", """
    SELECT DISTINCT label, CASE label WHEN 'Block' THEN id ELSE name END AS key, coalesce(step_kind, '') AS step_kind, coalesce(block_type, '') AS block_type, 0 AS db_operation_count FROM {flow_node}
    UNION SELECT 'Listener', bean, '', '', 0 FROM {listener}""")
def i12(t):
    return loaded_steps(t).nodes


@query("i12_load_step_edges", """
    WITH n AS (SELECT id, label, CASE label WHEN 'Block' THEN id ELSE name END AS key, name, job_id FROM {flow_node})
    SELECT 'CONTAINS' AS type, 'Job' AS srcLabel, job_id AS srcKey, label AS dstLabel, name AS dstKey FROM n WHERE label <> 'Block'
    UNION SELECT 'ENTRY', 'Job', e.job_id, n.label, n.key FROM {job_entry} e JOIN n ON n.id = e.node_id
    UNION SELECT 'PRECEDES', a.label, a.key, b.label, b.key FROM {flow_edge} e JOIN n a ON a.id = e.src_id JOIN n b ON b.id = e.dst_id
    UNION SELECT 'HAS_LISTENER', 'Job', job_id, 'Listener', bean FROM {listener}""")
def i12_edges(t):
    return loaded_steps(t).edges


@query("i14_load_calendar_patterns", """
    SELECT patternId AS pattern_id, matchExpression AS match_expression, name, CASE WHEN runtimeParams LIKE '%region' THEN 'date,region' WHEN runtimeParams IS NOT NULL THEN 'date' ELSE '' END AS runtime_params,
           coalesce(configParams, '') AS config_params, evaluatorFn AS evaluator_fn, isActive <> 'no' AS is_active, coalesce(version, 1) AS version FROM {sheet_pattern} WHERE patternId <> ' '""")
def i14(t):
    df = d.load_calendar_patterns(t.sheet_pattern)
    return df.withColumn("runtime_params", F.array_join("runtime_params", ",")).withColumn("config_params", F.array_join("config_params", ","))


@query("i15_load_holidays", """
    SELECT DISTINCT cast(ts AS date) AS holiday_date, CASE user_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'IN' ELSE 'ALL' END AS region, event_type AS name FROM events WHERE user_id % 50 > 1""")
def i15(t):
    return d.load_holidays(t.sheet_holiday, days(t))


@query("i16_load_business_calendars", """
    SELECT s.ruleId AS rule_id, s.name, CASE WHEN region = ' US ' THEN 'US' END AS region, CASE WHEN params = 'not json' THEN '{}' ELSE coalesce(params, '{}') END AS params, s.isActive = 'true' AS is_active,
           p.patternId AS pattern_id, p.evaluatorFn AS evaluator_fn FROM {sheet_calendar} s LEFT JOIN {sheet_pattern} p ON p.matchExpression = s.matchExpression AND p.patternId <> ' '""")
def i16(t):
    return d.load_business_calendars(t.sheet_calendar, d.load_calendar_patterns(t.sheet_pattern))


BAD_ASSOC = "o_orderkey % 20 = 19 OR (o_orderkey % 3 = 2 AND o_orderkey % 2 = 0) OR o_orderkey % 7 = 0 OR o_orderkey % 5 = 4"


@query("i17_calendar_associations", f"""
    SELECT DISTINCT CASE WHEN o_orderkey % 3 = 1 THEN 'SIC' ELSE 'JOB_GROUP' END AS context_type, 'C_' || (o_custkey + o) AS context_id, 'RUL_' || o_orderkey AS rule_id,
           CASE WHEN o_orderkey % 5 IN (0, 3) THEN 'ALLOWS' ELSE 'DENIES' END AS rule_type,
           CASE WHEN o_orderkey % 5 IN (1, 2) THEN CASE WHEN o_orderkey % 2 = 0 THEN 'RUN_NEXT_BUSINESS_DAY' ELSE 'SKIP' END END AS action
    FROM orders, (VALUES (0), (1)) v(o) WHERE NOT ({BAD_ASSOC})""")
def i17(t):
    return d.calendar_associations(t.sheet_calendar_assoc).rows


@query("i17_rejected_associations", """
    SELECT id, trim(requiresContextId) AS requiresContextId, CASE WHEN id = '' THEN 'incomplete' WHEN contextType = 'Job' THEN 'unknown context type' WHEN requiresContextId = ' , ' THEN 'no context id' ELSE 'unknown decision' END AS reason
    FROM {sheet_calendar_assoc} WHERE id = '' OR contextType = 'Job' OR requiresContextId = ' , ' OR Allowed = '?'""")
def i17_rejected(t):
    return d.calendar_associations(t.sheet_calendar_assoc).rejected


@query("i18_business_date", "SELECT event_id, CASE WHEN hour(ts) >= 18 THEN cast(ts AS date) + 1 ELSE cast(ts AS date) END AS business_date, cast(ts AS date) AS execution_date FROM events")
def i18(t):
    return t.events.select("event_id", ck.business_date(F.col("ts")).alias("business_date"), F.to_date("ts").alias("execution_date"))


@query("i19_derive_job_group_runs", """
    SELECT g || '_' || cast(business_date AS varchar) AS id, g AS job_group_id, business_date, epoch_ms(arg_min(start_ts, id)) % 86400000 AS start_time_ms, cast(arg_min(start_ts, id) AS date) AS execution_date
    FROM {run_dated} WHERE reason IS NULL GROUP BY g, business_date""")
def i19(t):
    return r.derive_job_group_runs(t.sheet_run, t.sic, t.job, t.has_job_one).rows


@query("i19_rejected_runs", "SELECT id, reason FROM {run_group} WHERE reason IS NOT NULL")
def i19_rejected(t):
    return r.derive_job_group_runs(t.sheet_run, t.sic, t.job, t.has_job_one).rejected


@query("i20_derive_context_runs", """
    SELECT x.id, g || '_' || cast(business_date AS varchar) AS jge_id, sic_id, j.id AS job_id, g AS job_group_id, business_date, cast(start_ts AS date) AS execution_date, epoch_ms(start_ts) % 86400000 AS start_time_ms,
           epoch_ms(end_ts) % 86400000 AS end_time_ms, greatest(0, coalesce(epoch_ms(end_ts) - epoch_ms(start_ts), 0)) AS duration_ms, status, exitCode AS exit_code, exitMessage AS exit_message
    FROM {run_sic} x LEFT JOIN {job} j ON j.name = x.jobName WHERE why IS NULL""")
def i20(t):
    return r.derive_context_runs(t.sheet_run, t.sic, t.job, t.has_job_one).rows


@query("i20_rejected_runs", "SELECT id, why AS reason FROM {run_sic} WHERE why IS NOT NULL")
def i20_rejected(t):
    return r.derive_context_runs(t.sheet_run, t.sic, t.job, t.has_job_one).rejected


@query("i21_load_resource_events", "SELECT id, resource_id, business_date, availability_time_ms, size_mb FROM {rae} WHERE resource_id IN (SELECT id FROM {resource})")
def i21(t):
    return r.load_resource_events(t.rae, t.resource)


@query("i22_resource_event_runs_group", """
    SELECT a.id AS rae_id, g.id AS jge_id, g.start_time_ms < a.availability_time_ms AS impacted FROM {rae} a JOIN {require_resource} q ON q.resource_id = a.resource_id AND q.owner_type = 'JOB_GROUP'
    JOIN {jge} g ON g.job_group_id = q.owner_id AND g.business_date = a.business_date""")
def i22(t):
    return r.resource_event_runs_group(t.rae, t.require_resource, t.jge)


@query("i23_resource_event_runs_context", """
    SELECT a.id AS rae_id, e.id AS jce_id FROM {rae} a JOIN {require_resource} q ON q.resource_id = a.resource_id AND q.owner_type = 'SIC' JOIN {jce} e ON e.sic_id = q.owner_id AND e.business_date = a.business_date""")
def i23(t):
    return r.resource_event_runs_context(t.rae, t.require_resource, t.jce)


@query("i24_reset_instance_tables", "SELECT business_date, count(*) AS runs FROM {jce} GROUP BY 1")
def i24(t):
    import uuid

    root = f"{work_dir(t.spark)}/runs-{uuid.uuid4().hex}"
    half = t.jce.where(F.col("status") == "FAILED")
    r.reset_instance_tables(root, {"job_context_execution": half, "job_group_execution": t.jge})
    r.reset_instance_tables(root, {"job_context_execution": t.jce})
    back = t.spark.read.parquet(f"{root}/job_context_execution")
    return back.groupBy("business_date").agg(F.count("*").alias("runs"))


@query("i25_scan_code_files", """
    SELECT path, regexp_extract(path, '[^/]+$') AS name FROM {code_file} WHERE path NOT LIKE '%/target/%' AND path NOT LIKE '%/src/test/%' AND path NOT LIKE '%.log'""")
def i25(t):
    return co.keep_code_files(t.code_file).select("path", co.file_name(F.col("path")).alias("name"))


@query("i25_scan_files_on_disk", r"""
    SELECT DISTINCT path, regexp_extract(path, '[^/]+$') AS name, CASE WHEN path LIKE '%.%' THEN regexp_extract(path, '\.[^./]+$') ELSE '' END AS extension,
           octet_length(encode(coalesce(text, ''))) AS size, md5(coalesce(text, '')) AS text_md5
    FROM {code_file} WHERE path NOT LIKE '%/target/%' AND path NOT LIKE '%/src/test/%' AND path NOT LIKE '%.log'""")
def i25_disk(t):
    """The files of the listing, written below a folder and found again there."""
    root = f"{work_dir(t.spark)}/tree-{uuid.uuid4().hex}"
    write_tree(t.code_file.select("path", "text").repartition(8, "path"), root)
    found = co.scan_code_files(t.spark, root).files
    return found.select("path", "name", "extension", "size", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("i26_tag_file_types", """
    SELECT path, 'XmlConfig' AS file_type FROM {code_file} WHERE path LIKE '%.xml' AND path NOT LIKE '%/pom.xml'
    UNION ALL SELECT path, 'SpringConfig' FROM {code_file} WHERE path LIKE '%.xml' AND path NOT LIKE '%/pom.xml' AND text LIKE '%http://www.springframework.org/schema/%'
    UNION ALL SELECT path, 'PomFile' FROM {code_file} WHERE path LIKE '%/pom.xml' UNION ALL SELECT path, 'SqlScript' FROM {code_file} WHERE path LIKE '%.sql'
    UNION ALL SELECT path, 'JavaTestClass' FROM {code_file} WHERE path LIKE '%.java' AND path LIKE '%/src/test/%' UNION ALL SELECT path, 'JavaClass' FROM {code_file} WHERE path LIKE '%.java' AND path LIKE '%/src/main/%'
    UNION ALL SELECT path, 'ShellScript' FROM {code_file} WHERE path LIKE '%.sh' UNION ALL SELECT path, 'PropertyFile' FROM {code_file} WHERE path LIKE '%.properties'
    UNION ALL SELECT path, 'File' FROM {code_file} WHERE path LIKE '%.md' OR path LIKE '%.log'""")
def i26(t):
    return co.tag_file_types(t.code_file)


@query("i27_mark_packages", """
    SELECT DISTINCT 'repo/src/main/java/' || f AS folder, p AS package, false AS is_test FROM {java_class} c, LATERAL (VALUES ('com', 'com'), ('com/acme', 'com.acme'), (replace(c.package, '.', '/'), c.package)) v(f, p) WHERE NOT c.is_test""")
def i27(t):
    return co.mark_packages(t.java_class.where("NOT is_test").select(
        F.concat(F.lit("repo/src/main/java/"), F.replace("package", F.lit("."), F.lit("/")), F.lit("/"), "name", F.lit(".java")).alias("path"), "package"))


@query("i28_extract_ddl", "SELECT * FROM {ddl_expected}")
def i28(t):
    return co.extract_ddl(t.ddl_file)


@query("i29_load_ddl_resources", "SELECT DISTINCT name, type, schema_name, package_name FROM {ddl_expected}")
def i29(t):
    return co.load_ddl_resources(co.extract_ddl(t.ddl_file)).resources.drop("id")


@query("i29_ddl_create_edges", "SELECT path, count(*) AS n FROM (SELECT DISTINCT path, name, type, schema_name, package_name FROM {ddl_expected}) GROUP BY 1")
def i29_edges(t):
    return co.load_ddl_resources(co.extract_ddl(t.ddl_file)).creates.groupBy("path").agg(F.count("*").alias("n"))


@query("i30_mark_duplicate_resources", "SELECT name, type, schema_name, package_name, count(DISTINCT path) AS file_count, count(DISTINCT path) > 1 AS duplicate_found FROM {ddl_expected} GROUP BY 1, 2, 3, 4")
def i30(t):
    return co.mark_duplicate_resources(co.extract_ddl(t.ddl_file))


@query("i31_parse_dynamic_jobs", "SELECT * FROM {dyn}")
def i31(t):
    return dy.parse_dynamic_jobs(t.dynamic_row)


@query("i32_dynamic_step_chain", """
    SELECT job_name, step_name AS src_step, nxt AS dst_step FROM (SELECT job_name, step_name, lead(step_name) OVER (PARTITION BY job_name ORDER BY step_order, step_name) AS nxt FROM {dyn}) WHERE nxt IS NOT NULL""")
def i32(t):
    return dy.dynamic_step_chain(dy.parse_dynamic_jobs(t.dynamic_row)).precedes


@query("i33_dynamic_step_edges", "SELECT * FROM {dyn_edge}")
def i33(t):
    return dy.dynamic_step_resources(dy.parse_dynamic_jobs(t.dynamic_row)).edges


@query("i33_dynamic_resources", "SELECT DISTINCT name, type FROM {dyn_edge}")
def i33_resources(t):
    return dy.dynamic_step_resources(dy.parse_dynamic_jobs(t.dynamic_row)).resources.select("name", "type")


@query("i34_script_type", """
    SELECT DISTINCT name, CASE WHEN name LIKE '%.sh' THEN 'BASH' WHEN name LIKE '%.PY' THEN 'PYTHON' ELSE 'SHELL' END AS by_suffix,
           CASE WHEN name LIKE '%.sh' THEN 'BASH' WHEN name LIKE '%.PY' THEN 'PYTHON' ELSE 'SHELL' END AS by_hint FROM {dyn_edge}""")
def i34(t):
    names = dy.dynamic_step_resources(dy.parse_dynamic_jobs(t.dynamic_row)).edges.select("name").distinct()
    return names.select("name", co.script_type(F.col("name")).alias("by_suffix"), co.script_type_hint(F.col("name")).alias("by_hint"))


@query("i35_sql_files_in_script", """
    SELECT id, 1 AS pos, '/apps/batch-common/' || CASE folder_kind WHEN 0 THEN 'sql' WHEN 1 THEN 'cfg' ELSE 'other' END || '/q' || (p_partkey % 50) || '.sql' AS ref FROM {script_file}
    UNION ALL SELECT id, 2, '/opt/x/z' || (p_partkey % 7) || '.SQL' FROM {script_file}""")
def i35(t):
    found = t.script_file.select("id", F.posexplode(co.sql_files_in_script(F.col("text"))).alias("pos", "ref"))
    return found.select("id", (F.col("pos") + 1).alias("pos"), "ref")


@query("i36_common_key", "SELECT path, CASE WHEN path LIKE 'apps/batch-common/%' THEN substr(path, 19) END AS common_key FROM {code_file}")
def i36(t):
    return t.code_file.select("path", co.common_key(F.col("path")).alias("common_key"))


@query("i36_match_by_common_key", """
    SELECT 'W_' || p_partkey AS want_id, 'K_' || p_partkey AS resource_id FROM part WHERE p_partkey % 5 = 1""")
def i36_match(t):
    scripts = t.part.where(F.col("p_partkey") % 5 == 1)
    wanted = t.part.select(F.concat(F.lit("W_"), "p_partkey").alias("want_id"), F.concat(F.lit("/x/other-common/jobs/run"), "p_partkey", F.lit(".sh")).alias("path"))
    known = scripts.select(F.concat(F.lit("K_"), "p_partkey").alias("id"), F.concat(F.lit("apps\\batch-common\\jobs\\run"), "p_partkey", F.lit(".sh")).alias("path"))
    return co.match_by_common_key(wanted, known)


@query("i37_match_sql_resource", """
    WITH w AS (SELECT id AS want_id, 'q' || (p_partkey % 50) || '.sql' AS name, CASE folder_kind WHEN 0 THEN 'sql' WHEN 1 THEN 'cfg' ELSE 'other' END AS folder FROM {script_file}),
    c AS (SELECT w.want_id, k.id, CASE WHEN contains(k.path, w.folder || '/' || w.name) THEN 1 WHEN contains(k.path, 'sql/' || w.name) THEN 2 ELSE 3 END AS rk FROM w JOIN {sql_file} k USING (name))
    SELECT want_id, arg_min(id, row(rk, id)) AS resource_id, CASE WHEN count(*) = 1 THEN 0 ELSE min(rk) END AS match_rank FROM c GROUP BY 1""")
def i37(t):
    folder = F.when(F.col("folder_kind") == 0, "sql").when(F.col("folder_kind") == 1, "cfg").otherwise("other")
    name = F.concat(F.lit("q"), (F.col("p_partkey") % 50).cast("string"), F.lit(".sql"))
    wanted = t.script_file.select(F.col("id").alias("want_id"), name.alias("script_name"), F.concat(F.lit("sqlplus u/p@T/apps/x-common/"), folder, F.lit("/"), name).alias("script_path"))
    return co.match_sql_resource(wanted, t.sql_file)


@query("i38_link_script_sql", """
    SELECT DISTINCT s.id AS script_id, k.id AS sql_id, 'SQL_SCRIPT' AS execution_type FROM {script_file} s JOIN {sql_file} k
    ON k.path = '/apps/batch-common/' || CASE folder_kind WHEN 0 THEN 'sql' WHEN 1 THEN 'cfg' ELSE 'other' END || '/q' || (p_partkey % 50) || '.sql'""")
def i38(t):
    return co.link_script_sql(t.script_file, t.sql_file)


@query("i39_load_classes", """
    SELECT c.fqn, c.name, c.package, c.is_interface, c.is_test, count(m.fqn) AS method_count FROM {java_class} c LEFT JOIN {java_method} m ON m.class_fqn = c.fqn GROUP BY 1, 2, 3, 4, 5""")
def i39(t):
    return co.load_code_tables(t.java_class, t.java_method, t.bean).classes


@query("i39_load_beans", "SELECT bean_id || '___' || bean_class AS composite_key, bean_id, bean_class FROM {bean}")
def i39_beans(t):
    return co.load_code_tables(t.java_class, t.java_method, t.bean).beans


