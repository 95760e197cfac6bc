"""Definition sheets, run records and repository files derived from the given tables."""

from __future__ import annotations

from batchlens.sources.testdata import FIXTURES

_S = "(SELECT count(*) FROM {supplier})"

FIXTURES.update({
    "sheet_tag": """
        SELECT 'TAG_' || c_custkey AS id, c_name AS name, c_mktsegment AS description, CASE WHEN c_custkey % 2 = 0 THEN 'SEG' END AS tagType,
               CASE WHEN c_custkey % 3 = 0 THEN false WHEN c_custkey % 3 = 1 THEN true END AS enabled FROM {customer}""",
    "first_resource": """
        SELECT 'G_' || p_partkey AS id, CASE WHEN p_size > 25 THEN 'res ' ELSE 'table ' END || p_partkey AS name, 'TABLE' AS type, true AS enabled, cast(NULL AS int) AS checkInterval,
               'S' || (p_partkey % 3) AS schemaName, cast(NULL AS varchar(10)) AS tagId FROM {part}""",
    "sheet_resource": """
        SELECT 'R_' || p_partkey AS id, 'res ' || p_partkey AS name, 'FILE' AS type, CASE WHEN p_size % 2 = 0 THEN true END AS enabled, p_size AS checkInterval,
               cast(NULL AS varchar(10)) AS schemaName, CASE WHEN p_size % 5 <> 0 THEN '[TAG_' || p_size || ', TAG_' || (p_size + 1) || ']' END AS tagId FROM {part}""",
    "sheet_job_group": """
        SELECT 'CG_' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS description, CASE WHEN c_custkey % 5 = 0 THEN false END AS enabled,
               CASE WHEN c_custkey % 3 > 0 THEN 'CG_' || (c_custkey + 5) || ' ,CG_' || (c_custkey + 1) || ',, CG_missing' END AS successor FROM {customer}""",
    "sheet_job": """
        SELECT CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE 'SJ_' || s_suppkey END AS id, CASE WHEN s_suppkey % 10 = 8 THEN NULL ELSE s_name END AS name,
               CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'dynamic_job' END AS type, CASE WHEN s_suppkey % 2 = 0 THEN false END AS enabled FROM {supplier}""",
    "sheet_assoc": """
        SELECT CASE WHEN j.job_key % 2 = 0 THEN j.id ELSE j.name END AS jobId, h.job_group_id AS jobGroupId FROM {has_job} h JOIN {job} j ON j.id = h.job_id
        UNION ALL SELECT 'nobody_' || id, id FROM {job_group} UNION ALL SELECT id, 'JG_none_' || id FROM {job}""",
    "sheet_context": f"""
        SELECT 'SIC_' || s_suppkey AS id, 'LOAD_' || (s_suppkey % (SELECT count(*) + 3 FROM {{job}})) AS contextForEntityId,
               CASE WHEN s_suppkey % 6 <> 5 THEN 'JG_' || (s_suppkey % 25) END AS jobGroupId, CASE WHEN s_suppkey % 8 = 0 THEN 'Y' END AS start_flag,
               CASE s_suppkey % 4 WHEN 0 THEN 'SIC_' || (s_suppkey + 1) WHEN 3 THEN NULL ELSE 'SIC_' || (s_suppkey + 2) || ', SIC_' || (s_suppkey + 3) || ',SIC_x' END AS successor,
               CASE s_suppkey % 4 WHEN 0 THEN 'SIMPLE' WHEN 1 THEN 'PARALLEL' ELSE 'OTHER' END AS block, CASE WHEN s_suppkey % 2 = 0 THEN true END AS enabled FROM {{supplier}}""",
    "sheet_dependency": f"""
        SELECT 'RES_' || (o_custkey * 2) AS resourceId, CASE o_orderkey % 4 WHEN 0 THEN 'SIC_' || (o_custkey % {_S}) WHEN 1 THEN 'JG_' || (o_custkey % 30) ELSE 'JOB_' || (o_custkey % 50) END AS requiresContextId,
               CASE o_orderkey % 4 WHEN 0 THEN 'ScheduleInstanceContext' WHEN 1 THEN 'JobGroup' WHEN 2 THEN 'Job' ELSE 'Nothing' END AS contextType FROM {{orders}}""",
    "sheet_sla": """
        SELECT 'SL_' || o_orderkey AS id, 'sla ' || o_orderkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN false END AS enabled, CASE WHEN o_orderkey % 3 = 0 THEN 'RELATIVE' ELSE 'ABSOLUTE' END AS type,
               CASE o_orderkey % 5 WHEN 0 THEN '07:00 AM' WHEN 1 THEN '5:30 pm' WHEN 2 THEN '07:15:20' WHEN 3 THEN 'at noon' END AS time,
               CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 10 END AS durationMs,
               CASE o_orderkey % 4 WHEN 0 THEN 'JobGroup' WHEN 1 THEN 'ScheduleInstanceContext' WHEN 2 THEN 'Resource' ELSE 'Step' END AS forEntityType, 'E_' || o_custkey AS forEntityId FROM {orders}""",
    "sheet_pattern": """
        SELECT CASE WHEN c_custkey % 9 = 8 THEN ' ' ELSE 'PAT_' || c_custkey END AS patternId, 'match_' || c_custkey AS matchExpression, c_name AS name,
               CASE WHEN c_custkey % 3 = 0 THEN ' date , region' WHEN c_custkey % 3 = 1 THEN 'date,,' END AS runtimeParams, CASE WHEN c_custkey % 2 = 0 THEN 'months' END AS configParams,
               CASE WHEN c_custkey % 2 = 0 THEN 'holiday' ELSE 'nth_dom' END AS evaluatorFn, CASE c_custkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'yes' WHEN 2 THEN '1' ELSE 'no' END AS isActive,
               CASE WHEN c_custkey % 2 = 0 THEN 2 END AS version FROM {customer}""",
    "sheet_holiday": """
        SELECT event_id AS id, CASE WHEN user_id % 50 = 0 THEN '1990-01-01' WHEN user_id % 50 = 1 THEN 'soon' ELSE substr(cast(ts AS varchar(40)), 1, 19) END AS date,
               CASE user_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'IN' ELSE 'ALL' END AS region, event_type AS name FROM {events}""",
    "sheet_calendar": """
        SELECT 'RUL_' || o_orderkey AS ruleId, 'rule ' || o_orderkey AS name, 'match_' || o_custkey AS matchExpression, CASE o_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' US ' END AS region,
               CASE o_orderkey % 4 WHEN 0 THEN '{"daysOfMonth":[1]}' WHEN 1 THEN 'not json' WHEN 2 THEN '{"region":"US"}' END AS params, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'no' END AS isActive FROM {orders}""",
    "sheet_calendar_assoc": """
        SELECT CASE WHEN o_orderkey % 20 = 19 THEN '' ELSE 'RUL_' || o_orderkey END AS id, CASE o_orderkey % 3 WHEN 0 THEN 'JobGroup' WHEN 1 THEN 'ScheduleInstanceContext' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Job' ELSE 'JobGroup' END END AS contextType,
               CASE o_orderkey % 7 WHEN 0 THEN ' , ' ELSE ' C_' || o_custkey || ', C_' || (o_custkey + 1) END AS requiresContextId,
               CASE o_orderkey % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'n' WHEN 2 THEN 'N' WHEN 3 THEN 'y' ELSE '?' END AS Allowed, CASE WHEN o_orderkey % 2 = 0 THEN 'RUN_NEXT_BUSINESS_DAY' END AS action FROM {orders}""",
    "has_job_one": """
        SELECT h.job_id, min(h.job_group_id) AS job_group_id FROM {has_job} h JOIN {job} j ON j.id = h.job_id WHERE j.job_key % 2 = 0 GROUP BY h.job_id
        UNION ALL SELECT h.job_id, h.job_group_id FROM {has_job} h JOIN {job} j ON j.id = h.job_id WHERE j.job_key % 2 = 1""",
    "sheet_run": f"""
        SELECT 'RUN_' || event_id AS id, 'LOAD_' || (k % (SELECT count(*) FROM {{job}})) AS jobName, CASE WHEN event_id % 3 = 0 THEN 'JG_' || (k % 25) END AS jobGroupId,
               CASE WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 11 = 0 THEN 'SIC_none' ELSE 'SIC_' || k END END AS jobContextId,
               CASE WHEN event_id % 97 = 5 THEN 'broken' ELSE substr(cast(ts AS varchar(40)), 1, 19) END AS startTime,
               CASE WHEN event_id % 89 = 5 THEN 'broken' ELSE substr(cast(ts AS varchar(40)), 1, 11) || '23:59:59' END AS endTime,
               event_type AS status, cast(user_id AS varchar(10)) AS exitCode, 'm' || (user_id % 3) AS exitMessage
        FROM (SELECT *, user_id % {_S} AS k FROM {{events}}) e""",
    # repository files: Java classes, pages as XML, parts as scripts and DDL
    "code_file": """
        SELECT CASE WHEN is_test THEN 'repo/src/test/java/com/acme/' || name || 'Test.java' ELSE 'repo/src/main/java/' || replace(package, '.', '/') || '/' || name || '.java' END AS path,
               'class ' || name AS text FROM {java_class}
        UNION ALL SELECT CASE WHEN page_id % 5 = 0 THEN 'repo/target/p' || page_id || '.xml' WHEN page_id % 5 = 1 THEN 'repo/conf/' || page_id || '/pom.xml' ELSE 'repo/conf/page_' || page_id || '.xml' END,
               CASE WHEN page_id % 2 = 0 THEN '<beans xmlns="http://www.springframework.org/schema/beans">' || html ELSE html END FROM {pages}
        UNION ALL SELECT CASE p_partkey % 5 WHEN 0 THEN 'db/s' || (p_partkey % 3) || '/t' || p_partkey || '.sql' WHEN 1 THEN 'apps/batch-common/jobs/run' || p_partkey || '.sh' WHEN 2 THEN 'repo/resources/a' || p_partkey || '.properties'
               WHEN 3 THEN 'repo/logs/x' || p_partkey || '.log' ELSE 'misc/readme' || p_partkey || '.md' END, p_name FROM {part}""",
    "ddl_file": """
        SELECT 'db/f' || p_partkey || '.sql' AS path, '-- head' || chr(10) || 'create table s' || (k % 3) || '.t' || k || ' (x int);' || chr(10) ||
               'CREATE OR REPLACE PACKAGE BODY s1.pkg' || k || ' as begin end;' || chr(10) || 'create public database link lnk' || p_partkey || ' connect;' || chr(10) ||
               'CREATE OR REPLACE PROCEDURE a.b.proc' || p_partkey || '(p int) is begin null; end;' || chr(10) || 'create view v' || p_partkey || ' as select 1;' AS text
        FROM (SELECT p_partkey, CASE WHEN p_size = 10 THEN p_partkey - 1 ELSE p_partkey END AS k FROM {part}) p""",
    "script_file": """
        SELECT 'SH_' || p_partkey AS id, 'run ' || p_partkey || ' sqlplus u/p@TNS @/apps/batch-common/' || CASE p_size % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'cfg' ELSE 'other' END || '/q' || (p_partkey % 50) || '.sql' || chr(10) ||
               'sqlplus "@/opt/x/z' || (p_partkey % 7) || '.SQL" @/opt/x/z' || (p_partkey % 7) || '.SQL' AS text, p_size % 3 AS folder_kind, p_partkey FROM {part}""",
    "sql_file": """
        SELECT 'SQ_' || s_suppkey AS id, '/apps/batch-common/' || CASE s_suppkey % 2 WHEN 0 THEN 'sql' ELSE 'cfg' END || '/q' || (s_suppkey % 50) || '.sql' AS path, 'q' || (s_suppkey % 50) || '.sql' AS name FROM {supplier}""",
    "dynamic_row": """
        SELECT 'DYN_' || l_suppkey AS JOB_NAME, 'STEP_' || l_suppkey || '_' || l_linenumber AS STEP_NAME, l_linenumber AS STEP_ORDER,
               CASE l_linenumber % 4 WHEN 0 THEN 'SHELL_EXECUTION' WHEN 1 THEN 'FTP_FILE_DOWNLOAD' WHEN 2 THEN 'DO_NOTHING' ELSE 'shell_execution' END AS STEP_KIND,
               CASE l_partkey % 9 WHEN 0 THEN 'DIR' WHEN 1 THEN ' file ' WHEN 2 THEN 'PARAMS' WHEN 3 THEN 'USER' WHEN 4 THEN 'PROC_NAME' WHEN 5 THEN 'PROC_SCHEMA' WHEN 6 THEN 'PROC_PACKAGE' WHEN 7 THEN 'PROC_PARAMS' ELSE 'NOISE' END AS KEY_PARAM,
               CASE l_partkey % 9 WHEN 0 THEN '/d' || (l_orderkey % 5) || '/' WHEN 1 THEN 'f' || l_orderkey || CASE l_orderkey % 3 WHEN 0 THEN '.sh' WHEN 1 THEN '.PY' ELSE '.dat' END ELSE 'v' || (l_orderkey % 100) END AS VALUE_PARAM,
               l_orderkey * 100000 + l_partkey AS seq FROM {lineitem}""",
    "bean": "SELECT 'bean_' || class_key AS bean_id, fqn AS bean_class FROM {java_class} WHERE NOT is_interface",
})

FIXTURES.update({
    # text of every method: eight kinds of body by key, with comments and blank lines
    "method_source": """
        SELECT m.fqn, m.class_fqn, m.name, m.method_key, m.method_key % 8 AS kind,
               CASE m.method_key % 6 WHEN 0 THEN 'List<Integer>' WHEN 1 THEN 'com.acme.OrderItemEntity' WHEN 2 THEN 'void' WHEN 3 THEN 'TradeLeg' WHEN 4 THEN 'java.util.Map<String, X>' ELSE 'CustRow' END AS return_type,
               '// note' || chr(10) || chr(10) || '/* long' || chr(10) || ' text */' || chr(10) || 'begin();' || chr(10) ||
               CASE m.method_key % 8
                   WHEN 0 THEN 'return jdbcTemplate.query("SELECT a, b FROM s' || (m.method_key % 3) || '.tab' || (m.method_key % 40) || ' t1, other' || (m.method_key % 5) || ' o JOIN x.y.deep' || (m.method_key % 4) || ' d ON d.k = o.k WHERE t1.x = 1", rm);'
                   WHEN 1 THEN 'jdbcTemplate.update("INSERT INTO s.t' || (m.method_key % 20) || ' values (1)" + "x");'
                   WHEN 2 THEN 'SimpleJdbcCall c = new SimpleJdbcCall(ds).withSchemaName("S1").withProcedureName("P' || (m.method_key % 30) || '"); stmt.setString(1, "x"); oracle.Driver d;'
                   WHEN 3 THEN 'CallableStatement cs = connection.prepareCall("{call sch.pkg.proc' || (m.method_key % 30) || '(?)}"); cs.setInt(1, v); cs.setInt(2, w);'
                   WHEN 4 THEN 'Runtime.getRuntime().exec("/opt/run' || (m.method_key % 20) || '.sh");'
                   WHEN 5 THEN 'new ProcessBuilder(dir + name); new SimpleJdbcCall(ds).withProcedureName(procName);'
                   WHEN 6 THEN 'executor.execute(scriptPath); new ProcessBuilder("deploy.py");'
                   ELSE 'jdbcTemplate.query(SqlConst.Q_' || (m.method_key % 10) || ', rm);' END || chr(10) || 'end();' AS source
        FROM {java_method} m""",
    "class_import": """
        SELECT fqn AS class_fqn, CASE class_key % 4 WHEN 0 THEN 'java.sql.Connection' WHEN 1 THEN 'java.util.List' WHEN 2 THEN 'org.hibernate.Session' ELSE 'java.io.File' END AS import_name FROM {java_class}
        UNION ALL SELECT fqn, 'org.apache.commons.exec.CommandLine' FROM {java_class} WHERE class_key % 5 = 0""",
    "sql_constant": """
        SELECT 'SqlConst' AS class_name, 'Q_' || s_suppkey AS constant_name, 'SELECT x FROM const_tab' || s_suppkey || ' WHERE y = 1' AS sql FROM {supplier}""",
    "method_op": """
        SELECT method_fqn, 'DB' AS kind, operation_type || ':' || table_name || ':' || confidence AS op FROM {db_operation}
        UNION ALL SELECT fqn, 'PROC', 'S1:NONE:P' || (method_key % 30) || ':ORACLE:PROCEDURE:HIGH' FROM {method_source} WHERE kind = 2
        UNION ALL SELECT fqn, 'PROC', 'UNKNOWN:NONE:DYNAMIC_PROCEDURE:UNKNOWN:PROCEDURE:LOW' FROM {method_source} WHERE kind = 5
        UNION ALL SELECT fqn, 'SHELL', 'RUNTIME_EXEC:/opt/run' || (method_key % 20) || '.sh:HIGH' FROM {method_source} WHERE kind = 4
        UNION ALL SELECT fqn, 'SHELL', 'PROCESS_BUILDER:DYNAMIC_PATH:LOW' FROM {method_source} WHERE kind = 5
        UNION ALL SELECT fqn, 'SHELL', 'RESOLVED:job' || (method_key % 9) || '.sh:HIGH' FROM {method_source} WHERE kind = 6
        UNION ALL SELECT fqn, 'SQL', 'RESOLVED:load' || (method_key % 9) || '.sql:HIGH' FROM {method_source} WHERE kind = 7""",
    "stored_step_op": """
        SELECT DISTINCT s.step_id, o.kind, o.op FROM {step_class} s JOIN {java_method} m ON m.class_fqn = s.class_fqn JOIN {method_op} o ON o.method_fqn = m.fqn""",
    "step_bean": """
        SELECT DISTINCT s.step_id, 'bean_' || c.class_key AS bean_id FROM {step_class} s JOIN {java_class} c ON c.fqn = s.class_fqn""",
    "manual_mapping": """
        SELECT s.fqn AS method_fqn, CASE kind WHEN 5 THEN 'SHELL' WHEN 1 THEN 'DB' WHEN 2 THEN 'PROC' ELSE 'SQL' END AS kind,
               CASE kind WHEN 5 THEN 'RESOLVED:fix' || (method_key % 7) || '.sh:HIGH' WHEN 1 THEN 'INSERT:FIX_' || (method_key % 7) || ':HIGH' WHEN 2 THEN 'S:NONE:FIX_' || (method_key % 7) || ':ORACLE:PROCEDURE:HIGH' ELSE 'RESOLVED:fix.sql:HIGH' END AS op,
               'FIX_' || (method_key % 7) AS resource_name, CASE WHEN s.method_key % 16 < 8 THEN 'bean_' || c.class_key END AS bean_id
        FROM {method_source} s JOIN {java_class} c ON c.fqn = s.class_fqn WHERE kind IN (1, 2, 5, 7)""",
    "role_bean": """
        SELECT s.id AS step_id, CASE WHEN step_kind = 'TASKLET' THEN 'bean_' || s.class_key END AS tasklet_bean, CASE WHEN step_kind = 'TASKLET' THEN a.fqn END AS tasklet_class,
               CASE WHEN step_kind = 'CHUNK' THEN 'bean_' || s.class_key END AS reader_bean, CASE WHEN step_kind = 'CHUNK' THEN a.fqn END AS reader_class,
               CASE WHEN step_kind = 'CHUNK' THEN 'other_' || s.class_key END AS processor_bean, CASE WHEN step_kind = 'CHUNK' THEN a.fqn END AS processor_class,
               cast(NULL AS varchar(20)) AS writer_bean, CASE WHEN step_kind = 'CHUNK' THEN 'com.nowhere.W' END AS writer_class
        FROM {step} s JOIN {java_class} a ON a.class_key = s.class_key""",
    # unresolved calls: declared class of the field, the injected bean class wins
    "raw_call": """
        SELECT DISTINCT m.fqn AS src_fqn, m.class_fqn, 'field' || (l.l_partkey % 3) AS field, t.fqn AS target_class,
               CASE l.l_linenumber % 3 WHEN 0 THEN 'execute' WHEN 1 THEN 'read' ELSE 'find' END AS name,
               CASE WHEN l.l_linenumber = 7 THEN m.class_fqn END AS via_class, CASE WHEN l.l_linenumber = 7 THEN m.name END AS via_name
        FROM {lineitem} l JOIN {java_method} m ON m.method_key = l.l_orderkey JOIN {java_class} t ON t.class_key = l.l_suppkey""",
    "injected": """
        SELECT a.fqn AS class_fqn, 'field1' AS field, b.fqn AS bean_class FROM {java_class} a JOIN {java_class} b ON b.class_key = a.parent_key WHERE a.class_key % 2 = 0""",
    "method_return": """
        SELECT m.fqn, m.class_fqn, m.name, m.further_analysis, c.fqn AS return_class FROM {java_method} m JOIN {java_class} k ON k.fqn = m.class_fqn LEFT JOIN {java_class} c ON c.class_key = k.class_key - 1""",
})

FIXTURES.update({
    "session_message": """
        SELECT conv_id AS session_id, turn, role, text, @from_millis@((1704067200 + conv_id * 3600 + turn * 60) * 1000) AS ts FROM {conversations}""",
})
