"""Batch-operations tables derived from the given star-schema tables.

Every table is one SQL statement in the subset that Spark SQL and DuckDB share,
so both sides of a cross-check start from the same rows.  ``{name}`` refers to
a given or derived table; ``@fn@`` names a function spelled differently in the
two dialects.  All rows of the given tables take part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_DIALECT = {
    "spark": {"json_text": "get_json_object", "micros": "unix_micros", "idiv": " div ", "from_millis": "timestamp_millis", "str_split": "split"},
    "duckdb": {"json_text": "json_extract_string", "micros": "epoch_us", "idiv": " // ", "from_millis": "epoch_ms", "str_split": "string_split"},
}

AS_OF = "2024-01-31"

# sizes: contexts, resources, jobs and classes all grow with the data
_S = "(SELECT count(*) FROM {supplier})"
_R = "(SELECT count(*) FROM {part})"
_C = "(SELECT count(*) FROM {customer})"
_J = f"(SELECT greatest(4, count(*) * 2 @idiv@ 5) FROM {{supplier}})"
GROUPS = 25

FIXTURES: dict[str, str] = {
    # ---- definitions -------------------------------------------------------
    "job_group": """
        SELECT 'JG_' || n_nationkey AS id, n_name AS name, 'Group of ' || n_name AS description,
               true AS enabled, CASE WHEN n_regionkey = 0 THEN 'HIGH' ELSE 'NORMAL' END AS priority,
               cast(n_nationkey AS bigint) AS group_key, cast(n_regionkey AS bigint) AS region_key
        FROM {nation}""",
    "group_precedes": """
        SELECT a.id AS src_id, b.id AS dst_id, 'COMPLETED' AS on_status
        FROM {job_group} a JOIN {job_group} b ON b.group_key = a.group_key + 5""",
    "job": f"""
        SELECT DISTINCT 'JOB_' || k AS id, 'LOAD_' || k AS name,
               CASE WHEN k % 5 = 0 THEN 'dynamic_job' ELSE 'spring_xml_config_job' END AS type,
               true AS enabled, 'jobs/job_' || k || '.xml' AS source_file, k % 2 = 0 AS restartable,
               'repo_' || (k % 3) AS git_repo, k AS job_key
        FROM (SELECT cast(s_suppkey % {_J} AS bigint) AS k FROM {{supplier}}) x""",
    "sic": f"""
        SELECT 'SIC_' || s_suppkey AS id, 'Context_LOAD_' || (s_suppkey % {_J}) AS name, true AS enabled,
               'JOB_' || (s_suppkey % {_J}) AS job_id, 'JG_' || (s_suppkey % {GROUPS}) AS job_group_id,
               s_suppkey AS sic_key, s_suppkey % {GROUPS} AS group_key
        FROM {{supplier}}""",
    "has_job": "SELECT DISTINCT job_group_id, job_id FROM {sic}",
    # tree over all contexts, and within each group by rank (key div 25)
    "sic_precedes": f"""
        SELECT DISTINCT 'SIC_' || src AS src_id, 'SIC_' || dst AS dst_id FROM (
            SELECT s_suppkey AS src, 2 * s_suppkey + 1 AS dst FROM {{supplier}}
            UNION ALL SELECT s_suppkey, 2 * s_suppkey + 2 FROM {{supplier}}
            UNION ALL SELECT s_suppkey, (2 * (s_suppkey @idiv@ {GROUPS}) + 1) * {GROUPS} + s_suppkey % {GROUPS} FROM {{supplier}}
            UNION ALL SELECT s_suppkey, (2 * (s_suppkey @idiv@ {GROUPS}) + 2) * {GROUPS} + s_suppkey % {GROUPS} FROM {{supplier}}
            UNION ALL SELECT s_suppkey, (2 * (s_suppkey @idiv@ {GROUPS}) + 3) * {GROUPS} + s_suppkey % {GROUPS} FROM {{supplier}}
        ) e WHERE dst < {_S}""",
    "entry": f"SELECT job_group_id, id AS sic_id FROM {{sic}} WHERE sic_key < {GROUPS}",
    "sla": """
        SELECT 'SIC' AS owner_type, id AS owner_id, name AS owner_name, 'SLA_' || id AS sla_id, 'Sla of ' || id AS sla_name,
               CASE WHEN sic_key % 13 = 5 THEN false WHEN sic_key % 7 = 0 THEN NULL ELSE true END AS enabled,
               CASE WHEN sic_key % 3 = 0 THEN 'RELATIVE' ELSE 'ABSOLUTE' END AS sla_type,
               CASE WHEN sic_key % 3 = 0 THEN cast(60000 AS bigint) END AS duration_ms,
               CASE WHEN sic_key % 3 = 1 THEN cast(72000000 AS bigint) END AS time_ms
        FROM {sic} WHERE sic_key % 3 <> 2
        UNION ALL
        SELECT 'JOB_GROUP', id, name, 'SLA_' || id, 'Sla of ' || id, true,
               CASE WHEN group_key % 4 = 0 THEN 'ABSOLUTE' ELSE 'RELATIVE' END,
               CASE WHEN group_key % 4 = 1 THEN cast(90000 AS bigint) END,
               CASE WHEN group_key % 4 = 0 THEN cast(75600000 AS bigint) END
        FROM {job_group} WHERE group_key % 4 < 2""",
    "resource": """
        SELECT 'RES_' || p_partkey AS id, upper(replace(p_name, ' ', '_')) || '_' || p_partkey AS name,
               CASE p_partkey % 5 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'FILE' WHEN 2 THEN 'SHELL_SCRIPT' WHEN 3 THEN 'PROCEDURE' ELSE 'SQL_SCRIPT' END AS type,
               'S' || (p_partkey % 3) AS schema_name, p_brand AS brand, true AS enabled, p_partkey AS resource_key
        FROM {part}""",
    "require_resource": f"""
        SELECT 'SIC' AS owner_type, id AS owner_id, 'RES_' || (sic_key % {_R}) AS resource_id FROM {{sic}}
        UNION ALL
        SELECT 'JOB_GROUP', id, 'RES_' || ((group_key * 7) % {_R}) FROM {{job_group}}
        UNION ALL
        SELECT 'JOB', id, 'RES_' || ((job_key * 11) % {_R}) FROM {{job}}""",
    "tag": "SELECT 'TAG_' || r_regionkey AS id, r_name AS name, 'Region tag' AS description FROM {region}",
    "has_tag": """
        SELECT 'JOB_GROUP' AS owner_type, id AS owner_id, 'TAG_' || region_key AS tag_id FROM {job_group}
        UNION ALL SELECT 'JOB', id, 'TAG_' || (job_key % 5) FROM {job}
        UNION ALL SELECT 'RESOURCE', id, 'TAG_' || (resource_key % 5) FROM {resource}""",
    # ---- run history -------------------------------------------------------
    "jce": f"""
        SELECT 'JCE_' || event_id AS id, 'JG_' || (k % {GROUPS}) || '_' || cast(bd AS varchar(10)) AS jge_id,
               'SIC_' || k AS sic_id, 'JOB_' || (k % {_J}) AS job_id, 'JG_' || (k % {GROUPS}) AS job_group_id,
               bd AS business_date, cast(ts AS date) AS execution_date, ts AS start_ts,
               @micros@(ts) @idiv@ 1000 % 86400000 AS start_time_ms, (@micros@(ts) @idiv@ 1000 + dur) % 86400000 AS end_time_ms,
               dur AS duration_ms, status, CASE WHEN status = 'FAILED' THEN code END AS exit_code,
               CASE WHEN status = 'FAILED' THEN 'E' || (cast(code AS bigint) % 10) END AS exit_message
        FROM (SELECT event_id, ts, user_id % {_S} AS k,
                     CASE WHEN hour(ts) >= 18 THEN cast(ts AS date) + 1 ELSE cast(ts AS date) END AS bd,
                     cast(round(value * 1000) AS bigint) AS dur, @json_text@(props, '$.k') AS code,
                     CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'RUNNING' ELSE 'COMPLETED' END AS status
              FROM {{events}}) e""",
    "jge": """
        SELECT jge_id AS id, job_group_id, business_date, min(start_ts) AS start_ts,
               @micros@(min(start_ts)) @idiv@ 1000 % 86400000 AS start_time_ms, cast(min(start_ts) AS date) AS execution_date
        FROM {jce} GROUP BY jge_id, job_group_id, business_date""",
    "rae": f"""
        SELECT 'RAE_' || o_orderkey AS id, 'RES_' || (o_custkey % {_R}) AS resource_id,
               DATE '2024-01-01' + cast(o_orderkey % 30 AS int) AS business_date,
               (o_orderkey * 37) % 86400 * 1000 AS availability_time_ms, o_totalprice / 1000 AS size_mb
        FROM {{orders}}""",
    # ---- calendar rules ----------------------------------------------------
    "business_calendar": """
        SELECT * FROM (VALUES
            (0, 'RULE_00', 'nth_multi_dow_month', '{"daysOfWeek":[1,2,3,4,5],"weekOccurrences":[1,2,3,4,5]}'),
            (1, 'RULE_01', 'nth_dow_month', '{"dayOfWeek":2,"weekOccurrences":[1,3]}'),
            (2, 'RULE_02', 'nth_dom', '{"daysOfMonth":[1,10,15,20,28],"months":[1,2,3]}'),
            (3, 'RULE_03', 'nth_first_biz_month', '{"bizDayFromStart":[1,2,10]}'),
            (4, 'RULE_04', 'nth_last_biz_month', '{"bizDayFromEnd":[1,2,5]}'),
            (5, 'RULE_05', 'nth_first_biz_quarter', '{"bizDayFromStart":[1,2,3],"quarters":[1]}'),
            (6, 'RULE_06', 'nth_last_biz_quarter', '{"bizDayFromEnd":[1,40,50]}'),
            (7, 'RULE_07', 'first_biz_year', '{}'),
            (8, 'RULE_08', 'last_biz_year', '{}'),
            (9, 'RULE_09', 'holiday', '{}'),
            (10, 'RULE_10', 'graph_property', '{"nodeName":"Day","propertyName":"isWeekend"}'),
            (11, 'RULE_11', 'named_holiday', '{"holidayDates":["2024-01-15","2024-01-26"]}'),
            (12, 'RULE_12', 'specific_date', '{"targetDates":["2024-01-02T00:00:00","bad","2024-01-17"]}'),
            (13, 'RULE_13', 'holiday', '{"region":"US"}'),
            (14, 'RULE_14', 'no_such_evaluator', '{}'),
            (15, 'RULE_15', 'nth_dom', 'not json')
        ) AS v(rule_key, rule_id, evaluator_fn, params)""",
    "holiday": """
        SELECT cast(d AS date) AS holiday_date, region, name FROM (VALUES
            ('2024-01-01', 'ALL', 'New Year'), ('2024-01-15', 'US', 'King Day'), ('2024-01-26', 'IN', 'Republic Day')
        ) AS v(d, region, name)""",
    "calendar_rule_assoc": """
        SELECT 'JOB_GROUP' AS context_type, id AS context_id, 'RULE_' || lpad(cast(group_key % 13 AS varchar(4)), 2, '0') AS rule_id, 'ALLOWS' AS rule_type
        FROM {job_group} WHERE group_key < 23
        UNION ALL
        SELECT 'JOB_GROUP', id, 'RULE_09', 'DENIES' FROM {job_group} WHERE group_key % 3 = 0 AND group_key < 23
        UNION ALL
        SELECT 'JOB_GROUP', id, 'RULE_13', 'DENIES' FROM {job_group} WHERE group_key = 23
        UNION ALL
        SELECT 'SIC', id, 'RULE_12', 'DENIES' FROM {sic} WHERE sic_key % 11 = 0
        UNION ALL
        SELECT 'SIC', id, 'RULE_00', 'ALLOWS' FROM {sic} WHERE sic_key % 5 = 0""",
    # ---- code --------------------------------------------------------------
    "java_class": f"""
        SELECT 'com.acme.p' || (c_custkey % 20) || '.' || cname AS fqn, cname AS name, 'com.acme.p' || (c_custkey % 20) AS package,
               c_custkey % 7 = 3 AS is_interface, c_custkey % 29 = 1 AS is_test, c_custkey AS class_key,
               CASE WHEN c_custkey > 0 THEN c_custkey @idiv@ 3 END AS parent_key
        FROM (SELECT c_custkey, 'C' || c_custkey || CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Dao' WHEN 'BUILDING' THEN 'ServiceImpl'
                     WHEN 'MACHINERY' THEN 'ShellRunner' WHEN 'HOUSEHOLD' THEN 'DefaultRepository' ELSE 'Step' END AS cname
              FROM {{customer}}) c""",
    "extends": """
        SELECT a.fqn AS child_fqn, b.fqn AS parent_fqn FROM {java_class} a JOIN {java_class} b ON a.parent_key = b.class_key""",
    "java_method": """
        SELECT c.fqn || '.' || m.mname || '_' || m.mkey || '()' AS fqn, c.fqn AS class_fqn, m.mname AS name, m.mkey AS method_key,
               m.mkey % 17 = 0 AS further_analysis
        FROM (SELECT o_orderkey AS mkey, o_custkey AS ckey,
                     CASE o_orderkey % 6 WHEN 0 THEN 'execute' WHEN 1 THEN 'read' WHEN 2 THEN 'process' WHEN 3 THEN 'write'
                          WHEN 4 THEN 'find' ELSE 'save' END AS mname FROM {orders}) m
        JOIN {java_class} c ON c.class_key = m.ckey""",
    "calls": """
        SELECT a.fqn AS src_fqn, b.fqn AS dst_fqn
        FROM (SELECT DISTINCT l_orderkey AS src, l_orderkey @idiv@ 4 + l_partkey % 3 AS dst FROM {lineitem}) e
        JOIN {java_method} a ON a.method_key = e.src JOIN {java_method} b ON b.method_key = e.dst
        WHERE e.src <> e.dst""",
    "db_operation": """
        SELECT DISTINCT m.fqn AS method_fqn,
               CASE WHEN l_discount = 0 THEN 'DYNAMIC_TABLE' ELSE 'T_' || l_suppkey END AS table_name,
               CASE l_returnflag WHEN 'A' THEN 'SELECT' WHEN 'N' THEN 'INSERT' ELSE 'UPDATE' END AS operation_type,
               CASE l_linestatus WHEN 'O' THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
        FROM {lineitem} l JOIN {java_method} m ON m.method_key = l.l_orderkey""",
    "step": f"""
        SELECT 'STEP_' || j || '_' || o AS id, 'step ' || j || ' ' || o AS name, 'JOB_' || j AS job_id, o AS step_order,
               CASE WHEN (j + o) % 2 = 0 THEN 'TASKLET' ELSE 'CHUNK' END AS step_kind,
               (j * 3 + o) * 7 % {_C} AS class_key, j AS job_key
        FROM (SELECT job_key AS j, 0 AS o FROM {{job}} UNION ALL SELECT job_key, 1 FROM {{job}} UNION ALL SELECT job_key, 2 FROM {{job}}) s""",
    "step_class": f"""
        SELECT s.id AS step_id, s.step_kind, b.role, c.fqn AS class_fqn
        FROM {{step}} s
        JOIN (SELECT 'TASKLET' AS kind, 'tasklet' AS role, 0 AS off UNION ALL SELECT 'CHUNK', 'reader', 0
              UNION ALL SELECT 'CHUNK', 'processor', 1 UNION ALL SELECT 'CHUNK', 'writer', 2) b ON b.kind = s.step_kind
        JOIN {{java_class}} c ON c.class_key = s.class_key + b.off""",
    "implements_ref": f"""
        SELECT c.fqn AS class_fqn, r.ref FROM {{java_class}} c JOIN (
            SELECT x.class_key, y.fqn AS ref FROM {{java_class}} x JOIN {{java_class}} y ON y.class_key = x.class_key - x.class_key % 14 + 3 WHERE x.class_key % 3 = 1
            UNION ALL SELECT class_key, 'Missing' || (class_key % 10) FROM {{java_class}} WHERE class_key % 3 = 2
            UNION ALL SELECT x.class_key, CASE WHEN x.class_key % 2 = 0 THEN y.fqn ELSE y.name END FROM {{java_class}} x JOIN {{java_class}} y ON y.class_key = x.class_key + 20 WHERE x.class_key % 3 = 1
        ) r ON r.class_key = c.class_key WHERE NOT c.is_interface""",
    "step_op": """
        SELECT DISTINCT s.step_id, d.operation_type || ':' || d.table_name || ':' || d.confidence AS op
        FROM {step_class} s JOIN {java_method} m ON m.class_fqn = s.class_fqn JOIN {db_operation} d ON d.method_fqn = m.fqn""",
    "step_resource": f"""
        SELECT id AS step_id, 'RES_' || ((job_key * 3 + step_order) % {_R}) AS resource_id FROM {{step}}""",
    "script_sql": "SELECT 'RES_' || resource_key AS script_id, 'RES_' || (resource_key + 2) AS sql_id FROM {resource} WHERE type = 'SHELL_SCRIPT'",
    "listener": "SELECT 'LSN_' || job_key AS id, id AS job_id, 'jobListener' || (job_key % 3) AS bean, 'JOB' AS scope FROM {job}",
    # ---- job-internal flow: steps, one decision and one block per job ---------
    "flow_node": """
        SELECT id, 'Step' AS label, name, job_id, step_kind, cast(NULL AS varchar(10)) AS block_type FROM {step}
        UNION ALL SELECT 'DEC_' || job_key, 'Decision', 'decide ' || job_key, id, NULL, NULL FROM {job}
        UNION ALL SELECT 'BLK_' || job_key, 'Block', 'block ' || job_key, id, NULL, 'PARALLEL' FROM {job}""",
    "flow_edge": """
        SELECT id AS job_id, 'STEP_' || job_key || '_0' AS src_id, 'DEC_' || job_key AS dst_id, cast(NULL AS varchar(10)) AS on_status FROM {job}
        UNION ALL SELECT id, 'DEC_' || job_key, 'STEP_' || job_key || '_1', 'COMPLETED' FROM {job}
        UNION ALL SELECT id, 'DEC_' || job_key, 'BLK_' || job_key, 'FAILED' FROM {job}
        UNION ALL SELECT id, 'BLK_' || job_key, 'STEP_' || job_key || '_2', NULL FROM {job} WHERE type = 'dynamic_job'
        UNION ALL SELECT id, 'STEP_' || job_key || '_1', 'STEP_' || job_key || '_2', NULL FROM {job}""",
    "job_entry": "SELECT id AS job_id, 'STEP_' || job_key || '_0' AS node_id FROM {job}",
    # ---- what-if scenarios: every context, job, group and resource ------------
    "scenario": """
        SELECT 'SC_' || id AS scenario_id, 'sic' AS source_type, id AS source_id,
               CASE sic_key % 3 WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE 90 END AS delay_minutes, DATE '2024-01-31' AS business_date FROM {sic}
        UNION ALL SELECT 'SC_' || id, 'JOB', name, 45, DATE '2024-01-31' FROM {job}
        UNION ALL SELECT 'SC_' || id, 'Job-Group', name, 120, DATE '2024-01-31' FROM {job_group}
        UNION ALL SELECT 'SC_' || id, ' resource', name, 30, DATE '2024-01-31' FROM {resource}""",
    # ---- one node list and one edge list over all labels ---------------------
    "node_view": """
        SELECT 'JobGroup' AS label, id, name, description, cast(NULL AS varchar(40)) AS type, enabled, cast(NULL AS varchar(20)) AS status FROM {job_group}
        UNION ALL SELECT 'Job', id, name, NULL, type, enabled, NULL FROM {job}
        UNION ALL SELECT 'ScheduleInstanceContext', id, name, NULL, NULL, enabled, NULL FROM {sic}
        UNION ALL SELECT 'Resource', id, name, NULL, type, enabled, NULL FROM {resource}
        UNION ALL SELECT 'SLA', sla_id, sla_name, NULL, sla_type, enabled, NULL FROM {sla}
        UNION ALL SELECT 'Tag', id, name, description, NULL, NULL, NULL FROM {tag}
        UNION ALL SELECT 'JobGroupExecution', id, NULL, NULL, NULL, NULL, NULL FROM {jge}
        UNION ALL SELECT 'JobContextExecution', id, NULL, NULL, NULL, NULL, status FROM {jce}""",
    "edge_view": """
        SELECT 'FOR_GROUP' AS type, 'ScheduleInstanceContext' AS src_label, id AS src_id, 'JobGroup' AS dst_label, job_group_id AS dst_id FROM {sic}
        UNION ALL SELECT 'FOR_JOB', 'ScheduleInstanceContext', id, 'Job', job_id FROM {sic}
        UNION ALL SELECT 'HAS_JOB', 'JobGroup', job_group_id, 'Job', job_id FROM {has_job}
        UNION ALL SELECT 'PRECEDES', 'ScheduleInstanceContext', src_id, 'ScheduleInstanceContext', dst_id FROM {sic_precedes}
        UNION ALL SELECT 'PRECEDES', 'JobGroup', src_id, 'JobGroup', dst_id FROM {group_precedes}
        UNION ALL SELECT 'ENTRY', 'JobGroup', job_group_id, 'ScheduleInstanceContext', sic_id FROM {entry}
        UNION ALL SELECT 'HAS_SLA', CASE owner_type WHEN 'SIC' THEN 'ScheduleInstanceContext' ELSE 'JobGroup' END, owner_id, 'SLA', sla_id FROM {sla}
        UNION ALL SELECT 'REQUIRE_RESOURCE', CASE owner_type WHEN 'SIC' THEN 'ScheduleInstanceContext' WHEN 'JOB' THEN 'Job' ELSE 'JobGroup' END, owner_id, 'Resource', resource_id FROM {require_resource}
        UNION ALL SELECT 'HAS_TAG', CASE owner_type WHEN 'RESOURCE' THEN 'Resource' WHEN 'JOB' THEN 'Job' ELSE 'JobGroup' END, owner_id, 'Tag', tag_id FROM {has_tag}
        UNION ALL SELECT 'EXECUTES_JOB_GROUP', 'JobGroupExecution', id, 'JobGroup', job_group_id FROM {jge}
        UNION ALL SELECT 'EXECUTES_JOB_CONTEXT', 'JobGroupExecution', jge_id, 'JobContextExecution', id FROM {jce}
        UNION ALL SELECT 'EXECUTES_CONTEXT', 'JobContextExecution', id, 'ScheduleInstanceContext', sic_id FROM {jce}""",
}


def _dialect(text: str, which: str) -> str:
    return re.sub(r"@(\w+)@", lambda m: _DIALECT[which][m.group(1)], text)


def duckdb_text(text: str) -> str:
    """The statement with DuckDB spellings and plain table names."""
    return re.sub(r"\{(\w+)\}", r"\1", _dialect(text, "duckdb"))


class Tables:
    """Given and derived tables of one data folder, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._tag = "bl_" + re.sub(r"\W", "_", self.dir.strip("/"))
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._build(name)
        return self._made[name]

    def _build(self, name: str) -> DataFrame:
        if name in RAW:
            df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            for field in df.schema.fields:
                if field.dataType.typeName() == "timestamp_ntz":
                    df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
            return df
        if name not in FIXTURES:
            raise AttributeError(name)
        return self.sql(FIXTURES[name])

    def sql(self, text: str) -> DataFrame:
        """Run a statement that refers to tables as ``{name}``."""

        def view(match: re.Match) -> str:
            name = match.group(1)
            label = f"{self._tag}_{name}"
            getattr(self, name).createOrReplaceTempView(label)
            return label

        return self.spark.sql(re.sub(r"\{(\w+)\}", view, _dialect(text, "spark")))
