"""Session history and streaming queries; streams run to the end of the given tables."""

import uuid

from pyspark.sql import functions as F

from batchlens.operators import sessions as s
from batchlens.plans.registry import query
from batchlens.session import work_dir
from batchlens.sources.upsert import VersionedTable
from batchlens.streaming import runs as st


def run_stream(t):
    """Run records from the event stream, as the batch tables derive them."""
    e = st.parquet_stream(t.spark, t.dir, "events")
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "RUNNING").otherwise("COMPLETED")
    return e.select(
        F.concat(F.lit("JCE_"), "event_id").alias("id"), F.col("user_id"), F.col("ts").alias("start_ts"),
        F.round(F.col("value") * 1000).cast("bigint").alias("duration_ms"), status.alias("status"),
    )


@query("h1_session_tail", """
    SELECT session_id, turn, role, text, ts FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM {session_message}) WHERE rn <= 3""")
def h1(t):
    return s.session_tail(t.session_message, 3)


@query("h2_expire_sessions", """
    SELECT session_id, max(ts) AS last_update, count(*) AS message_count, max(ts) < TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 24 HOUR AS expired FROM {session_message} GROUP BY 1""")
def h2(t):
    return s.expire_sessions(t.session_message, "2024-01-05 00:00:00").sessions


@query("h2_expiry_summary", """
    SELECT count(*) FILTER (e) AS removed, count(*) FILTER (NOT e) AS active FROM (SELECT max(ts) < TIMESTAMP '2024-01-05 00:00:00' - INTERVAL 24 HOUR AS e FROM {session_message} GROUP BY session_id)""")
def h2_summary(t):
    return s.expire_sessions(t.session_message, "2024-01-05 00:00:00").summary


@query("h2_stream_expired_sessions", """
    SELECT session_id, max(ts) + INTERVAL 24 HOUR AS expired_at, count(*) AS message_count FROM {session_message} GROUP BY 1
    HAVING max(ts) + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM {session_message})""")
def h2_stream(t):
    c = st.parquet_stream(t.spark, t.dir, "conversations")
    ts = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return st.run_expired_sessions(c.select(F.col("conv_id").alias("session_id"), ts.alias("ts"))).expired


@query("r1_stream_runs", "SELECT id, start_ts, duration_ms, status, business_date, execution_date FROM {jce}")
def r1(t):
    runs = run_stream(t).drop("user_id")
    table = VersionedTable(t.spark, f"{work_dir(t.spark)}/runs-{uuid.uuid4().hex}", parts=8)
    return st.run_upsert(st.stream_runs(runs.unionByName(run_stream(t).drop("user_id"))), table, ["id"], ["start_ts"], "events")


@query("r2_stream_timeline", """
    SELECT business_date, count(*) AS total_executions, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'FAILED') AS failed FROM {jce} GROUP BY 1""")
def r2(t):
    return st.run_to_table(st.stream_timeline(run_stream(t)), "update", ["business_date"])


@query("r2_stream_failure_bursts", """
    SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, count(*) AS failures FROM (
        SELECT unnest([time_bucket(INTERVAL 30 MINUTE, start_ts), time_bucket(INTERVAL 30 MINUTE, start_ts) - INTERVAL 30 MINUTE]) AS w FROM {jce} WHERE status = 'FAILED') GROUP BY 1""")
def r2_bursts(t):
    return st.run_to_table(st.stream_failure_bursts(run_stream(t)), "update", ["window_start", "window_end"])


@query("r3_stream_resource_impact", """
    SELECT a.id AS rae_id, g.id AS jge_id, g.start_time_ms < a.availability_time_ms AS impacted
    FROM {rae} a JOIN {require_resource} q ON q.resource_id = a.resource_id AND q.owner_type = 'JOB_GROUP' JOIN {jge} g ON g.job_group_id = q.owner_id AND g.business_date = a.business_date""")
def r3(t):
    at = F.timestamp_seconds(F.unix_date("business_date").cast("bigint") * 86400 + F.col("availability_time_ms") / 1000)
    events = st.table_stream(t.rae.select(F.col("id").alias("rae_id"), "resource_id", "business_date", at.alias("available_ts")))
    needs = t.require_resource.where(F.col("owner_type") == "JOB_GROUP").select("resource_id", F.col("owner_id").alias("job_group_id"))
    runs = st.table_stream(t.jge.select(F.col("id").alias("jge_id"), "job_group_id", "business_date", F.col("start_ts").cast("timestamp").alias("start_ts")))
    return st.run_resource_impact(events, needs, runs).rows
