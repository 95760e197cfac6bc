"""The driver contract, and one cheap query of each family against SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from batchlens.sources.testdata import RAW
from tools.check import rows

DATA = "/root/testdata/sf0.001"
PICKED = (
    "x3_execution_timeline p3_duration_trend p9_duration_anomaly i13_calendar_weeks e17_eligible e19_anomaly_summary t1_reachable d2_jobgroup_execution_flow "
    "g1_entity_graph_edges k2_graph_schema s4_sla_coverage c6_longest_path j1_resolve_roots l6_job_topology v8_packages_by_missing_pct i17_calendar_associations "
    "i20_derive_context_runs i28_extract_ddl o4_tables_in_sql o7_detect_procedure_calls o20_step_resource_links h1_session_tail r2_stream_timeline"
).split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in RAW:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 200
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cur.fetchall())
