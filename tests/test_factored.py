"""The projection kept by groups against the one that has a row for each scenario and context."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from batchlens.operators import factored as fw
from batchlens.operators import whatif as w

DAY, NEXT = dt.date(2024, 1, 31), dt.date(2024, 2, 1)
AS_OF = "2024-01-31"


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def make(spark, seed, cycle=False, negative=False):
    """Frames with repeated and null keys, contexts without runs, and groups that come after themselves."""
    rng = random.Random(seed)
    ids = [f"S{i:02d}" for i in range(26)]
    home = {x: f"G{rng.randrange(5)}" for x in ids}
    sics = [(x, f"n{i % 20}", f"J{i % 7}", home[x]) for i, x in enumerate(ids)] + [(ids[3], "n3", "J3", home[ids[3]]), (ids[9], "n9", "J2", "G4"), (None, "nn", "J1", "G1")]
    edges = [(ids[i], ids[j]) for i in range(26) for j in range(i + 1, 26) if rng.random() < 0.09]
    edges += [edges[0], (None, ids[5]), (ids[5], None), (ids[4], "S99"), ("S98", ids[20])] + ([(ids[25], ids[6]), (ids[6], ids[25])] if cycle else [])
    group_edges = [("G0", "G1"), ("G1", "G2"), ("G2", "G3"), ("G3", "G1"), ("G0", "G4"), ("G0", "G4"), (None, "G0")]
    scenarios = [(f"SC_{x}", "sic", x, rng.choice([0, 20, 90]), rng.choice([DAY, NEXT])) for x in ids] + [(f"SC_J{k}", "JOB", f"J{k}", 45, DAY) for k in range(7)]
    scenarios += [(f"SC_G{k}", "Job-Group", f"G{k}", 120, NEXT) for k in range(5)] + [("SC_R", "resource", "R1", None, DAY), ("SC_X", "sic", "none", 5, DAY)]
    scenarios += [(scenarios[2][0], "sic", ids[2], 30, scenarios[2][4]), (scenarios[4][0], "sic", ids[5], 10, NEXT)]
    runs = []
    for i, x in enumerate(ids):
        for n in range(0 if i % 6 == 1 else rng.randrange(1, 8)):
            day = DAY - dt.timedelta(days=n)
            long = -5 if negative and i == 8 else rng.randrange(0, 900_000)
            runs.append((f"E{x}{n}", f"{home[x]}_{day}", x, day, dt.datetime.combine(day, dt.time(3)), day, 10_800_000 + n, 11_000_000 + rng.randrange(10_000), long, "COMPLETED"))
    sla = [("SIC", x, x, f"L{x}", f"l{x}", rng.choice([True, None, False]), kind, 60_000 if kind == "RELATIVE" else None, 20_000_000 if kind == "ABSOLUTE" else None)
           for i, x in enumerate(ids) if i % 3 for kind in [rng.choice(["RELATIVE", "ABSOLUTE"])]]
    sla += [("JOB_GROUP", g, g, f"L{g}{n}", g, True, "ABSOLUTE", None, 15_000_000 + n) for g in ("G1", "G2") for n in range(2)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    named = "id string, name string"
    return dict(
        scenarios=frame(scenarios, "scenario_id string, source_type string, source_id string, delay_minutes int, business_date date"),
        sics=frame(sics, "id string, name string, job_id string, job_group_id string"), job=frame([(f"J{k}", f"j{k}") for k in range(7)], named),
        job_group=frame([(f"G{k}", f"g{k}") for k in range(5)], named), resource=frame([("R1", "r1")], named),
        require=frame([("SIC", ids[2], "R1"), ("JOB_GROUP", "G3", "R1")], "owner_type string, owner_id string, resource_id string"),
        edges=frame(edges, "src_id string, dst_id string"), group_edges=frame(group_edges, "src_id string, dst_id string"),
        sla=frame(sla, "owner_type string, owner_id string, owner_name string, sla_id string, sla_name string, enabled boolean, sla_type string, duration_ms long, time_ms long"),
        runs=frame(runs, "id string, jge_id string, sic_id string, business_date date, start_ts timestamp, execution_date date, start_time_ms long, end_time_ms long, duration_ms long, status string"),
        as_of=AS_OF,
    )


@pytest.fixture(scope="module", params=[8])
def both(spark, request):
    frames = make(spark, request.param)
    return frames, w.impact_frame(**frames), fw.impact_frame(**frames)


def test_nodes_are_those_of_all_rows(spark, both):
    _, whole, parts = both
    cols = ["scenario_id", "node", "job_group_id", "deadline_ms", "dur", "duration_source"]
    assert parts.parts is not None
    assert rows_of(fw.nodes(parts), cols) == rows_of(whole.nodes, cols)


def test_listed_contexts_are_not_shuffled_one_by_one(spark, both):
    """A row for every scenario and context of later groups was written and shuffled several times."""
    _, whole, parts = both
    assert parts.parts.direct.count() < whole.nodes.count()
    plan = fw.listed(parts.parts, parts.parts.member.select("kind", "node", "dur"))._jdf.queryExecution().optimizedPlan().toString()
    top = plan.splitlines()[:3]
    assert any("Generate inline" in line for line in top) and not any("Join" in line for line in top[:2])


def test_delays_are_those_of_all_rows(spark, both):
    _, whole, parts = both
    cols = ["scenario_id", "node", "propagated_delay_ms"]
    assert rows_of(fw.propagated_delay(parts), cols) == rows_of(w.propagated_delay(whole.nodes, whole.links), cols)


def test_finishes_are_those_of_all_rows(spark, both):
    _, whole, parts = both
    cols = ["scenario_id", "node", "delay", "baseline", "projected"]
    idle = whole.nodes.withColumn("executed_ms", F.lit(None).cast("bigint"))
    assert rows_of(fw.finish_projection(parts, 5), cols) == rows_of(w.finish_projection(idle, whole.links, 5), cols)


def test_tails_are_those_of_all_rows(spark, both):
    _, whole, parts = both
    cols = ["scenario_id", "node", "downstream_after_ms"]
    assert rows_of(fw.downstream_tail(parts), cols) == rows_of(w.downstream_tail(whole.nodes, whole.links), cols)


def test_finishes_on_each_scenarios_date(spark):
    frames = make(spark, 3)
    whole, parts = w.impact_frame(**frames), fw.impact_frame(**frames, dated=True)
    runs = [(f"S{i:02d}", day, i * 1000, 400_000 + i) for i in range(0, 26, 2) for day in ([DAY, NEXT] if i % 4 else [NEXT])]
    latest = spark.createDataFrame(runs, "sic_id string, business_date date, duration_ms long, end_time_ms long")
    cols = ["scenario_id", "node", "delay", "baseline", "projected"]
    ran = w.actual_on_date(frames["scenarios"], latest).select("scenario_id", "node", "executed_ms")
    want = w.finish_projection(whole.nodes.join(ran, ["scenario_id", "node"], "left"), whole.links)
    assert rows_of(fw.finish_projection(parts, latest=latest, scenarios=frames["scenarios"]), cols) == rows_of(want, cols)


@pytest.mark.parametrize("odd", ["cycle", "negative"])
def test_cycles_and_negative_durations_take_the_long_way(spark, odd):
    frames = make(spark, 5, **{odd: True})
    parts = fw.impact_frame(**frames)
    cols = ["scenario_id", "node", "dur"]
    assert parts.parts is None
    whole = w.impact_frame(**frames)
    assert rows_of(fw.nodes(parts), cols) == rows_of(whole.nodes, cols)
    assert fw.propagated_delay(parts).count() == fw.downstream_tail(parts).count() == fw.finish_projection(parts).count() == whole.nodes.count()
