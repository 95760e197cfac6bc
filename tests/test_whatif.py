"""Projections against a sequential simulation of the documented order."""

import random
import re

from pyspark.sql import functions as F

from batchlens.operators import whatif as w
from batchlens.operators.traverse import reachable

NODE = "scenario_id string, node string, job_group_id string, is_root boolean, delay_ms long, dur long, deadline_ms long, executed_ms long"


def scenario(rng, sid):
    n = rng.randrange(4, 11)
    names = [f"n{i:02d}" for i in range(n)]
    groups = [f"g{rng.randrange(4)}" for _ in names]
    delay = rng.choice([0, 60_000, 500_000])
    roots = set(rng.sample(names, rng.randrange(1, 3)))
    rows = [
        (sid, x, g, x in roots, delay, None if rng.random() < 0.25 else rng.randrange(0, 900), None if rng.random() < 0.4 else rng.randrange(0, 5000),
         None if rng.random() < 0.6 else rng.randrange(0, 9000))
        for x, g in zip(names, groups)
    ]
    edges = {(names[i], names[j]) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.2}
    return rows, edges


def levels(names, edges):
    out = {}
    for x in sorted(names):
        out[x] = max([out[a] + 1 for a, b in edges if b == x], default=0)
    return out


def simulate(rows, edges):
    info = {r[1]: r for r in rows}
    lv = levels(info, edges)
    home = {r[2] for r in rows if r[3]}
    preds = {x: [a for a, b in edges if b == x] for x in info}
    delay, proj, best = {}, {}, {}

    def placed_in(x):
        return [proj[p] for p in preds[x] if proj.get(p) is not None]

    def settle(x, value):
        proj[x] = value
        if value is not None:
            g = info[x][2]
            best[g] = max(best.get(g, value), value)

    def delays(x):
        own = info[x][4] if info[x][3] else 0
        delay[x] = max([own] + [delay.get(p, 0) for p in preds[x]])

    def alone(x):
        return (info[x][6] or 0) + info[x][5]

    for x in sorted((x for x in info if info[x][2] in home), key=lambda x: (lv[x], x)):
        delays(x)
        _, _, _, root, _, dur, dead, _ = info[x]
        if dur is None:
            settle(x, None)
        elif root and dead is not None:
            settle(x, dead + delay[x])
        elif placed_in(x):
            settle(x, max(placed_in(x)) + dur)
        else:
            settle(x, alone(x))
    away = [x for x in info if info[x][2] not in home]
    for level in sorted({lv[x] for x in away}):
        here = [x for x in away if lv[x] == level]
        for x in here:
            delays(x)
        for x in sorted(x for x in here if info[x][5] is None or placed_in(x)):
            settle(x, None if info[x][5] is None else max(placed_in(x)) + info[x][5])
        for x in sorted((x for x in here if x not in proj), key=lambda x: (info[x][2], x)):
            others = [v for g, v in best.items() if g != info[x][2]]
            settle(x, max(others) + info[x][5] if others else alone(x))
    return delay, proj


def test_projection_equals_simulation(spark):
    rng = random.Random(11)
    rows, links, want = [], [], {}
    for i in range(60):
        r, e = scenario(rng, f"s{i}")
        rows += r
        links += [(f"s{i}", a, b) for a, b in e]
        d, p = simulate(r, e)
        want.update({(f"s{i}", x): (d[x], p[x]) for x in d})
    nodes = spark.createDataFrame(rows, NODE)
    e = spark.createDataFrame(links, "scenario_id string, src_id string, dst_id string")
    got = {(r.scenario_id, r.node): (r.propagated_delay_ms, r.projected_finish_ms) for r in w.sla_based_projection(nodes, e).collect()}
    assert got == want
    delays = {(r.scenario_id, r.node): r.propagated_delay_ms for r in w.propagated_delay(nodes, e).collect()}
    assert delays == {k: v[0] for k, v in want.items()}


def test_tail_and_start_anchored_finish(spark):
    rng = random.Random(5)
    rows, links, tails, ends = [], [], {}, {}
    for i in range(30):
        r, e = scenario(rng, f"s{i}")
        rows += r
        links += [(f"s{i}", a, b) for a, b in e]
        info = {x[1]: x for x in r}
        total = {}
        for x in sorted(info, reverse=True):
            dur = info[x][5]
            known = [total[b] for a, b in e if a == x and total[b] is not None]
            total[x] = None if dur is None else dur + max(known, default=0)
            tails[(f"s{i}", x)] = None if dur is None else total[x] - dur
        delay, base, proj = {}, {}, {}
        for x in sorted(info):
            _, _, _, root, d, dur, _, ran = info[x]
            ps = [a for a, b in e if b == x]
            delay[x] = max([d if root else 0] + [delay[p] for p in ps])
            b0 = max([100] + [base[p] for p in ps if base[p] is not None])
            p0 = max([100] + [proj[p] for p in ps if proj[p] is not None])
            if dur is None:
                base[x] = proj[x] = None
            elif ran is not None:
                base[x] = ran
                proj[x] = ran + delay[x] if root else ran
                delay[x] = delay[x] if root else 0
            else:
                base[x], proj[x] = b0 + dur, p0 + dur + delay[x]
            ends[(f"s{i}", x)] = (delay[x], base[x], proj[x])
    nodes = spark.createDataFrame(rows, NODE)
    e = spark.createDataFrame(links, "scenario_id string, src_id string, dst_id string")
    assert {(r.scenario_id, r.node): r.downstream_after_ms for r in w.downstream_tail(nodes, e).collect()} == tails
    assert {(r.scenario_id, r.node): (r.delay, r.baseline, r.projected) for r in w.finish_projection(nodes, e, 100).collect()} == ends


def test_source_types_are_normalised(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Job-Group",), (" jobgroup ",), ("SIC",), ("planet",), (None,)], "t string")
    assert [r.k for r in df.select(w.source_kind(F.col("t")).alias("k")).collect()] == ["job_group", "job_group", "sic", None, None]


def test_stored_pairs_are_not_broadcast_by_their_file_size(spark):
    """Names that repeat make small files; the rows are what a broadcast would put into the driver."""
    pairs = spark.range(400_000).select(F.format_string("SC_%010d", F.col("id") % 40).alias("scenario_id"), F.format_string("SIC_%010d", F.floor(F.col("id") / 40)).alias("node"))
    edges = spark.createDataFrame([("a", "b")], "src_id string, dst_id string")
    walked = reachable(edges, pairs, ["scenario_id"])
    met = walked.join(walked.withColumnRenamed("distance", "again"), ["scenario_id", "node"])
    assert "BroadcastExchange" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 400_000


def test_links_are_freed_of_repeats_before_the_joins_and_only_there(spark):
    """Links outnumber nodes: a distinct over them, and further ones in levels and waves, were most of the projection's shuffles."""
    nodes = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("s", "c"), ("t", "b"), ("t", "c"), (None, "a")], "scenario_id string, node string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), (None, "a")], "src_id string, dst_id string")
    links = w.scenario_edges(nodes, edges)
    assert sorted(tuple(r) for r in links.collect()) == [("s", "a", "b"), ("s", "a", "c"), ("s", "b", "c"), ("t", "b", "c")]
    assert not links._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
    known = nodes.where("scenario_id IS NOT NULL").distinct().withColumn("dur", F.lit(5).cast("bigint"))
    placed = w.with_levels(known, links, induced=True)
    assert sorted(tuple(r) for r in placed.collect()) == sorted(tuple(r) for r in w.with_levels(known, links).collect())
    tails = [sorted(tuple(r) for r in w.downstream_tail(placed, e).collect()) for e in (links, links.unionByName(links))]
    assert tails[0] == tails[1] == [("s", "a", 10), ("s", "b", 5), ("s", "c", 0), ("t", "b", 5), ("t", "c", 0)]


def test_contexts_of_later_groups_are_not_shuffled_one_by_one(spark, monkeypatch):
    """Only cells of a group meet the contexts already impacted; repeated and null ids stay as in a plain join."""
    monkeypatch.setattr(w, "CELL", 2, raising=False)
    sics = [("a0", "A"), ("b0", "B"), ("b1", "B"), ("b1", "B"), ("b2", "B"), ("b2", "C"), (None, "B"), ("c0", "C"), ("x", None), ("d0", "D")]
    roots, already = [("s", "a0"), ("t", "b0"), ("u", "d0")], [("s", "a0"), ("s", "b2"), ("s", "b2"), ("t", "b0"), ("t", "b1"), ("t", "c0"), ("u", None)]
    links = [("A", "B"), ("B", "C"), ("C", "B")]
    below = {"A": "BC", "B": "BC", "D": ""}
    home = {"a0": "A", "b0": "B", "d0": "D"}
    want = sorted(((s, n) for s, r in roots for n, g in sics if g and g in below[home[r]] and (n is None or (s, n) not in already)), key=str)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = w.group_cascade(
            spark.createDataFrame(roots, "scenario_id string, node string"), spark.createDataFrame(already, "scenario_id string, node string"),
            spark.createDataFrame(sics, "id string, job_group_id string"), spark.createDataFrame(links, "src_id string, dst_id string"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(((r.scenario_id, r.node) for r in got.collect()), key=str) == want
        assert not re.search(r"hashpartitioning\(scenario_id#\d+, node#\d+", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
