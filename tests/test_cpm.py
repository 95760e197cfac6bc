"""Critical paths against a plain computation per run."""

import hashlib
import random

from batchlens.operators import cpm as c
from batchlens.operators.traverse import ancestors


def plain(dur, edges, entries, limit):
    succ = {n: [b for a, b in edges if a == n and b in dur and a in dur] for n in set(dur) | set(entries)}
    reach, todo = set(entries), list(entries)
    while todo:
        for b in succ[todo.pop()]:
            if b not in reach:
                reach.add(b)
                todo.append(b)
    pred = {n: [a for a in reach if n in succ[a]] for n in reach}
    es, ef = {}, {}
    for n in sorted(reach):
        es[n] = 0 if n in entries or not pred[n] else max(ef[p] for p in pred[n])
        ef[n] = es[n] + dur.get(n, 0)
    sinks = [n for n in reach if not [b for b in succ[n] if b in reach]]
    done = max(ef[n] for n in sinks)
    finish = limit if limit else done
    ls, lf = {}, {}
    for n in sorted(reach, reverse=True):
        nxt = [b for b in succ[n] if b in reach]
        lf[n] = min((ls[b] for b in nxt), default=finish)
        ls[n] = lf[n] - dur.get(n, 0)
    node = min(sinks, key=lambda n: (-ef[n], n))
    path = [node]
    while pred[node]:
        node = min(pred[node], key=lambda p: (-ef[p], p))
        path.append(node)
    return {n: (es[n], ef[n], ls[n], lf[n], n in path) for n in reach}, done, path[::-1]


def build(spark, runs, sics, entry, edges, sla):
    jge = sorted({(r[1], r[2]) for r in runs})
    return (
        spark.createDataFrame([(j, g) for j, g in jge], "id string, job_group_id string").selectExpr("*", "DATE '2024-01-01' AS business_date"),
        spark.createDataFrame([(f"{r[1]}/{r[0]}", r[1], r[0], r[3], "COMPLETED") for r in runs], "id string, jge_id string, sic_id string, duration_ms long, status string"),
        spark.createDataFrame(sics, "id string, job_group_id string"), spark.createDataFrame(entry, "job_group_id string, sic_id string"),
        spark.createDataFrame(edges, "src_id string, dst_id string"), spark.createDataFrame(sla, "owner_type string, owner_id string, duration_ms long"),
    )


def test_all_runs_equal_plain_passes(spark):
    rng = random.Random(2)
    sics, edges, entry, runs, sla, want = [], [], [], [], [], {}
    for g in range(3):
        names = [f"g{g}n{i:02d}" for i in range(9)]
        sics += [(n, f"G{g}") for n in names]
        own = [(a, b) for i, a in enumerate(names) for b in names[i + 1:] if rng.random() < 0.3]
        edges += own
        starts = names[:2]
        entry += [(f"G{g}", s) for s in starts]
        limit = 5000 if g == 1 else None
        if limit:
            sla.append(("JOB_GROUP", f"G{g}", limit))
        for k in range(4):
            jge = f"G{g}_run{k}"
            dur = {n: rng.randrange(1, 900) for n in names if rng.random() < 0.8}
            dur.setdefault(names[8], 5)
            runs += [(n, jge, f"G{g}", d) for n, d in dur.items()]
            want[jge] = plain(dur, own, starts, limit)
    sla.append(("SIC", "x", 1))
    r = c.critical_paths(*build(spark, runs, sics, entry, edges, sla))
    got = {}
    for m in r.metrics.collect():
        got.setdefault(m.jge_id, {})[m.node] = (m.es, m.ef, m.ls, m.lf, m.is_longest)
    assert got == {k: v[0] for k, v in want.items()}
    for row in r.runs.collect():
        text = "->".join(want[row.jge_id][2])
        assert (row.completion_ms, row.path_text) == (want[row.jge_id][1], text)
        assert row.signature_hash == hashlib.sha256(text.encode()).hexdigest()
    assert r.skipped.count() == 0


def test_cyclic_runs_are_skipped_unless_a_missing_context_breaks_the_cycle(spark):
    sics = [(n, "G") for n in "abc"]
    edges = [("a", "b"), ("b", "c"), ("c", "b")]
    runs = [("a", "r1", "G", 1), ("b", "r1", "G", 2), ("c", "r1", "G", 3), ("a", "r2", "G", 1), ("b", "r2", "G", 2)]
    sla = [("SIC", "x", 1)]
    r = c.critical_paths(*build(spark, runs, sics, [("G", "a")], edges, sla))
    assert [(x.jge_id, x.reason) for x in r.skipped.collect()] == [("r1", "graph is not acyclic")]
    assert [(x.jge_id, x.path_text) for x in r.runs.collect()] == [("r2", "a->b")]


def test_a_long_chain_takes_few_rounds(spark):
    n = 10_000
    parents = spark.range(1, n).selectExpr("'r' AS jge_id", "cast(id AS string) AS node", "cast(id - 1 AS string) AS parent")
    starts = spark.createDataFrame([("r", str(n - 1)), ("q", "5")], "jge_id string, node string")
    found, rounds = ancestors(parents, starts, ["jge_id"])
    got = {(r.jge_id, r.node): r.distance for r in found.collect()}
    assert got == {("q", "5"): 0, **{("r", str(i)): n - 1 - i for i in range(n)}} and found.count() == n + 1
    assert rounds <= 20
    texts = {r.jge_id: r.path_text for r in c.path_texts(found.selectExpr("jge_id", "node", f"{n - 1} - distance AS position")).collect()}
    assert texts == {"q": "5", "r": "->".join(map(str, range(n)))}


def test_parents_of_many_runs(spark):
    rng = random.Random(8)
    parent = {(f"r{k}", str(i)): str(rng.randrange(i)) for k in range(6) for i in range(1, 40) if rng.random() < 0.9}
    rows = [(k, n, p) for (k, n), p in parent.items()]
    starts = [(f"r{k}", str(rng.randrange(40))) for k in range(6)]
    want = set()
    for k, n in starts:
        d = 0
        while n is not None:
            want.add((k, n, d))
            n, d = parent.get((k, n)), d + 1
    found, _ = ancestors(spark.createDataFrame(rows, "jge_id string, node string, parent string"), spark.createDataFrame(starts, "jge_id string, node string"), ["jge_id"])
    got = [tuple(r) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)
