"""Loops against plain-Python walks over small random graphs."""

import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from batchlens.functions.ranking import group_index
from batchlens.operators import condense, reachindex
from batchlens.operators import traverse as tr
from batchlens.session import SHUFFLES_GO, LoopState


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def bfs(edges, root, min_hops, max_hops, allowed=None):
    out, seen = {}, set()
    queue = deque([(root, 0)])
    if allowed is not None and root not in allowed:
        return out
    if min_hops == 0:
        out[root] = 0
        seen.add(root)
    while queue:
        node, d = queue.popleft()
        if max_hops is not None and d >= max_hops:
            continue
        for a, b in edges:
            if a == node and b not in seen and (allowed is None or b in allowed):
                seen.add(b)
                out[b] = d + 1
                queue.append((b, d + 1))
    return out


def random_edges(rng, n, m, acyclic):
    out = set()
    while len(out) < m:
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b:
            out.add((min(a, b), max(a, b)) if acyclic else (a, b))
    return sorted(out)


def test_reachable_matches_bfs_with_cycles_bounds_and_scope(spark):
    rng = random.Random(7)
    edges = [(str(a), str(b)) for a, b in random_edges(rng, 14, 26, acyclic=False)]
    nodes = [str(i) for i in range(14)]
    e = frame(spark, edges, "src_id string, dst_id string")
    roots = frame(spark, [(n, n) for n in nodes], "root string, node string")
    allowed = set(nodes[:10])
    scope = frame(spark, [(n,) for n in sorted(allowed)], "node string")
    for lo, hi, inside in ((0, None, None), (1, None, None), (0, 2, None), (1, 3, None), (0, None, allowed)):
        got = {(r.root, r.node): r.distance for r in tr.reachable(e, roots, min_hops=lo, max_hops=hi, scope=scope if inside else None).collect()}
        want = {(n, k): v for n in nodes for k, v in bfs(edges, n, lo, hi, inside).items()}
        assert got == want
    up = {(r.root, r.node) for r in tr.reachable(e, roots, min_hops=1, max_hops=None, direction="up").collect()}
    down = {(r.root, r.node) for r in tr.reachable(e, roots, min_hops=1, max_hops=None).collect()}
    assert up == {(b, a) for a, b in down}


def test_bound_of_fifty_hops_on_a_chain(spark):
    e = frame(spark, [(f"n{i}", f"n{i + 1}") for i in range(60)], "src_id string, dst_id string")
    got = tr.reachable(e, frame(spark, [("n0", "n0")], "root string, node string"), max_hops=50).collect()
    assert len(got) == 51 and max(r.distance for r in got) == 50


def test_scope_that_differs_per_traversal(spark):
    e = frame(spark, [("a", "b"), ("b", "c")], "src_id string, dst_id string")
    roots = frame(spark, [("s1", "a"), ("s2", "a")], "scenario_id string, node string")
    scope = frame(spark, [("s1", "a"), ("s1", "b"), ("s1", "c"), ("s2", "a"), ("s2", "c")], "scenario_id string, node string")
    got = {(r.scenario_id, r.node) for r in tr.reachable(e, roots, ["scenario_id"], scope=scope, scope_keys=["scenario_id"]).collect()}
    assert got == {("s1", "a"), ("s1", "b"), ("s1", "c"), ("s2", "a")}


def test_levels_are_longest_paths_and_cycles_come_last(spark):
    rng = random.Random(3)
    edges = random_edges(rng, 15, 30, acyclic=True)
    want = {n: 0 for n in range(15)}
    for a, b in sorted(edges):
        pass
    for n in range(15):
        want[n] = max([want[a] + 1 for a, b in edges if b == n], default=0)
    e = frame(spark, [(str(a), str(b)) for a, b in edges], "src_id string, dst_id string")
    nodes = frame(spark, [(str(n),) for n in range(15)], "node string")
    got = {int(r.node): r.level for r in tr.topological_levels(nodes, e).collect()}
    assert got == want

    loop = frame(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "src_id string, dst_id string")
    rows = {r.node: (r.level, r.in_cycle) for r in tr.topological_levels(frame(spark, [(x,) for x in "abcd"], "node string"), loop).collect()}
    assert rows["a"] == (0, False) and all(rows[x][1] for x in "bcd") and rows["b"][0] >= 1


def test_group_index_spreads_one_large_group(spark):
    rows = [("big", i % 97, f"r{i:05d}") for i in range(3000)] + [("small", 1, "x"), ("small", 0, "y")]
    df = frame(spark, rows, "g string, o int, id string")
    got = group_index(df, ["g"], ["o", "id"], "pos").collect()
    want = {}
    for g in ("big", "small"):
        for i, r in enumerate(sorted((o, k) for gg, o, k in rows if gg == g)):
            want[(g, r[1])] = i
    assert {(r.g, r.id): r.pos for r in got} == want


def strong(nodes, edges):
    """Components by mutual reachability."""
    down = {n: {n} | set(bfs(edges, n, 1, None)) for n in nodes}
    return {n: min(m for m in nodes if m in down[n] and n in down[m]) for n in nodes}


def test_components_and_their_levels(spark):
    rng = random.Random(21)
    for n, m in ((30, 40), (8, 0)):
        nodes = [f"n{i:02d}" for i in range(n)]
        edges = [(nodes[a], nodes[b]) for a, b in random_edges(rng, n, m, acyclic=False)] + [(nodes[0], nodes[0])]
        e = frame(spark, edges, "src_id string, dst_id string")
        parts = condense.strong_components(frame(spark, [(x,) for x in nodes], "node string"), e).collect()
        want = strong(nodes, edges)
        assert {r.node: r.component for r in parts} == want and len(parts) == n
        level = {r.node: r.level for r in parts}
        assert all(level[a] > level[b] for a, b in edges if want[a] != want[b])
        assert all(level[x] == level[want[x]] for x in nodes)


def test_names_are_numbered_in_order_before_the_loops(spark, monkeypatch):
    """Rounds shuffle numbers; the smallest number still has the smallest name."""
    kinds, plain = [], condense.topological_levels
    monkeypatch.setattr(condense, "topological_levels", lambda nodes, edges: kinds.append(nodes.schema["node"].dataType.typeName()) or plain(nodes, edges))
    e = frame(spark, [("n10", "n9"), ("n9", "n10"), ("n9", "b"), ("b", "a"), ("outside", "a"), ("a", None)], "src_id string, dst_id string")
    nodes = frame(spark, [("n9",), ("n10",), ("b",), ("a",), ("a",), (None,)], "node string")
    rows = condense.strong_components(nodes, e).collect()
    assert {(r.node, r.component) for r in rows} == {("n9", "n10"), ("n10", "n10"), ("b", "b"), ("a", "a"), (None, None)} and len(rows) == 5
    assert kinds and set(kinds) == {"long"}


def test_levels_leave_links_behind_that_are_used_up(spark, monkeypatch):
    monkeypatch.setattr(tr, "REWRITTEN", 3)
    rng, written = random.Random(5), []
    plain = LoopState.drop
    monkeypatch.setattr(LoopState, "drop", lambda self, table: written.append(table.columns) or plain(self, table))
    nodes = [f"n{i:02d}" for i in range(14)]
    edges = {(nodes[a], nodes[b]) for a, b in random_edges(rng, 14, 40, acyclic=True)}
    want = {}
    for x in nodes:
        want[x] = max([want[a] + 1 for a, b in edges if b == x], default=0)
    got = tr.topological_levels(frame(spark, [(x,) for x in nodes], "node string"), frame(spark, list(edges), "src_id string, dst_id string")).collect()
    assert {r.node: r.level for r in got} == want and not any(r.in_cycle for r in got)
    assert len(written) > 1  # more than the one table of all links


def test_nodes_behind_a_cycle_are_not_on_it(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "e")], "src_id string, dst_id string")
    got = {r.node: r.component for r in condense.cycle_members(frame(spark, [(x,) for x in "abcdef"], "node string"), e).collect()}
    assert got == {"b": "b", "c": "b", "e": "e", "f": "e"}


@pytest.mark.parametrize("walked", [0, 10_000])
def test_facts_below_shared_layers_and_cycles(spark, monkeypatch, walked):
    monkeypatch.setattr(condense, "WALKED", walked)
    rng = random.Random(4)
    # many entries over one utility layer that calls itself in circles
    edges = [(f"e{i}", f"u{rng.randrange(6)}") for i in range(20) for _ in range(2)] + [(f"u{i}", f"u{(i + 1) % 6}") for i in range(4)]
    edges += [("u4", "v0"), ("u5", "v1"), ("v0", "v1"), ("v1", "v0"), ("v1", "w"), ("x", "y")]
    facts = [("u0", "DB", "a"), ("v0", "DB", "b"), ("v1", "SQL", None), ("w", "DB", "b"), ("e3", "DB", "own"), ("y", "DB", "away")]
    roots = [(f"s{i % 7}", f"e{i}") for i in range(20)] + [("s0", "e19"), ("s9", "missing"), ("s8", "y")]
    e = frame(spark, edges, "src_id string, dst_id string")
    own = frame(spark, facts, "node string, kind string, op string").withColumn("at", F.col("node"))
    r = frame(spark, roots, "step_id string, node string")
    want = {}
    for step, root in roots:
        for n in {root} | set(bfs(edges, root, 1, None)):
            for at, kind, op in facts:
                if at == n:
                    want[step, kind, op] = min(want.get((step, kind, op), at), at)
    got = {(x.step_id, x.kind, x.op): x.at for x in condense.found_below(r, e, own, ["kind", "op"], {"at": F.min("at")}).collect()}
    assert got == want
    plain = [(x.step_id, x.kind, x.op) for x in condense.found_below(r, e, own, ["kind", "op"]).collect()]
    assert set(plain) == set(want) and len(plain) == len(want)


def test_search_with_targets_stays_among_nodes_that_lead_to_one(spark):
    rng = random.Random(9)
    nodes = [str(i) for i in range(20)]
    edges = [(str(a), str(b)) for a, b in random_edges(rng, 20, 34, acyclic=False)]
    e = frame(spark, edges, "src_id string, dst_id string")
    roots = frame(spark, [(n, n) for n in nodes[:8]], "root string, node string")
    goals = {"13", "17"}
    targets = frame(spark, [(g,) for g in goals], "node string")
    back = [(b, a) for a, b in edges]
    ahead = {n for g in goals for n in bfs(back, g, 0, None)}
    for hops in (None, 2, 3):
        full = {(n, k): v for n in nodes[:8] for k, v in bfs(edges, n, 0, hops).items()}
        got = {(r.root, r.node): r.distance for r in tr.reachable(e, roots, max_hops=hops, targets=targets).collect()}
        assert {k: v for k, v in got.items() if k[1] in goals} == {k: v for k, v in full.items() if k[1] in goals}
        assert all(n in ahead for _, n in got) and all(full[k] == v for k, v in got.items())


def test_asked_pairs_equal_the_closure(spark):
    rng = random.Random(31)
    for n, m, acyclic in ((25, 45, True), (25, 34, False)):
        nodes = [f"n{i:02d}" for i in range(n)]
        edges = [(nodes[a], nodes[b]) for a, b in random_edges(rng, n, m, acyclic)]
        index = reachindex.reach_index(frame(spark, [(x,) for x in [*nodes, "alone"]], "node string"), frame(spark, edges, "src_id string, dst_id string"))
        pairs = [(a, b) for a in [*nodes, "alone", "unknown"] for b in [*nodes, "alone"]]
        got = reachindex.reaches(index, frame(spark, pairs + pairs[:9], "src_id string, dst_id string"))
        want = {(a, b): a != "unknown" and (a == b or b in bfs(edges, a, 1, None)) for a, b in pairs}
        rows = got.pairs.collect()
        assert {(r.src_id, r.dst_id): r.reachable for r in rows} == want and len(rows) == len(want)
        assert got.searched < len(pairs) / 4  # labels decide most pairs


def test_a_walk_may_write_rows_in_proportion_to_its_links(spark):
    """A few rows for each link are cheaper than facts of whole components, however many links there are."""
    e = frame(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)] + [(f"n{i}", f"m{i}") for i in range(6)], "src_id string, dst_id string")
    roots = frame(spark, [(f"n{i}", f"n{i}") for i in range(7)], "root string, node string")
    assert tr.reachable(e, roots, most=10) is None
    assert tr.reachable(e, roots, most=10, per_links=2).count() == 49  # twelve links: sixty rows
    assert tr.reachable(e, roots, most=10, per_links=12) is None


def test_shuffles_behind_a_written_table_go(spark):
    def held():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")

    state = LoopState(spark, "shuffled")
    spark._jvm.System.gc()
    before, setting = held(), spark.conf.get(SHUFFLES_GO)
    stored, n = state.save(spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before and spark.conf.get(SHUFFLES_GO) == setting
    assert n == 10 and {(r.k, r.n) for r in stored.collect()} == {(k, 100) for k in range(10)}
