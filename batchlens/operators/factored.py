"""The delay projection with the contexts of later groups kept as groups.

Most rows of a projection are contexts that are only in it because their group
comes after a root's group.  No impacted predecessor leads to such a context
(it would be below a root then), so its levels, starts and finishes follow from
the groups the roots lie in, never from the roots themselves.  They are worked
out once for every ``kind`` of scenario: the same groups of roots and, where
dates matter, the same dates.  Contexts below a root (``direct``) keep a row for
each scenario.  What depends on both is small and written out: the links from
one to the other, tails that a link into a direct context lengthens, and the
starts of a scenario's groups.

The rows of a scenario's later groups are listed when a result is read, from
cells of about ``CELL`` contexts of a kind, and never shuffled one by one.

This needs an order all contexts fit into and durations that aren't negative.
Where precedence has a cycle, or a duration is below zero, the projection of
``whatif`` over a row for each scenario and context is used instead.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.operators import whatif as w
from batchlens.operators.performance import avg_duration, circular_mean_finish
from batchlens.operators.traverse import reachable, topological_levels, waves
from batchlens.session import LoopState, plan_by_row_size

KEY = ["scenario_id"]
#: Contexts of a kind that are listed as one row, about.
CELL = 256


class Parts(NamedTuple):
    state: LoopState
    scen: DataFrame  # scenario_id, delay_ms, days, kind (null without a later group); a row for each row of the scenarios
    reach: DataFrame  # scenario_id, node, distance: contexts below the roots
    direct: DataFrame  # the same with all inputs: scenario_id, days, kind, node, job_group_id, is_root, delay_ms, deadline_ms, dur, duration_source, home, level
    attr: DataFrame  # days, node, job_group_id, deadline_ms, dur, duration_source, level: inputs of every context
    member: DataFrame  # kind, days, node, job_group_id, deadline_ms, dur, duration_source, home, level: contexts of the later groups of a kind
    size: DataFrame  # kind, cells
    groups: DataFrame  # kind, job_group_id: later groups
    ordered: DataFrame  # src_id, dst_id, _from, _to: precedence with the places of both ends in the order
    dates: DataFrame  # days, business_date


class Impact(NamedTuple):
    roots: DataFrame
    slas: DataFrame
    parts: Parts | None
    whole: w.Impact | None  # rows for each scenario and context, where ``parts`` can't be used


def _days(scenarios: DataFrame, as_of: str | None) -> DataFrame:
    """(scenario_id, days): the dates of a scenario's rows; with ``as_of`` earlier ones are refused."""
    date = F.col("business_date")
    if as_of is not None:
        early = F.raise_error(F.lit("a date projection needs today or a later date")).cast("date")
        date = F.when(date < F.lit(as_of).cast("date"), early).otherwise(date)
    return scenarios.groupBy("scenario_id").agg(F.array_join(F.array_sort(F.collect_list(date.cast("string"))), ",").alias("days"))


def impact_frame(
    scenarios: DataFrame, sics: DataFrame, job: DataFrame, job_group: DataFrame, resource: DataFrame, require: DataFrame,
    edges: DataFrame, group_edges: DataFrame, sla: DataFrame, runs: DataFrame, as_of: str, days: int = 30,
    plan: DataFrame | None = None, latest: DataFrame | None = None, dated: bool = False,
) -> Impact:
    """Impacted contexts of all scenarios with durations and deadlines.

    With ``plan`` only contexts planned on a scenario's date take part, with
    ``latest`` the runs on that date give durations; ``dated`` tells dates apart without either.
    """
    spark = scenarios.sparkSession
    plan_by_row_size(spark)
    state = LoopState(spark, "impact")
    names = sics.select(F.col("id").alias("node")).where("node IS NOT NULL")
    between = w.scenario_edges(names.withColumn("scenario_id", F.lit(0)), edges)
    order, seen = state.save_counting(topological_levels(names, between.drop("scenario_id")), cycles=F.col("in_cycle"))
    dated = dated or plan is not None or latest is not None
    scen = w.delay_ms(scenarios)
    scen = scen.join(_days(scenarios, as_of if plan is not None else None), "scenario_id") if dated else scen.withColumn("days", F.lit(""))
    scen, _ = state.save(scen)
    dates = scen.select("days").distinct().withColumn("day", F.explode(F.split("days", ","))).select("days", F.try_to_date("day").alias("business_date")).where("business_date IS NOT NULL")

    averages, _ = state.save(avg_duration(runs, sics, as_of, days).select("sic_id", "avg_duration_ms"))
    ends = w.sla_deadlines(sics, sla, circular_mean_finish(runs, sics, as_of, days))
    slas, _ = state.save(ends.slas)
    attr = scen.select("days").distinct().crossJoin(sics.select(F.col("id").alias("node"), "job_group_id")).where("node IS NOT NULL")
    planned = None
    if plan is not None:
        day = plan.where("should_run").select("business_date", F.col("sic_id").alias("node"))
        planned, _ = state.save(dates.join(day, "business_date").select("days", "node").distinct())
        attr = attr.join(planned, ["days", "node"], "left_semi")
    attr = attr.join(ends.deadlines.select(F.col("sic_id").alias("node"), "deadline_ms"), "node", "left").withColumnRenamed("days", "scenario_id")
    actual = None if latest is None else dates.join(latest, "business_date").select(F.col("days").alias("scenario_id"), F.col("sic_id").alias("node"), "duration_ms")
    attr = w.effective_duration(attr, averages, actual).withColumnRenamed("scenario_id", "days")
    attr, facts = state.save_counting(attr.join(order.drop("in_cycle"), "node"), negative=F.col("dur") < 0)

    if seen["cycles"] or facts["negative"]:
        scope = None if plan is None else w.date_scope(scenarios, plan, as_of)
        actual = None if latest is None else w.actual_on_date(scenarios, latest)
        whole = w.impact_frame(scenarios, sics, job, job_group, resource, require, edges, group_edges, sla, runs, as_of, days, scope, actual)
        return Impact(whole.roots, whole.slas, None, whole)

    roots = w.resolve_roots(scenarios, sics, job, job_group, resource, require)
    scope = None
    if planned is not None:
        roots = roots.join(scen.select("scenario_id", "days").distinct(), "scenario_id").join(planned, ["days", "node"], "left_semi")
        scope = planned
    roots, _ = state.save(roots)
    if scope is None:
        reach = w.impacted(roots, edges)
    else:
        reach = reachable(edges, roots, ["scenario_id", "days"], scope=scope, scope_keys=["days"])

    # kinds are named after the lowest of their scenarios
    member = sics.select(F.col("id").alias("node"), "job_group_id")
    start = roots.select("scenario_id", "node").join(member, "node").where("scenario_id IS NOT NULL AND job_group_id IS NOT NULL").select("scenario_id", "job_group_id").distinct()
    of = start.groupBy("scenario_id").agg(F.array_sort(F.collect_list("job_group_id")).alias("home")).join(scen.select("scenario_id", "days").distinct(), "scenario_id")
    of, _ = state.save(of)
    kinds, _ = state.save(of.groupBy("home", "days").agg(F.min("scenario_id").alias("kind")))
    scen = scen.join(of.join(kinds, ["home", "days"]).select("scenario_id", "kind"), "scenario_id", "left")
    scen, _ = state.save(scen)
    at_home = kinds.select("kind", F.explode("home").alias("job_group_id"))
    groups = reachable(group_edges, at_home.withColumnRenamed("job_group_id", "node"), ["kind"], min_hops=1).select("kind", F.col("node").alias("job_group_id"))
    flags = at_home.withColumn("home", F.lit(True))

    def flagged(df: DataFrame) -> DataFrame:
        return df.join(flags, ["kind", "job_group_id"], "left").withColumn("home", F.coalesce("home", F.lit(False)))

    inside = groups.join(member, "job_group_id").select("kind", "node").join(kinds.select("kind", "days"), "kind")
    members, _ = state.save(flagged(inside.join(attr, ["days", "node"])))
    size, _ = state.save(members.groupBy("kind").agg(F.ceil(F.count("*") / CELL).alias("cells")))
    direct = reach.select("scenario_id", "node", (F.col("distance") == 0).alias("is_root")).join(scen, "scenario_id").join(attr, ["days", "node"])
    ordered = between.drop("scenario_id").join(order.select(F.col("node").alias("src_id"), F.col("level").alias("_from")), "src_id").join(
        order.select(F.col("node").alias("dst_id"), F.col("level").alias("_to")), "dst_id")
    ordered, _ = state.save(ordered.select("src_id", "dst_id", "_from", "_to"))
    return Impact(roots, slas, Parts(state, scen, reach, flagged(direct), attr, members, size, groups, ordered, dates), None)


# ---- listing ---------------------------------------------------------------


def _placed(p: Parts, rows: DataFrame) -> DataFrame:
    """Rows of (kind, node) with the cell they are listed in."""
    return rows.join(p.size, "kind").withColumn("cell", F.pmod(F.xxhash64("node"), "cells")).drop("cells")


def _hits(p: Parts) -> DataFrame:
    """(scenario_id, cell, hit): contexts of a cell that are below a root and so not listed again."""
    near = p.direct.where("kind IS NOT NULL").select("scenario_id", "kind", "job_group_id", "node").join(p.groups, ["kind", "job_group_id"], "left_semi")
    return p.state.save(_placed(p, near).groupBy("scenario_id", "cell").agg(F.collect_set("node").alias("hit")))[0]


def _open(hit: Column) -> Column:
    """The members of a cell that aren't among its hits."""
    left = F.filter("members", lambda m: ~F.array_contains(hit, m["node"]))
    return F.when(hit.isNull(), F.col("members")).otherwise(left)


def listed(p: Parts, rows: DataFrame, facts: DataFrame | None = None, changed: DataFrame | None = None, copies: int = 1) -> DataFrame:
    """Rows of (kind, node) for every scenario of the kind, but for contexts below its roots.

    ``facts`` adds columns by scenario, ``changed`` by scenario and cell.  A
    row comes once for every row of the scenario, to the power of ``copies``.
    """
    columns = [c for c in rows.columns if c not in ("kind", "cell")]
    cells, _ = p.state.save(_placed(p, rows).groupBy("kind", "cell").agg(F.collect_list(F.struct(*columns)).alias("members")))
    asked = p.scen.where("kind IS NOT NULL").select("scenario_id", "kind")
    for _ in range(copies - 1):
        asked = asked.join(p.scen.select("scenario_id"), "scenario_id")
    extra: list[str] = []
    if facts is not None:
        asked = asked.join(facts, "scenario_id", "left")
        extra += [c for c in facts.columns if c != "scenario_id"]
    asked = asked.join(cells.select("kind", "cell"), "kind").join(_hits(p), ["scenario_id", "cell"], "left")
    if changed is not None:
        asked = asked.join(changed, ["scenario_id", "cell"], "left")
        extra += [c for c in changed.columns if c not in ("scenario_id", "cell")]
    return asked.join(cells, ["kind", "cell"]).select("scenario_id", *extra, F.inline(_open(F.col("hit"))))


def nodes(f: Impact) -> DataFrame:
    """Impacted contexts with their effective durations and deadlines."""
    cols = ["scenario_id", "node", "job_group_id", "deadline_ms", "dur", "duration_source"]
    if f.parts is None:
        return f.whole.nodes.select(*cols)
    return f.parts.direct.select(*cols).unionByName(listed(f.parts, f.parts.member.select("kind", *cols[1:])).select(*cols))


# ---- solving ---------------------------------------------------------------


def _links(p: Parts, direct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links into contexts below a root: from others below it (with places in the order), and from listed ones (scenario_id, kind, src_id, dst_id)."""
    ids = direct.select("scenario_id", "kind", "node").distinct()
    into = ids.withColumnRenamed("node", "dst_id").join(p.ordered, "dst_id")
    other = ids.select("scenario_id", F.col("node").alias("src_id"), F.lit(True).alias("near"))
    found = into.join(other, ["scenario_id", "src_id"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    found, _ = p.state.save(found.where("near OR kind IS NOT NULL"), ["near"])
    far = found.where("NOT near").join(p.member.select("kind", F.col("node").alias("src_id")).distinct(), ["kind", "src_id"], "left_semi")
    return found.where("near").select("scenario_id", "src_id", "dst_id", "_from", "_to"), far.select("scenario_id", "kind", "src_id", "dst_id")


def _links_of(p: Parts, nodes: DataFrame, key: str) -> DataFrame:
    """(key, src_id, dst_id, _from, _to): links among the nodes of each kind, or of each date."""
    ids = nodes.select(key, "node").distinct()
    return ids.withColumnRenamed("node", "src_id").join(p.ordered, "src_id").join(ids.withColumnRenamed("node", "dst_id"), [key, "dst_id"], "left_semi")


def propagated_delay(f: Impact) -> DataFrame:
    """Largest delay reaching each impacted context; none reaches one that is not below a root."""
    p = f.parts
    if p is None:
        return w.propagated_delay(f.whole.nodes, f.whole.links)
    direct, _ = p.state.save(p.direct)
    near, _ = _links(p, direct)
    own = F.when(F.col("is_root"), F.col("delay_ms")).otherwise(F.lit(0))
    came = F.when(F.col("home"), F.col("delay_home")).otherwise(F.col("delay_in"))  # root groups are solved first
    solved = waves(
        direct, near, KEY, {"delay_in": F.max("delay"), "delay_home": F.max(F.when(F.col("from_home"), F.col("delay")))},
        {"delay": F.greatest(own, F.coalesce(came, F.lit(0))).cast("bigint"), "from_home": F.col("home")}, KEY, repeats_count=False,
    ).select("scenario_id", "node", F.col("delay").alias("propagated_delay_ms"))
    rest = listed(p, p.member.select("kind", "node")).withColumn("propagated_delay_ms", F.lit(0).cast("bigint"))
    return solved.unionByName(rest)


def finish_projection(f: Impact, anchor_ms: int = 0, latest: DataFrame | None = None, scenarios: DataFrame | None = None) -> DataFrame:
    """Finish times from a start anchor; contexts that already ran, by ``latest`` on the scenario's date, stay where they are."""
    p = f.parts
    if p is None:
        rows = f.whole.nodes
        if latest is None:
            rows = rows.withColumn("executed_ms", F.lit(None).cast("bigint"))
        else:
            rows = rows.join(w.actual_on_date(scenarios, latest).select("scenario_id", "node", "executed_ms"), ["scenario_id", "node"], "left")
        return w.finish_projection(rows, f.whole.links, anchor_ms)

    def with_runs(df: DataFrame) -> DataFrame:
        if latest is None:
            return df.withColumn("executed_ms", F.lit(None).cast("bigint"))
        ran = p.dates.join(latest, "business_date").select("days", F.col("sic_id").alias("node"), F.col("end_time_ms").alias("executed_ms"))
        return df.join(ran, ["days", "node"], "left")

    direct, _ = p.state.save(with_runs(p.direct))
    near, far = _links(p, direct)
    rows = with_runs(p.member).withColumnRenamed("kind", "scenario_id").withColumn("is_root", F.lit(False)).withColumn("delay_ms", F.lit(0).cast("bigint"))
    base = w.finish_projection(rows, _links_of(p, p.member, "kind").withColumnRenamed("kind", "scenario_id"), anchor_ms).withColumnRenamed("scenario_id", "kind")
    before = far.join(base.select("kind", F.col("node").alias("src_id"), "baseline"), ["kind", "src_id"]).groupBy(
        "scenario_id", F.col("dst_id").alias("node")).agg(F.max("baseline").alias("before_ms"))
    solved = w.finish_projection(direct.join(before, ["scenario_id", "node"], "left"), near, anchor_ms)
    return solved.unionByName(listed(p, base))


def downstream_tail(f: Impact) -> DataFrame:
    """Longest run time after each impacted context; null where its own duration is unknown.

    All that follows a context below a root is below it too, so its tail is
    that of the whole graph.  A listed context has the tail of its kind, unless
    a link into a context below a root makes it longer.
    """
    p = f.parts
    if p is None:
        return w.downstream_tail(f.whole.nodes, f.whole.links)

    def tails(nodes: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        links, _ = p.state.save(_links_of(p, nodes, key), ["_from"])
        out = w.downstream_tail(nodes.withColumnRenamed(key, "scenario_id"), links.select(F.col(key).alias("scenario_id"), "src_id", "dst_id"))
        after, _ = p.state.save(out.withColumnRenamed("scenario_id", key))
        longest = nodes.groupBy(key, "node").agg(F.max("dur").alias("dur"), F.first("level").alias("level")).where("dur IS NOT NULL")
        return after, p.state.save(longest.join(after.groupBy(key, "node").agg(F.max("downstream_after_ms").alias("after")), [key, "node"]))[0], links

    all_after, all_ends, _ = tails(p.attr, "days")
    kind_after, kind_ends, kind_links = tails(p.member, "kind")
    days = p.scen.where("kind IS NOT NULL").select("kind", "days").distinct()
    _, far = _links(p, p.state.save(p.direct.select("scenario_id", "kind", "node"))[0])
    ends = all_ends.select("days", F.col("node").alias("dst_id"), (F.col("dur") + F.col("after")).alias("best"))
    into = far.join(days, "kind").join(ends, ["days", "dst_id"]).groupBy("scenario_id", "kind", F.col("src_id").alias("node")).agg(F.max("best").alias("best"))
    into, top = p.state.save_largest(into.join(kind_ends, ["kind", "node"]).where("best > after").select("scenario_id", "kind", "node", "best", "level"), top=F.col("level"))
    leads: dict[int, list[int]] = {}
    for row in kind_links.select("_from", "_to").distinct().collect():  # pairs of levels
        leads.setdefault(row["_from"], []).append(row["_to"])
    rounds: dict[int, DataFrame] = {}
    for level in range(top["top"], -1, -1):
        here = into.where(F.col("level") == level).select("scenario_id", "kind", "node", "best")
        below = [rounds[n] for n in sorted(leads.get(level, [])) if n in rounds]
        if below:
            step = kind_links.where(F.col("_from") == level).select("kind", F.col("src_id").alias("node"), "dst_id")
            longer = p.state.union_of(below).select("scenario_id", "kind", F.col("node").alias("dst_id"), (F.col("dur") + F.col("best")).alias("best"))
            here = here.unionByName(longer.join(step, ["kind", "dst_id"]).select("scenario_id", "kind", "node", "best"))
        here = here.groupBy("scenario_id", "kind", "node").agg(F.max("best").alias("best"))
        here = here.join(kind_ends.where(F.col("level") == level).select("kind", "node", "dur", "after"), ["kind", "node"]).where("best > after")
        saved, count = p.state.save(here.select("scenario_id", "kind", "node", "dur", "best"))
        if count:
            rounds[level] = saved
    near = p.reach.select("scenario_id", "node").join(p.scen.select("scenario_id", "days"), "scenario_id").join(all_after, ["days", "node"])
    near = near.select("scenario_id", "node", "downstream_after_ms")
    if not rounds:
        return near.unionByName(listed(p, kind_after))
    changed = _placed(p, p.state.union_of(list(rounds.values())).select("scenario_id", "kind", "node", "best"))
    changed = changed.groupBy("scenario_id", "cell").agg(F.collect_list(F.struct("node", "best")).alias("longer"))
    own = F.get(F.filter("longer", lambda x: x["node"] == F.col("node")), F.lit(0))["best"]
    after = F.when(F.col("downstream_after_ms").isNotNull(), F.greatest("downstream_after_ms", own))
    return near.unionByName(listed(p, kind_after, changed=changed).select("scenario_id", "node", after.alias("downstream_after_ms")))
