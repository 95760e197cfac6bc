"""What-if delay projection for many scenarios together.

A scenario is a row (scenario_id, source_type, source_id, delay_minutes and,
for a projection on a date, business_date).  Nothing here runs per scenario:
every step is one job over all of them, keyed by ``scenario_id``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchlens.functions.clock import ms_to_clock
from batchlens.operators.performance import ANOMALY_MIN_SAMPLES, avg_duration, circular_mean_finish
from batchlens.operators.sla import sla_for_contexts
from batchlens.operators.traverse import flip, reachable, topological_levels, waves
from batchlens.session import LoopState

KEY = ["scenario_id"]


def source_kind(text: Column) -> Column:
    """Normalised source type; null when unknown."""
    t = F.regexp_replace(F.lower(F.trim(text)), "[- ]", "_")
    return F.when(t.isin("resource", "job", "sic", "job_group"), t).when(t == "jobgroup", "job_group")


def delay_ms(scenarios: DataFrame) -> DataFrame:
    return scenarios.select("scenario_id", (F.greatest(F.lit(0), F.col("delay_minutes")).cast("bigint") * 60_000).alias("delay_ms"))


def resolve_roots(scenarios: DataFrame, sics: DataFrame, job: DataFrame, job_group: DataFrame, resource: DataFrame, require: DataFrame) -> DataFrame:
    """Contexts a scenario starts from; sources match by id or name."""
    asked = scenarios.select("scenario_id", source_kind(F.col("source_type")).alias("kind"), F.col("source_id").alias("match"))

    def named(df: DataFrame, kind: str) -> DataFrame:
        ids = df.select(F.col("id").alias("match"), F.col("id").alias("entity"))
        return ids.unionByName(df.select(F.col("name").alias("match"), F.col("id").alias("entity"))).distinct().withColumn("kind", F.lit(kind))

    ctx = sics.select(F.col("id").alias("node"), "job_id", "job_group_id")
    by_kind = {
        "sic": ctx.select(F.col("node").alias("entity"), "node"),
        "job": ctx.select(F.col("job_id").alias("entity"), "node"),
        "job_group": ctx.select(F.col("job_group_id").alias("entity"), "node"),
        "resource": require.where(F.col("owner_type") == "SIC").select(F.col("resource_id").alias("entity"), F.col("owner_id").alias("node"))
        .unionByName(
            require.where(F.col("owner_type") == "JOB_GROUP")
            .select(F.col("resource_id").alias("entity"), F.col("owner_id").alias("job_group_id"))
            .join(ctx, "job_group_id").select("entity", "node")
        ),
    }
    entities = {"sic": sics, "job": job, "job_group": job_group, "resource": resource}
    out = None
    for kind, members in by_kind.items():
        found = asked.join(named(entities[kind], kind), ["kind", "match"]).join(members, "entity").select("scenario_id", "node")
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def impacted(roots: DataFrame, edges: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Roots and everything below them; ``scope`` is (scenario_id, node)."""
    return reachable(edges, roots, KEY, scope=scope, scope_keys=KEY if scope is not None else ())


#: Contexts of a group that ``group_cascade`` handles as one row, about.
CELL = 256


def group_cascade(roots: DataFrame, already: DataFrame, sics: DataFrame, group_edges: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Contexts of groups downstream of the roots' groups that are not impacted yet.

    The result has a row for every scenario and context of its groups; only the
    cells of those groups are shuffled, with the contexts already impacted, and
    the others of a cell are listed last.
    """
    state = LoopState(sics.sparkSession, "cascade")
    member = sics.select(F.col("id").alias("node"), "job_group_id")
    start = roots.join(member, "node").select("scenario_id", F.col("job_group_id").alias("node")).distinct()
    groups = reachable(group_edges, start, KEY, min_hops=1).select("scenario_id", F.col("node").alias("job_group_id"))
    sizes = member.groupBy("job_group_id").agg(F.ceil(F.count("*") / CELL).alias("cells"))
    in_cell = F.pmod(F.xxhash64("node"), "cells").alias("cell")
    placed, _ = state.save(member.join(sizes, "job_group_id").select("node", "job_group_id", in_cell))
    # structs, since a list of plain values leaves out nulls
    cells, _ = state.save(placed.groupBy("job_group_id", "cell").agg(F.collect_list(F.struct("node")).alias("members")))
    if scope is not None:
        wanted = groups.join(placed, "job_group_id").join(scope, ["scenario_id", "node"], "left_semi").select("scenario_id", "node")
        return wanted.join(already.select("scenario_id", "node"), ["scenario_id", "node"], "left_anti")
    hit = already.select("scenario_id", "node").join(placed, "node").groupBy("scenario_id", "job_group_id", "cell").agg(F.collect_set("node").alias("hit"))
    asked = groups.join(cells.select("job_group_id", "cell"), "job_group_id").join(hit, ["scenario_id", "job_group_id", "cell"], "left")
    left = F.filter("members", lambda m: ~F.coalesce(F.array_contains("hit", m["node"]), F.lit(False)))
    return asked.join(cells, ["job_group_id", "cell"]).select("scenario_id", F.inline(F.when(F.col("hit").isNull(), F.col("members")).otherwise(left)))


def effective_duration(nodes: DataFrame, averages: DataFrame, actual: DataFrame | None = None) -> DataFrame:
    """Duration of each node: the run on the scenario's date, else the average, else missing.

    ``averages`` has sic_id and avg_duration_ms; ``actual`` has scenario_id,
    node and duration_ms.
    """
    avg = averages.select(F.col("sic_id").alias("node"), F.col("avg_duration_ms").cast("bigint").alias("avg_ms"))
    j = nodes.join(avg, "node", "left")
    if actual is None:
        j = j.withColumn("actual_ms", F.lit(None).cast("bigint"))
    else:
        j = j.join(actual.select("scenario_id", "node", F.col("duration_ms").alias("actual_ms")), ["scenario_id", "node"], "left")
    source = F.when(F.col("actual_ms").isNotNull(), "actual").when(F.col("avg_ms").isNotNull(), "average").otherwise("missing")
    return j.withColumn("dur", F.coalesce("actual_ms", "avg_ms")).withColumn("duration_source", source).drop("actual_ms", "avg_ms")


class Deadlines(NamedTuple):
    deadlines: DataFrame  # sic_id, deadline_ms
    slas: DataFrame  # service-level rows incl. historical stand-ins


def sla_deadlines(sics: DataFrame, sla: DataFrame, finish: DataFrame, min_samples: int = ANOMALY_MIN_SAMPLES) -> Deadlines:
    """Deadline per context: its group's first absolute level, else its usual finish when no level exists."""
    slas = sla_for_contexts(sics, sla)
    groups = slas.where((F.col("owner_type") == "JOB_GROUP") & (F.upper("sla_type") == "ABSOLUTE")).groupBy("sic_id").agg(
        F.min_by("sla_time_ms", "sla_id").alias("group_deadline")
    )
    usual = finish.where((F.col("sample_count") >= min_samples) & F.col("finish_ms").isNotNull()).join(
        slas.select("sic_id").distinct(), "sic_id", "left_anti"
    ).select("sic_id", "finish_ms")
    stand_in = usual.join(sics.select(F.col("id").alias("sic_id"), F.col("name").alias("owner_name")), "sic_id").select(
        "sic_id", F.lit("HISTORICAL_AVG").alias("owner_type"), F.col("sic_id").alias("owner_id"), "owner_name",
        F.concat(F.lit("HIST_AVG_"), "sic_id").alias("sla_id"), F.lit("Historical Average Finish").alias("sla_name"),
        F.lit("ABSOLUTE").alias("sla_type"), F.lit(None).cast("bigint").alias("sla_duration_ms"), F.col("finish_ms").alias("sla_time_ms"),
    )
    deadlines = sics.select(F.col("id").alias("sic_id")).join(groups, "sic_id", "left").join(usual, "sic_id", "left").select(
        "sic_id", F.coalesce("group_deadline", "finish_ms").alias("deadline_ms")
    )
    return Deadlines(deadlines, slas.unionByName(stand_in))


def scenario_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of each scenario: both ends impacted."""
    # repeats go before the joins, which then make none: links outnumber nodes
    ids = nodes.select("scenario_id", "node").distinct()
    return (
        ids.withColumnRenamed("node", "src_id").join(edges.select("src_id", "dst_id").distinct(), "src_id")
        .join(ids.withColumnRenamed("node", "dst_id"), ["scenario_id", "dst_id"], "left_semi")
        .select("scenario_id", "src_id", "dst_id")
    )


def with_levels(nodes: DataFrame, links: DataFrame, induced: bool = False) -> DataFrame:
    """Nodes with their topological level inside their scenario (kept if already there); ``induced`` links are those of ``scenario_edges``."""
    if "level" in nodes.columns:
        return nodes
    levels = topological_levels(nodes, links, KEY, KEY, induced).drop("in_cycle")
    return nodes.join(levels, ["scenario_id", "node"])


def downstream_tail(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Longest run time after each node; null for a node whose duration is unknown.

    ``nodes``: scenario_id, node, dur and, when known, level.
    """
    back = flip(links)
    placed = with_levels(nodes, links).select("scenario_id", "node", "dur", "level")
    # successors have higher levels, so the walk starts at the highest
    top = placed.agg(F.max("level")).first()[0] or 0
    placed = placed.withColumn("level", F.lit(top) - F.col("level"))
    tail = F.when(F.col("dur").isNotNull(), F.col("dur") + F.coalesce("best", F.lit(0)))
    out = waves(placed, back, KEY, {"best": F.max("tail")}, {"tail": tail}, KEY, repeats_count=False)
    return out.select("scenario_id", "node", F.when(F.col("tail").isNotNull(), F.greatest(F.col("tail") - F.col("dur"), F.lit(0))).alias("downstream_after_ms"))


def _prepared(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with level and root-group flag, and the links that count.

    Root groups are solved first, so a link from another group into a root
    group carries nothing.
    """
    state = LoopState(nodes.sparkSession, "projection")
    home = nodes.where("is_root").select("scenario_id", "job_group_id").distinct().withColumn("home", F.lit(True))
    flagged = nodes.join(home, ["scenario_id", "job_group_id"], "left").withColumn("home", F.coalesce("home", F.lit(False)))
    flagged, _ = state.save(with_levels(flagged, links))
    side = flagged.select("scenario_id", F.col("node").alias("src_id"), F.col("home").alias("src_home"))
    other = flagged.select("scenario_id", F.col("node").alias("dst_id"), F.col("home").alias("dst_home"))
    kept = links.join(side, ["scenario_id", "src_id"]).join(other, ["scenario_id", "dst_id"]).where("src_home OR NOT dst_home")
    kept, _ = state.save(kept.select("scenario_id", "src_id", "dst_id"))
    return flagged, kept


def _delay() -> Column:
    own = F.when(F.col("is_root"), F.col("delay_ms")).otherwise(F.lit(0))
    return F.greatest(own, F.coalesce("delay_in", F.lit(0))).cast("bigint")


def propagated_delay(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Largest delay reaching each node. ``nodes``: scenario_id, node, job_group_id, is_root, delay_ms."""
    placed, kept = _prepared(nodes, links)
    return waves(placed, kept, KEY, {"delay_in": F.max("delay")}, {"delay": _delay()}, KEY, repeats_count=False).select(
        "scenario_id", "node", F.col("delay").alias("propagated_delay_ms")
    )


def sla_based_projection(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Projected finish of each impacted context, starting from deadlines.

    ``nodes``: scenario_id, node, job_group_id, is_root, delay_ms, dur, deadline_ms.

    A root with a deadline finishes at deadline plus delay.  Otherwise a
    context finishes its duration after its latest predecessor.  A context of
    another group that no predecessor places starts after everything other
    groups have finished so far.  "So far" follows one fixed order: root
    groups first, then topological level, contexts with predecessors before
    those without, then group and context id.

    In that order the start of an unplaced context is a running sum: each
    group's unplaced contexts start at the largest finish so far, and raise it
    by the longest of them.  It is therefore computed from one row per
    scenario and group, never by walking contexts one after the other.
    """
    state = LoopState(nodes.sparkSession, "projection")
    placed, kept = _prepared(nodes, links)
    gathered = {"delay_in": F.max("delay"), "proj_in": F.max("projected")}
    alone = F.coalesce("deadline_ms", F.lit(0)) + F.col("dur")
    home_proj = (
        F.when(F.col("dur").isNull(), F.lit(None))
        .when(F.col("is_root") & F.col("deadline_ms").isNotNull(), F.col("deadline_ms") + _delay())
        .when(F.col("proj_in").isNotNull(), F.col("proj_in") + F.col("dur"))
        .otherwise(alone)
    ).cast("bigint")
    first, _ = state.save(waves(placed.where("home"), kept, KEY, gathered, {"delay": _delay(), "projected": home_proj}, KEY, repeats_count=False))
    solved = [first]

    away = placed.where(~F.col("home"))
    top = away.agg(F.max("level")).first()[0]
    for level in range(0, -1 if top is None else top + 1):
        before = state.union_of(solved)
        here = away.where(F.col("level") == level)
        into = here.select("scenario_id", F.col("node").alias("dst_id")).join(kept, ["scenario_id", "dst_id"])
        facts = into.join(before.select("scenario_id", F.col("node").alias("src_id"), "delay", "projected"), ["scenario_id", "src_id"]).groupBy(
            "scenario_id", F.col("dst_id").alias("node")
        ).agg(*(c.alias(n) for n, c in gathered.items()))
        here = here.join(facts, ["scenario_id", "node"], "left").select(
            *placed.columns, _delay().alias("delay"), (F.col("proj_in") + F.col("dur")).cast("bigint").alias("projected")
        )
        if not here.columns == first.columns:
            here = here.select(*first.columns)
        unplaced = F.col("projected").isNull() & F.col("dur").isNotNull()
        here, counts = state.save_counting(here, loose=unplaced)
        if not counts["n"]:
            continue
        if not counts["loose"]:
            solved.append(here)
            continue
        loose = here.where(unplaced)
        starts = _unplaced_starts(before.unionByName(here), loose)
        fixed = loose.join(starts, ["scenario_id", "job_group_id"]).withColumn(
            "projected", F.coalesce(F.col("start_ms") + F.col("dur"), alone).cast("bigint")
        ).select(*first.columns)
        done, _ = state.save(here.join(loose.select("scenario_id", "node"), ["scenario_id", "node"], "left_anti").unionByName(fixed))
        solved.append(done)
    return state.union_of(solved).select(
        "scenario_id", "node", F.col("delay").alias("propagated_delay_ms"), F.col("deadline_ms").alias("baseline_finish_ms"),
        F.col("projected").alias("projected_finish_ms"),
    )


def _unplaced_starts(known: DataFrame, loose: DataFrame) -> DataFrame:
    """Start of the unplaced contexts of one level per (scenario, group); null when nothing finished before."""
    peaks = known.where("projected IS NOT NULL").groupBy("scenario_id", "job_group_id").agg(F.max("projected").alias("peak"))
    best = peaks.groupBy("scenario_id").agg(F.max(F.struct("peak", "job_group_id")).alias("b")).select(
        "scenario_id", F.col("b.peak").alias("best"), F.col("b.job_group_id").alias("best_group")
    )
    second = peaks.join(best, "scenario_id").where(F.col("job_group_id") != F.col("best_group")).groupBy("scenario_id").agg(
        F.max("peak").alias("second")
    )
    per_group = loose.groupBy("scenario_id", "job_group_id").agg(
        F.max("dur").alias("longest"), F.max(F.coalesce("deadline_ms", F.lit(0)) + F.col("dur")).alias("alone")
    )
    w = Window.partitionBy("scenario_id").orderBy("job_group_id")  # one row per group of a scenario
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    j = per_group.join(best, "scenario_id", "left").join(second, "scenario_id", "left")
    j = j.withColumn("others", F.when(F.col("best_group") == F.col("job_group_id"), F.col("second")).otherwise(F.col("best")))
    # finish after the first group, then a running sum over the later ones
    j = j.withColumn("peak_after", F.greatest("best", F.coalesce(F.col("others") + F.col("longest"), F.col("alone"))))
    j = j.select(
        "scenario_id", "job_group_id", "others", F.row_number().over(w).alias("rn"),
        F.first("peak_after").over(w).alias("after_first"), F.first("longest").over(w).alias("first_longest"),
        F.coalesce(F.sum("longest").over(earlier), F.lit(0)).alias("earlier"),
    )
    start = F.when(F.col("rn") == 1, F.col("others")).otherwise(F.col("after_first") + F.col("earlier") - F.col("first_longest"))
    return j.select("scenario_id", "job_group_id", start.alias("start_ms"))


def finish_projection(nodes: DataFrame, links: DataFrame, anchor_ms: int = 0) -> DataFrame:
    """Finish times from a start anchor; contexts that already ran stay where they are.

    ``nodes``: scenario_id, node, is_root, delay_ms, dur, executed_ms and, where
    predecessors that aren't among the nodes have finished, their last finish ``before_ms``.
    """
    placed = with_levels(nodes, links)
    if "before_ms" not in placed.columns:
        placed = placed.withColumn("before_ms", F.lit(None).cast("bigint"))
    ran, known = F.col("executed_ms").isNotNull(), F.col("dur").isNotNull()
    delay = F.when(known & ran & ~F.col("is_root"), F.lit(0)).otherwise(_delay()).cast("bigint")
    anchor = F.lit(anchor_ms)
    base = F.when(known & ran, F.col("executed_ms")).when(known, F.greatest(anchor, "base_in", "before_ms") + F.col("dur")).cast("bigint")
    proj = (
        F.when(known & ran & F.col("is_root"), F.col("executed_ms") + _delay())
        .when(known & ran, F.col("executed_ms"))
        .when(known, F.greatest(anchor, "proj_in", "before_ms") + F.col("dur") + _delay())
    ).cast("bigint")
    out = waves(
        placed, links, KEY, {"delay_in": F.max("delay"), "base_in": F.max("baseline"), "proj_in": F.max("projected")},
        {"delay": delay, "baseline": base, "projected": proj}, KEY, repeats_count=False,
    )
    return out.select("scenario_id", "node", "delay", "baseline", "projected")


def projected_sla(rows: DataFrame) -> DataFrame:
    """Verdict of each impacted context against each of its service levels."""
    kind = F.upper(F.coalesce("sla_type", F.lit("")))
    base = F.when(kind == "ABSOLUTE", F.col("sla_time_ms"))
    limit = F.coalesce("sla_duration_ms", F.lit(0))
    finish, dur = F.col("projected_finish_ms"), F.col("dur")
    effective = F.when(
        (F.upper("owner_type") == "JOB_GROUP") & F.col("downstream_after_ms").isNotNull() & base.isNotNull(),
        F.greatest(F.lit(0), base - F.col("downstream_after_ms")),
    ).otherwise(base)
    buffer = base - finish
    over = F.coalesce((kind == "RELATIVE") & (limit > 0) & (dur > limit), F.lit(False))
    late = F.coalesce((kind == "ABSOLUTE") & (finish > effective), F.lit(False))
    impact = (
        F.when((kind == "ABSOLUTE") & base.isNotNull() & finish.isNotNull(), F.greatest(F.lit(0), finish - base))
        .when((kind == "RELATIVE") & (limit > 0) & dur.isNotNull(), F.greatest(F.lit(0), dur - limit))
        .otherwise(0)
    )
    reason = (
        F.when(late, "absolute_time_breach").when(over, "duration_threshold_breach").when(buffer >= 0, "within_buffer")
        .when(limit > 0, "within_duration_threshold").otherwise("no_computable_threshold")
    )
    return rows.select(
        "*", base.alias("base_deadline_ms"), effective.alias("effective_deadline_ms"), buffer.alias("buffer_ms"),
        impact.cast("bigint").alias("real_sla_impact_ms"), (over | late).alias("projected_breach"), (over | late).alias("at_risk"),
        reason.alias("risk_reason"),
    )


def _seconds(ms: Column) -> Column:
    return F.bround(ms / 1000.0, 2)


def consolidate(nodes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per impacted context with its worst service level; times as clocks, amounts in seconds."""
    worst = verdicts.groupBy("scenario_id", "node").agg(
        F.min_by(
            F.struct("sla_id", "sla_name", "sla_type", "sla_duration_ms", "sla_time_ms", "buffer_ms", "risk_reason"),
            F.struct(-F.col("real_sla_impact_ms"), ~F.col("projected_breach"), ~F.col("at_risk"), F.col("sla_id").isNull(), "sla_id"),
        ).alias("w"),
        F.bool_or("at_risk").alias("at_risk"), F.max("real_sla_impact_ms").alias("impact_ms"),
    )
    j = nodes.join(worst, ["scenario_id", "node"], "left")
    return j.select(
        "scenario_id", "node", "job_group_id", F.coalesce("at_risk", F.lit(False)).alias("at_risk"),
        _seconds(F.col("dur")).alias("effective_duration_sec"),
        ms_to_clock(F.col("baseline_finish_ms")).alias("baseline_finish_time"),
        ms_to_clock(F.col("projected_finish_ms")).alias("projected_finish_time"),
        _seconds(F.coalesce("impact_ms", F.lit(0))).alias("real_sla_impact_sec"),
        F.col("w.sla_id").alias("sla_id"), F.col("w.sla_type").alias("sla_type"),
        _seconds(F.col("w.sla_duration_ms")).alias("sla_duration_sec"), ms_to_clock(F.col("w.sla_time_ms")).alias("sla_time"),
        F.greatest(F.lit(0.0), _seconds(F.col("w.buffer_ms"))).alias("_buffer"), F.col("w.buffer_ms").alias("_has_buffer"),
        F.col("w.risk_reason").alias("risk_reason"),
    ).withColumn("buffer_sec", F.when(F.col("_has_buffer").isNotNull(), F.col("_buffer"))).drop("_buffer", "_has_buffer")


class Prediction(NamedTuple):
    impacted: DataFrame  # consolidated rows
    verdicts: DataFrame  # per service level
    summary: DataFrame  # per scenario, empty ones too


class Impact(NamedTuple):
    roots: DataFrame
    nodes: DataFrame  # scenario_id, node, job_group_id, is_root, delay_ms, dur, deadline_ms, ...
    links: DataFrame
    slas: DataFrame


def impact_frame(
    scenarios: DataFrame, sics: DataFrame, job: DataFrame, job_group: DataFrame, resource: DataFrame, require: DataFrame,
    edges: DataFrame, group_edges: DataFrame, sla: DataFrame, runs: DataFrame, as_of: str, days: int = 30,
    scope: DataFrame | None = None, actual: DataFrame | None = None,
) -> Impact:
    """Impacted contexts of all scenarios with durations and deadlines (written once)."""
    state = LoopState(scenarios.sparkSession, "impact")
    roots = resolve_roots(scenarios, sics, job, job_group, resource, require)
    if scope is not None:
        roots = roots.join(scope, ["scenario_id", "node"], "left_semi")
    roots, _ = state.save(roots)
    direct = impacted(roots, edges, scope).select("scenario_id", "node")
    extra = group_cascade(roots, direct, sics, group_edges, scope)
    # written first: their small sizes are then known where millions of nodes meet them
    averages, _ = state.save(avg_duration(runs, sics, as_of, days).select("sic_id", "avg_duration_ms"))
    ends = sla_deadlines(sics, sla, circular_mean_finish(runs, sics, as_of, days))
    ends = Deadlines(state.save(ends.deadlines)[0], ends.slas)
    nodes = (
        direct.unionByName(extra).join(sics.select(F.col("id").alias("node"), "job_id", "job_group_id"), "node")
        .join(roots.withColumn("is_root", F.lit(True)), ["scenario_id", "node"], "left")
        .withColumn("is_root", F.coalesce("is_root", F.lit(False)))
        .join(delay_ms(scenarios), "scenario_id")
        .join(ends.deadlines.select(F.col("sic_id").alias("node"), "deadline_ms"), "node", "left")
    )
    nodes, _ = state.save(effective_duration(nodes, averages, actual))
    links, _ = state.save(scenario_edges(nodes, edges))
    nodes, _ = state.save(with_levels(nodes, links, induced=True))
    slas, _ = state.save(ends.slas)
    return Impact(roots, nodes, links, slas)


def predict_sla_impact(scenarios: DataFrame, impact: Impact) -> Prediction:
    """Service levels each scenario would break; scenarios without roots or impact show zeros."""
    projected = sla_based_projection(impact.nodes, impact.links)
    tails = downstream_tail(impact.nodes, impact.links)
    facts = impact.nodes.join(projected, ["scenario_id", "node"]).join(tails, ["scenario_id", "node"])
    facts, _ = LoopState(scenarios.sparkSession, "prediction").save(facts)
    verdicts = projected_sla(facts.join(impact.slas.withColumnRenamed("sic_id", "node"), "node"))
    rows = consolidate(facts, verdicts)
    n_roots = impact.roots.groupBy("scenario_id").agg(F.count("*").alias("root_sic_count"))
    n_hit = impact.nodes.groupBy("scenario_id").agg(F.count("*").alias("impacted_sic_count"))
    n_sla = verdicts.groupBy("scenario_id").agg(
        F.count("sla_id").alias("sla_evaluated_count"), F.count_if("projected_breach").alias("projected_breach_count"),
        F.count_if("at_risk").alias("at_risk_count"),
    )
    counts = ["root_sic_count", "impacted_sic_count", "sla_evaluated_count", "projected_breach_count", "at_risk_count"]
    summary = (
        scenarios.select("scenario_id", source_kind(F.col("source_type")).alias("source_type"), "source_id", "delay_minutes")
        .join(n_roots, "scenario_id", "left").join(n_hit, "scenario_id", "left").join(n_sla, "scenario_id", "left").fillna(0, counts)
    )
    return Prediction(rows, verdicts, summary)


def date_scope(scenarios: DataFrame, plan: DataFrame, as_of: str) -> DataFrame:
    """Contexts planned on each scenario's date; dates before ``as_of`` are refused."""
    today = F.lit(as_of).cast("date")
    dated = scenarios.select(
        "scenario_id",
        F.when(F.col("business_date") < today, F.raise_error(F.lit("a date projection needs today or a later date")).cast("date"))
        .otherwise(F.col("business_date")).alias("business_date"),
    )
    planned = plan.where("should_run").select("business_date", F.col("sic_id").alias("node"))
    return dated.join(planned, "business_date").select("scenario_id", "node")


def actual_on_date(scenarios: DataFrame, latest: DataFrame) -> DataFrame:
    """Run of each context on each scenario's date, with its duration and finish."""
    return scenarios.select("scenario_id", "business_date").join(latest, "business_date").select(
        "scenario_id", F.col("sic_id").alias("node"), "duration_ms", F.col("end_time_ms").alias("executed_ms")
    )
