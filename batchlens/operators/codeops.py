"""Operations of methods and steps as long tables, their clean-up and their links.

A method's or step's operations are rows (owner, kind, op) with kind DB, PROC,
SHELL or SQL; nothing is gathered into one array per owner.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchlens.operators.codescan import GREY_CORE, GREY_DB, GREY_PROC, GREY_SHELL, mentions
from batchlens.operators.condense import found_below
from batchlens.operators.traverse import reachable
from batchlens.session import LoopState

SHELL_METHODS = ("RUNTIME_EXEC", "PROCESS_BUILDER", "SCRIPT_ENGINE", "COMMAND_LINE")  # fixed values
ROLE_METHOD = {"tasklet": "execute", "reader": "read", "processor": "process", "writer": "write"}  # fixed values


def part(op: Column, i: int) -> Column:
    return F.trim(F.try_element_at(F.split(op, ":"), F.lit(i)))


def is_grey(kind: Column, op: Column) -> Column:
    """Entry whose table, procedure or script segment names something unresolved."""
    return (
        F.when(kind == "DB", mentions(part(op, 2), GREY_DB)).when(kind == "PROC", mentions(part(op, 3), GREY_PROC))
        .when(kind == "SHELL", mentions(part(op, 2), GREY_SHELL)).otherwise(mentions(op, GREY_CORE))
    )


class MethodOps(NamedTuple):
    operations: DataFrame
    flags: DataFrame


def method_db_operations(existing: DataFrame, found: DataFrame) -> MethodOps:
    """Replace the table operations of the methods in ``found``; unresolved tables only raise the review flag."""
    up = found.select(
        "method_fqn", F.upper(F.coalesce("operation_type", F.lit("UNKNOWN"))).alias("operation_type"), F.upper(F.coalesce("table_name", F.lit("UNKNOWN"))).alias("table_name"),
        F.upper(F.coalesce("confidence", F.lit("MEDIUM"))).alias("confidence"),
    )
    grey = mentions(F.col("table_name"), GREY_DB)
    flags = up.groupBy("method_fqn").agg(F.bool_or(grey).alias("further_analysis"))
    kept = existing.join(flags.select("method_fqn"), "method_fqn", "left_anti").select(up.columns)
    return MethodOps(kept.unionByName(up.where(~grey)).distinct(), flags)


def method_procedures(calls: DataFrame) -> DataFrame:
    """Encoded call per method with review flag; ``links`` marks calls that get a resource and an edge."""
    kind = F.when(F.col("is_function"), "FUNCTION").otherwise("PROCEDURE")
    text = F.concat_ws(
        ":", F.coalesce("schema_name", F.lit("UNKNOWN")), F.coalesce("package_name", F.lit("NONE")), "procedure_name", "database_type", kind, F.coalesce("confidence", F.lit("HIGH"))
    )
    review = mentions(F.col("procedure_name"), GREY_PROC) | mentions(F.col("schema_name"), GREY_PROC) | mentions(F.col("package_name"), GREY_PROC)
    return calls.select("method_fqn", text.alias("op"), review.alias("further_analysis"), (~review).alias("links"))


def method_shell(execs: DataFrame) -> DataFrame:
    """Encoded command runs, one row each, with the method's count and review flag."""
    flags = execs.groupBy("method_fqn").agg(F.count("*").alias("execution_count"), F.bool_or("further_analysis").alias("needs_review"))
    rows = execs.select(
        "method_fqn", F.concat_ws(":", "execution_method", "script_name", "confidence").alias("op"), "grey_area_reason", (~F.col("further_analysis")).alias("links")
    )
    return rows.join(flags, "method_fqn")


def ancestors(extends: DataFrame, classes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(class_fqn, ancestor_fqn, depth) including the class itself at depth 0."""
    edges = extends.select(F.col("child_fqn").alias("src_id"), F.col("parent_fqn").alias("dst_id"))
    roots = classes.select(F.col("class_fqn").alias("root"), F.col("class_fqn").alias("node")).distinct()
    r = reachable(edges, roots, max_hops=max_depth)
    return r.select(F.col("root").alias("class_fqn"), F.col("node").alias("ancestor_fqn"), F.col("distance").alias("depth"))


def entry_methods(step_class: DataFrame, methods: DataFrame, extends: DataFrame, limit: int | None = None) -> DataFrame:
    """Entry methods of each step, its classes' own and inherited ones; with ``limit`` the nearest few."""
    wanted = F.when(F.col("step_kind") == "TASKLET", F.array(F.lit("execute"))).otherwise(F.array(F.lit("read"), F.lit("process"), F.lit("write")))
    asked = step_class.select("step_id", "class_fqn", F.explode(wanted).alias("name")).distinct()
    up = ancestors(extends, step_class.select("class_fqn"))
    have = methods.select(F.col("class_fqn").alias("ancestor_fqn"), "name", F.col("fqn").alias("method_fqn"))
    hits = asked.join(up, "class_fqn").join(have, ["ancestor_fqn", "name"]).groupBy("step_id", "method_fqn").agg(F.min("depth").alias("depth"))
    if limit is None:
        return hits
    w = Window.partitionBy("step_id").orderBy("depth", "method_fqn")  # top few per step: limited before the shuffle too
    return hits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).drop("rn")


def _call_edges(calls: DataFrame) -> DataFrame:
    return calls.select(F.col("src_fqn").alias("src_id"), F.col("dst_fqn").alias("dst_id"))


def _roots(entries: DataFrame) -> DataFrame:
    return entries.select("step_id", F.col("method_fqn").alias("node"))


def consolidate_step_ops(entries: DataFrame, calls: DataFrame, method_op: DataFrame) -> DataFrame:
    """Distinct operations of all methods reachable from a step's entry methods, per kind."""
    own = method_op.select(F.col("method_fqn").alias("node"), "kind", "op")
    return found_below(_roots(entries), _call_edges(calls), own, ["kind", "op"])


def step_op_counts(steps: DataFrame, ops: DataFrame) -> DataFrame:
    """Count per step and kind, zeros included."""
    kinds = steps.select(F.col("id").alias("step_id"), F.explode(F.array(*(F.lit(k) for k in ("DB", "PROC", "SHELL", "SQL")))).alias("kind"))
    n = ops.groupBy("step_id", "kind").agg(F.count("*").alias("op_count"))
    return kinds.join(n, ["step_id", "kind"], "left").withColumn("op_count", F.coalesce("op_count", F.lit(0)))


def consolidate_all_steps(
    stored: DataFrame, entries: DataFrame, calls: DataFrame, method_op: DataFrame, class_level: DataFrame, step_bean: DataFrame
) -> DataFrame:
    """Resolved step entries stay; reachable operations join them, except of methods settled at class level for a bean of the step.

    ``class_level``: method_fqn, bean_id.  ``step_bean``: step_id, bean_id.
    """
    keep = stored.where(~is_grey(F.col("kind"), F.col("op"))).select("step_id", "kind", "op")
    # operations of methods settled for some step keep their method, so that each step can leave out its own
    special = class_level.select(F.col("method_fqn").alias("node"), F.lit(True).alias("special")).distinct()
    own = method_op.select(F.col("method_fqn").alias("node"), "kind", "op").join(special, "node", "left").select(
        "node", "kind", "op", F.when(F.col("special"), F.col("node")).alias("method_fqn"))
    settled = class_level.join(step_bean, "bean_id").select("step_id", "method_fqn").distinct()
    found = found_below(_roots(entries), _call_edges(calls), own, ["kind", "op", "method_fqn"])
    fresh = found.join(settled, ["step_id", "method_fqn"], "left_anti").select("step_id", "kind", "op")
    return keep.unionByName(fresh).distinct()


def resolve_method(asked: DataFrame, methods: DataFrame) -> DataFrame:
    """Method of a reference: exact, else by class and name when it has no signature (lowest wins). Needs ref."""
    a = asked.select("ref").distinct()
    exact = a.join(methods.select(F.col("fqn").alias("ref"), F.col("fqn").alias("method_fqn")), "ref", "left")
    bare = a.where(~F.col("ref").contains("(")).select(
        "ref", F.regexp_extract("ref", r"^(.*)\.[^.]+$", 1).alias("class_fqn"), F.regexp_extract("ref", r"([^.]+)$", 1).alias("name"))
    byname = bare.join(methods.select("class_fqn", "name", "fqn"), ["class_fqn", "name"]).groupBy("ref").agg(
        F.min("fqn").alias("guess"), F.count("*").alias("candidates"))
    return exact.join(byname, "ref", "left").select(
        "ref", F.coalesce("method_fqn", "guess").alias("method_fqn"), (F.col("method_fqn").isNull() & (F.coalesce("candidates", F.lit(0)) > 1)).alias("ambiguous"))


class Applied(NamedTuple):
    method_op: DataFrame
    step_op: DataFrame
    resources: DataFrame


def apply_manual(method_op: DataFrame, step_op: DataFrame, mappings: DataFrame, step_bean: DataFrame) -> Applied:
    """Put hand-made resolutions in place of unresolved entries.

    ``mappings``: method_fqn, kind, op, resource_name, bean_id.  With a bean
    the entry goes to every step using the bean and the method's own list is
    emptied; without one it goes to the method.  A target's unresolved entries
    of the kind give way; shell entries of a method stay only when resolved,
    and database lists of methods are rebuilt from their edges instead.
    """
    m = mappings.distinct()
    with_bean, direct = m.where("bean_id IS NOT NULL"), m.where("bean_id IS NULL")
    to_step = with_bean.join(step_bean, "bean_id").select("step_id", "kind", "op").distinct()
    touched = to_step.select("step_id", "kind", F.lit(True).alias("hit")).distinct()
    step_left = step_op.join(touched, ["step_id", "kind"], "left").where(~(F.coalesce("hit", F.lit(False)) & is_grey(F.col("kind"), F.col("op"))))
    steps = step_left.select("step_id", "kind", "op").unionByName(to_step).distinct()

    generic = with_bean.select("method_fqn", "kind", F.lit(True).alias("generic")).distinct()
    mine = direct.select("method_fqn", "kind", F.lit(True).alias("mine")).distinct()
    flagged = method_op.join(generic, ["method_fqn", "kind"], "left").join(mine, ["method_fqn", "kind"], "left")
    grey, kind = is_grey(F.col("kind"), F.col("op")), F.col("kind")
    gives_way = F.when(kind == "SHELL", ~F.col("op").startswith("RESOLVED")).when(kind == "PROC", grey).otherwise(False)
    left = flagged.where(F.col("generic").isNull() & ~(F.coalesce("mine", F.lit(False)) & gives_way))
    added = direct.where(kind != "DB").select("method_fqn", "kind", "op")
    methods = left.select("method_fqn", "kind", "op").unionByName(added).distinct()
    table = F.when(kind == "DB", "TABLE").when(kind == "PROC", "PROCEDURE").when(kind == "SHELL", "SHELL_SCRIPT").otherwise("SQL_SCRIPT")
    resources = m.select(F.col("resource_name").alias("name"), table.alias("type"), F.lit(True).alias("manually_resolved")).distinct()
    return Applied(methods, steps, resources)


def dismiss(method_op: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Drop unresolved entries of dismissed (method_fqn, kind); database lists and resolved shell entries stay."""
    j = method_op.join(dismissed.select("method_fqn", "kind", F.lit(True).alias("gone")).distinct(), ["method_fqn", "kind"], "left")
    kind, op = F.col("kind"), F.col("op")
    drop = F.when(kind == "PROC", is_grey(kind, op)).when(kind == "SHELL", is_grey(kind, op) & ~op.startswith("RESOLVED")).otherwise(False)
    return j.where(~(F.coalesce("gone", F.lit(False)) & drop)).select("method_fqn", "kind", "op")


def rebuild_method_ops(methods: DataFrame, db_operation: DataFrame) -> DataFrame:
    """Encoded database operations of every method from its edges, with the count (0 without any)."""
    text = F.concat_ws(":", "operation_type", "table_name", F.coalesce("confidence", F.lit("MEDIUM")))
    ops = db_operation.select("method_fqn", text.alias("op")).distinct()
    n = ops.groupBy("method_fqn").agg(F.count("*").alias("op_count"))
    return methods.select(F.col("fqn").alias("method_fqn")).join(ops, "method_fqn", "left").join(n, "method_fqn", "left").withColumn(
        "op_count", F.coalesce("op_count", F.lit(0)))


def normal_operation(text: Column) -> Column:
    t = F.upper(text)

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | t.contains(w)
        return out

    return (
        F.when(has("SELECT", "READ", "QUERY"), "READ").when(has("INSERT", "CREATE"), "INSERT").when(has("DELETE", "REMOVE"), "DELETE")
        .when(has("UPDATE", "MERGE"), "INSERT").when(has("AGGREGATE", "COUNT", "SUM"), "AGGREGATE").otherwise("READ")
    )


def step_resource_links(step_op: DataFrame) -> DataFrame:
    """Resolved step operations as edges to resources: (step_id, edge, resource_type, resource_name, operation, confidence)."""
    t = step_op.where(~mentions(F.col("op"), GREY_CORE)).withColumn("op", F.regexp_replace("op", "^RESOLVED:", ""))
    op, none = F.col("op"), F.lit(None).cast("string")
    size = F.size(F.split(op, ":"))
    db = t.where((F.col("kind") == "DB") & (size >= 2)).select(
        "step_id", F.lit("DB_OPERATION").alias("edge"), F.lit("TABLE").alias("resource_type"), part(op, 2).alias("resource_name"),
        normal_operation(part(op, 1)).alias("operation"), F.coalesce(part(op, 3), F.lit("MEDIUM")).alias("confidence"))
    proc = t.where((F.col("kind") == "PROC") & (size >= 5)).select(
        "step_id", F.lit("INVOKES").alias("edge"), part(op, 5).alias("resource_type"), part(op, 3).alias("resource_name"), part(op, 1).alias("operation"),
        F.coalesce(part(op, 6), F.lit("HIGH")).alias("confidence"))
    led = F.upper(part(op, 1)).isin(*SHELL_METHODS)
    shell = t.where(F.col("kind") == "SHELL").select(
        "step_id", F.lit("EXECUTES").alias("edge"), F.lit("SHELL_SCRIPT").alias("resource_type"), F.when(led & (size >= 2), part(op, 2)).otherwise(part(op, 1)).alias("resource_name"),
        none.alias("operation"), F.coalesce(F.when(led, part(op, 3)).otherwise(part(op, 2)), F.lit("HIGH")).alias("confidence"))
    rated = F.upper(F.element_at(F.split(op, ":"), -1)).isin("HIGH", "MEDIUM", "LOW") & (size >= 2)
    sql = t.where(F.col("kind") == "SQL").select(
        "step_id", F.lit("INVOKES").alias("edge"), F.lit("SQL_SCRIPT").alias("resource_type"), F.trim(F.when(rated, F.regexp_replace(op, ":[^:]*$", "")).otherwise(op)).alias("resource_name"),
        none.alias("operation"), F.when(rated, F.element_at(F.split(op, ":"), -1)).otherwise("HIGH").alias("confidence"))
    return db.unionByName(proc).unionByName(shell).unionByName(sql).where(F.col("resource_name") != "").distinct()


def step_links_by_methods(step_class: DataFrame, methods: DataFrame, calls: DataFrame, method_op: DataFrame) -> DataFrame:
    """Operations of all methods at or below a step's classes; the lowest method is kept per (step, operation)."""
    own = step_class.select("step_id", "class_fqn").distinct().join(methods.select("class_fqn", F.col("fqn").alias("method_fqn")), "class_fqn")
    ops = method_op.select(F.col("method_fqn").alias("node"), "kind", "op", "method_fqn")
    return found_below(_roots(own), _call_edges(calls), ops, ["kind", "op"], {"method_fqn": F.min("method_fqn")})


def job_list(job: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    picked = job if kinds is None else job.where(F.col("type").isin(kinds))
    return picked.select("id", "name", "type").orderBy("name")


def repositories(job: DataFrame) -> DataFrame:
    return job.groupBy(F.col("git_repo").alias("repository")).agg(F.count("*").alias("job_count"))


def method_source(methods: DataFrame, fqn: str | None = None) -> DataFrame:
    picked = methods if fqn is None else methods.where(F.col("fqn") == fqn)
    return picked.select("fqn", "class_fqn", "source")


def step_gap_counts(steps: DataFrame, step_op: DataFrame) -> DataFrame:
    """Unresolved entries per step."""
    gaps = step_op.where(is_grey(F.col("kind"), F.col("op")) & (F.col("kind") != "SQL")).groupBy(F.col("step_id").alias("id")).agg(F.count("*").alias("gap_count"))
    return steps.join(gaps, "id", "left").select("job_id", F.col("id").alias("step_id"), "step_kind", F.coalesce("gap_count", F.lit(0)).alias("gap_count"))


def step_gaps(step_class: DataFrame, methods: DataFrame, calls: DataFrame, method_op: DataFrame, max_calls: int | None = None) -> DataFrame:
    """Unresolved entries of methods below a step's entry methods (at most ``max_calls`` calls, if given)."""
    names = list(ROLE_METHOD.values())
    own = step_class.select("step_id", "class_fqn").distinct().join(
        methods.where(F.col("name").isin(names)).select("class_fqn", F.col("fqn").alias("method_fqn")), "class_fqn").select("step_id", "method_fqn")
    own, _ = LoopState(own.sparkSession, "own").save(own)
    grey = method_op.where(is_grey(F.col("kind"), F.col("op")) & (F.col("kind") != "SQL"))
    start = own.select(F.col("method_fqn").alias("root"), F.col("method_fqn").alias("node")).distinct()
    below = reachable(_call_edges(calls), start, max_hops=max_calls, targets=grey.select(F.col("method_fqn").alias("node")).distinct())
    reach = own.join(below.select(F.col("root").alias("method_fqn"), F.col("node").alias("found")), "method_fqn").select(
        "step_id", F.col("found").alias("method_fqn")).distinct()
    flags = methods.select(F.col("fqn").alias("method_fqn"), F.coalesce("further_analysis", F.lit(False)).alias("further_analysis"))
    return reach.join(grey, "method_fqn").join(flags, "method_fqn").select(
        "step_id", F.lower("kind").alias("category"), "op", "method_fqn", "further_analysis")


class Trace(NamedTuple):
    methods: DataFrame  # step_id, method_fqn (unresolved), distance
    path: DataFrame  # step_id, method_fqn, position, on_path


def trace_unknown(entries: DataFrame, calls: DataFrame, method_op: DataFrame) -> Trace:
    """Shortest call path from a step's entries to each method with unresolved entries.

    One walk back from the unresolved methods finds all that lead to one; the
    walk forward stays among them and keeps each method's lowest caller.  Paths
    are then read off for the unresolved methods only, the farthest first, so
    that every hop reads the methods of one distance.
    """
    state = LoopState(entries.sparkSession, "trace")
    edges = _call_edges(calls)
    roots = _roots(entries).distinct()
    grey = method_op.where(is_grey(F.col("kind"), F.col("op"))).select(F.col("method_fqn").alias("node")).distinct()
    reach = reachable(edges, roots, ["step_id"], max_hops=None, targets=grey, callers=True)
    hit, far = state.save_largest(reach.join(grey, "node", "left_semi").select("step_id", "node", "distance"), distance=F.col("distance"))
    done: list[DataFrame] = []
    for position in range(max(far["distance"], 0), -1, -1):
        at = hit.where(F.col("distance") == position).select(
            "step_id", F.col("node").alias("method_fqn"), F.lit(position).alias("position"), F.col("node").alias("on_path"))
        if done:
            below = reach.where(F.col("distance") == position + 1).select("step_id", F.col("node").alias("on_path"), "caller")
            back = done[-1].join(below, ["step_id", "on_path"]).select("step_id", "method_fqn", F.lit(position).alias("position"), F.col("caller").alias("on_path"))
            at = at.unionByName(back)
        done.append(state.save(at)[0])
    return Trace(hit.withColumnRenamed("node", "method_fqn"), state.union_of(done))


class Registry(NamedTuple):
    extends: DataFrame
    implementations: DataFrame
    summary: DataFrame


def interface_registry(classes: DataFrame, extends: DataFrame, references: DataFrame) -> Registry:
    """Extends edges between known classes, direct implementations of interfaces, and none/single/multiple per interface.

    ``references``: class_fqn, ref (full names).
    """
    ids = classes.select("fqn")
    known = extends.join(ids.withColumnRenamed("fqn", "child_fqn"), "child_fqn", "left_semi").join(ids.withColumnRenamed("fqn", "parent_fqn"), "parent_fqn", "left_semi")
    faces = classes.where("is_interface").select(F.col("fqn").alias("interface_fqn"))
    impl = references.join(classes.where(~F.col("is_interface")).select(F.col("fqn").alias("class_fqn")), "class_fqn", "left_semi").select(
        F.col("ref").alias("interface_fqn"), F.col("class_fqn").alias("impl_fqn")).join(faces, "interface_fqn", "left_semi").distinct()
    n = impl.groupBy("interface_fqn").agg(F.count("*").alias("impl_count"), F.min("impl_fqn").alias("first_impl"))
    summary = faces.join(n, "interface_fqn", "left").select(
        "interface_fqn", F.coalesce("impl_count", F.lit(0)).alias("impl_count"), "first_impl",
        F.when(F.col("impl_count") == 1, "single").when(F.col("impl_count") > 1, "multiple").otherwise("none").alias("bucket"))
    return Registry(known.select("child_fqn", "parent_fqn"), impl, summary)


def inherited_method(asked: DataFrame, methods: DataFrame, extends: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nearest class declaring a method, for (class_fqn, name): the class itself or an ancestor."""
    up = ancestors(extends, asked, max_depth)
    have = methods.groupBy(F.col("class_fqn").alias("ancestor_fqn"), "name").agg(F.min("fqn").alias("method_fqn"))
    hits = asked.select("class_fqn", "name").distinct().join(up, "class_fqn").join(have, ["ancestor_fqn", "name"])
    best = F.min_by(F.struct("ancestor_fqn", "depth", "method_fqn"), F.struct("depth", "ancestor_fqn")).alias("b")
    return hits.groupBy("class_fqn", "name").agg(best).select("class_fqn", "name", "b.*")


def bean_lookup(beans: DataFrame, bean_id: str | None = None, composite_key: str | None = None, bean_class: str | None = None) -> DataFrame:
    """Beans by id, composite key or class."""
    out = beans
    for column, value in (("bean_id", bean_id), ("composite_key", composite_key), ("bean_class", bean_class)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def bean_stats(beans: DataFrame) -> DataFrame:
    return beans.agg(F.count("*").alias("total"), F.count_if("processed").alias("processed"), F.count_if(~F.col("processed")).alias("pending"))


class StepBeans(NamedTuple):
    uses: DataFrame
    implemented_by: DataFrame
    unmatched: DataFrame


def step_bean_edges(steps: DataFrame, beans: DataFrame, classes: DataFrame) -> StepBeans:
    """Beans and classes behind a step's four roles. ``steps``: step_id plus <role>_bean and <role>_class columns."""
    roles = ("tasklet", "reader", "processor", "writer")
    stacked = steps.select("step_id", F.explode(F.array(*(
        F.struct(F.lit(r).alias("role"), F.col(f"{r}_bean").alias("bean_id"), F.col(f"{r}_class").alias("bean_class")) for r in roles))).alias("x")
    ).select("step_id", "x.*").where("bean_id IS NOT NULL OR bean_class IS NOT NULL")
    keyed = stacked.withColumn("composite_key", F.concat_ws("___", "bean_id", "bean_class"))
    known = beans.select("composite_key").distinct()
    uses = keyed.where("bean_id IS NOT NULL").join(known, "composite_key", "left_semi").select("step_id", "role", "composite_key")
    missing = keyed.where("bean_id IS NOT NULL").join(known, "composite_key", "left_anti").select("step_id", "role", "composite_key")
    impl = stacked.join(classes.select(F.col("fqn").alias("bean_class")), "bean_class", "left_semi").select("step_id", F.col("bean_class").alias("class_fqn")).distinct()
    return StepBeans(uses.distinct(), impl, missing.distinct())


def returned_classes(raw: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls with the return type (``returned``) of the call they hang on (via_*).

    Calls that hang on no other find nothing; a key of their own spreads them over all tasks, else one task would get them all.
    """
    named = lambda owner, name: F.concat(F.length(owner).cast("string"), F.lit(":"), owner, name)
    returns = methods.select(named(F.col("class_fqn"), F.col("name")).alias("_via"), "fqn", "return_class").groupBy("_via").agg(F.min_by("return_class", "fqn").alias("returned"))
    alone = F.concat(F.lit("#"), F.xxhash64("src_fqn", "name", "target_class").cast("string"))
    keyed = raw.withColumn("_via", F.coalesce(named(F.col("via_class"), F.col("via_name")), alone))
    return keyed.join(returns, "_via", "left").drop("_via")


class Resolved(NamedTuple):
    calls: DataFrame
    uses_class: DataFrame


def resolve_call_edges(raw: DataFrame, injected: DataFrame, classes: DataFrame, methods: DataFrame, extends: DataFrame, registry: Registry) -> Resolved:
    """Call edges to declared methods, interfaces resolved to implementations.

    ``raw``: src_fqn, class_fqn, field, target_class, name, via_class, via_name.
    ``injected``: class_fqn, field, bean_class.  An injected bean class
    replaces the declared type of its field; a chained call takes the return
    type of the call it hangs on (via_*).
    """
    r = raw.join(injected.select("class_fqn", "field", "bean_class"), ["class_fqn", "field"], "left")
    r = returned_classes(r, methods)
    r = r.withColumn("declared", F.coalesce("bean_class", "returned", "target_class"))
    faces = registry.summary.select(F.col("interface_fqn").alias("declared"), "impl_count", "first_impl", "bucket")
    r = r.join(faces, "declared", "left").withColumn("chosen", F.coalesce("first_impl", "declared"))
    r, _ = LoopState(raw.sparkSession, "calls").save(r)
    found = inherited_method(r.select(F.col("chosen").alias("class_fqn"), "name"), methods, extends)
    found = found.select(F.col("class_fqn").alias("chosen"), "name", F.col("method_fqn").alias("dst_fqn"), F.col("ancestor_fqn").alias("dst_class"))
    j = r.join(found, ["chosen", "name"], "left")
    reason = (
        F.when(F.col("bucket") == "none", "no_implementation").when(F.col("bucket") == "multiple", "multiple_implementations")
        .when((F.col("bucket") == "single") & F.col("dst_fqn").isNull(), "method_not_found_in_implementation")
    )
    j = j.withColumn("review_reason", reason)
    calls = j.where("dst_fqn IS NOT NULL").select(
        "src_fqn", "dst_fqn", F.col("review_reason").isNotNull().alias("requires_review"), "review_reason",
        (F.col("bucket").isNotNull() & (F.col("bucket") != "none")).alias("resolved_from_interface"),
    ).distinct()
    uses = j.select("class_fqn", F.coalesce("dst_class", "chosen").alias("target")).where("class_fqn <> target").join(
        classes.select(F.col("fqn").alias("target")), "target", "left_semi").distinct()
    return Resolved(calls, uses.select("class_fqn", "target"))
