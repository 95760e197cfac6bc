"""Questions over the union node and edge views, and merging of graph results."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_PROPERTIES = ("id", "name", "description", "type", "enabled", "status")

# fixed values: descriptions of the labels and edge types of the schema report
LABEL_TEXT = {
    "JobGroup": "Group of scheduled jobs", "Job": "Batch job definition", "ScheduleInstanceContext": "A job placed in a group's schedule",
    "Resource": "File, table, script or procedure a run needs", "SLA": "Service level", "JobGroupExecution": "One run of a group",
    "JobContextExecution": "One run of a context",
}
EDGE_TEXT = {
    "FOR_GROUP": "Context belongs to group", "FOR_JOB": "Context runs job", "PRECEDES": "Must finish before",
    "HAS_SLA": "Is bound by service level", "ENTRY": "Group starts here", "REQUIRE_RESOURCE": "Needs resource",
}


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def _with_properties(nodes: DataFrame) -> DataFrame:
    """Node id, label and the non-null ones of the fixed properties."""
    pairs = [x for p in NODE_PROPERTIES for x in (F.lit(p), F.col(p).cast("string"))]
    return nodes.select("id", "label", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("properties"))


def _center(nodes: DataFrame, matches) -> tuple[str, str]:
    """Label and id of the entity asked for: one row, so it can become a literal filter."""
    row = nodes.where(matches).select("label", "id").orderBy("label", "id").first()
    return (row.label, row.id) if row else ("", "")


def _around(edges: DataFrame, label: str, node_id: str) -> DataFrame:
    """Edges at a node, either direction: two literal filters, which also prune edge types that cannot touch its label."""
    out = edges.where((F.col("src_label") == label) & (F.col("src_id") == node_id))
    back = edges.where((F.col("dst_label") == label) & (F.col("dst_id") == node_id))
    return out.unionByName(back).distinct()


def entity_graph(nodes: DataFrame, edges: DataFrame, entity: str) -> Graph:
    """An entity (by id or name) with its direct neighbours and edges."""
    label, node_id = _center(nodes, (F.col("id") == entity) | (F.col("name") == entity))
    links = _around(edges, label, node_id)
    ends = F.explode(F.array(
        F.struct(F.col("src_label").alias("label"), F.col("src_id").alias("id")), F.struct(F.col("dst_label").alias("label"), F.col("dst_id").alias("id")),
    ))
    neighbours = links.select(ends.alias("n")).select("n.*").where((F.col("label") != label) | (F.col("id") != node_id)).distinct()
    own = nodes.where((F.col("label") == label) & (F.col("id") == node_id))
    return Graph(_with_properties(nodes.join(neighbours, ["label", "id"], "left_semi").unionByName(own)), links)


def expand_node(nodes: DataFrame, edges: DataFrame, node_id: str, existing: DataFrame) -> Graph:
    """Neighbours of a node (by id) that are not in ``existing`` (column id), and the edges to them."""
    label, found = _center(nodes, F.col("id") == node_id)
    links = _around(edges, label, found)
    at_source = (F.col("src_id") == found) & (F.col("src_label") == label)
    other = links.withColumn("n_label", F.when(at_source, F.col("dst_label")).otherwise(F.col("src_label")))
    other = other.withColumn("n_id", F.when(at_source, F.col("dst_id")).otherwise(F.col("src_id")))
    fresh = other.join(existing.select(F.col("id").alias("n_id")).distinct(), "n_id", "left_anti")
    ids = fresh.select(F.col("n_label").alias("label"), F.col("n_id").alias("id")).distinct()
    return Graph(_with_properties(nodes.join(ids, ["label", "id"], "left_semi")), fresh.select(edges.columns))


def merge_graphs(results: Sequence[Graph]) -> Graph:
    """Union of graph results; the first result that has an id keeps it.

    Nodes need ``id``; edges need ``id`` or, when it is null, ``position``
    (their place in their own list), which gives ``rel-<position>``.
    """
    def first_of(frames: list[DataFrame]) -> DataFrame:
        tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
        merged = tagged[0]
        for f in tagged[1:]:
            merged = merged.unionByName(f, allowMissingColumns=True)
        cols = [c for c in merged.columns if c not in ("id", "_source")]
        merged = merged.where(F.col("id").isNotNull() & (F.col("id") != ""))
        order = F.struct("_source", F.to_json(F.struct(*cols)))
        return merged.groupBy("id").agg(F.min_by(F.struct(*cols), order).alias("v")).select("id", "v.*")

    edges = [
        g.edges.withColumn("id", F.coalesce(F.col("id"), F.concat(F.lit("rel-"), F.col("position").cast("string")))).drop("position")
        for g in results
    ]
    return Graph(first_of([g.nodes for g in results]), first_of(edges))


def strip_graph(results: DataFrame) -> DataFrame:
    """Drop graph payload columns; inside ``groups`` drop each item's ``graphlet``."""
    slim = results.drop("graphlet", "nodes", "relationships")
    field = next((f for f in slim.schema.fields if f.name == "groups"), None)
    if field is None or not isinstance(field.dataType, T.ArrayType):
        return slim
    if "graphlet" not in field.dataType.elementType.fieldNames():
        return slim
    return slim.withColumn("groups", F.transform("groups", lambda g: g.dropFields("graphlet")))


def node_statistics(nodes: DataFrame) -> DataFrame:
    """Node count per label, largest first."""
    return nodes.groupBy("label").agg(F.count("*").alias("node_count")).orderBy(F.desc("node_count"), "label")


def _described(df: DataFrame, column: str, texts: dict[str, str], fallback: str) -> DataFrame:
    pairs = [x for k, v in texts.items() for x in (F.lit(k), F.lit(v))]
    text = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.concat(F.lit(fallback), F.col(column)))
    return df.select(F.col(column).alias("item"), text.alias("description"))


def graph_schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels, edge types, property keys per label and (label, type, label) patterns, described."""
    labels = _described(nodes.select("label").distinct(), "label", LABEL_TEXT, "Node type: ").withColumn("kind", F.lit("label"))
    types = _described(edges.select("type").distinct(), "type", EDGE_TEXT, "Relationship type: ").withColumn("kind", F.lit("edge_type"))
    present = nodes.groupBy("label").agg(*(F.count(p).alias(p) for p in NODE_PROPERTIES))
    keys = present.select("label", F.explode(F.array(*(F.when(F.col(p) > 0, F.lit(p)) for p in NODE_PROPERTIES))).alias("key")).where("key IS NOT NULL")
    props = keys.select(
        F.concat_ws(".", "label", "key").alias("item"),
        F.format_string("Property '%s' of node '%s'", "key", "label").alias("description"), F.lit("property").alias("kind"),
    )
    shape = edges.select("src_label", "type", "dst_label").distinct()
    patterns = shape.select(
        F.format_string("(%s)-[:%s]->(%s)", "src_label", "type", "dst_label").alias("item"),
        F.lit(None).cast("string").alias("description"), F.lit("pattern").alias("kind"),
    )
    return labels.unionByName(types).unionByName(props).unionByName(patterns).select("kind", "item", "description")
