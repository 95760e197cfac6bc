"""Dependency, flow and graph queries."""

from pyspark.sql import functions as F

from batchlens.operators import flows as f
from batchlens.operators import graphview as g
from batchlens.plans.registry import SHARED, query

SHARED.update({
    "chain": """
        SELECT root, node, CASE min(k) WHEN 0 THEN 'TARGET' WHEN 1 THEN 'UPSTREAM' ELSE 'DOWNSTREAM' END AS direction FROM (
            SELECT root, node, 0 AS k FROM {down} WHERE distance = 0 UNION ALL SELECT node, root, 1 FROM {down} WHERE distance BETWEEN 1 AND 30
            UNION ALL SELECT root, node, 2 FROM {down} WHERE distance BETWEEN 1 AND 30) GROUP BY 1, 2""",
    "names": "SELECT s.id AS node, s.name AS context_name, j.name AS job_name, s.enabled FROM {sic} s LEFT JOIN {job} j ON j.id = s.job_id",
    "gflow": "SELECT e.job_group_id, d.node, min(d.distance) AS distance FROM {entry} e JOIN {down} d ON d.root = e.sic_id WHERE d.distance <= 30 GROUP BY 1, 2",
    "sflow": """ /*rec*/ SELECT job_id, node, min(d) AS distance FROM (WITH RECURSIVE r AS (SELECT job_id, node_id AS node, 0 AS d FROM {job_entry}
        UNION SELECT r.job_id, e.dst_id, r.d + 1 FROM r JOIN {flow_edge} e ON e.src_id = r.node WHERE r.d < 20) SELECT * FROM r) GROUP BY 1, 2""",
    "near": """
        SELECT * FROM {edge_view} WHERE (src_id = 'JG_3' AND src_label = 'JobGroup') OR (dst_id = 'JG_3' AND dst_label = 'JobGroup')""",
    "near_ids": "SELECT 'JobGroup' AS label, 'JG_3' AS id UNION SELECT src_label, src_id FROM {near} UNION SELECT dst_label, dst_id FROM {near}",
})

PROPS = " UNION ALL ".join(
    f"SELECT id, label, '{p}' AS key, cast({p} AS varchar) AS value FROM picked WHERE {p} IS NOT NULL" for p in g.NODE_PROPERTIES
)


def chain(t):
    return f.job_dependency_chain(t.sic, t.job, t.sic_precedes)


def group_flow(t):
    return f.jobgroup_execution_flow(t.sic, t.job, t.entry, t.sic_precedes)


def step_flow(t):
    return f.job_step_flow(t.flow_node, t.flow_edge, t.job_entry)


def flat(nodes):
    return nodes.select("id", "label", F.explode("properties").alias("key", "value"))


@query("d1_job_dependency_chain", "SELECT c.root, c.node, n.context_name, n.job_name, c.direction, n.enabled FROM {chain} c JOIN {names} n USING (node)")
def d1(t):
    return chain(t).nodes


@query("d1_dependency_edges", """
    SELECT d.root, e.src_id, e.dst_id FROM {down} d JOIN {sic_precedes} e ON e.src_id = d.node WHERE d.distance < 30
    UNION SELECT d.node, e.src_id, e.dst_id FROM {down} d JOIN {sic_precedes} e ON e.dst_id = d.root WHERE d.distance < 30""")
def d1_edges(t):
    return chain(t).edges


@query("d1_dependency_summary", """
    SELECT root, count(*) AS total_contexts, count(*) FILTER (direction = 'UPSTREAM') AS upstream_job_count,
           count(*) FILTER (direction = 'DOWNSTREAM') AS downstream_job_count FROM {chain} GROUP BY 1""")
def d1_summary(t):
    return chain(t).summary


@query("d2_jobgroup_execution_flow", """
    SELECT job_group_id, node, context_name, job_name, enabled, distance,
           row_number() OVER (PARTITION BY job_group_id ORDER BY distance, node) - 1 AS order_index FROM {gflow} JOIN {names} USING (node)""")
def d2(t):
    return group_flow(t).nodes


@query("d2_flow_edges", "SELECT DISTINCT job_group_id, src_id, dst_id FROM {gflow} JOIN {sic_precedes} ON src_id = node WHERE distance < 30")
def d2_edges(t):
    return group_flow(t).edges


@query("d3_job_step_flow", """
    SELECT s.job_id, node, label, name, coalesce(step_kind, '') AS step_kind, coalesce(block_type, '') AS block_type, distance
    FROM {sflow} s JOIN {flow_node} n ON n.id = s.node""")
def d3(t):
    return step_flow(t).nodes


@query("d3_step_flow_edges", "SELECT DISTINCT s.job_id, src_id, dst_id, coalesce(on_status, 'DEFAULT') AS on_status FROM {sflow} s JOIN {flow_edge} e ON e.src_id = s.node WHERE distance < 20")
def d3_edges(t):
    return step_flow(t).edges


@query("d3_step_flow_summary", """
    SELECT s.job_id, count(*) AS node_count, count(*) FILTER (label = 'Step') AS step_count, count(*) FILTER (label = 'Decision') AS decision_count,
           count(*) FILTER (label = 'Block') AS block_count FROM {sflow} s JOIN {flow_node} n ON n.id = s.node GROUP BY 1""")
def d3_summary(t):
    return step_flow(t).summary


@query("d4_terminal_step_paths", """
    WITH RECURSIVE sinks AS (SELECT job_id, node FROM {sflow} WHERE node NOT IN (SELECT src_id FROM {flow_edge})),
    b AS (SELECT job_id, node AS sink, node FROM sinks UNION SELECT b.job_id, b.sink, e.src_id FROM b JOIN {flow_edge} e ON e.dst_id = b.node)
    SELECT b.job_id, b.sink, b.node, s.distance FROM b JOIN {sflow} s ON s.job_id = b.job_id AND s.node = b.node""")
def d4(t):
    return f.terminal_step_paths(t.flow_edge, t.job_entry)


@query("g1_entity_graph_nodes", f"WITH picked AS (SELECT n.* FROM {{node_view}} n JOIN {{near_ids}} USING (label, id)) {PROPS}")
def g1_nodes(t):
    return flat(g.entity_graph(t.node_view, t.edge_view, "NATION_3").nodes)


@query("g1_entity_graph_edges", "SELECT DISTINCT * FROM {near}")
def g1_edges(t):
    return g.entity_graph(t.node_view, t.edge_view, "JG_3").edges


@query("g2_expand_node", f"""
    WITH picked AS (SELECT n.* FROM {{node_view}} n JOIN {{near_ids}} x USING (label, id) WHERE id <> 'JG_3' AND id NOT IN (SELECT sic_id FROM {{entry}})) {PROPS}""")
def g2(t):
    return flat(g.expand_node(t.node_view, t.edge_view, "JG_3", t.entry.select(F.col("sic_id").alias("id"))).nodes)


@query("g2_expand_edges", """
    SELECT DISTINCT * FROM {near} WHERE (CASE WHEN src_id = 'JG_3' THEN dst_id ELSE src_id END) NOT IN (SELECT sic_id FROM {entry})""")
def g2_edges(t):
    return g.expand_node(t.node_view, t.edge_view, "JG_3", t.entry.select(F.col("sic_id").alias("id"))).edges


def two_graphs(t):
    flow, steps = group_flow(t), step_flow(t)
    one = g.Graph(
        flow.nodes.select(F.col("node").alias("id"), F.lit("ScheduleInstanceContext").alias("label"), "job_name").distinct(),
        flow.edges.select(F.concat_ws(">", "src_id", "dst_id").alias("id"), "src_id", "dst_id", F.lit(None).cast("int").alias("position")).distinct(),
    )
    names = f.context_job_names(t.sic, t.job)
    two = g.Graph(
        names.select(F.col("node").alias("id"), F.lit("Context").alias("label"), F.lit(None).cast("string").alias("job_name"))
        .unionByName(steps.nodes.select(F.col("node").alias("id"), "label", F.lit(None).cast("string").alias("job_name"))),
        t.job_entry.select(F.lit(None).cast("string").alias("id"), F.col("job_id").alias("src_id"), F.col("node_id").alias("dst_id"),
                           F.regexp_extract("job_id", r"(\d+)$", 1).cast("int").alias("position")),
    )
    return g.merge_graphs([one, two])


@query("g4_merge_graph_nodes", """
    SELECT id, label, job_name FROM (SELECT DISTINCT node AS id, 'ScheduleInstanceContext' AS label, job_name FROM {gflow} JOIN {names} USING (node))
    UNION ALL SELECT node, 'Context', NULL FROM {names} WHERE node NOT IN (SELECT node FROM {gflow})
    UNION ALL SELECT node, label, NULL FROM {sflow} s JOIN {flow_node} n ON n.id = s.node""")
def g4_nodes(t):
    return two_graphs(t).nodes


@query("g4_merge_graph_edges", """
    SELECT DISTINCT src_id || '>' || dst_id AS id, src_id, dst_id FROM {gflow} JOIN {sic_precedes} ON src_id = node WHERE distance < 30
    UNION ALL SELECT 'rel-' || replace(job_id, 'JOB_', ''), job_id, node_id FROM {job_entry}""")
def g4_edges(t):
    return two_graphs(t).edges


@query("g5_strip_graph", """
    SELECT s.job_id, count(*) AS node_count, count(*) FILTER (label = 'Step') AS step_count FROM {sflow} s JOIN {flow_node} n ON n.id = s.node GROUP BY 1""")
def g5(t):
    flow = step_flow(t)
    item = F.struct("node_count", "step_count", F.struct(F.col("job_id").alias("center")).alias("graphlet"))
    nested = flow.summary.select("job_id", F.lit("x").alias("graphlet"), F.lit("y").alias("relationships"), F.array(item).alias("groups"))
    return g.strip_graph(nested).select("job_id", F.inline("groups"))


@query("k1_node_statistics", "SELECT label, count(*) AS node_count FROM {node_view} GROUP BY 1")
def k1(t):
    return g.node_statistics(t.node_view)


def _case(column, texts, fallback):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in texts.items()) + f" ELSE '{fallback}' || {column} END"


@query("k2_graph_schema", f"""
    SELECT DISTINCT 'label' AS kind, label AS item, {_case('label', g.LABEL_TEXT, 'Node type: ')} AS description FROM {{node_view}}
    UNION ALL SELECT DISTINCT 'edge_type', type, {_case('type', g.EDGE_TEXT, 'Relationship type: ')} FROM {{edge_view}}
    UNION ALL SELECT DISTINCT 'pattern', '(' || src_label || ')-[:' || type || ']->(' || dst_label || ')', NULL FROM {{edge_view}}
    UNION ALL SELECT DISTINCT 'property', label || '.' || k, 'Property ''' || k || ''' of node ''' || label || '''' FROM (
      {" UNION ALL ".join(f"SELECT label, '{p}' AS k FROM {{node_view}} WHERE {p} IS NOT NULL" for p in g.NODE_PROPERTIES)})""")
def k2(t):
    return g.graph_schema(t.node_view, t.edge_view)
