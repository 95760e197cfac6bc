from pyspark.sql import functions as F

from batchlens.operators import codeops, codescan, traverse
from batchlens.operators.codeops import returned_classes


def methods(spark, *sources):
    return spark.createDataFrame([(f"m{i}", "run", s) for i, s in enumerate(sources)], "fqn string, name string, source string")


def test_a_chain_of_sixty_is_walked_to_its_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "src_id long, dst_id long")
    roots = spark.createDataFrame([(0, 0)], "root long, node long")
    assert traverse.reachable(edges, roots).agg({"distance": "max"}).first()[0] == 60


def test_deep_inheritance_and_every_entry_method(spark):
    extends = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(15)], "child_fqn string, parent_fqn string")
    have = spark.createDataFrame([(f"c{i}", "execute", f"c{i}.execute") for i in (0, 3, 7, 12, 15)], "class_fqn string, name string, fqn string")
    step = spark.createDataFrame([("s", "c0", "TASKLET")], "step_id string, class_fqn string, step_kind string")
    assert codeops.entry_methods(step, have, extends).count() == 5
    assert codeops.entry_methods(step, have, extends, limit=3).count() == 3


def test_every_parameter_and_any_case(spark):
    calls = "".join(f' c.setObject ({"," * i} ' for i in range(12)) + " ".join(f".setString{' ' * i}(" for i in range(1, 13))
    rows = {r["method_fqn"]: r for r in codescan.detect_procedure_calls(methods(
        spark, f'new SimpleJdbcCall(ds).withProcedureName("P") {calls}', 'callablestatement cs = x; "{call a.b.c(?)}" .setInt( DB2Connection',
        'em.createStoredProcedureQuery("s.f")', 'new simplejdbccall(ds).withFunctionName("F")')).collect()}
    assert rows["m0"]["parameters"] and rows["m0"]["call_type"] == "SimpleJdbcCall"
    assert (rows["m1"]["call_type"], rows["m1"]["procedure_name"], rows["m1"]["database_type"], rows["m1"]["parameters"]) == ("CallableStatement", "c", "DB2", [])
    assert (rows["m2"]["schema_name"], rows["m2"]["procedure_name"]) == ("s", "f")
    assert rows["m3"]["is_function"]


def test_put_together_sql_is_seen_however_far(spark):
    far = 'jdbcTemplate.query("SELECT a FROM t ' + "x" * 900 + ' " + t + " y", m);'
    near = 'jdbcTemplate.query("SELECT a FROM t;u", m); String s = "a" + b;'
    none = spark.createDataFrame([], "class_name string, constant_name string, sql string")
    got = {r["method_fqn"]: r["query"] for r in codescan.extract_query(methods(spark, far, near), none).collect()}
    assert got == {"m0": "DYNAMIC_SQL", "m1": "SELECT a FROM t;u"}


def test_tables_of_statements(spark):
    texts = [
        "SELECT a FROM s.tab t1, other o JOIN x.y.deep d ON d.k = o.k WHERE t1.x IN (1, 2)", "INSERT INTO log.entry (a) VALUES (1)", "UPDATE acc SET a = 1",
        "select x from one left outer join two on a = b group by x", "DYNAMIC_SQL", "SELECT 1", "DELETE FROM old.rows",
    ]
    q = spark.createDataFrame(list(enumerate(texts)), "method_fqn int, query string")
    got = {(r["method_fqn"], r["schema_name"], r["table_name"]) for r in codescan.tables_in_sql(q).collect()}
    assert got == {
        (0, "s", "tab"), (0, None, "other"), (0, "y", "deep"), (1, "log", "entry"), (2, None, "acc"), (3, None, "one"), (3, None, "two"),
        (4, None, "DYNAMIC_TABLE"), (6, "old", "rows"),
    }


def test_nested_generics(spark):
    df = spark.createDataFrame([("m(A<B<C<D<E<F<G>>>>>>, H <I>)",), ("plain()",), (None,)], "s string")
    assert [r[0] for r in df.select(codescan.erased_key(df["s"])).collect()] == ["m(A,H)", "plain()", None]


def test_calls_that_hang_on_no_other_are_spread(spark):
    raw = spark.range(1000).select(
        F.format_string("m%d", "id").alias("src_fqn"), F.lit("C").alias("target_class"), F.lit("read").alias("name"),
        F.when(F.col("id") == 0, "C").alias("via_class"), F.when(F.col("id") <= 1, "read").alias("via_name"))
    methods = spark.createDataFrame([("C.read_2()", "C", "read", "E"), ("C.read_1()", "C", "read", "D")], "fqn string, class_fqn string, name string, return_class string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = returned_classes(raw, methods).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 1000 and {r["src_fqn"]: r["returned"] for r in rows if r["returned"]} == {"m0": "D"}
    assert len({r["part"] for r in rows if r["via_class"] is None}) > 1


def test_paths_of_unresolved_methods_take_the_lowest_caller(spark):
    """Several paths of one length, a longer one, and circles back into them; each hop reads what the walk has found."""
    calls = [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a"), ("e", "f"), ("a", "f"), ("f", "d"), ("x", "e")]
    edges = spark.createDataFrame([*calls, ("a", "b")], "src_fqn string, dst_fqn string")
    entries = spark.createDataFrame([("s", "a"), ("s", "a"), ("t", "x")], "step_id string, method_fqn string")
    ops = spark.createDataFrame([(m, "DB", "SELECT:DYNAMIC_TABLE:LOW") for m in ("d", "e", "x")] + [("f", "DB", "SELECT:T:LOW")], "method_fqn string, kind string, op string")
    found = codeops.trace_unknown(entries, edges, ops)
    assert {(r.step_id, r.method_fqn, r.distance) for r in found.methods.collect()} == {("s", "d", 2), ("s", "e", 3), ("t", "x", 0), ("t", "e", 1), ("t", "d", 3)}
    paths = {}
    for r in found.path.collect():
        paths.setdefault((r.step_id, r.method_fqn), {})[r.position] = r.on_path
    assert {k: "".join(v[i] for i in sorted(v)) for k, v in paths.items()} == {
        ("s", "d"): "abd", ("s", "e"): "abde", ("t", "x"): "x", ("t", "e"): "xe", ("t", "d"): "xefd"}
