import pytest

"""Upserts, loaders, clocks and statistics on small hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from batchlens.functions import clock as ck
from batchlens.operators import codescan, graphview, performance
from batchlens.sources import code, runs, tree, upsert
from batchlens.sources.code import link_script_sql, load_ddl_resources


def test_upsert_modes_and_null_keys(spark):
    old = spark.createDataFrame([("a", None, "x", 1), ("b", "k", None, 2)], "id string, part string, v string, keep int")
    new = spark.createDataFrame([("a", None, "y", 1), ("a", None, "z", 2), ("c", "k", "w", 1), ("b", "k", "q", 1)], "id string, part string, v string, n int")
    got = upsert.upsert(old, new, ["id", "part"], ["n"]).select("id", "v", "keep").collect()
    assert {tuple(r) for r in got} == {("a", "z", 1), ("b", "q", 2), ("c", "w", None)}
    got = upsert.upsert(old, new, ["id", "part"], ["n"], "coalesce").select("id", "v").collect()
    assert {tuple(r) for r in got} == {("a", "x"), ("b", "q"), ("c", "w")}


def test_versioned_table_keeps_old_state_until_committed(spark, tmp_path):
    t = upsert.VersionedTable(spark, str(tmp_path / "t"))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    t.upsert(one, ["id"], None)
    (tmp_path / "t" / "v=9").mkdir()  # a write that never finished
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"], None)
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_reset_replaces_only_given_dates(spark, tmp_path):
    root = str(tmp_path)
    day = lambda n, k: (f"j{n}{k}", dt.date(2024, 1, n))
    a = spark.createDataFrame([day(1, "x"), day(2, "x")], "id string, business_date date")
    runs.reset_instance_tables(root, {"job_context_execution": a})
    runs.reset_instance_tables(root, {"job_context_execution": spark.createDataFrame([day(2, "y")], "id string, business_date date")}, only_dates=True)
    back = {r.id for r in spark.read.parquet(f"{root}/job_context_execution").collect()}
    assert back == {"j1x", "j2y"}


def test_scan_code_files_from_disk(spark, tmp_path):
    for p in ("src/main/java/A.java", "src/test/java/ATest.java", "target/B.java", "conf/app.xml", "x.log", "db/t.sql", ".env"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text('<beans xmlns="http://www.springframework.org/schema/beans"/>' if p.endswith("xml") else "text")
    (tmp_path / "conf" / "raw.txt").write_bytes(b"\xff\xfe\x00")
    files, rejects = code.scan_code_files(spark, str(tmp_path))
    assert [tuple(r) for r in rejects.collect()] == [("conf/raw.txt", 3)]
    assert {r.path for r in files.collect()} == {"src/main/java/A.java", "conf/app.xml", "db/t.sql"}
    kinds = {(r.path, r.file_type) for r in code.tag_file_types(files).collect()}
    assert kinds == {("src/main/java/A.java", "JavaClass"), ("conf/app.xml", "XmlConfig"), ("conf/app.xml", "SpringConfig"), ("db/t.sql", "SqlScript")}


def test_skipped_files_are_not_read_and_folders_are_shared_out(spark, tmp_path):
    for n in range(30):
        f = tmp_path / f"m{n % 5}" / f"p{n % 3}" / f"F{n}.java"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"class F{n} {{ é }}")
    for p in ("m0/build/X.java", "m1/src/test/Y.java", "m2/keep.log", ".git/config"):  # reading one of these would fail
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.symlink_to(tmp_path / "nowhere")
    rows = {r.path: (r.text, r.size) for r in code.scan_code_files(spark, str(tmp_path)).files.collect()}
    assert rows == {f"m{n % 5}/p{n % 3}/F{n}.java": (f"class F{n} {{ é }}", len(f"class F{n} {{ é }}".encode())) for n in range(30)}
    assert code.scan_code_files(spark, str(tmp_path), max_depth=0).files.count() == 0
    few = tree.read_tree(spark, str(tmp_path), code.SKIP_DIRS, code.glob_regex(code.SKIP_FILES), partitions=3)
    assert few.rdd.getNumPartitions() <= 8 and few.count() == 30
    empty = tmp_path / "m9"
    empty.mkdir()
    assert code.scan_code_files(spark, str(empty)).files.count() == 0


def test_clocks(spark):
    df = spark.createDataFrame([("23:59:59.5",), ("07:00",), ("02:00:00+05:30",), ("24:00",), ("soon",)], "t string")
    assert [r.m for r in df.select(ck.clock_to_ms(F.col("t")).alias("m")).collect()] == [86399500, 25200000, 7200000, None, None]
    ms = spark.createDataFrame([(90_000_000,), (5_400_000,), (None,)], "m long")
    assert [r.c for r in ms.select(ck.ms_to_clock(F.col("m")).alias("c")).collect()] == ["25:00:00", "01:30:00", None]


def test_circular_mean_crosses_midnight_and_single_sample_deviation(spark):
    rows = [("s", dt.date(2024, 1, 5), 23 * 3_600_000 + 1_800_000, 10), ("s", dt.date(2024, 1, 6), 1_800_000, 30), ("one", dt.date(2024, 1, 5), 0, 7)]
    r = spark.createDataFrame(rows, "sic_id string, business_date date, end_time_ms long, duration_ms long")
    sics = spark.createDataFrame([("s",), ("one",), ("none",)], "id string")
    mean = {x.sic_id: (x.avg_finish_time, x.sample_count) for x in performance.circular_mean_finish(r, sics, "2024-01-31").collect()}
    assert mean["s"][0] in ("00:00:00", "23:59:59") and mean["none"] == (None, 0)
    base = {x.sic_id: (x.hist_avg_ms, x.hist_std_ms, x.hist_sample_count) for x in performance.anomaly_baseline(r, sics, "2024-01-20").collect()}
    assert base["one"] == (7.0, 0.0, 1) and base["none"] == (None, None, 0) and abs(base["s"][1] - 14.1421356) < 1e-6


def test_text_rules(spark):
    q = spark.createDataFrame([
        ("a", "select x from s.t1 a left outer join t_two b on a.k = b.k, tab3 where 1=1"), ("b", "INSERT INTO db.sch.tgt VALUES (1)"), ("c", "DYNAMIC_SQL"),
        ("d", "UPDATE acc SET v = 1"), ("e", "select 1 from ab"),
    ], "method_fqn string, query string")
    got = {(r.method_fqn, r.table_name, r.schema_name) for r in codescan.tables_in_sql(q).collect()}
    assert got == {("a", "t1", "s"), ("a", "t_two", None), ("a", "tab3", None), ("b", "tgt", "sch"), ("c", "DYNAMIC_TABLE", None), ("d", "acc", None)}
    names = spark.createDataFrame([("run.sh", "x"), ("scriptPath", "x"), ("/opt/job", "x"), ("ab", "x"), ("go.sh", 'a + "b"'), ("error.sh", "x")], "n string, s string")
    assert [r.g for r in names.select(codescan.is_grey_script(F.col("n"), F.col("s")).alias("g")).collect()] == [False, True, False, True, True, True]


def test_merge_keeps_first_and_numbers_edges(spark):
    n1 = spark.createDataFrame([("a", "X")], "id string, label string")
    n2 = spark.createDataFrame([("a", "Y"), ("b", "Y"), ("", "Y")], "id string, label string")
    e1 = spark.createDataFrame([("e", "a", "b", None)], "id string, s string, d string, position int")
    e2 = spark.createDataFrame([(None, "a", "b", 0), ("e", "x", "y", 1)], "id string, s string, d string, position int")
    g = graphview.merge_graphs([graphview.Graph(n1, e1), graphview.Graph(n2, e2)])
    assert {tuple(r) for r in g.nodes.collect()} == {("a", "X"), ("b", "Y")}
    assert {(r.id, r.s) for r in g.edges.collect()} == {("e", "a"), ("rel-0", "a")}


def test_a_second_writer_of_a_version_fails(spark, tmp_path):
    one, other = (upsert.VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    rows = spark.createDataFrame([(i, "a") for i in range(50)], "id int, v string")
    one.upsert(rows, ["id"], None)
    folders = one._state(1)["parts"]
    other.upsert(spark.createDataFrame([(3, "b")], "id int, v string"), ["id"], None)
    assert sum(folders[p] != f for p, f in other._state(2)["parts"].items()) == 1  # one part was written anew
    assert {r["id"]: r["v"] for r in one.read().collect()} == {i: "b" if i == 3 else "a" for i in range(50)}
    with pytest.raises(upsert.VersionConflict):
        one._commit(2, folders, {})


def test_order_decides_and_is_needed_for_repeated_keys(spark):
    old = spark.createDataFrame([(1, "old")], "id int, v string")
    new = spark.createDataFrame([(1, "z-first", 1), (1, "a-last", 2)], "id int, v string, n int")
    assert [r["v"] for r in upsert.upsert(old, new, ["id"], ["n"]).collect()] == ["a-last"]
    with pytest.raises(Exception, match="no load order"):
        upsert.upsert(old, new, ["id"], None).collect()


def test_old_versions_and_orphans_go(spark, tmp_path):
    t = upsert.VersionedTable(spark, str(tmp_path / "t"), parts=4)
    for n in range(5):
        t.upsert(spark.createDataFrame([(i, n) for i in range(n, 20)], "id int, v int"), ["id"], None)
    (tmp_path / "t" / "00000003-orphan" / "_part=0").mkdir(parents=True)  # left by a writer that failed
    (tmp_path / "t" / "00000006-running" / "_part=0").mkdir(parents=True)  # of a writer at work
    before = sorted(map(tuple, t.read().collect()))
    assert t.expire(2) > 0 and t.versions() == [4, 5]
    assert sorted(map(tuple, t.read().collect())) == before == [(i, min(i, 4)) for i in range(20)]
    assert {r["id"]: r["v"] for r in t.read(4).collect()} == {i: min(i, 3) for i in range(20)}
    names = {p.name[:8] for p in (tmp_path / "t").iterdir() if p.name != "_versions"}
    assert "00000006" in names and "00000003" not in {n for n in names if (tmp_path / "t" / f"{n}-orphan").exists()}
    used = {f for v in (4, 5) for f in t._state(v)["parts"].values()}
    left = {str(p) for p in (tmp_path / "t").glob("0000000[1-5]-*/_part=*")}
    assert left == used and t.expire(2) == 0


def test_edges_of_scripts_are_not_shuffled_and_come_once(spark):
    scripts = spark.createDataFrame([("a", "@/x/q.sql @/y/q.sql"), ("a", "@/x/q.sql"), ("b", "@/q.sql"), (None, "@/y/q.sql"), ("c", None)], "id string, text string")
    sqls = spark.createDataFrame(
        [("1", "/x/q.sql"), ("1", "/x/q.sql"), ("2", "/x/q.sql"), ("2", "/y/q.sql"), (None, "q.sql"), (None, "/z/q.sql"), ("3", "/w/x/q.sql"), ("4", "/x/Q.sql"), ("5", None)], "id string, path string")
    edges = link_script_sql(scripts, sqls)
    got = sorted((str(r["script_id"]), str(r["sql_id"])) for r in edges.collect())
    want = [("None", "2"), ("None", "None"), ("a", "1"), ("a", "2"), ("a", "3"), ("a", "None"), ("b", "1"), ("b", "2"), ("b", "3"), ("b", "None")]
    assert got == want
    assert "Union" in edges._jdf.queryExecution().analyzed().toString().splitlines()[1]


def test_ids_of_ddl_resources_are_not_shuffled(spark):
    ddl = spark.createDataFrame([("f", 1, "TABLE", None, None, "T"), ("g", 1, "TABLE", None, None, "T"), ("f", 2, "VIEW", "S", None, "T")], "path string, pos int, type string, schema_name string, package_name string, name string")
    loaded = load_ddl_resources(ddl)
    assert loaded.resources.count() == 2 and loaded.creates.count() == 3
    assert loaded.creates.join(loaded.resources, loaded.creates["resource_id"] == loaded.resources["id"]).count() == 3
    assert "sha2" not in loaded.resources.drop("id")._jdf.queryExecution().optimizedPlan().toString()


def test_scripts_are_matched_by_common_key_without_a_broadcast(spark):
    """Names, keys and endings are far larger than the planner takes them for; a broadcast of them filled the driver."""
    wanted = spark.createDataFrame(
        [("w1", "/x/other-common/jobs/run1.sh"), ("w1", "/x/other-common/jobs/run1.sh"), ("w2", "/x/other-common/jobs/run2.sh"), ("w3", "/x/jobs/run1.sh"), (None, "/y/common/jobs/run1.sh"), ("w5", None)],
        "want_id string, path string")
    known = spark.createDataFrame(
        [("k2", "apps\\batch-common\\jobs\\run1.sh"), ("k1", "/opt/myjobs/run1.sh"), ("k0", "/opt/jobs/old/run1.sh"), ("k3", "/opt/other/run2.sh"), (None, "/opt/jobs/run1.sh")],
        "id string, path string")
    got = code.match_by_common_key(wanted, known)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((tuple(r) for r in got.collect()), key=str) == [("w1", "k1"), ("w1", "k1"), (None, "k1")]
