"""Code and database repositories: file inventory, file types, packages, DDL, scripts."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchlens.sources.tree import read_tree

# fixed values: folders and files left out of the inventory
SKIP_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv", "target", "build", ".idea", ".vscode", "bin", "obj", ".gradle", "out")
SKIP_FILES = (
    ".gitignore", ".gitattributes", ".editorconfig", ".DS_Store", "Thumbs.db", ".env", ".env.local", ".env.development", ".env.test",
    ".env.production", "*.log", "*.tmp", "*.bak", "*.swp", "*~", ".npmrc", ".yarnrc", "package-lock.json", "yarn.lock", ".classpath", ".project",
)

# fixed values: file type rules (extensions, patterns, locations, names)
TEST_JAVA = (r"Test\.java$", r"IT\.java$", r"TestCase\.java$")
SPRING_MARK = r"http://www\.springframework\.org/schema/"


def glob_regex(globs: tuple[str, ...]) -> str:
    return "^(" + "|".join(re.escape(g).replace(r"\*", ".*") for g in globs) + ")$"


def path_parts(path: Column) -> Column:
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")


def file_name(path: Column) -> Column:
    return F.element_at(path_parts(path), -1)


def keep_code_files(files: DataFrame, skip_dirs=SKIP_DIRS, skip_files=SKIP_FILES, max_depth: int | None = None) -> DataFrame:
    """Inventory rows (column ``path``) that are not in skipped folders, skipped by name, in ``src/test`` or, with ``max_depth``, deeper."""
    parts = path_parts(F.col("path"))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad_dir = F.arrays_overlap(folders, F.array(*(F.lit(d) for d in skip_dirs)))
    in_test = F.lower(F.concat(F.lit("/"), F.array_join(folders, "/"), F.lit("/"))).contains("/src/test/")
    name = file_name(F.col("path"))
    kept = files.where(~bad_dir & ~in_test & ~name.rlike(glob_regex(tuple(skip_files))))
    return kept if max_depth is None else kept.where(F.size(folders) <= max_depth + 1)


class Scan(NamedTuple):
    files: DataFrame  # path, size, text, name, extension
    rejects: DataFrame  # path, size of files whose content is no UTF-8 text


def scan_code_files(spark: SparkSession, root: str, skip_dirs=SKIP_DIRS, skip_files=SKIP_FILES, max_depth: int | None = None) -> Scan:
    """Kept files below a folder, listed and read in parallel, one partition per folder (``tree``).

    Skipped folders aren't entered and the content of skipped files isn't read.
    """
    read = read_tree(spark, root, skip_dirs, glob_regex(tuple(skip_files)), max_depth)
    read = read.withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).drop("content")
    files = read.where(F.col("text").isNotNull()).withColumn("name", file_name(F.col("path"))).withColumn("extension", extension(F.col("path")))
    return Scan(files, read.where(F.col("text").isNull()).select("path", "size"))


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1)


def _any(path: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (path.rlike(f"(?i){p}") for p in patterns))


def _located(path: Column, places: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (path.contains(p) for p in places))


def tag_file_types(files: DataFrame) -> DataFrame:
    """One row per file and type; a file no rule knows is a plain File. Needs path and text."""
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    name, ext = file_name(F.col("path")), extension(F.col("path"))
    other_xml = (ext == ".xml") & ~F.lower(name).isin("pom.xml", "web.xml")
    plain = ~other_xml & (ext != ".sql")
    rules = {
        "SpringConfig": (other_xml & F.col("text").rlike(SPRING_MARK)),
        "XmlConfig": other_xml,
        "SqlScript": (ext == ".sql") | (plain & (ext == ".ddl")),
        "JavaClass": plain & (ext == ".java") & ~_any(path, TEST_JAVA) & _located(path, ("src/main/java", "src/java", "src")),
        "JavaTestClass": plain & (ext == ".java") & (_any(path, TEST_JAVA) | _located(path, ("src/test/java", "test", "src/test"))),
        "PomFile": name == "pom.xml",
        "WebXmlFile": name == "web.xml",
        "PropertyFile": plain & ext.isin(".properties", ".env") & _located(path, ("src/main/resources", "resources", "config")),
        "DockerFile": name.isin("Dockerfile", "docker-compose.yml", ".dockerignore"),
        "CiCdFile": name.isin("azure-pipelines.yml", "azure-pipelines-artifactory-onprem.yml", "Jenkinsfile", ".gitlab-ci.yml"),
        "ShellScript": plain & ext.isin(".sh", ".bat", ".cmd", ".ps1", ".pl"),
    }
    hits = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(label)) for label, cond in rules.items())))
    return files.select("path", F.explode(F.when(F.size(hits) == 0, F.array(F.lit("File"))).otherwise(hits)).alias("file_type"))


def mark_packages(classes: DataFrame) -> DataFrame:
    """Folders that spell a package below ``src``; needs path and package."""
    parts = path_parts(F.col("path"))
    at = F.array_position(parts, "src")
    folders = F.slice(parts, (at + 1).cast("int"), F.greatest(F.size(parts) - at - 1, F.lit(0)).cast("int"))
    pkg = F.split("package", r"\.")
    base = classes.where(F.col("package").isNotNull() & (F.col("package") != "")).select(
        parts.alias("parts"), at.cast("int").alias("at"), folders.alias("folders"), pkg.alias("pkg")
    ).where("at > 0 AND size(folders) >= size(pkg)")
    starts = F.filter(F.sequence(F.lit(1), F.size("folders") - F.size("pkg") + 1), lambda i: F.slice(F.col("folders"), i, F.size("pkg")) == F.col("pkg"))
    placed = base.withColumn("start", F.try_element_at(starts, F.lit(1))).where("start IS NOT NULL")
    each = placed.select("parts", "at", "start", "pkg", F.posexplode("pkg").alias("j", "segment"))
    return each.select(
        F.array_join(F.slice("parts", F.lit(1), F.col("at") + F.col("start") + F.col("j")), "/").alias("folder"),
        F.array_join(F.slice("pkg", F.lit(1), F.col("j") + 1), ".").alias("package"),
        F.array_join(F.slice("parts", F.lit(1), F.col("at") + F.col("start") + F.col("j")), "/").contains("/test/").alias("is_test"),
    ).distinct()


CREATE_HEAD = (
    r"(?i)CREATE\s+(?:OR\s+REPLACE\s+)?(?:PUBLIC\s+)?(?:PACKAGE\s+BODY|DATABASE\s+LINK|TABLE|VIEW|PROCEDURE|FUNCTION|PACKAGE|TRIGGER|SYNONYM|SEQUENCE|INDEX|TYPE)\s+"
)


def extract_ddl(files: DataFrame) -> DataFrame:
    """One row per CREATE statement of each file: type, schema, package and name in upper case."""
    cut = F.regexp_replace("text", f"({CREATE_HEAD})", "\u0001$1")
    pieces = files.select("path", F.posexplode(F.split(cut, "\u0001")).alias("pos", "statement"))
    s = F.regexp_replace(F.upper(F.trim("statement")), r"\s+", " ")
    body = F.regexp_replace(s, r"^CREATE (OR REPLACE )?", "")
    kind = (
        F.when(body.rlike("^PACKAGE BODY "), "PACKAGE").when(body.rlike("^(PUBLIC )?DATABASE LINK "), "DATABASE_LINK")
        .when(body.rlike("^(TABLE|VIEW|PROCEDURE|FUNCTION|PACKAGE|TRIGGER|SYNONYM|SEQUENCE|INDEX|TYPE) "), F.regexp_extract(body, "^(\\w+)", 1))
    )
    rest = F.regexp_replace(body, "^(PACKAGE BODY|(PUBLIC )?DATABASE LINK|\\w+) ", "")
    full = F.regexp_extract(rest, r"^([^\s(;]+)", 1)
    names = F.split(full, r"\.")
    n = F.size(names)
    found = pieces.where(s.startswith("CREATE")).select("path", "pos", kind.alias("type"), names.alias("names"), n.alias("n"))
    return found.where("type IS NOT NULL AND names[0] <> ''").select(
        "path", "pos", "type", F.when(F.col("n") >= 2, F.col("names")[0]).alias("schema_name"),
        F.when(F.col("n") >= 3, F.col("names")[1]).alias("package_name"), F.col("names")[F.least(F.col("n"), F.lit(3)) - 1].alias("name"),
    )


class DdlResources(NamedTuple):
    resources: DataFrame
    creates: DataFrame


DDL_KEY = ["name", "type", "schema_name", "package_name"]


def load_ddl_resources(ddl: DataFrame) -> DdlResources:
    """Distinct objects with a stable id, and file to object edges; missing name parts compare equal."""
    ident = F.concat(F.lit("DDL_"), F.sha2(F.concat_ws("\u0001", *(F.coalesce(c, F.lit("\u0000")) for c in DDL_KEY)), 256))
    resources = ddl.select(*DDL_KEY).distinct().select(ident.alias("id"), *DDL_KEY)  # the id follows from the key and is not carried through the shuffle
    return DdlResources(resources, ddl.select("path", *DDL_KEY).distinct().select("path", ident.alias("resource_id")).distinct())


def mark_duplicate_resources(ddl: DataFrame) -> DataFrame:
    """Objects defined in more than one file."""
    per = ddl.select(*DDL_KEY, "path").distinct().groupBy(*DDL_KEY).agg(F.count("*").alias("file_count"))
    return per.withColumn("duplicate_found", F.col("file_count") > 1)


# fixed values: script kinds by suffix, in order of precedence
SCRIPT_SUFFIX = ((".sh", "BASH"), (".py", "PYTHON"), (".ps1", "POWERSHELL"), (".bat", "BATCH"), (".cmd", "BATCH"), (".pl", "PERL"))
# fixed values: script kinds by content, in order of precedence
SCRIPT_HINT = (("\\.sh|bash", "BASH"), ("\\.py|python", "PYTHON"), ("\\.ps1|powershell", "POWERSHELL"), ("\\.bat|\\.cmd", "BATCH"), ("\\.pl|perl", "PERL"))


def script_type(name: Column) -> Column:
    """Script kind by file suffix."""
    t, out = F.lower(F.coalesce(name, F.lit(""))), F.lit("SHELL")
    for suffix, kind in reversed(SCRIPT_SUFFIX):
        out = F.when(t.endswith(suffix), kind).otherwise(out)
    return out


def script_type_hint(text: Column) -> Column:
    """Script kind by any hint in a command line."""
    t, out = F.lower(F.coalesce(text, F.lit(""))), F.lit("SHELL")
    for pattern, kind in reversed(SCRIPT_HINT):
        out = F.when(t.rlike(pattern), kind).otherwise(out)
    return out


def sql_files_in_script(text: Column) -> Column:
    """Absolute ``@/path.sql`` references, distinct, in order."""
    found = F.regexp_extract_all(text, F.lit(r"""(?i)@(["']?/[^\s"'>]+\.sql["']?)"""), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "^[\"']|[\"']$", "")))


def common_key(path: Column) -> Column:
    """``<folder>/<file>`` after the first folder whose name ends in common."""
    parts = F.filter(F.split(path, r"[/\\]"), lambda x: x != "")
    spots = F.filter(
        F.transform(parts, lambda x, i: F.when(F.lower(x).endswith("common") & (i + 2 < F.size(parts)), i + 1)), lambda x: x.isNotNull()
    )
    at = F.try_element_at(spots, F.lit(1))
    return F.when(at.isNotNull(), F.concat_ws("/", F.element_at(parts, at + 1), F.element_at(parts, at + 2)))


def _segment_links(known: DataFrame) -> DataFrame:
    """Per path (id, name, path) and pair of neighbouring segments: every ending of the first, and the second.

    A path contains ``A/B`` exactly when some segment ends with A and the next
    begins with B, so containment becomes an equality on the ending; the rows
    per path are bounded by its length.
    """
    parts = path_parts(F.col("path"))
    pairs = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x, i: F.struct(x.alias("first"), F.get(parts, i + 1).alias("second")))
    each = known.select("id", "name", F.explode(pairs).alias("p")).select("id", "name", "p.*")
    endings = F.transform(F.sequence(F.lit(1), F.length("first")), lambda i: F.substring(F.col("first"), i, F.length(F.col("first"))))
    return each.select("id", "name", F.explode(endings).alias("ending"), "second")


def match_by_common_key(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Known script with the same file name whose path holds the wanted path's key (lowest id wins).

    Names, keys and endings are many times larger than what the planner sees of
    their tables, so both joins are told to sort: a broadcast would have to fit the driver.
    """
    asked = wanted.select("want_id", file_name(F.col("path")).alias("name"), common_key(F.col("path")).alias("key")).where("key IS NOT NULL")
    halves = F.split("key", "/")
    keys = asked.select("name", "key").distinct().withColumn("ending", halves[0]).withColumn("begin", halves[1])
    have = known.select("id", "path", file_name(F.col("path")).alias("name"))
    links = _segment_links(have).groupBy("name", "ending", "second").agg(F.min("id").alias("id"))
    found = keys.hint("merge").join(links, ["name", "ending"]).where(F.col("second").startswith(F.col("begin"))).groupBy("name", "key").agg(F.min("id").alias("resource_id"))
    return asked.hint("merge").join(found, ["name", "key"]).select("want_id", "resource_id")


def match_sql_resource(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """SQL file for a (script_name, script_path): by folder key, then ``sql/<file>``, then any; lowest id wins."""
    parts = F.filter(F.split(F.coalesce("script_path", F.lit("")), r"[/\\]"), lambda x: F.trim(x) != "")
    after = F.array_max(F.filter(F.transform(parts, lambda x, i: F.when(F.lower(F.trim(x)).endswith("common"), i + 2)), lambda x: x.isNotNull()))
    follow = F.trim(F.when(after.isNotNull(), F.try_element_at(parts, after)))
    folder = F.when(follow.isNotNull() & (F.lower(follow) != F.lower("script_name")), follow)
    asked = wanted.select("want_id", F.col("script_name").alias("name"), F.coalesce(folder, F.lit("sql")).alias("folder"))
    by_name = known.groupBy("name").agg(F.min("id").alias("any_id"), F.count("*").alias("candidates"))
    links = _segment_links(known.select("id", "name", "path")).where(F.col("second").startswith(F.col("name")))
    by_folder = links.groupBy("name", F.col("ending").alias("folder")).agg(F.min("id").alias("folder_id"))
    in_sql = by_folder.where("folder = 'sql'").select("name", F.col("folder_id").alias("sql_id"))
    j = asked.join(by_name, "name").join(by_folder, ["name", "folder"], "left").join(in_sql, "name", "left")
    rank = F.when(F.col("candidates") == 1, 0).when(F.col("folder_id").isNotNull(), 1).when(F.col("sql_id").isNotNull(), 2).otherwise(3)
    return j.select("want_id", F.coalesce("folder_id", "sql_id", "any_id").alias("resource_id"), rank.alias("match_rank"))


def _tails(path: Column) -> Column:
    """Every ending of a path that starts at a segment."""
    parts = path_parts(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def link_script_sql(scripts: DataFrame, sqls: DataFrame) -> DataFrame:
    """Edges from scripts (id, text) to the SQL files (id, path) they call: one path ends with the other."""
    plain = lambda path: F.array_join(path_parts(F.col(path)), "/")
    refs = scripts.select(F.col("id").alias("script_id"), F.explode(sql_files_in_script(F.col("text"))).alias("ref")).select("script_id", plain("ref").alias("whole")).distinct()
    files = sqls.select(F.col("id").alias("sql_id"), plain("path").alias("full")).distinct()
    # paths are matched before ids come in, so edges, far more than either, need no shuffle
    asked, known = refs.select("whole").distinct(), files.select("full").distinct()
    longer = asked.withColumn("tail", F.col("whole")).join(known.select("full", F.explode(_tails(F.col("full"))).alias("tail")), "tail").select("whole", "full")
    shorter = asked.select("whole", F.explode(_tails(F.col("whole"))).alias("full")).join(known, "full").select("whole", "full")
    called = refs.join(longer.unionByName(shorter).distinct(), "whole").select("script_id", "full").distinct()
    # only a file id that stands for several paths can meet a script twice
    paths = files.groupBy("sql_id").agg(F.count("*").alias("paths"), F.min("full").alias("full"))
    once = called.join(paths.where("paths = 1 AND sql_id IS NOT NULL"), "full").select("script_id", "sql_id")
    unnamed = called.join(files.where("sql_id IS NULL"), "full").select("script_id", "sql_id")
    several = called.join(files.join(paths.where("paths > 1").select("sql_id"), "sql_id"), "full").select("script_id", "sql_id")
    return once.unionByName(several.unionByName(unnamed).distinct()).withColumn("execution_type", F.lit("SQL_SCRIPT"))


class CodeTables(NamedTuple):
    classes: DataFrame
    methods: DataFrame
    has_method: DataFrame
    beans: DataFrame


def load_code_tables(classes: DataFrame, methods: DataFrame, beans: DataFrame) -> CodeTables:
    """Class, method and bean tables with counts; beans are keyed ``<id>___<class>``."""
    counts = methods.groupBy(F.col("class_fqn").alias("fqn")).agg(F.count("*").alias("method_count"))
    c = classes.join(counts, "fqn", "left").select(
        "fqn", "name", "package", F.coalesce("is_interface", F.lit(False)).alias("is_interface"), F.coalesce("is_test", F.lit(False)).alias("is_test"),
        F.coalesce("method_count", F.lit(0)).alias("method_count"),
    )
    m = methods.select("fqn", "class_fqn", "name", F.coalesce("further_analysis", F.lit(False)).alias("further_analysis"))
    b = beans.select(F.concat_ws("___", "bean_id", "bean_class").alias("composite_key"), "bean_id", "bean_class").distinct()
    return CodeTables(c, m, m.select("class_fqn", F.col("fqn").alias("method_fqn")).distinct(), b)
