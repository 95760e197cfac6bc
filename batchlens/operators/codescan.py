"""Rule scans over class and method text: data access, procedures, shell runs.

All rules are column expressions over the whole text; a method yields rows, not
arrays.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchlens.sources.code import script_type_hint

# fixed values: data-access rules
DB_IMPORTS = ("javax.persistence", "org.springframework.jdbc", "java.sql", "org.springframework.data", "org.hibernate", "jakarta.persistence", "javax.sql")
NOT_DAO_SUFFIXES = ("entity", "model", "dto", "vo", "bean", "pojo")
DAO_METHOD_WORDS = ("find", "save", "delete", "update", "insert", "query", "get", "create", "persist", "fetch", "search", "remove", "merge", "select")
OPERATION_PREFIXES = (
    ("SELECT", ("find", "get", "select", "query", "search", "fetch")),
    ("INSERT", ("save", "insert", "create", "persist", "add")),
    ("UPDATE", ("update", "modify", "merge", "edit")),
    ("DELETE", ("delete", "remove")),
)
OPERATION_PATTERNS = (
    ("SELECT", (r"createQuery\s*\(\s*[\"']SELECT", r"\.find\(", r"\.findAll\(", r"getResultList\(", r"jdbcTemplate\.query\(", r"jdbcTemplate\.queryForObject\(",
                r"jdbcTemplate\.queryForList\(", r"namedParameterJdbcTemplate\.query\(", r"namedParameterJdbcTemplate\.queryForObject\(",
                r"namedParameterJdbcTemplate\.queryForList\(")),
    ("INSERT", (r"\.persist\(", r"\.save\(", r"createQuery\s*\(\s*[\"']INSERT", r"jdbcTemplate\.update\(.*INSERT", r"namedParameterJdbcTemplate\.update\(.*INSERT")),
    ("UPDATE", (r"\.merge\(", r"\.update\(", r"createQuery\s*\(\s*[\"']UPDATE", r"jdbcTemplate\.update\(", r"namedParameterJdbcTemplate\.update\(")),
    ("DELETE", (r"\.remove\(", r"\.delete\(", r"createQuery\s*\(\s*[\"']DELETE", r"jdbcTemplate\.update\(.*DELETE", r"namedParameterJdbcTemplate\.update\(.*DELETE")),
)
DIRECT_DB = (
    r"jdbcTemplate\.", r"namedParameterJdbcTemplate\.", r"entityManager\.(persist|merge|remove|find|createQuery|createNativeQuery)", r"\.persist\s*\(",
    r"\.merge\s*\(", r"\.remove\s*\(", r"session\.(save|update|delete|createQuery|createSQLQuery)", "PreparedStatement", r"Statement\.execute",
    r"connection\.(prepareStatement|createStatement)", r"@Query\s*\(", "@Modifying",
)
JPQL_TEXT = r"(?s)createQuery\s*\(\s*[\"']([^\"']+)[\"']"
INLINE_SQL = r"(?s)(?:namedParameterJdbcTemplate|jdbcTemplate)\.(?:query|queryForObject|queryForList|update)\s*\(\s*[\"']([^\"']+)[\"']"
CONSTANT_SQL = r"(?s)(?:namedParameterJdbcTemplate|jdbcTemplate)\.(?:query|queryForObject|queryForList|update)\s*\(\s*([A-Z][\w.]*)\.([A-Za-z_][A-Za-z_0-9]*)\s*[,)]"
PREPARED_CONSTANT = r"(?s)(?:prepareStatement|prepareCall)\s*\(\s*([A-Z][\w.]*)\.([A-Za-z_][A-Za-z_0-9]*)\s*[,)]"
DYNAMIC_SQL = (r"[\"'][^\"'][\"']\s*\+|\+\s*[\"']", r"String\.format", "StringBuilder", "StringBuffer")
REST_OF_STATEMENT = r"""(?:[^;"']++|"[^"]*+"|'[^']*+')*+"""
JAVA_TYPES = (
    "List", "Set", "Map", "Collection", "ArrayList", "HashSet", "HashMap", "String", "Integer", "Long", "Double", "Float", "Boolean", "Character", "Byte",
    "Short", "Object", "void", "int", "long", "double", "float", "boolean", "char", "byte", "short",
)


def _any_match(text: Column, patterns, flags: str = "(?i)") -> Column:
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """Capture of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def classify_dao(classes: DataFrame, imports: DataFrame, methods: DataFrame) -> DataFrame:
    """Data-access classes: by name, or by a database import plus a telling method name."""
    low = F.lower("name")
    excluded = reduce(lambda a, b: a | b, (low.endswith(s) for s in NOT_DAO_SUFFIXES))
    by_import = imports.where(reduce(lambda a, b: a | b, (F.col("import_name").startswith(p) for p in DB_IMPORTS))).select("class_fqn").distinct()
    by_method = methods.where(reduce(lambda a, b: a | b, (F.lower("name").contains(w) for w in DAO_METHOD_WORDS))).select("class_fqn").distinct()
    both = by_import.join(by_method, "class_fqn", "left_semi").select(F.col("class_fqn").alias("fqn"), F.lit(True).alias("telling"))
    named = low.contains("dao") | low.contains("repository")
    verdict = ~F.col("is_interface") & ~excluded & (named | F.coalesce("telling", F.lit(False)))
    return classes.join(both, "fqn", "left").select("fqn", verdict.alias("is_dao"))


def detect_operation(methods: DataFrame) -> DataFrame:
    """Operation of methods that touch the database: name prefix first, then text patterns, in rule order. Needs fqn, name, source."""
    name, src = F.lower("name"), F.col("source")
    rules = [(op, reduce(lambda a, b: a | b, (name.startswith(p) for p in ps))) for op, ps in OPERATION_PREFIXES]
    rules += [(op, _any_match(src, ps)) for op, ps in OPERATION_PATTERNS]
    op = F.lit(None).cast("string")
    for label, cond in reversed(rules):
        op = F.when(cond, label).otherwise(op)
    return methods.where(_any_match(src, DIRECT_DB)).select(F.col("fqn").alias("method_fqn"), op.alias("operation_type")).where("operation_type IS NOT NULL")


def extract_query(methods: DataFrame, constants: DataFrame) -> DataFrame:
    """SQL text of a method: literal, or through a (class, constant) look-up; put-together SQL is DYNAMIC_SQL."""
    src = F.col("source")
    inline = _first(src, INLINE_SQL)
    # the rest of the statement, however long: up to the first semicolon outside quotes
    from_call = F.regexp_extract(src, f"(?s)({INLINE_SQL[4:]}{REST_OF_STATEMENT})", 1)
    inline = F.when(inline.isNotNull(), F.when(_any_match(from_call, DYNAMIC_SQL, ""), "DYNAMIC_SQL").otherwise(F.trim(inline)))
    found = methods.select(
        F.col("fqn").alias("method_fqn"), F.coalesce(F.trim(_first(src, JPQL_TEXT)), inline).alias("literal"),
        F.coalesce(_first(src, CONSTANT_SQL, 1), _first(src, PREPARED_CONSTANT, 1)).alias("class_name"),
        F.coalesce(_first(src, CONSTANT_SQL, 2), _first(src, PREPARED_CONSTANT, 2)).alias("constant_name"),
    )
    looked = found.join(constants.select("class_name", "constant_name", "sql"), ["class_name", "constant_name"], "left")
    return looked.select("method_fqn", F.coalesce("literal", "sql").alias("query")).where("query IS NOT NULL")


# words that end a list of tables, and words after which a table (or a list of them) is named
CLAUSE_WORDS = ("WHERE", "GROUP BY", "ORDER BY", "HAVING", "LIMIT", "UNION", "EXCEPT", "INTERSECT")
TABLE_WORDS = ("FROM", "JOIN", "INTO", "UPDATE")


def _words(words) -> str:
    return r"\b(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + r")\b"


def tables_in_sql(queries: DataFrame) -> DataFrame:
    """Tables a statement names (method_fqn, query).

    A statement with FROM is read from there to its first clause word, another
    one whole.  It is cut at table words and, in a FROM list, at commas; each
    part starts with a table name or an opening bracket.
    """
    q = F.col("query")
    has_from = q.rlike("(?i)" + _words(["FROM"]))
    behind = F.element_at(F.split(q, "(?i)" + _words(["FROM"]), 2), -1)
    listed = F.split(F.split(behind, "(?i)" + _words(CLAUSE_WORDS) + "|;", 2)[0], "(?i),|" + _words(TABLE_WORDS))
    targets = F.split(q, "(?i)" + _words(TABLE_WORDS))
    parts = F.when(has_from, listed).otherwise(F.slice(targets, 2, F.greatest(F.size(targets) - 1, F.lit(0))))
    refs = F.array_distinct(F.transform(parts, lambda i: F.regexp_extract(i, r"^\s*([\w.]+)", 1)))
    each = queries.where(q != "DYNAMIC_SQL").select("method_fqn", F.explode(refs).alias("ref"))
    pieces = F.split("ref", r"\.")
    real = each.where((F.col("ref") != "") & ((F.length("ref") > 2) | F.col("ref").contains(".")))
    found = real.select(
        "method_fqn", F.element_at(pieces, -1).alias("table_name"), F.when(F.size(pieces) > 1, F.try_element_at(pieces, F.lit(-2))).alias("schema_name")
    )
    dynamic = queries.where(q == "DYNAMIC_SQL").select("method_fqn", F.lit("DYNAMIC_TABLE").alias("table_name"), F.lit(None).cast("string").alias("schema_name"))
    return found.unionByName(dynamic).distinct()


def entity_to_table(name: Column, case: str = "snake_case", suffix: str = "Entity") -> Column:
    bare = F.replace(name, F.lit(suffix), F.lit(""))
    if case == "snake_case":
        return F.lower(F.regexp_replace(bare, "(?<!^)(?=[A-Z])", "_"))
    return F.lower(bare) if case == "lower" else F.upper(bare) if case == "upper" else bare


def infer_table(methods: DataFrame) -> DataFrame:
    """Table of a method without SQL: entity return type, entity in a query or find, else its return type."""
    ret, src = F.coalesce("return_type", F.lit("")), F.col("source")
    simple = F.regexp_replace(F.regexp_extract(ret, r"([^.]*)$", 1), "<.*>", "")
    entity = F.coalesce(_first(src, r"(?i)FROM\s+(\w+)"), _first(src, r"(?i)\.find\(\s*(\w+)\.class"))
    table = (
        F.when(ret.contains("Entity"), entity_to_table(ret)).when(entity.isNotNull(), entity_to_table(entity))
        .when(simple.isin(*JAVA_TYPES), "UNKNOWN").when(simple.rlike("^[A-Z]"), entity_to_table(simple))
    )
    return methods.select(F.col("fqn").alias("method_fqn"), table.alias("table_name"))


# fixed values: procedure-call rules, in order
PROCEDURE_INDICATORS = (
    ("SimpleJdbcCall", (r"new SimpleJdbcCall", r"SimpleJdbcCall\s+\w+\s*=")),
    ("CallableStatement", (r"connection.prepareCall", "CallableStatement", r"\{\s*call\s+")),
    ("StoredProcedureQuery", ("createStoredProcedureQuery", "createNamedStoredProcedureQuery", "StoredProcedureQuery")),
)
PARAMETER_CALLS = (
    r"\.setString\s*\(", r"\.setInt\s*\(", r"\.setLong\s*\(", r"\.setDouble\s*\(", r"\.setBoolean\s*\(", r"\.setDate\s*\(", r"\.setTimestamp\s*\(",
    r"\.setBigDecimal\s*\(", r"\.setObject\s*\(", r"\.setParameter\s*\(", r"\.registerOutParameter\s*\(",
)
DATABASE_WORDS = (("ORACLE", ("oracle",)), ("POSTGRESQL", ("postgres", "pgconnection")), ("MYSQL", ("mysql", "mariadb")), ("SQL_SERVER", ("sqlserver", "mssql")), ("DB2", ("db2",)))


def _quoted(call: str) -> str:
    return call + r"\s*\(\s*[\"']([^\"']+)[\"']"


def _variable(call: str) -> str:
    return call + r"\s*\(\s*[\w\[\].]+\s*\)"


def _dotted(full: Column) -> tuple[Column, Column, Column]:
    """(schema, package, name) of a 1-, 2- or 3+-part name."""
    p = F.split(full, r"\.")
    n = F.size(p)
    name = F.when(n >= 3, F.array_join(F.slice(p, 3, F.greatest(n - 2, F.lit(0))), ".")).when(n == 2, F.try_element_at(p, F.lit(2))).otherwise(full)
    return F.when(n >= 2, p[0]), F.when(n >= 3, F.try_element_at(p, F.lit(2))), name


def detect_procedure_calls(methods: DataFrame) -> DataFrame:
    """First usable procedure or function call of a method, by call type in rule order."""
    src = F.col("source")
    none = F.lit(None).cast("string")

    def call(schema, catalog, package, name, function):
        return F.when(name.isNotNull(), F.struct(
            schema.alias("schema_name"), catalog.alias("catalog_name"), package.alias("package_name"), name.alias("procedure_name"), function.alias("is_function"),
        ))

    func = _first(src, _quoted("withFunctionName"))
    dynamic = F.when(src.rlike(_variable("withProcedureName")), "DYNAMIC_PROCEDURE").when(src.rlike(_variable("withSchemaName")), "DYNAMIC_SCHEMA").when(
        src.rlike(_variable("withCatalogName")), "DYNAMIC_CATALOG")
    simple = call(
        F.coalesce(_first(src, _quoted("withSchemaName")), F.when(src.rlike(_variable("withSchemaName")), "DYNAMIC_SCHEMA")),
        F.coalesce(_first(src, _quoted("withCatalogName")), F.when(src.rlike(_variable("withCatalogName")), "DYNAMIC_CATALOG")),
        none, F.coalesce(func, _first(src, _quoted("withProcedureName")), dynamic), func.isNotNull(),
    )
    cs_full = _first(src, r"(?i)call\s+([\w.]+)\s*\(")
    s, p, n = _dotted(cs_full)
    cs_dynamic = F.when(src.rlike(r"prepareCall\s*\(\s*\w+\s*\+|String\.format"), "DYNAMIC_PROCEDURE")
    callable_ = call(s, none, p, F.coalesce(n, cs_dynamic), F.lit(False))
    s2, p2, n2 = _dotted(_first(src, _quoted("createStoredProcedureQuery")))
    sp = call(s2, none, p2, F.coalesce(n2, _first(src, _quoted("createNamedStoredProcedureQuery")),
                                       F.when(src.rlike(r"createStoredProcedureQuery\s*\(\s*\w+\s*\)"), "DYNAMIC_PROCEDURE")), F.lit(False))
    bodies = {"SimpleJdbcCall": simple, "CallableStatement": callable_, "StoredProcedureQuery": sp}
    found = F.coalesce(*(
        F.when(_any_match(src, ind) & bodies[kind].isNotNull(), F.struct(F.lit(kind).alias("call_type"), bodies[kind].alias("c"))) for kind, ind in PROCEDURE_INDICATORS
    ))
    db = F.lit("UNKNOWN")
    for kind, words in reversed(DATABASE_WORDS):
        db = F.when(reduce(lambda a, b: a | b, (F.lower(src).contains(w) for w in words)), kind).otherwise(db)
    params = F.flatten(F.array(*(F.regexp_extract_all(src, F.lit(p), F.lit(0)) for p in PARAMETER_CALLS)))
    params = F.array_distinct(F.transform(params, lambda x: F.trim(F.regexp_replace(x, r"[,\s]+", " "))))
    out = methods.select(F.col("fqn").alias("method_fqn"), found.alias("f"), db.alias("database_type"), params.alias("parameters")).where("f IS NOT NULL")
    # parameters are listed for calls built in code only
    listed = F.when(F.col("f.call_type") == "SimpleJdbcCall", F.col("parameters")).otherwise(F.array().cast("array<string>"))
    return out.select("method_fqn", "f.call_type", "f.c.*", "database_type", listed.alias("parameters"))


# fixed values: shell rules
SHELL_NAMES = ("BatchUtils", "ShellExecutor", "CommandExecutor", "ProcessExecutor")
NOT_SHELL_NAMES = ("QueryExecutor", "TaskExecutor", "JobExecutor", "Executor")
SHELL_IMPORTS = (
    "java.lang.Runtime", "java.lang.ProcessBuilder", "org.apache.commons.exec.CommandLine", "org.apache.commons.exec.DefaultExecutor",
    "org.apache.commons.exec.Executor", "java.lang.Process", "org.apache.commons.exec", "org.springframework.util.exec", "java.io.BufferedReader",
    "java.io.InputStreamReader",
)
SHELL_CODE = (
    r"Runtime\.getRuntime\(\)\.exec\s*\(", r"(?:RUNTIME|runtime|rt)\s*\.\s*exec\s*\(", r"new\s+ProcessBuilder\s*\(", r"executor\.execute\s*\(",
    r"CommandLine\.parse\s*\(",
)
SHELL_CALLS = (
    ("Runtime.exec", r"(?s)Runtime\.getRuntime\(\)\.exec\s*\(\s*([^)]+)\)"), ("ProcessBuilder", r"(?s)new\s+ProcessBuilder\s*\(\s*([^)]+)\)"),
    ("CommonsExec", r"(?s)executor\.execute\s*\(\s*([^)]+)\)"),
)
# fixed values: rules of the rule file in order: pattern, execution method
SHELL_RULES = tuple(zip(SHELL_CODE, ("Runtime.exec", "Runtime.exec", "ProcessBuilder", "CommonsExec", "CommonsExec"), strict=True))
LITERAL, ARGUMENTS = r"""["']([^"']+)["']""", r"new\s+String\[\]\s*\{([^}]+)\}"
# fixed values: what a command argument that isn't a plain text looks like, in order: pattern, script type, script name, reason
SHELL_VERDICTS = (
    (r"\w+\s*\+|\+\s*\w+|String\.format|String\.join", "SHELL", "DYNAMIC_PATH", "DYNAMIC_PATH:String concatenation or formatting detected"),
    (r"(?i)\b(scriptPath|hostname|user|command|cmd)\b", "SHELL", "PARAMETERIZED", "PARAMETERIZED:Script path passed as parameter"),
    ("(?i)ssh|scp|sftp|rsync", "REMOTE_SHELL", "REMOTE_EXECUTION", "REMOTE_EXECUTION:SSH or remote execution detected"),
    ("", "UNKNOWN", "UNKNOWN_SCRIPT", "UNKNOWN_SCRIPT:Cannot determine script from source"),
)
# fixed values: signs of a script name that is a variable, or settled by its ending or place
VARIABLE_NAME, VARIABLE_WORDS = "^[a-z][a-zA-Z0-9_]*$", ("script", "file", "path", "command", "cmd", "dir")
PUT_TOGETHER = r"String\.(format|join)|StringBuilder|StringBuffer"
SCRIPT_ENDING, ABSOLUTE_PATH = r"\.(sh|py|ps1|bat|cmd|pl|rb|js)$", r"^([a-zA-Z]:[/\\]|/)"
SHORTEST_NAME = 3
GREY_CORE = ("UNKNOWN", "DYNAMIC", "PARAMETERIZED")
GREY_DB = GREY_CORE + ("DYNAMIC_TABLE", "DYNAMIC_CATALOG", "DYNAMIC_SCHEMA")
GREY_PROC = GREY_CORE + ("DYNAMIC_PROCEDURE", "DYNAMIC_PACKAGE")
SCRIPT_QUALITY = (
    "unknown", "dynamic", "parameterized", "variable", "placeholder", "error", "exception", "unable", "failed", "missing", "not found", "invalid",
    "undefined", "null", "empty",
)
GREY_SHELL = GREY_CORE + ("DYNAMIC_PATH", "DYNAMIC_SCRIPT", "UNKNOWN_SCRIPT", "REMOTE_EXECUTION") + SCRIPT_QUALITY


def mentions(text: Column, words) -> Column:
    """Text contains one of the words, in any case."""
    return F.upper(F.coalesce(text, F.lit(""))).rlike("|".join(re.escape(w.upper()) for w in words))


def classify_shell_executor(classes: DataFrame, imports: DataFrame, sources: DataFrame) -> DataFrame:
    """Classes that run commands: hinted by name or import, and really doing it in their text (class_fqn, source)."""
    low = F.lower("name")
    ignored = reduce(lambda a, b: a | b, (low.contains(n.lower()) for n in NOT_SHELL_NAMES))
    hinted = reduce(lambda a, b: a | b, (low.contains(n.lower()) for n in SHELL_NAMES))
    imp = imports.where(reduce(lambda a, b: a | b, (F.col("import_name").contains(p) for p in SHELL_IMPORTS))).select(
        F.col("class_fqn").alias("fqn"), F.lit(True).alias("by_import")).distinct()
    doing = sources.where(_any_match(F.col("source"), SHELL_CODE, "")).select(F.col("class_fqn").alias("fqn"), F.lit(True).alias("does")).distinct()
    verdict = ~ignored & (hinted | F.coalesce("by_import", F.lit(False))) & F.coalesce("does", F.lit(False))
    return classes.join(imp, "fqn", "left").join(doing, "fqn", "left").select("fqn", verdict.alias("is_shell_executor"))


def detect_shell(methods: DataFrame) -> DataFrame:
    """One row per command run of a method: script, kind, confidence and why it is unclear."""
    found = None
    for kind, pattern in SHELL_CALLS:
        part = methods.select(
            F.col("fqn").alias("method_fqn"), F.lit(kind).alias("execution_method"),
            F.posexplode(F.regexp_extract_all("source", F.lit(pattern), F.lit(1))).alias("pos", "raw"),
        )
        found = part if found is None else found.unionByName(part)
    arg = F.trim("raw")
    literal = arg.startswith('"') & arg.endswith('"')
    path = F.regexp_replace(arg, '^"+|"+$', "")

    def verdict(plain: Column, field: int) -> Column:
        out = F.lit(None).cast("string")
        for rule in reversed(SHELL_VERDICTS):
            out = F.when(arg.rlike(rule[0]), rule[field]).otherwise(out)
        return F.when(literal, plain).otherwise(out)

    return found.select(
        "method_fqn", "execution_method", "pos", verdict(script_type_hint(path), 1).alias("script_type"), verdict(path, 2).alias("script_name"),
        F.when(literal, "HIGH").otherwise("LOW").alias("confidence"), (~literal).alias("further_analysis"),
        verdict(F.lit(None).cast("string"), 3).alias("grey_area_reason"),
    )


def detect_shell_by_rules(methods: DataFrame, rules=SHELL_RULES) -> DataFrame:
    """One row per method that runs commands, by the first rule (pattern, execution method) its text matches.

    The script is the first text in quotes of more than two characters that is
    neither a flag nor a switch or path (no leading ``-`` or ``/``); its type
    follows from it or, without one, from the whole text.  Arguments are those
    of the first string array.
    """
    method = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        method = F.when(F.col("source").rlike(pattern), name).otherwise(method)
    usable = F.filter(
        F.regexp_extract_all("source", F.lit(LITERAL), F.lit(1)), lambda x: (F.length(x) > 2) & ~x.startswith("-") & ~x.startswith("/"))
    script = F.try_element_at(usable, F.lit(1))
    listed = F.regexp_extract("source", ARGUMENTS, 1)
    bare = F.transform(F.split(listed, ","), lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^[\"']+|[\"']+$", ""))
    return methods.withColumn("execution_method", method).where("execution_method IS NOT NULL").select(
        F.col("fqn").alias("method_fqn"), "execution_method", script.alias("script_name"), script_type_hint(F.coalesce(script, "source")).alias("script_type"),
        F.when(listed != "", bare).otherwise(F.array().cast("array<string>")).alias("arguments"),
    )


def is_grey_script(name: Column, source: Column) -> Column:
    """Script name that needs a person to look at it."""
    low = F.lower(F.coalesce(name, F.lit("")))
    has = lambda words: reduce(lambda a, b: a | b, (low.contains(w) for w in words))
    unclear = (
        (low == "") | has(SCRIPT_QUALITY) | (name.rlike(VARIABLE_NAME) & has(VARIABLE_WORDS))
        | (source.contains("+") & source.rlike("[\"']")) | source.rlike(PUT_TOGETHER) | (F.length(name) < SHORTEST_NAME)
    )
    settled = low.rlike(SCRIPT_ENDING) | name.rlike(ABSOLUTE_PATH)
    return F.coalesce(unclear, F.lit(False)) | ~F.coalesce(settled, F.lit(False))


def code_line_count(source: Column) -> Column:
    """Lines that are neither blank nor comment."""
    bare = F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    return F.size(F.filter(F.split(bare, "\n"), lambda x: F.trim(x) != ""))


def erased_key(signature: Column) -> Column:
    """Method key without generic arguments and blanks."""
    # each round removes the innermost brackets: as many rounds as there are brackets
    depth = F.length(F.regexp_replace(F.coalesce(signature, F.lit("")), "[^<]", ""))
    rounds = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    inner = F.aggregate(rounds, signature, lambda text, _: F.regexp_replace(text, r"<[^<>]*>", ""))
    return F.regexp_replace(inner, r"\s+", "")
