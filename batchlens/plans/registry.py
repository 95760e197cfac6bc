"""Registry of named queries and their SQL statements for cross-checking."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from batchlens.sources import sheets  # noqa: F401  (adds derived tables)
from batchlens.sources.testdata import FIXTURES, Tables, duckdb_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, tuple[str, dict[str, str]]] = {}


def query(name: str, oracle: str | None = None, ctes: dict[str, str] | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``oracle`` is a SELECT in DuckDB SQL; ``{table}`` stands for a derived
    table, which is added as a common table expression together with whatever
    it depends on.  ``ctes`` adds further expressions local to the query.
    """

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = (oracle, ctes or {})
        return fn

    return wrap


def with_ctes(body: str, extra: dict[str, str]) -> str:
    """Prefix ``body`` with the derived tables it mentions, dependencies first."""
    known = {**FIXTURES, **SHARED, **extra}
    order: list[str] = []

    def visit(text: str) -> None:
        for ref in re.findall(r"\{(\w+)\}", text):
            if ref in known and ref not in order:
                visit(known[ref])
                if ref not in order:
                    order.append(ref)

    visit(body)
    main = duckdb_text(body).strip()
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", main)
    if not order:
        return main
    head = ",\n".join(f"{n} AS ({duckdb_text(known[n])})" for n in order)
    recursive = "RECURSIVE " if "/*rec*/" in head or (own and own.group(1)) else ""
    return f"WITH {recursive}{head},\n{main[own.end():]}" if own else f"WITH {recursive}{head}\n{main}"


# Expressions only the SQL side needs (the Spark side has an operator for them).
SHARED: dict[str, str] = {}
