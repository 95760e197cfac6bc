"""Small DuckDB SQL builders used by the cross-check statements."""

from __future__ import annotations

from batchlens.sources.testdata import AS_OF


def clock(ms: str) -> str:
    """HH:MM:SS text of a millisecond expression."""
    s = f"(({ms}) // 1000)"
    return (
        f"(lpad(cast({s} // 3600 AS varchar), 2, '0') || ':' || lpad(cast({s} % 3600 // 60 AS varchar), 2, '0')"
        f" || ':' || lpad(cast({s} % 60 AS varchar), 2, '0'))"
    )


def day_clock(day: str, ms: str) -> str:
    return f"cast({day} AS varchar) || 'T' || {clock(ms)}"


def since(days: int) -> str:
    return f"business_date >= DATE '{AS_OF}' - {days}"
