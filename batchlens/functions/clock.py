"""Times of day as integer milliseconds, and dates: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000

# fixed values: clock spellings accepted in definition sheets
CLOCK_FORMATS = ("hh:mm a", "h:mm a", "HH:mm:ss", "HH:mm")


def ms_to_clock(ms: Column) -> Column:
    """Milliseconds to ``HH:MM:SS``; hours may pass 23 for the next day."""
    seconds = F.floor(ms / 1000)
    return F.when(
        ms.isNotNull(),
        F.format_string(
            "%02d:%02d:%02d",
            F.floor(seconds / 3600),
            F.floor((seconds % 3600) / 60),
            seconds % 60,
        ),
    )


def clock_to_ms(text: Column) -> Column:
    """``HH:MM[:SS[.fff]]`` with an optional offset to milliseconds of day, else null."""
    pattern = r"^(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(?:Z|[+-]\d{2}:?\d{2})?$"

    def part(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(F.trim(text), pattern, i), F.lit("")), F.lit("0"))

    h, m, s = (part(i).cast("bigint") for i in (1, 2, 3))
    milli = F.substring(F.rpad(part(4), 3, "0"), 1, 3).cast("bigint")
    ok = F.trim(text).rlike(pattern) & (h < 24) & (m < 60) & (s < 60)
    return F.when(ok, h * 3_600_000 + m * 60_000 + s * 1000 + milli)


def ms_of_day(ts: Column) -> Column:
    """Milliseconds since midnight of a timestamp."""
    return F.pmod(F.unix_millis(ts), F.lit(DAY_MS))


def parse_clock(text: Column) -> Column:
    """Clock text in any accepted spelling to milliseconds of day; null if none fits."""
    t = F.upper(F.trim(text))
    parsed = F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in CLOCK_FORMATS))
    return (F.hour(parsed) * 3_600_000 + F.minute(parsed) * 60_000 + F.second(parsed) * 1000).cast("bigint")


def parse_date(text: Column) -> Column:
    """First ten characters as an ISO date; null when they are none."""
    return F.try_to_date(F.substring(F.trim(text), 1, 10), "yyyy-MM-dd")


def parse_timestamp(text: Column) -> Column:
    """ISO date-time with blank or ``T`` separator and optional ``Z``/offset; null if unreadable."""
    t = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    return F.try_to_timestamp(t)


def business_date(ts: Column, cutoff: int = 18) -> Column:
    """Runs starting at or after the cutoff hour book to the next day."""
    return F.date_add(F.to_date(ts), F.when(F.hour(ts) >= cutoff, 1).otherwise(0))


def day_and_clock(day: Column, ms: Column) -> Column:
    """``<date>T<clock>``, null when either part is."""
    return F.concat(day.cast("string"), F.lit("T"), ms_to_clock(ms))
