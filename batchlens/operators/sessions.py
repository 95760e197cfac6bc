"""Message history per session."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def session_tail(messages: DataFrame, max_turns: int = 10) -> DataFrame:
    """Last messages of each session in order.

    The rank limit also runs before the shuffle, so a session with very many
    messages sends few rows to its task.
    """
    w = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    last = messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= max_turns)
    return last.drop("back")


class Expiry(NamedTuple):
    sessions: DataFrame  # session_id, last_update, expired
    summary: DataFrame


def expire_sessions(messages: DataFrame, now: str, ttl_hours: int = 24) -> Expiry:
    """Sessions by last update; those older than the time to live count as expired."""
    last = messages.groupBy("session_id").agg(F.max("ts").alias("last_update"), F.count("*").alias("message_count"))
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(hours=F.lit(ttl_hours))
    judged = last.withColumn("expired", F.col("last_update") < limit)
    return Expiry(judged, judged.agg(F.count_if("expired").alias("removed"), F.count_if(~F.col("expired")).alias("active")))
