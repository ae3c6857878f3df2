"""Stream forms of source health and pacing. Both use built-in stateful operators with a watermark, so state is bounded
by it; queries end in the sink the caller names, with its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_health(fetches: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """Per host and day: fetches and those that went well; later rows than `lateness` are dropped."""
    w = fetches.withWatermark("ts", lateness).groupBy("host", F.window("ts", "1 day").alias("w"))
    return w.agg(F.count_if("ok").alias("n_ok"), F.count("*").alias("n")).select("host", F.col("w.start").alias("day"), "n_ok", "n")


def activity_sessions(events: DataFrame, gap: str = "11 hours", lateness: str = "2 hours") -> DataFrame:
    """Per host: sessions of publications at most `gap` apart; the next one may begin when a session has ended."""
    s = events.withWatermark("ts", lateness).groupBy("host", F.session_window("ts", gap).alias("s"))
    return s.agg(F.count("*").alias("n")).select("host", F.col("s.start").alias("first"), F.col("s.end").alias("may_act_after"), "n")


def first_slugs(candidates: DataFrame, lateness: str = "1 day") -> DataFrame:
    """The first candidate of each slug, within the watermark."""
    return candidates.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["slug"])
