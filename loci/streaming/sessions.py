"""Sessions: events of one user without a longer break between them, from a table or from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.operators.skew import neighbours, running_count, segment_bounds


def sessions(events: DataFrame, user: str, at: str, gap_seconds: int) -> DataFrame:
    """(user, session_start, session_end, events) of a table.

    A session ends at its last event.  An event that comes exactly ``gap_seconds`` after the one before still belongs to
    it.  Events of one user are put in order by segments of time, so one user may have most of them.
    Rows without a user are one user; rows without a time are left out.
    """
    moments = events.where(F.col(at).isNotNull()).groupBy(F.col(user).alias("_user"), F.unix_micros(F.col(at).cast("timestamp")).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    # Null is no join key, so it is a flag and an empty value.
    keyed = moments.select(F.isnull("_user").alias("_none"), F.coalesce(F.col("_user").cast("string"), F.lit("")).alias("_key"), "_user", "_at", "_n")
    bounds = segment_bounds(keyed, "_at")
    group = ["_none", "_key"]
    before = neighbours(keyed, group, "_at", preceding={"_previous": F.col("_at")}, bounds=bounds)
    opens = F.coalesce(F.col("_at") - F.col("_previous") > gap_seconds * 1_000_000, F.lit(True))
    numbered = running_count(before, group, "_at", opens, "_session", bounds)
    return numbered.groupBy(*group, "_session").agg(
        F.first("_user").alias(user), F.timestamp_micros(F.min("_at")).alias("session_start"), F.timestamp_micros(F.max("_at")).alias("session_end"), F.sum("_n").alias("events"),
    ).select(user, "session_start", "session_end", "events")


def session_stream(events: DataFrame, user: str, at: str, gap_seconds: int, late_seconds: int) -> DataFrame:
    """The same rows from a stream, each once its session can no longer grow; events over ``late_seconds`` late are dropped."""
    watched = events.withWatermark(at, f"{late_seconds} seconds")
    grouped = watched.groupBy(F.col(user), F.session_window(at, f"{gap_seconds} seconds").alias("_w"))
    return grouped.agg(F.min(at).alias("session_start"), F.max(at).alias("session_end"), F.count(F.lit(1)).alias("events")).select(
        user, "session_start", "session_end", "events")
