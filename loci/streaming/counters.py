"""When is a session due for a save: every fifteen messages of its user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.functions import fixed


def saves_due(messages: DataFrame, session: str = "session_id", every: int = fixed.SAVE_INTERVAL) -> DataFrame:
    """User messages per session and how many saves they have called for.

    Works on a table and on a stream alike (in update mode).  A plain count is
    enough state: a save falls due whenever the count passes a multiple of
    ``every``, and counts are added up before they are shuffled.
    """
    said = messages.where((F.col("role") == "user") & ~F.contains("content", F.lit("<command-message>")))
    counted = said.groupBy(session).agg(F.count("*").alias("user_messages"))
    return counted.withColumn("saves_due", F.floor(F.col("user_messages") / every).cast("bigint"))


def run_save_counter(messages: DataFrame, sink, checkpoint: str, session: str = "session_id", every: int = fixed.SAVE_INTERVAL):
    """Feed ``sink(rows, batch_id)`` with the sessions whose figures changed."""
    return (
        saves_due(messages, session, every).writeStream.outputMode("update").foreachBatch(sink)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
