"""Structured Streaming: staged fact files and new conversation files into the drawer log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.functions import text as tx
from loci.operators.store import DrawerTable, as_upserts
from loci.schemas import DRAWER_LOG, STAGED, conform

_DEFAULTS = {"wing": "win_general", "hall": "hal_general", "room": "roo_general", "closet": "clo_general", "topic": "session"}


def read_staged(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of staged batches; files that are no JSON give rows of nulls."""
    return (
        spark.readStream.schema(STAGED).option("multiLine", "true").option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.json").json(folder)
    )


def _day(now: str):
    return F.left(F.coalesce("staged_at", F.lit(now)), F.lit(10))


def fact_rows(facts: DataFrame, now: str) -> DataFrame:
    """Drawer rows of facts (staged_at, _pos, content, palace, vector, ...).

    Facts without text, palace or vector are left out.  Ids are made of what a
    row says, so reading a file twice changes nothing.
    """
    usable = facts.withColumn("session_date", _day(now)).where(
        (F.coalesce("content", F.lit("")) != "") & (F.coalesce("palace", F.lit("")) != "") & F.col("vector").isNotNull()
    )
    key = F.concat_ws("\x01", "staged_at", "palace", "content", F.col("_pos").cast("string"))
    placed = usable.withColumns({
        **{n: tx.or_default(F.col(n), d) for n, d in _DEFAULTS.items()},
        "importance": F.coalesce(F.nullif("importance", F.lit(0.0)), F.lit(3.0)), "project": F.coalesce("project", F.lit("")),
        "tags": F.coalesce(F.array_join("tags", ","), F.lit("")), "source": F.lit("session"), "added_by": F.lit("bridge"),
        "filed_at": F.lit(now), "document": F.col("content"), "original_id": F.concat(F.lit("bridge_"), tx.short_md5(key, 16)),
    })
    return as_upserts(placed, 0)


def diary_lines(batches: DataFrame, now: str) -> DataFrame:
    """Drawer rows of the diary lines of staged batches."""
    lines = batches.where(F.coalesce("diary_entry.content", F.lit("")) != "").select(
        F.lit(fixed.SESSIONS_PALACE).alias("palace"), F.col("diary_entry.content").alias("document"),
        F.coalesce("diary_entry.vector", F.array_repeat(F.lit(0.0).cast("float"), fixed.VECTOR_SIZE)).alias("vector"),
        F.lit("wing_agent").alias("wing"), F.lit("hall_diary").alias("hall"), F.lit("diary").alias("room"), F.lit("clo_general").alias("closet"),
        F.lit("diary_entry").alias("type"), F.lit("bridge").alias("source"), F.lit("session-summary").alias("topic"),
        F.lit(2.0).alias("importance"), F.lit("agent").alias("agent"), F.lit(now).alias("filed_at"), _day(now).alias("date"), F.lit("bridge").alias("added_by"),
        F.concat(F.lit("diary_bridge_"), tx.short_md5(F.concat_ws("\x01", "staged_at", "diary_entry.content"), 12)).alias("original_id"),
    )
    return as_upserts(lines, 0)


def staged_rows(batches: DataFrame, now: str) -> DataFrame:
    """Drawer rows of staged batches: their facts and their diary lines."""
    facts = batches.select("staged_at", F.posexplode("facts").alias("_pos", "f")).select("staged_at", "_pos", "f.*")
    return fact_rows(facts, now).unionByName(diary_lines(batches, now))


def incomplete(batches: DataFrame) -> DataFrame:
    """Batches with a fact that still lacks its vector (they wait, see ``retry``)."""
    return batches.where(F.exists("facts", lambda f: f["vector"].isNull()))


def topics_saved(rows: DataFrame) -> DataFrame:
    """(filed_at, topic, items_saved) of drawer rows that a run saved; as many rows as topics."""
    return rows.where(F.col("palace") != fixed.SESSIONS_PALACE).groupBy("filed_at", "topic").agg(F.count(F.lit(1)).alias("items_saved"))


def save_summary(rows: DataFrame, now: str, most_topics: int | None = None) -> DataFrame:
    """(last_save_date, items_saved, topics) of what a run saved, for show.

    Topics are counted before they meet in one row, the most frequent first; ``most_topics`` bounds how many do.
    """
    topics = topics_saved(rows).groupBy("topic").agg(F.sum("items_saved").alias("n"))
    shown = topics.where(F.col("topic").isNotNull())
    if most_topics is not None:
        shown = shown.orderBy(F.desc("n"), "topic").limit(most_topics)
    listed = shown.agg(F.array_sort(F.collect_list("topic")).alias("topics"))
    return topics.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items_saved")).crossJoin(listed).select(F.lit(now[:10]).alias("last_save_date"), "items_saved", "topics")


def saves(spark: SparkSession, table: DrawerTable) -> DataFrame:
    """(version, filed_at, topic, items_saved) of all ingest runs so far."""
    return spark.read.schema("version long, filed_at string, topic string, items_saved long").parquet(f"{table.path}-saves")


def run_ingest(spark: SparkSession, folder: str, table: DrawerTable, checkpoint: str, now: str, patience: str | None = None):
    """Take in everything staged so far and stop.

    Facts without a vector wait in the stream's state until a later file of the same batch brings it; every fact is filed
    once.  What each micro-batch saved, by topic, is kept beside the table (see ``saves``).
    """
    from loci.streaming import retry

    table.create()
    base = table.next_version()
    batches = read_staged(spark, folder)

    def store(rows: DataFrame, number: int) -> None:
        filed = conform(rows.withColumn("version", F.lit(base + number)), DRAWER_LOG)
        table.append(filed)
        # The version names the folder, so a micro-batch done twice replaces its own figures.
        topics_saved(filed).write.mode("overwrite").parquet(f"{table.path}-saves/version={base + number}")

    def take_facts(batch: DataFrame, number: int) -> None:
        fact = F.from_json("fact", STAGED["facts"].dataType.elementType)
        found = batch.where("whole").select(F.nullif("batch", F.lit("")).alias("staged_at"), "pos", fact.alias("f"))
        store(fact_rows(found.select("staged_at", F.col("pos").alias("_pos"), "f.*"), now), 2 * number)

    def take_lines(batch: DataFrame, number: int) -> None:
        store(diary_lines(batch, now), 2 * number + 1)

    whole = retry.once_whole(batches, patience or retry.PATIENCE)
    query = whole.writeStream.foreachBatch(take_facts).option("checkpointLocation", f"{checkpoint}/facts").trigger(availableNow=True).start()
    query.awaitTermination()
    lines = batches.writeStream.foreachBatch(take_lines).option("checkpointLocation", f"{checkpoint}/lines").trigger(availableNow=True).start()
    lines.awaitTermination()
    return query


def run_convo_ingest(spark: SparkSession, folder: str, table: DrawerTable, checkpoint: str, *, wing: str, palace: str, now: str, mode: str = "exchange"):
    """Mine conversation files as they appear; each file is taken once."""
    from loci.sources.files import mine_convos

    table.create()
    base = table.next_version()
    stream = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true").load(folder)
    )

    def sink(batch: DataFrame, number: int) -> None:
        rows = mine_convos(batch.select("path", "content"), wing=wing, palace=palace, now=now, version=base + number, mode=mode, drawers=table.current())
        table.append(rows)

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
