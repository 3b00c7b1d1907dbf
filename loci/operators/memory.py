"""Reads over drawers: status, wings, rooms, recall, diary, the essential story."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.functions import text as tx
from loci.operators.filters import path_match


def status(drawers: DataFrame, missing: str = "unknown") -> DataFrame:
    """Total, per-wing and per-room counts in one pass: (level, name, drawers)."""
    named = drawers.select(
        tx.or_default(F.col("wing"), missing).alias("wing"), tx.or_default(F.col("room"), missing).alias("room")
    )
    counted = named.groupingSets([[], ["wing"], ["room"]], "wing", "room").agg(
        F.count("*").alias("drawers"),
        F.grouping("wing").alias("no_wing"),
        F.grouping("room").alias("no_room"),
    )
    level = F.when(F.col("no_wing") == 0, "wing").when(F.col("no_room") == 0, "room").otherwise("total")
    name = F.coalesce("wing", "room", F.lit("total"))
    return counted.select(level.alias("level"), name.alias("name"), "drawers")


def list_wings(drawers: DataFrame) -> DataFrame:
    return drawers.groupBy(tx.or_default(F.col("wing"), "unknown").alias("wing")).agg(
        F.count("*").alias("drawers")
    )


def list_rooms(drawers: DataFrame, wing: str | None = None) -> DataFrame:
    found = path_match(drawers, wing=wing)
    return found.groupBy(tx.or_default(F.col("room"), "unknown").alias("room")).agg(
        F.count("*").alias("drawers")
    )


def wing_rooms(drawers: DataFrame) -> DataFrame:
    """Nested counts as rows, wings by name and rooms by size."""
    return (
        drawers.groupBy(
            tx.or_default(F.col("wing"), "?").alias("wing"), tx.or_default(F.col("room"), "?").alias("room")
        )
        .agg(F.count("*").alias("drawers"))
        .orderBy("wing", F.desc("drawers"), "room")
    )


def recall(drawers: DataFrame, wing=None, room=None, limit: int | None = None) -> DataFrame:
    """Drawers of a room, whitespace-squashed to 300 characters."""
    found = path_match(drawers, wing=wing, room=room)
    if limit is not None:
        found = found.orderBy("original_id").limit(limit)
    return found.select(
        "original_id",
        tx.or_default(F.col("room"), "?").alias("room"),
        tx.or_default(F.col("wing"), "?").alias("wing"),
        tx.or_default(F.col("hall"), "?").alias("hall"),
        F.coalesce("importance", F.lit(3.0)).alias("importance"),
        F.coalesce("filed_at", F.lit("")).alias("filed_at"),
        tx.snippet(F.col("document"), 300).alias("content"),
    )


def diary_entries(drawers: DataFrame, agent: str | None = None, session_id=None, topic=None) -> DataFrame:
    found = drawers.where(F.col("room") == "diary")
    if agent is not None:
        found = found.where(F.col("wing") == tx.agent_wing(F.lit(agent)))
    if session_id:
        found = found.where(F.col("session_id") == session_id)
    if topic:
        found = found.where(F.col("topic") == topic)
    return found


def diary_read(drawers: DataFrame, agent=None, last_n: int | None = 10, session_id=None, topic=None) -> DataFrame:
    """The newest n entries of every agent (or of one)."""
    order = Window.partitionBy("wing").orderBy(F.desc_nulls_last("filed_at"), F.desc("original_id"))
    return (
        diary_entries(drawers, agent, session_id, topic)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= last_n if last_n is not None else F.lit(True))
        .select(
            "wing", "position", "original_id",
            F.coalesce("date", F.lit("")).alias("date"),
            F.coalesce("filed_at", F.lit("")).alias("timestamp"),
            F.coalesce("topic", F.lit("")).alias("topic"),
            F.col("document").alias("content"),
        )
    )


def essential_rows(drawers: DataFrame, rows: int = fixed.L1_ROWS) -> DataFrame:
    """The most important drawers of every palace."""
    importance = F.coalesce("importance", F.lit(3.0))
    order = Window.partitionBy("palace").orderBy(F.desc(importance), F.asc("original_id"))
    return (
        drawers.select("palace", "original_id", "room", "source_file", "document", importance.alias("importance"))
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= rows)
    )


def essential_story(drawers: DataFrame, rows: int = fixed.L1_ROWS, budget: int = fixed.L1_CHARS) -> DataFrame:
    """The top rows of each palace as text: rooms in order, lines within a budget.

    The character count covers headers and printed lines; a line over budget
    ends its room, later rooms still get their header.  Only the top rows of a
    palace (15) are ever gathered.
    """
    source = F.when(
        F.length("source_file") > 0, F.concat(F.lit(" ("), tx.basename(F.col("source_file")), F.lit(")"))
    ).otherwise("")
    picked = essential_rows(drawers, rows).select(
        "palace",
        F.struct(
            tx.or_default(F.col("room"), "general").alias("room"),
            F.col("position"),
            F.concat(F.lit("  - "), tx.snippet(F.col("document"), 200), source).alias("line"),
        ).alias("entry"),
    )

    def step(acc, e):
        new_room = acc["room"].isNull() | (acc["room"] != e["room"])
        header = F.concat(F.lit("\n["), e["room"], F.lit("]"))
        before = acc["total"] + F.when(new_room, F.length(header)).otherwise(0)
        closed = F.when(new_room, F.lit(False)).otherwise(acc["closed"])
        over = before + F.length(e["line"]) > budget
        shown = F.when(closed, F.array().cast("array<string>")).when(
            over, F.array(F.lit("  ... (more available via search)"))
        ).otherwise(F.array(e["line"]))
        head = F.when(new_room, F.array(header)).otherwise(F.array().cast("array<string>"))
        return F.struct(
            e["room"].alias("room"),
            (before + F.when(closed | over, 0).otherwise(F.length(e["line"]))).alias("total"),
            (closed | over).alias("closed"),
            F.concat(acc["lines"], head, shown).alias("lines"),
        )

    start = F.struct(
        F.lit(None).cast("string").alias("room"), F.lit(0).alias("total"), F.lit(False).alias("closed"),
        F.array(F.lit("## L1 — ESSENTIAL STORY")).alias("lines"),
    )
    folded = F.aggregate(F.array_sort(F.col("entries")), start, step, lambda acc: F.array_join(acc["lines"], "\n"))
    return picked.groupBy("palace").agg(F.collect_list("entry").alias("entries")).select(
        "palace", folded.alias("l1_essential")
    )


def illuminate(
    palaces: DataFrame, drawers: DataFrame, ranked: DataFrame | None = None, wing: str | None = None,
    saves: DataFrame | None = None, today: str | None = None,
) -> DataFrame:
    """Identity and essential story of one palace, as one row.

    ``ranked`` is a one-row result of ``routing.rank_palaces`` for a context;
    without it the default palace is taken, else the first by name.
    ``saves`` is a table (last_save_date, items_saved, topics).
    """
    if ranked is not None:
        best = ranked.select(F.element_at("candidates", 1)["name"].alias("name"))
        chosen = palaces.join(F.broadcast(best.limit(1)), "name", "left_semi")
    else:
        chosen = palaces
    # One row at most from here on, so the joins below are with a single row.
    chosen = chosen.orderBy(F.desc("is_default"), "name").limit(1)
    focus = F.lit(wing) if wing else F.nullif(F.col("wing_focus"), F.lit(""))
    identity = chosen.select(
        F.col("name").alias("palace"), "description", F.nullif("wing_focus", F.lit("")).alias("wing_focus"),
        F.when(F.col("is_default"), "default fallback").otherwise("scope/keyword match").alias("reason"),
        tx.or_default(
            F.col("l0_body"), ""
        ).alias("body"),
        focus.alias("_focus"),
    ).withColumn(
        "l0_identity",
        F.when(F.col("body") != "", F.col("body")).otherwise(
            F.concat(F.lit("## L0 — IDENTITY\n("), F.col("palace"), F.lit(" — no body content)"))
        ),
    ).drop("body")
    scoped = drawers.join(F.broadcast(identity.select("palace", "_focus")), "palace").where(
        F.col("_focus").isNull() | (F.col("wing") == F.col("_focus"))
    )
    story = essential_story(scoped)
    out = identity.join(story, "palace", "left").withColumn(
        "l1_essential",
        F.coalesce("l1_essential", F.lit("## L1 — ESSENTIAL STORY\nNo memories yet.")),
    ).drop("_focus")
    if saves is None:
        return out.withColumn("l1_recent_saves", F.lit(None).cast("string"))
    day = F.to_date(F.lit(today)) if today else F.current_date()
    recent = (
        saves.where((F.to_date("last_save_date") >= F.date_sub(day, 7)) & (F.col("items_saved") > 0))
        .orderBy(F.desc("last_save_date"))
        .limit(1)
        .select(F.concat(
            F.col("last_save_date"), F.lit(": "), F.col("items_saved").cast("string"),
            F.lit(" item saved ("), F.array_join("topics", ", "), F.lit(")"),
        ).alias("l1_recent_saves"))
    )
    return out.withColumn("_one", F.lit(1)).join(
        F.broadcast(recent.withColumn("_one", F.lit(1))), "_one", "left"
    ).drop("_one")
