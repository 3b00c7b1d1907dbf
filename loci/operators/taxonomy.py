"""The wing > hall > room > closet tree of every palace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loci.functions import text as tx

LEVELS = ("wing", "hall", "room", "closet")
_PREFIX = {"wing": "win", "hall": "hal", "room": "roo", "closet": "clo"}


def node_id(level, palace, name):
    """Short stable id of a node: its level, palace and name."""
    return F.concat(level, F.lit("_"), tx.short_md5(F.concat_ws("\x01", level, palace, name), 12))


def assign(rows: DataFrame) -> DataFrame:
    """Add wing_id, hall_id, room_id and closet_id to rows with the four names."""
    return rows.withColumns({
        f"{lv}_id": node_id(F.lit(_PREFIX[lv]), F.col("palace"), F.col(lv)) for lv in LEVELS
    })


def nodes(rows: DataFrame) -> DataFrame:
    """(palace, level, name, id, size); size counts the rows filed under a node."""
    listed = F.explode(F.array(*[
        F.struct(F.lit(lv).alias("level"), F.lit(_PREFIX[lv]).alias("prefix"), F.col(lv).alias("name")) for lv in LEVELS
    ]))
    flat = rows.select("palace", listed.alias("n")).select("palace", "n.*")
    counted = flat.groupBy("palace", "level", "prefix", "name").agg(F.count("*").alias("size"))
    return counted.select("palace", "level", "name", node_id(F.col("prefix"), F.col("palace"), F.col("name")).alias("id"), "size")


def edges(rows: DataFrame) -> DataFrame:
    """Distinct (palace, parent_level, parent, child)."""
    listed = F.explode(F.array(*[
        F.struct(F.lit(a).alias("parent_level"), F.col(a).alias("parent"), F.col(b).alias("child"))
        for a, b in zip(LEVELS, LEVELS[1:])
    ]))
    return rows.select("palace", listed.alias("e")).select("palace", "e.*").distinct()


def paths(edge_table: DataFrame, palace: str | None = None) -> DataFrame:
    """Complete wing/hall/room/closet paths, following edges by name."""
    found = edge_table if palace is None else edge_table.where(F.col("palace") == palace)

    def step(level, child):
        return found.where(F.col("parent_level") == level).select("palace", F.col("parent").alias(level), F.col("child").alias(child))

    return (
        step("wing", "hall").join(step("hall", "room"), ["palace", "hall"])
        .join(step("room", "closet"), ["palace", "room"])
        .select("palace", "wing", "hall", "room", "closet")
    )


def strict_paths(rows: DataFrame) -> DataFrame:
    """Paths that rows really use (a shared hall does not mix its parents' rooms)."""
    return rows.select("palace", *LEVELS).distinct()


def tree_lines(path_table: DataFrame) -> DataFrame:
    """The tree as text lines: (palace, wing, hall, room, closet, depth, line).

    One row per node, in reading order when sorted by the four names with
    empty ones first.  ``in_order`` does that sort.
    """
    made = []
    for depth, level in enumerate(LEVELS):
        have = LEVELS[: depth + 1]
        rows = path_table.select(
            "palace", *[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in LEVELS],
            F.lit(depth).alias("depth"), F.concat(F.lit("  " * depth), F.col(level)).alias("line"),
        )
        made.append(rows.distinct() if depth < 3 else rows)
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def in_order(lines: DataFrame) -> DataFrame:
    return lines.orderBy("palace", *[F.asc_nulls_first(c) for c in LEVELS])


def tree(path_table: DataFrame) -> DataFrame:
    """Rooms with their closets numbered, the form a nested reader needs.

    Rows, not one nested document: a palace's tree can be of any size.
    """
    order = Window.partitionBy("palace", "wing", "hall", "room").orderBy("closet")
    return path_table.withColumn("closet_no", F.row_number().over(order)).withColumns({
        f"{lv}_id": node_id(F.lit(_PREFIX[lv]), F.col("palace"), F.col(lv)) for lv in LEVELS
    })


def delete_closets(edge_table: DataFrame, closet_ids: DataFrame) -> DataFrame:
    """Edges without the closets named by (palace, closet_id)."""
    gone = closet_ids.select("palace", F.col("closet_id").alias("_id"), F.lit("room").alias("parent_level"))
    keyed = edge_table.withColumn("_id", node_id(F.lit("clo"), F.col("palace"), F.col("child")))
    return keyed.join(gone, ["palace", "parent_level", "_id"], "left_anti").drop("_id").select(edge_table.columns)
