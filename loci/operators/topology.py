"""The graph of palaces and rooms: tunnels, traversal, figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.session import cut_lineage


def rooms(drawers: DataFrame) -> DataFrame:
    """(palace, slug, drawer_count) of every room in use."""
    slug = F.coalesce("room_name", "room") if "room_name" in drawers.columns else F.col("room")
    return drawers.where(slug.isNotNull()).groupBy("palace", slug.alias("slug")).agg(
        F.count("*").alias("drawer_count")
    )


def tunnels(room_table: DataFrame, palace_a: str | None = None, palace_b: str | None = None) -> DataFrame:
    """Rooms found in two palaces.

    With both names the given pair, with one name its tunnels to any other
    palace, without names every pair once (a < b).
    """
    left = room_table.select(F.col("slug").alias("tunnel"), F.col("palace").alias("palace_a"))
    right = room_table.select(F.col("slug").alias("tunnel"), F.col("palace").alias("palace_b"))
    if palace_a:
        left = left.where(F.col("palace_a") == palace_a)
        right = right.where(F.col("palace_b") == palace_b) if palace_b else right.where(F.col("palace_b") != palace_a)
        return left.join(right, "tunnel")
    return left.join(right, "tunnel").where(F.col("palace_a") < F.col("palace_b"))


def shared_rooms(room_table: DataFrame) -> DataFrame:
    """Rooms that are in several palaces, with the number of palaces and of pairs.

    Says how many tunnels there are without listing the pairs.
    """
    n = F.count("*")
    return (
        room_table.groupBy("slug").agg(n.alias("palaces"))
        .where(F.col("palaces") > 1)
        .withColumn("tunnels", F.expr("palaces * (palaces - 1) div 2"))
    )


def traverse(room_table: DataFrame, start: str, max_hops: int = 3, via_tunnel: bool = False) -> DataFrame:
    """Rooms within max_hops of a start room: (slug, distance, palace).

    Rooms are neighbours when one palace has both.  Each hop goes from rooms
    to the palaces not yet opened and from those to their rooms, so no room
    pair is ever listed; a palace is opened once.  ``palace`` is the first (by
    name) palace a room was reached through.
    """
    member = room_table.select("palace", "slug").distinct()
    seen = member.where(F.col("slug") == start).select("slug").distinct()
    home = member.where(F.col("slug") == start).select("palace").distinct()
    opened = member.limit(0).select("palace")
    frontier, layers = seen, []
    for hop in range(1, max_hops + 1):
        reached = member.join(frontier, "slug", "left_semi").select("palace").distinct()
        reached = reached.join(opened, "palace", "left_anti")
        found = (
            member.join(reached, "palace").groupBy("slug").agg(F.min("palace").alias("palace"))
            .join(seen, "slug", "left_anti")
            .withColumn("distance", F.lit(hop))
        )
        if hop > 1:
            # Later hops read this one several times; store it and forget its plan.
            found = cut_lineage(found)
        layers.append(found)
        opened = opened.unionByName(reached)
        frontier = found.select("slug")
        seen = seen.unionByName(frontier)
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    if via_tunnel:
        direct = member.join(home, "palace", "left_semi").select("slug").distinct().withColumn("_direct", F.lit(True))
        out = out.join(direct, "slug", "left").withColumn("via_tunnel", F.col("_direct").isNull()).drop("_direct")
        return out.select("slug", "distance", "palace", "via_tunnel")
    return out.select("slug", "distance", "palace")


def graph_stats(room_table: DataFrame, palaces: DataFrame | None = None) -> DataFrame:
    """One row: palaces, rooms, drawers, rooms shared between palaces."""
    per_slug = room_table.groupBy("slug").agg(F.count("*").alias("n"), F.sum("drawer_count").alias("d"))
    base = per_slug.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rooms"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("drawers"),
        F.count_if(F.col("n") > 1).alias("tunnels"),
    )
    source = room_table.select("palace") if palaces is None else palaces.select(F.col("name").alias("palace"))
    named = source.agg(F.countDistinct("palace")).scalar()
    return base.select(named.alias("palaces"), "rooms", "drawers", "tunnels")


def rooms_per_palace(room_table: DataFrame) -> DataFrame:
    return room_table.groupBy("palace").agg(F.count("*").alias("room_count")).orderBy(F.desc("room_count"), "palace")
