"""Joins and running values that stay spread out when one key is very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key is heavy when it has at least 1/HEAVY_SHARE of all rows, so there are
# never more than HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1000


def join_unique(big: DataFrame, unique: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join rows with a side that has one row per key and knows the key's row count.

    Keys holding at least a thousandth of all rows (so at most a thousand of
    them) are matched by broadcast; their rows then carry a hash of the whole
    row as an extra join key, which finds nothing on the other side but keeps
    them spread out.  All other keys are small and take an ordinary join.
    """
    total = unique.agg(F.sum(weight)).scalar()
    is_heavy = F.col(weight) * HEAVY_SHARE >= total
    values = [c for c in unique.columns if c not in on]
    packed = unique.select(*on, F.struct(*values).alias("_value"), is_heavy.alias("_heavy"))
    heavy = packed.where("_heavy").select(*on, F.col("_value").alias("_hot"))
    light = packed.where(~F.col("_heavy")).select(*on, F.col("_value").alias("_cold"), F.lit(0).cast("bigint").alias("_spread"))
    tagged = big.join(F.broadcast(heavy), on, "left").withColumn(
        "_spread",
        F.when(F.col("_hot").isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(*big.columns).bitwiseOR(F.lit(1))),
    )
    found = tagged.join(light, [*on, "_spread"], "left").withColumn("_value", F.coalesce("_hot", "_cold"))
    if how == "inner":
        found = found.where(F.col("_value").isNotNull())
    return found.select(*big.columns, *[F.col("_value")[c].alias(c) for c in values])


SEGMENTS = 256


def segment_bounds(df: DataFrame, order: str) -> list:
    """Values that cut a table into about equal parts along an ordering column."""
    shares = [i / SEGMENTS for i in range(1, SEGMENTS)]
    found = df.agg(F.percentile_approx(order, shares, 10_000)).first()[0]
    return sorted(set(found or []))


def segment_of(value: Column, bounds: list) -> Column:
    """Number of bounds at or below a value, by binary search in generated code."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(bounds[mid]), pick(lo, mid)).otherwise(pick(mid + 1, hi))

    return pick(0, len(bounds))


def running_count(
    df: DataFrame, group: list[str], order: str, flag: Column, out: str, bounds: list | None = None,
) -> DataFrame:
    """Number of flagged rows up to and including each one, per group in order.

    ``order`` is unique in its group.  Rows are counted within segments of the
    ordering column, each about 1/256 of the table, and segments are added up
    from their totals; so a group of any size is sorted by many tasks.
    """
    bounds = segment_bounds(df, order) if bounds is None else bounds
    cut = df.withColumn("_seg", segment_of(F.col(order), bounds)).withColumn("_flag", flag.cast("int"))
    totals = cut.groupBy(*group, "_seg").agg(F.sum("_flag").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.withColumn("_in", F.sum("_flag").over(inside))
        .join(before, [*group, "_seg"])
        .withColumn(out, (F.col("_in") + F.col("_before")).cast("bigint"))
        .drop("_seg", "_flag", "_in", "_before")
    )


def neighbours(
    df: DataFrame, group: list[str], order: str, following: dict[str, Column] | None = None,
    preceding: dict[str, Column] | None = None, bounds: list | None = None,
) -> DataFrame:
    """Values of the next and of the previous row per group, as new columns.

    Segmented like ``running_count``: the first and last row of a segment take
    their neighbour from the edge of the nearest segment that has rows.
    """
    bounds = segment_bounds(df, order) if bounds is None else bounds
    cut = df.withColumn("_seg", segment_of(F.col(order), bounds))
    inside = Window.partitionBy(*group, "_seg").orderBy(order)
    across = Window.partitionBy(*group).orderBy("_seg")
    edges, local, outs = [], {}, []
    shifts = []
    for tag, wanted, pick, shift in (("n", following, F.min_by, F.lead), ("p", preceding, F.max_by, F.lag)):
        if not wanted:
            continue
        row = F.struct(*[c.alias(n) for n, c in wanted.items()])
        edges.append(pick(row, order).alias(f"_edge_{tag}"))
        shifts.append((f"_far_{tag}", shift(f"_edge_{tag}").over(across)))
        local[f"_near_{tag}"] = shift(row).over(inside)
        outs += [(n, F.coalesce(f"_near_{tag}", f"_far_{tag}")[n]) for n in wanted]
    far = cut.groupBy(*group, "_seg").agg(*edges)
    far = far.select(*group, "_seg", *[c.alias(n) for n, c in shifts])
    joined = cut.withColumns(local).join(far, [*group, "_seg"])
    return joined.select(*df.columns, *[c.alias(n) for n, c in outs])
