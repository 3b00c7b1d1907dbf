"""Distributed least-significant-digit radix sort: stable counting-sort passes over the digits of a composite key.

A row's position is a number; positions are cut into blocks.  A pass counts the rows of
each digit value in each block; prefix sums over (digit value, block) give where each
block's rows of a value begin; a row's destination is that offset plus its place among
the equal rows of its block.  Destinations are the positions of the next pass, so a pass
keeps the order of the one before among equal digits.  After the last pass the position
is the rank.

No group exceeds a block (``BLOCK_BITS``), whatever the keys, for rows are only ordered
inside one value of one block.  Offsets are sums of counts: one row for each value of a
block, added up per value, and at most 2^``DIGIT_BITS`` totals.  Digits in which all rows
agree take no pass.  Each pass is written to the shared folder, so a lost executor costs
tasks of one pass only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loci.llm.common import fresh, written

DIGIT_BITS = 16
BLOCK_BITS = 18


def unsigned(number: Column) -> Column:
    """A signed long as the unsigned 64 bits that sort alike."""
    return number.bitwiseXOR(F.lit(-(1 << 63)))


def _digits(keys: list[str], bits: int) -> list[Column]:
    """Digits of unsigned 64-bit columns, least significant first; the last column counts least."""
    mask = F.lit((1 << bits) - 1).cast("bigint")
    return [F.shiftrightunsigned(F.col(k), at).bitwiseAND(mask) for k in reversed(keys) for at in range(0, 64, bits)]


def _moved(rows: DataFrame, digit: Column, at: str, block_bits: int, names: list[str]) -> DataFrame:
    """One pass: the rows with their destinations as positions."""
    block, value, n, start, place = names
    cut = rows.withColumns({block: F.shiftright(F.col(at), block_bits), value: digit})
    counted = written(cut.groupBy(block, value).agg(F.count(F.lit(1)).alias(n)), "radix-counts")
    before_block = Window.partitionBy(value).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    # At most 2^bits totals, so one task can add them up.
    before_value = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy(value).agg(F.sum(n).alias(n))
    totals = totals.select(value, F.coalesce(F.sum(n).over(before_value), F.lit(0)).alias(start))
    earlier = counted.select(block, value, F.coalesce(F.sum(n).over(before_block), F.lit(0)).alias(n))
    offsets = earlier.join(totals, value).select(block, value, (F.col(start) + F.col(n)).alias(start))
    inside = Window.partitionBy(block, value).orderBy(at)
    placed = cut.withColumn(place, F.row_number().over(inside) - 1).join(offsets, [block, value])
    return placed.select(*[c for c in rows.columns if c != at], (F.col(start) + F.col(place)).cast("bigint").alias(at))


def ranked(rows: DataFrame, keys: list[Column], out: str = "rank", bits: int = DIGIT_BITS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The rows with their rank (1, 2, 3, ...) by keys, the first of which counts most.

    Keys are longs taken as unsigned 64-bit numbers, without nulls.  Rows with equal keys
    get distinct ranks in some order.  All columns travel through every pass, so give
    narrow rows.  An empty table stays empty.
    """
    at, *names = fresh(rows, "at", "block", "value", "n", "start", "place")
    held = fresh(rows, *[f"key{i}" for i in range(len(keys))])
    # Positions are settled by writing them: whatever order tasks read in, the first pass sees these.
    current = written(rows.select("*", *[k.cast("bigint").alias(h) for k, h in zip(keys, held, strict=True)], F.monotonically_increasing_id().alias(at)), "radix-start")
    digits = _digits(held, bits)
    seen = current.agg(*[F.min(d).alias(f"a{i}") for i, d in enumerate(digits)], *[F.max(d).alias(f"b{i}") for i, d in enumerate(digits)]).first()
    differ = [d for i, d in enumerate(digits) if seen[f"a{i}"] != seen[f"b{i}"]] or digits[:1]
    for digit in differ:
        current = written(_moved(current, digit, at, block_bits, names), "radix-pass")
    return current.select(*rows.columns, (F.col(at) + 1).alias(out))
