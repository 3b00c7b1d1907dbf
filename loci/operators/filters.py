"""Predicates: the where-document compiler, path filters, as-of validity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def compile_where(where: dict | None) -> Column | None:
    """Turn ``{field: value}``, ``{"$and": [..]}``, ``{"$or": [..]}`` into a Column.

    A map with several fields means AND.  Nesting has ordinary boolean
    meaning, and equality on plain columns reaches the Parquet scan.
    """
    if not where:
        return None
    if "$and" in where or "$or" in where:
        key = "$and" if "$and" in where else "$or"
        parts = [c for c in map(compile_where, where[key]) if c is not None]
        if not parts:
            return None
        return reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), parts)
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in where.items()])


def path_where(wing=None, hall=None, room=None, closet=None) -> dict:
    """The where-document for a taxonomy path: empty, one field, or an $and."""
    parts = [
        {k: v} for k, v in (("wing", wing), ("hall", hall), ("room", room), ("closet", closet)) if v
    ]
    if not parts:
        return {}
    return parts[0] if len(parts) == 1 else {"$and": parts}


def apply_where(df, where: dict | None):
    condition = compile_where(where)
    return df if condition is None else df.where(condition)


def path_match(df, wing=None, hall=None, room=None, closet=None):
    """Filter on a path given as ids or as display names."""
    for level, value in (("wing", wing), ("hall", hall), ("room", room), ("closet", closet)):
        if value:
            hit = F.col(level) == value
            if f"{level}_name" in df.columns:
                hit = hit | (F.col(f"{level}_name") == value)
            df = df.where(hit)
    return df


def valid_at(valid_from: Column, valid_to: Column, as_of: Column) -> Column:
    """Validity at a date, both ends inclusive; a null date accepts every row."""
    return (
        as_of.isNull()
        | ((valid_from.isNull() | (valid_from <= as_of)) & (valid_to.isNull() | (valid_to >= as_of)))
    )


def active_at(valid_from: Column, valid_to: Column, as_of: Column) -> Column:
    """Like valid_at, but without a date only open facts count as active."""
    return F.when(as_of.isNull(), valid_to.isNull()).otherwise(valid_at(valid_from, valid_to, as_of))
