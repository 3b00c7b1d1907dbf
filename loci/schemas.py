"""Table layouts."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _I = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# One row per change of a drawer.  The current state is the row with the
# highest (version, seq) per (palace, point_id); op is 'upsert' or 'delete'.
DRAWER_LOG = _struct(
    ("palace", _S), ("point_id", _S), ("original_id", _S), ("document", _S),
    ("vector", T.ArrayType(T.FloatType())),
    ("wing", _S), ("wing_name", _S), ("hall", _S), ("hall_name", _S),
    ("room", _S), ("room_name", _S), ("closet", _S), ("closet_name", _S),
    ("source_file", _S), ("chunk_index", _I), ("added_by", _S), ("filed_at", _S),
    ("topic", _S), ("importance", _D), ("project", _S), ("tags", _S), ("source", _S),
    ("session_date", _S), ("session_id", _S), ("agent", _S), ("type", _S), ("date", _S),
    ("ingest_mode", _S), ("extract_mode", _S),
    ("routing_confidence", _D), ("routing_best_palace", _S), ("needs_review", T.BooleanType()),
    ("routing_reason", _S), ("reviewed_at", _S), ("consolidated_from_palace", _S),
    ("sleep_action", _S), ("sleep_reason", _S), ("delete_requested_at", _S),
    ("extra", T.MapType(_S, _S)),
    ("op", _S), ("version", _L), ("seq", _L),
)

PALACES = _struct(
    ("name", _S), ("description", _S), ("keywords", T.ArrayType(_S)), ("wing_focus", _S),
    ("l0_body", _S), ("is_default", T.BooleanType()), ("usage_count", _L), ("last_used_at", _S),
    ("scope", _S), ("vector", T.ArrayType(T.FloatType())),
)

ENTITIES = _struct(("namespace", _S), ("id", _S), ("name", _S), ("type", _S), ("properties", _S))

TRIPLES = _struct(
    ("id", _S), ("namespace", _S), ("subject_id", _S), ("predicate", _S), ("object_id", _S),
    ("valid_from", _S), ("valid_to", _S), ("confidence", _D), ("source_closet", _S), ("source_file", _S),
)

PEOPLE = _struct(
    ("name", _S), ("ord", _L), ("source", _S), ("contexts", T.ArrayType(_S)), ("aliases", T.ArrayType(_S)),
    ("relationship", _S), ("confidence", _D), ("canonical", _S), ("seen_count", _L),
)

ROUTES = _struct(("query", _S), ("palace", _S), ("source", _S), ("ts", _S), ("seq", _L))

STAGED = _struct(
    ("staged_at", _S),
    ("project", _S),
    ("facts", T.ArrayType(_struct(
        ("content", _S), ("topic", _S), ("importance", _D), ("project", _S),
        ("tags", T.ArrayType(_S)), ("palace", _S), ("wing", _S), ("hall", _S), ("room", _S), ("closet", _S),
        ("vector", T.ArrayType(T.FloatType())),
    ))),
    ("diary_entry", _struct(("content", _S), ("vector", T.ArrayType(T.FloatType())))),
)


def conform(df, schema: T.StructType):
    """Cast to a layout, filling columns the input does not have with null."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select([
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])

CLOSETS_GONE = T.StructType([
    T.StructField("palace", T.StringType()), T.StructField("closet_id", T.StringType()), T.StructField("deleted_at", T.StringType()),
])
