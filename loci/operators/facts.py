"""The temporal fact graph: entities, triples with validity, and their upkeep.

Dates are ``YYYY-MM-DD`` strings compared as strings, as stored by the users
of the original tools; a null end means the fact is still open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loci.functions import fixed
from loci.functions import text as tx
from loci.operators.filters import active_at, valid_at
from loci.operators.skew import HEAVY_SHARE, neighbours, running_count, segment_bounds
from loci.schemas import ENTITIES, TRIPLES, conform
from loci.session import cut_lineage, kept

# Names of up to this many ids are sent to the facts.
FEW_IDS = 50_000
# Rows of one fact that one task folds in any case; beyond that a fact with a thousandth of all rows is spread out.
HOT_ROWS = 200_000
KEY = ["namespace", "subject_id", "predicate", "object_id"]


def with_ids(rows: DataFrame) -> DataFrame:
    """Add subject_id/object_id, normalise the predicate, default the namespace."""
    if "namespace" not in rows.columns:
        rows = rows.withColumn("namespace", F.lit("default"))
    return rows.withColumns({
        "subject_id": tx.entity_id(F.col("subject")),
        "object_id": tx.entity_id(F.col("object")),
        "predicate": tx.predicate_id(F.col("predicate")),
    })


def triple_id(now: Column) -> Column:
    """Readable id with a hash of the key, the start date and the time of saving."""
    source = F.concat_ws(":", *KEY, F.coalesce("valid_from", F.lit("")), now)
    return F.concat(F.lit("t_"), F.concat_ws("_", "subject_id", "predicate", "object_id", tx.short_md5(source, 12)))


# --- writing ----------------------------------------------------------------------------


def add_entities(entities: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert or overwrite entities by (namespace, id); the last row of a batch wins."""
    new = rows.select(
        F.col("namespace"), tx.entity_id(F.col("name")).alias("id"), "name",
        F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("properties", F.lit("{}")).alias("properties"), "seq",
    )
    last = new.groupBy("namespace", "id").agg(F.max_by(F.struct("name", "type", "properties"), "seq").alias("e"))
    last = last.select("namespace", "id", "e.*")
    rest = entities.join(last.select("namespace", "id"), ["namespace", "id"], "left_anti")
    return rest.unionByName(conform(last, ENTITIES))


def entities_of(rows: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Entities that facts mention and that are not known yet (first spelling wins)."""
    sides = F.array(*[F.struct(F.col(f"{c}_id").alias("id"), F.col(c).alias("name"), F.lit(n).alias("side")) for n, c in enumerate(("subject", "object"))])
    named = rows.select("namespace", "seq", F.inline(sides))
    # Numbers only are kept per spelling, which needs no sort; a row without seq comes first.
    spelled = named.groupBy("namespace", "id", "name").agg(*[
        c.alias(f"{n}{side}") for side in (0, 1) for n, c in (
            ("seq", F.min(F.when(F.col("side") == side, F.col("seq")))), ("none", F.max((F.col("side") == side) & F.col("seq").isNull())))
    ])
    place = [F.when(F.col(f"none{n}") | F.col(f"seq{n}").isNotNull(), F.struct(
        F.when(~F.col(f"none{n}"), F.col(f"seq{n}")).alias("seq"), F.lit(n).alias("side"))) for n in (0, 1)]
    first = spelled.groupBy("namespace", "id").agg(F.min_by("name", F.least(*place)).alias("name"))
    if entities is not None:
        first = first.join(entities.select("namespace", "id"), ["namespace", "id"], "left_anti")
    return first.select("namespace", "id", "name", F.lit("unknown").alias("type"), F.lit("{}").alias("properties"))


def add_triples(triples: DataFrame, rows: DataFrame, now: str) -> DataFrame:
    """The triples that a batch really adds.

    ``rows`` has (subject, predicate, object, seq) and optionally valid_from,
    valid_to, confidence, source_closet, source_file.  A row whose key is
    open already, in the table or earlier in the batch, adds nothing.
    """
    rows = with_ids(rows)
    for name, default in (("valid_from", None), ("valid_to", None), ("confidence", 1.0), ("source_closet", None), ("source_file", None)):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(default).cast(TRIPLES[name].dataType))
    # The first open row of a key blocks everything after it in the batch.
    open_first = rows.groupBy(*KEY).agg(
        F.min(F.when(F.col("valid_to").isNull(), F.col("seq"))).alias("_open"),
    )
    closed = rows.where(F.col("valid_to").isNotNull())
    opening = rows.where(F.col("valid_to").isNull()).groupBy(*KEY).agg(
        F.min_by(F.struct(*rows.columns), "seq").alias("_row")
    ).select("_row.*")
    kept = closed.join(open_first, KEY).where(F.col("_open").isNull() | (F.col("seq") < F.col("_open"))).drop("_open")
    fresh = kept.unionByName(opening)
    already = triples.where(F.col("valid_to").isNull()).select(*KEY).distinct()
    fresh = fresh.join(already, KEY, "left_anti")
    named = fresh.withColumn("id", triple_id(F.concat(F.lit(now), F.lit("#"), F.col("seq").cast("string"))))
    return conform(named, TRIPLES)


def invalidate(triples: DataFrame, ends: DataFrame, today: str) -> DataFrame:
    """Close open triples named by (subject, predicate, object[, ended])."""
    ends = with_ids(ends)
    ended = F.col("ended") if "ended" in ends.columns else F.lit(None).cast("string")
    # Several ends for one key in a batch: the first closes it.
    order = F.col("seq") if "seq" in ends.columns else F.coalesce(ended, F.lit(today))
    first = ends.groupBy(*KEY).agg(F.min_by(F.coalesce(ended, F.lit(today)), order).alias("_end"))
    joined = triples.join(first, KEY, "left")
    return conform(
        joined.withColumn("valid_to", F.coalesce("valid_to", "_end")), TRIPLES
    )


def clear(table: DataFrame, namespace: str) -> DataFrame:
    return table.where(F.col("namespace") != namespace)


# --- reading ------------------------------------------------------------------------------


def _met(rows: DataFrame, triples: DataFrame, side: str, used: dict[str, int]) -> DataFrame:
    """Look-up rows for one side of the facts, keyed like it; sent along where few of them are met.

    Few ids may hold very many facts, which a shuffle by id would put in few tasks.  ``used`` is
    about how many ids the facts have on each side; it is filled when first asked for.
    """
    if rows.limit(FEW_IDS + 1).count() <= FEW_IDS:
        return F.broadcast(rows)
    if not used:
        counted = [F.approx_count_distinct(F.struct("namespace", c)).alias(c) for c in ("subject_id", "object_id")]
        used.update(triples.agg(*counted).first().asDict())
    if used[side] > FEW_IDS:
        return rows
    met = cut_lineage(rows.join(triples.select("namespace", side).distinct(), ["namespace", side], "left_semi"))
    return F.broadcast(met) if met.limit(2 * FEW_IDS + 1).count() <= 2 * FEW_IDS else met


def _names(entities: DataFrame, side: str, name: str) -> DataFrame:
    return entities.select("namespace", F.col("id").alias(side), F.col("name").alias(name))


def _odd_names(triples: DataFrame, entities: DataFrame, side: str) -> DataFrame | None:
    """(namespace, side, _known, _name) of the ids of a side of the facts whose entity is not one named like its id, if they are few."""
    used = triples.select("namespace", side).distinct()
    named = entities.groupBy("namespace", F.col("id").alias(side)).agg(F.count("*").alias("_n"), F.max("name").alias("_only"))
    odd = used.join(named, ["namespace", side], "left").where(
        F.col(side).isNotNull() & (F.col("_n").isNull() | (F.col("_n") > 1) | ~F.col("_only").eqNullSafe(F.col(side)))
    ).select("namespace", side)
    odd = kept(odd.limit(FEW_IDS + 1))
    if odd.count() > FEW_IDS:
        return None
    own = entities.select("namespace", F.col("id").alias(side), F.lit(True).alias("_known"), F.col("name").alias("_name"))
    found = kept(own.join(F.broadcast(odd), ["namespace", side], "left_semi"))
    missing = odd.join(F.broadcast(found.select("namespace", side).distinct()), ["namespace", side], "left_anti")
    return found.unionByName(missing.select("*", F.lit(False).alias("_known"), F.lit(None).cast("string").alias("_name")))


def _named(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with the names of both sides; a fact whose entity is not known falls out.

    Where entities are many, but few of those met are named other than their id, only these are sent to the facts,
    which then stay where they are.
    """
    few = entities.limit(FEW_IDS + 1).count() <= FEW_IDS
    for side, name in (("subject_id", "subject"), ("object_id", "object")):
        odd = None if few else _odd_names(triples, entities, side)
        if odd is None:
            triples = triples.join(_met(_names(entities, side, name), triples, side, {}), ["namespace", side])
            continue
        met = triples.where(F.col("namespace").isNotNull() & F.col(side).isNotNull()).join(F.broadcast(odd), ["namespace", side], "left")
        triples = met.where(F.coalesce("_known", F.lit(True))).withColumn(
            name, F.when(F.col("_known"), F.col("_name")).otherwise(F.col(side))).drop("_known", "_name")
    return triples


def _state(as_of: Column) -> list[Column]:
    return [
        F.col("valid_to").isNull().alias("active_now"),
        active_at(F.col("valid_from"), F.col("valid_to"), as_of).alias("active_as_of"),
    ]


def query_entities(
    triples: DataFrame, entities: DataFrame, wanted: DataFrame, direction: str = "outgoing",
) -> DataFrame:
    """Facts of many entities at once.

    ``wanted`` has (entity[, as_of, namespace]); ``direction`` is outgoing,
    incoming or both.  A self-loop appears once per direction.
    """
    if "as_of" not in wanted.columns:
        wanted = wanted.withColumn("as_of", F.lit(None).cast("string"))
    if "namespace" not in wanted.columns:
        wanted = wanted.withColumn("namespace", F.lit("default"))
    wanted = wanted.withColumn("_id", tx.entity_id(F.col("entity"))).distinct()
    parts: list[DataFrame] = []
    used: dict[str, int] = {}
    for side, name, far in (("subject_id", "outgoing", "object"), ("object_id", "incoming", "subject")):
        if direction not in (name, "both"):
            continue
        # What is asked for meets its entity before it meets the facts.
        keyed = wanted.withColumnRenamed("_id", side).join(entities.select("namespace", F.col("id").alias(side)), ["namespace", side])
        found = triples.join(_met(keyed, triples, side, used), ["namespace", side]).where(
            valid_at(F.col("valid_from"), F.col("valid_to"), F.col("as_of"))
        )
        other = f"{far}_id"
        found = found.join(_met(_names(entities, other, far), triples, other, used), ["namespace", other])
        full = found.select(
            "entity", "as_of", F.lit(name).alias("direction"),
            F.col("entity" if name == "outgoing" else "subject").alias("subject"),
            "predicate",
            F.col("entity" if name == "incoming" else "object").alias("object"),
            "valid_from", "valid_to", "confidence", "source_closet", *_state(F.col("as_of")),
        )
        parts.append(full)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_time(facts: DataFrame) -> DataFrame:
    """The listing order of facts: start date (open starts last), predicate, names."""
    return facts.orderBy(F.asc_nulls_last("valid_from"), "predicate", "subject", "object")


def query_relationship(triples: DataFrame, entities: DataFrame, predicate: str, as_of: str | None = None) -> DataFrame:
    day = F.lit(as_of).cast("string")
    found = triples.where(
        (F.col("predicate") == tx.predicate_id(F.lit(predicate))) & valid_at(F.col("valid_from"), F.col("valid_to"), day)
    )
    return _named(found, entities).select(
        "valid_from", "valid_to", "subject", "predicate", "object", *_state(day)
    )


def timeline(
    triples: DataFrame, entities: DataFrame, entity: str | None = None, limit: int | None = None, ident: Column | None = None,
) -> DataFrame:
    """Facts in time order, all or the first ``limit``.

    ``ident`` stands for the column id, where that follows from a fact's other columns: it is then only worked out
    to compare facts that are alike in time and names, and not shuffled.
    """
    found = triples
    if entity is not None:
        eid = tx.entity_id(F.lit(entity))
        found = triples.where((F.col("subject_id") == eid) | (F.col("object_id") == eid))
    last = F.col("id") if ident is None else ident
    key = [F.asc_nulls_last("valid_from"), F.asc("predicate"), F.asc("subject_id"), F.asc("object_id"), last.asc()]
    if limit is not None:
        # The first rows are picked before names are fetched.
        found = found.orderBy(*key).limit(limit)
    named = _named(found, entities)
    # A name that is its id is not shuffled a second time.
    both = {name: F.when(~F.col(name).eqNullSafe(F.col(f"{name}_id")), F.struct(name)) for name in ("subject", "object")}
    listed = named.withColumns(both).select(*KEY, "valid_from", "valid_to", *both, *(["id"] if ident is None else [])).orderBy(*key)
    own = {name: F.when(F.col(name).isNull(), F.col(f"{name}_id")).otherwise(F.col(name)[name]) for name in both}
    return listed.select(
        "valid_from", "valid_to", own["subject"].alias("subject"), "predicate", own["object"].alias("object"), F.col("valid_to").isNull().alias("active_now")
    )


def stats(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Counts as one row; see ``relationship_types`` for the predicates."""
    counted = triples.agg(
        F.count("*").alias("triples"),
        F.count_if(F.col("valid_to").isNull()).alias("current_facts"),
        F.count_if(F.col("valid_to").isNotNull()).alias("expired_facts"),
        F.countDistinct("predicate").alias("relationship_types"),
    )
    return counted.withColumn("entities", entities.agg(F.count("*")).scalar()).select(
        "entities", "triples", "current_facts", "expired_facts", "relationship_types"
    )


def relationship_types(triples: DataFrame) -> DataFrame:
    return triples.select("predicate").distinct().orderBy("predicate")


# --- reconciling extracted facts -----------------------------------------------------------

_FOLD_SCHEMA = (
    "namespace string, subject_id string, predicate string, object_id string, run bigint, ended_run boolean, "
    "first_seq bigint, day string, action string, reason string, active_valid_from string, previous_valid_to string"
)


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Outcome of each distinct step, for steps sorted by fact and order.

    Only the state of the fact at hand is kept, across batch borders too, so
    the number of steps of one fact does not matter.
    """
    at, active, start, last_end = None, False, None, None
    for pdf in batches:
        out = []
        keys = zip(*[pdf[c] for c in KEY])
        stored = zip(pdf["open_now"], pdf["open_from"], pdf["last_end"])
        for key, state, is_end, day in zip(keys, stored, pdf["ended_run"], pdf["day"]):
            if key != at:
                at, (active, start, last_end) = key, state
            since, previous = None, None
            if is_end:
                if not active:
                    verdict = ("skip", "no_active_fact_to_invalidate")
                elif start is not None and day < start:
                    verdict, since = ("skip", "temporal_conflict_end_before_start"), start
                else:
                    verdict = ("invalidate", None)
                    active, start = False, None
                    last_end = day if last_end is None else max(last_end, day)
            elif last_end is not None and day is not None and day < last_end:
                verdict, previous = ("skip", "temporal_conflict_start_before_previous_end"), last_end
            else:
                verdict = ("add", None)
                if not active:
                    active, start = True, day
            out.append((*verdict, since, previous))
        names = ["action", "reason", "active_valid_from", "previous_valid_to"]
        yield pd.concat([pdf[[*KEY, "run", "ended_run", "first_seq", "day"]], pd.DataFrame(out, columns=names, dtype=object)], axis=1)


_ROW = ["seq", "namespace", "subject", "predicate", "object", "valid_from", "ended", "confidence"]
_VERDICTS = (
    ("add", None), ("invalidate", None), ("skip", "no_active_fact_to_invalidate"),
    ("skip", "temporal_conflict_end_before_start"), ("skip", "temporal_conflict_start_before_previous_end"),
)


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their outcome, for rows sorted by a hash of the fact and order, a fact's stored state (step 0 or 1) first.

    Only the state of the fact at hand is kept, and of others of the very same hash.
    """
    actions, reasons = (pa.array([v[n] for v in _VERDICTS], pa.string()) for n in (0, 1))
    at, states = None, {}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        turns = np.zeros(n, bool)
        for name in ("_hash", *KEY):
            column = batch.column(name)
            turns[1:] |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        turns[0] = True
        starts = np.flatnonzero(turns).tolist()
        steps, seqs, froms, ends = (batch.column(c).to_pylist() for c in ("_step", "seq", "valid_from", "ended"))
        codes, since, previous = [0] * n, [None] * n, [None] * n
        for lo, hi in zip(starts, [*starts[1:], n]):
            place, *key = (batch.column(c)[lo].as_py() for c in ("_hash", *KEY))
            if place != at:
                at, states = place, {}
            active, start, last_end, closing = states.get(tuple(key), (False, None, None, None))
            for i in range(lo, hi):
                end, day = ends[i], froms[i]
                if steps[i] < 2:
                    active, start, last_end = steps[i] == 1, day, end
                elif end is not None:
                    if not active:
                        # A row alike the closing one, in its place, says the same.
                        codes[i] = 1 if closing == (seqs[i], end) else 2
                    elif start is not None and end < start:
                        codes[i], since[i] = 3, start
                    else:
                        codes[i], closing = 1, (seqs[i], end)
                        active, start = False, None
                        last_end = end if last_end is None else max(last_end, end)
                elif last_end is not None and day is not None and day < last_end:
                    codes[i], previous[i], closing = 4, last_end, None
                else:
                    closing = None
                    if not active:
                        active, start = True, day
            states[tuple(key)] = active, start, last_end, closing
        told = pa.array(codes)
        out = pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in _ROW], actions.take(told), reasons.take(told), pa.array(since, pa.string()), pa.array(previous, pa.string())],
            [*_ROW, "action", "reason", "active_valid_from", "previous_valid_to"],
        )
        yield out.filter(pc.equal(batch.column("_step"), 2))


def _streamed(state: DataFrame, facts: DataFrame) -> DataFrame:
    """Outcomes of facts none of which is hot: each fact's rows stream through one task, sorted once."""
    place = F.xxhash64(*KEY).alias("_hash")
    rows = facts.select(*_ROW, "subject_id", "object_id", place, F.lit(2).alias("_step"))
    none = {f.name: F.lit(None).cast(f.dataType) for f in facts.schema}
    known = {
        **none, **{c: F.col(c) for c in KEY}, "valid_from": F.col("open_from"), "ended": F.col("last_end"),
    }
    stored = state.select(*[known[c].alias(c) for c in (*_ROW, "subject_id", "object_id")], place, F.col("open_now").cast("int").alias("_step"))
    schema = T.StructType([facts.schema[c] for c in _ROW] + [
        T.StructField(c, T.StringType()) for c in ("action", "reason", "active_valid_from", "previous_valid_to")])
    return rows.unionByName(stored).repartition("_hash").sortWithinPartitions("_hash", "_step", "seq").mapInArrow(_verdicts, schema)


def _spread(state: DataFrame, facts: DataFrame) -> DataFrame:
    """Outcomes of hot facts, whose rows are sorted by many tasks.

    A run of alike steps (adds, or ends) with the same date has at most one
    first step that matters, so only first steps reach the ordered fold; the
    others take their outcome from it.
    """
    facts = facts.withColumn("_ends", F.col("ended").isNotNull()).withColumn("_day", F.coalesce("ended", "valid_from"))
    bounds = segment_bounds(facts, "seq")
    before = neighbours(facts, KEY, "seq", preceding={"_prev": F.col("_ends")}, bounds=bounds)
    flips = F.col("_prev").isNull() | (F.col("_prev") != F.col("_ends"))
    # Read twice below, and every step up to here would be doubled each time.
    runs = cut_lineage(running_count(before, KEY, "seq", flips, "run", bounds).drop("_prev"))
    steps = runs.groupBy(*KEY, "run", F.col("_ends").alias("ended_run"), F.col("_day").alias("day")).agg(
        F.min("seq").alias("first_seq")
    )
    # A later step of a run with the same date sees what its first one left.
    ready = steps.join(state, KEY, "left").withColumn("open_now", F.coalesce("open_now", F.lit(False)))
    in_order = ready.repartition(*KEY).sortWithinPartitions(*KEY, "first_seq").select(
        *KEY, "run", "ended_run", "first_seq", "day", "open_now", "open_from", "last_end"
    )
    done = cut_lineage(in_order.mapInPandas(_fold, _FOLD_SCHEMA))
    closing = done.where(F.col("action") == "invalidate").select(*KEY, "run", F.col("first_seq").alias("_closed"))
    verdicts = done.join(closing, [*KEY, "run"], "left")
    keyed = runs.withColumn("day", F.coalesce("_day", F.lit(""))).join(
        verdicts.drop("ended_run").withColumn("day", F.coalesce("day", F.lit(""))), [*KEY, "run", "day"]
    )
    # Ends after the closing one of their run find nothing open any more.
    late = F.col("_ends") & (F.col("seq") > F.col("_closed"))
    late = F.coalesce(late, F.lit(False))
    return keyed.select(
        *_ROW,
        F.when(late, "skip").otherwise(F.col("action")).alias("action"),
        F.when(late, "no_active_fact_to_invalidate").otherwise(F.col("reason")).alias("reason"),
        F.when(~late, F.col("active_valid_from")).alias("active_valid_from"), "previous_valid_to",
    )


def reconcile(triples: DataFrame, facts: DataFrame) -> DataFrame:
    """What to do with each extracted fact: add, invalidate, or skip and why.

    ``facts`` has (subject, predicate, object, valid_from, ended, confidence,
    seq), seq being a unique integer.  The outcome of a fact depends on those
    before it with the same key.
    """
    # Counted and folded below, each of which reads it again; a fact without a key has no outcome.
    facts = kept(with_ids(facts).select(*_ROW, "subject_id", "object_id").dropna(subset=KEY))
    state = triples.groupBy(*KEY).agg(
        F.coalesce(F.max(F.col("valid_to").isNull()), F.lit(False)).alias("open_now"),
        F.min(F.when(F.col("valid_to").isNull(), F.col("valid_from"))).alias("open_from"),
        F.max("valid_to").alias("last_end"),
    )
    hot, total = [], facts.count()
    if total >= HOT_ROWS:
        counted = facts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(HOT_ROWS, total / HEAVY_SHARE))
        hot = counted.select(*KEY).collect()
    aside = F.broadcast(facts.sparkSession.createDataFrame(hot, ", ".join(f"{c} string" for c in KEY))) if hot else None
    # Rows without a place have no order to stream in either.
    lost = facts.where(F.col("seq").isNull()).select(*KEY)
    if lost.limit(1).count():
        aside = lost.distinct() if aside is None else lost.union(aside).distinct()
    if aside is not None:
        decided = _streamed(state, facts.join(aside, KEY, "left_anti")).unionByName(_spread(state, facts.join(aside, KEY, "left_semi")))
    else:
        decided = _streamed(state, facts)
    return decided.select(
        "seq", "namespace", "subject", "predicate", "object", "action", "reason", "valid_from", "ended", "active_valid_from",
        "previous_valid_to", tx.round_half_up(F.col("confidence"), 3).alias("confidence"),
    )


def apply_reconciled(triples: DataFrame, decided: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Triples after carrying out ``reconcile``'s actions, and the new ones alone.

    Per key, adds and ends alternate once repeats are dropped, so each add is
    closed by the next end of its key.
    """
    steps = with_ids(decided.where(F.col("action").isin("add", "invalidate"))).withColumn("_end", F.col("action") == "invalidate")
    bounds = segment_bounds(steps, "seq")
    previous = neighbours(steps, KEY, "seq", preceding={"_prev": F.col("_end")}, bounds=bounds)
    was_open = triples.where(F.col("valid_to").isNull()).select(*KEY).distinct().withColumn("_open", F.lit(True))
    marked = previous.join(was_open, KEY, "left")
    opening = (~F.col("_end")) & F.coalesce(F.col("_prev"), F.coalesce("_open", F.lit(False)) == F.lit(False))
    turning = marked.where(opening | F.col("_end"))
    closed = neighbours(turning, KEY, "seq", {"_closed": F.when(F.col("_end"), F.col("ended"))}, bounds=bounds)
    adds = closed.where(~F.col("_end")).withColumn("valid_to", F.col("_closed"))
    adds = adds.withColumn("id", triple_id(F.concat(F.lit(now), F.lit("#"), F.col("seq").cast("string")))).withColumn(
        "confidence", F.lit(1.0)
    )
    added = conform(adds, TRIPLES)
    # The first end of a key that was open closes the stored triple.
    first = steps.groupBy(*KEY).agg(F.min_by(F.when(F.col("_end"), F.col("ended")), F.when(F.col("_end"), F.col("seq"))).alias("_first"))
    kept = triples.join(first, KEY, "left").withColumn("valid_to", F.coalesce("valid_to", "_first"))
    return conform(kept, TRIPLES).unionByName(added), added


def last_closed(triples: DataFrame) -> DataFrame:
    """Latest end per fact, for facts that were closed at least once."""
    return triples.where(F.col("valid_to").isNotNull()).groupBy(*KEY).agg(F.max("valid_to").alias("last_valid_to"))
