"""Staged facts that still lack their vector wait in keyed state until a later file of the same batch brings it.

Each fact comes out once: complete, or as given up when batches staged more than ``patience`` later have come.
From then on the batch is over: its state goes, and the watermark drops what is staged for it still.  Time is that
of staging, so a run that takes in what is there and stops gives the same rows as one that goes on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PATIENCE = "1 day"
_OUT = "batch string, pos int, fact string, whole boolean"
_NAMES = ["batch", "pos", "fact", "whole"]


def staged_facts(batches: DataFrame) -> DataFrame:
    """(batch, pos, fact, whole) of staged batches: facts as JSON, by their batch and place there.  Facts without text or palace are left out."""
    at = F.coalesce(F.try_to_timestamp("staged_at"), F.current_timestamp())
    facts = batches.select(F.coalesce("staged_at", F.lit("")).alias("batch"), at.alias("at"), F.posexplode("facts").alias("pos", "f"))
    named = facts.where((F.coalesce("f.content", F.lit("")) != "") & (F.coalesce("f.palace", F.lit("")) != ""))
    return named.select("batch", "at", "pos", F.to_json("f").alias("fact"), F.col("f.vector").isNotNull().alias("whole"), F.unix_millis("at").alias("ms"))


def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One batch's new rows over its state: places that came out, and facts that wait."""
    out, held = (set(json.loads(state.get[0])), json.loads(state.get[1])) if state.exists else (set(), {})
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(key[0], int(pos), fact, False) for pos, fact in held.items()], columns=_NAMES)
        return
    rows = [r for f in frames for r in zip(f["pos"].tolist(), f["fact"].tolist(), f["whole"].tolist(), f["ms"].tolist())]
    news = []
    # Complete facts first, so that a place staged both ways in one go comes out complete.
    for pos, fact, whole, _ in sorted(rows, key=lambda r: not r[2]):
        if pos in out:
            continue
        if whole:
            out.add(pos)
            held.pop(str(pos), None)
            news.append((key[0], pos, fact, True))
        else:
            held.setdefault(str(pos), fact)
    state.update((json.dumps(sorted(out)), json.dumps(held)))
    state.setTimeoutTimestamp(max([state.getCurrentWatermarkMs(), *(r[3] for r in rows)]) + 1)
    yield pd.DataFrame(news, columns=_NAMES)


def once_whole(batches: DataFrame, patience: str = PATIENCE) -> DataFrame:
    """A stream of staged batches as a stream of facts, each once: (batch, pos, fact, whole)."""
    return staged_facts(batches).withWatermark("at", patience).groupBy("batch").applyInPandasWithState(
        step, _OUT, "out string, held string", "append", GroupStateTimeout.EventTimeTimeout)
