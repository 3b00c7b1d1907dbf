"""Review of filed drawers: audit, moves, deferred deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.functions import text as tx
from loci.functions.vectors import embed, top_k
from loci.operators import routing, taxonomy
from loci.operators.store import as_deletes, as_upserts

_PATH_DEFAULTS = {"wing": "Recovered Memory", "hall": "Sleep Refile", "room": "Unsorted", "closet": "Recovered"}


def routing_context(df: DataFrame, text: str = "document") -> Column:
    """The text and its path names, one per line, empty ones left out."""
    names = [c for c in ("wing_name", "hall_name", "room_name", "closet_name") if c in df.columns]
    return F.concat_ws("\n", *[F.nullif(F.col(c), F.lit("")) for c in (text, *names)])


def decide(current: Column, current_score: Column, candidates: Column, min_score=fixed.MIN_SCORE, min_gap=fixed.MIN_GAP) -> Column:
    """struct<action, reason, current_score, best_score, suggested_palace> of a ranked row."""
    best = F.get(candidates, F.lit(0))
    now = F.coalesce(current_score, F.lit(0.0))
    top = F.coalesce(best["score"], F.lit(0.0))
    none = F.size(candidates) == 0
    stays = best["name"] == current
    reason = (
        F.when(none, "no_candidates").when(stays, "current_palace_best_match")
        .when(top < min_score, "best_score_below_threshold").when(top - now < min_gap, "score_gap_too_small")
        .otherwise("better_palace_match_found")
    )
    return F.struct(
        F.when(reason == "better_palace_match_found", "move").otherwise("keep").alias("action"),
        reason.alias("reason"),
        F.when(~none, now).alias("current_score"), F.when(~none, top).alias("best_score"),
        F.when(~none, best["name"]).alias("suggested_palace"),
    )


def path_names(df: DataFrame) -> dict[str, Column]:
    """Display names of a row's path with their fall-backs."""
    out = {}
    for level, default in _PATH_DEFAULTS.items():
        options = [F.nullif(F.col(c), F.lit("")) for c in (f"{level}_name", level) if c in df.columns]
        out[f"{level}_name"] = F.coalesce(*options, F.lit(default))
    return out


def audit(
    drawers: DataFrame, palaces: DataFrame, palace: str | None = None, *, text: bool = True, limit: int | None = None,
    min_score=fixed.MIN_SCORE, min_gap=fixed.MIN_GAP,
) -> DataFrame:
    """One finding per drawer: keep, move to a better palace, or delete (if queued).

    Scores every drawer against every palace in its own row; there is no
    shuffle.  ``flagged`` marks moves, deletes and rows that need review.
    """
    rows = drawers if palace is None else drawers.where(F.col("palace") == palace)
    if limit is not None:
        rows = rows.orderBy("original_id").limit(limit)
    if text:
        rows = rows.withColumn("_context", routing_context(rows))
    # Stored vectors are of the bare text; the context is embedded afresh
    # unless only vectors are there.
    rows = rows.withColumn("_vector", embed(F.col("_context")) if text else F.col("vector"))
    ranked = routing.rank_palaces(rows, palaces, text="_context" if text else None, vector="_vector", current="palace")
    have = set(drawers.columns)
    queued = (F.col("sleep_action") == "delete") if "sleep_action" in have else F.lit(False)
    queued = F.coalesce(queued, F.lit(False))
    d = decide(F.col("palace"), F.col("current_score"), F.col("candidates"), min_score, min_gap)
    reason = tx.or_default(F.col("sleep_reason"), "sleep_delete_queued") if "sleep_reason" in have else F.lit("sleep_delete_queued")
    review = F.coalesce(F.col("needs_review"), F.lit(False)) if "needs_review" in have else F.lit(False)
    review = review & ~queued
    action = F.when(queued, "delete").otherwise(d["action"])
    return ranked.select(
        F.col("original_id").alias("drawer_id"), F.col("palace").alias("current_palace"),
        *[c.alias(n) for n, c in path_names(ranked).items()],
        (F.col("routing_confidence") if "routing_confidence" in have else F.lit(None).cast("double")).alias("current_routing_confidence"),
        review.alias("needs_review"), action.alias("action"),
        F.when(queued, reason).otherwise(d["reason"]).alias("reason"),
        *[F.when(~queued, d[c]).alias(c) for c in ("suggested_palace", "current_score", "best_score")],
        (F.when(~queued, F.col("candidates"))).alias("candidates"),
        *([tx.preview(F.col("document"), 220).alias("preview")] if "document" in have else []),
        ((action != "keep") | review).alias("flagged"),
    )


def choose_path(own: dict[str, Column], matched: dict[str, Column], similarity: Column) -> dict[str, Column]:
    """The matched drawer's path from similarity 0.82 on, else the own path."""
    near = F.coalesce(similarity >= fixed.PATH_MATCH, F.lit(False))
    return {k: F.when(near, matched[k]).otherwise(own[k]) for k in own}


def nearest_paths(moves: DataFrame, drawers: DataFrame) -> DataFrame:
    """The most similar drawer in the target palace, with its path names."""
    probes = moves.select(F.col("drawer_id").alias("query_id"), F.col("to_palace").alias("palace"), "vector")
    hit = top_k(probes, drawers, 1, item_id="original_id", group="palace")
    paths = drawers.select("palace", "original_id", *[c.alias(f"matched_{n}") for n, c in path_names(drawers).items()])
    return hit.join(probes.select("query_id", "palace"), "query_id").join(paths, ["palace", "original_id"]).select(
        F.col("query_id").alias("drawer_id"), F.col("score").alias("matched_similarity"), *[f"matched_{n}_name" for n in _PATH_DEFAULTS]
    )


def queue_deletes(drawers: DataFrame, requests: DataFrame, version: int, now: str) -> tuple[DataFrame, DataFrame]:
    """Mark drawers for deletion: (log rows, answers).

    ``requests`` has (palace, drawer_id, reason).
    """
    asked = requests.select("palace", F.col("drawer_id").alias("original_id"), F.col("reason").alias("_reason")).dropDuplicates(["palace", "original_id"])
    found = drawers.join(asked, ["palace", "original_id"])
    marked = found.withColumns({
        "sleep_action": F.lit("delete"), "sleep_reason": F.coalesce("_reason", F.lit("manual_delete")), "delete_requested_at": F.lit(now),
    }).drop("_reason")
    known = drawers.select("palace", "original_id").withColumn("_ok", F.lit(True))
    answers = asked.join(known, ["palace", "original_id"], "left").select(
        "palace", F.col("original_id").alias("drawer_id"), F.col("_ok").isNotNull().alias("success"),
        F.when(F.col("_ok").isNotNull(), "queued_for_sleep_deletion").alias("status"),
        F.when(F.col("_ok").isNull(), F.concat(F.lit("Drawer not found: "), F.col("original_id"))).alias("error"),
    )
    return as_upserts(marked.drop("op", "version", "seq"), version), answers


def pending_deletes(drawers: DataFrame, palace: str | None = None, max_deletes: int | None = None) -> DataFrame:
    rows = drawers.where(F.col("sleep_action") == "delete")
    rows = rows if palace is None else rows.where(F.col("palace") == palace)
    return rows if max_deletes is None else rows.orderBy("original_id").limit(max_deletes)


def move(
    drawers: DataFrame, moves: DataFrame, version: int, now: str, reason: str | None = None,
) -> DataFrame:
    """Log rows that move drawers: a delete and an upsert per drawer, in one append.

    ``moves`` has (drawer_id, from_palace, to_palace[, reason]).
    """
    why = F.col("reason") if "reason" in moves.columns else F.lit(reason or "sleep_consolidation")
    plan = moves.select(
        F.col("drawer_id").alias("original_id"), F.col("from_palace").alias("palace"), "to_palace", why.alias("_why")
    )
    rows = drawers.join(plan, ["palace", "original_id"])
    # One id may be on the move from two palaces.
    rows = rows.withColumn("_probe", F.concat_ws("\x01", "palace", F.col("original_id").cast("string")))
    near = nearest_paths(rows.select(F.col("_probe").alias("drawer_id"), "to_palace", "vector"), drawers)
    rows = rows.join(near.withColumnRenamed("drawer_id", "_probe"), "_probe", "left").drop("_probe")
    turn = F.row_number().over(Window.partitionBy("to_palace", "original_id").orderBy("palace"))
    rows = rows.withColumn("_turn", turn)
    matched = {f"{n}_name": F.col(f"matched_{n}_name") for n in _PATH_DEFAULTS}
    target = choose_path(path_names(rows), matched, F.col("matched_similarity"))
    gone = as_deletes(rows, version, F.lit(0))
    placed = rows.withColumns({
        **target, "consolidated_from_palace": F.col("palace"), "routing_reason": F.col("_why"),
        "routing_confidence": F.coalesce("matched_similarity", "routing_confidence"),
        "routing_best_palace": F.col("to_palace"), "needs_review": F.lit(False), "reviewed_at": F.lit(now),
    }).withColumn("palace", F.col("to_palace"))
    named = placed.withColumns({
        lv: taxonomy.node_id(F.lit(taxonomy._PREFIX[lv]), F.col("palace"), F.col(f"{lv}_name")) for lv in taxonomy.LEVELS
    })
    return gone.unionByName(as_upserts(named.drop("op", "version", "seq"), version, F.col("_turn")))


def consolidate(
    drawers: DataFrame, palaces: DataFrame, palace: str, *, version: int, now: str, dry_run: bool = True,
    max_moves: int | None = None, max_deletes: int | None = None, limit: int | None = None,
    min_score=fixed.MIN_SCORE, min_gap=fixed.MIN_GAP,
) -> tuple[DataFrame, DataFrame]:
    """Audit a palace and return (findings acted on, log rows to append).

    A dry run returns the same findings and no log rows.
    """
    findings = audit(drawers, palaces, palace, limit=limit, min_score=min_score, min_gap=min_gap)
    moves = findings.where(F.col("action") == "move").orderBy("drawer_id")
    moves = moves if max_moves is None else moves.limit(max_moves)
    deletes = findings.where(F.col("action") == "delete").orderBy("drawer_id")
    deletes = deletes if max_deletes is None else deletes.limit(max_deletes)
    picked = moves.unionByName(deletes)
    if dry_run:
        return picked, drawers.sparkSession.createDataFrame([], as_deletes(drawers).schema)
    gone = drawers.join(
        deletes.select(F.col("current_palace").alias("palace"), F.col("drawer_id").alias("original_id")), ["palace", "original_id"], "left_semi"
    )
    plan = moves.select("drawer_id", F.col("current_palace").alias("from_palace"), F.col("suggested_palace").alias("to_palace"), "reason")
    return picked, as_deletes(gone, version).unionByName(move(drawers, plan, version, now))


def summary(findings: DataFrame) -> DataFrame:
    """Counts per palace: scanned, moves, deletes, review."""
    return findings.groupBy("current_palace").agg(
        F.count("*").alias("scanned"),
        F.count_if(F.col("action") == "move").alias("moves"),
        F.count_if(F.col("action") == "delete").alias("deletes"),
        F.count_if("needs_review").alias("needs_review"),
    )

