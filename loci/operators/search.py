"""Search over drawers: top-k, routed search, duplicates, diary search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.functions import text as tx
from loci.functions.vectors import embed, top_k
from loci.operators import routing
from loci.operators.filters import apply_where, path_match
from loci.operators.memory import diary_entries
from loci.operators.skew import join_unique
from loci.session import cut_lineage, kept

# Hits up to this many are sent to the texts, which are then not shuffled.
FEW_HITS = 100_000
_PATH = ("wing", "wing_name", "hall", "hall_name", "room", "room_name", "closet", "closet_name")


def with_vector(rows: DataFrame, text: str, vector: str = "vector") -> DataFrame:
    return rows if vector in rows.columns else rows.withColumn(vector, embed(F.col(text)))


def similarity(score):
    return tx.round_half_up(score, 3)


def hit_fields(df: DataFrame) -> list:
    """The eleven fields of a search hit; empty strings become null."""
    have = set(df.columns)
    out = [F.col("document").alias("text")]
    for name in _PATH:
        col = F.col(name) if name in have else F.lit(None).cast("string")
        out.append(F.nullif(col, F.lit("")).alias(name))
    src = F.col("source_file") if "source_file" in have else F.lit(None).cast("string")
    out.append(tx.basename(tx.or_default(src, "?")).alias("source_file"))
    out.append(similarity(F.col("score")).alias("similarity"))
    return out


def drawer_key(df: DataFrame) -> DataFrame:
    """Add _key, naming a drawer across palaces; it sorts by id, then by palace."""
    own = F.col("original_id").cast("string")
    if df.schema["original_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        own = F.lpad(own, 20, "0")
    palace = F.coalesce(F.col("palace").cast("string"), F.lit("")) if "palace" in df.columns else F.lit("")
    return df.withColumn("_key", F.concat(own, F.lit("\x01"), palace))


def search(
    queries: DataFrame, drawers: DataFrame, k: int = fixed.SEARCH_K, *, where: dict | None = None,
    wing=None, hall=None, room=None, closet=None, by_palace: bool = False, skip_same_id: bool = False,
    query_id: str = "query_id", query_text: str = "query", vectors: DataFrame | None = None,
) -> DataFrame:
    """Best k drawers of every query, with the hit fields.

    Path filters and ``where`` run before the scoring and reach the scan.
    ``by_palace`` restricts a query to its own palace.  ``vectors`` are those of
    the drawers left, (palace, original_id, vector), where they are at hand.
    """
    queries = with_vector(queries, query_text)
    found = path_match(apply_where(drawers, where), wing, hall, room, closet)
    # Ids are unique within a palace only.  A query is left out of its own hits by id.
    found = found.withColumn("_key", F.col("original_id")) if skip_same_id else drawer_key(found)
    scored = found if vectors is None else drawer_key(vectors)
    hits = top_k(
        queries, scored, k, query_id=query_id, item_id="_key",
        group="palace" if by_palace else None, skip_same_id=skip_same_id,
    )
    # Only k rows per query are left; they fetch their texts by key.
    if queries.limit(FEW_HITS // k + 1).count() <= FEW_HITS // k:
        hits = F.broadcast(hits)
    payload = [c for c in ("palace", "document", "source_file", *_PATH) if c in found.columns]
    full = hits.join(found.select("_key", "original_id", *payload), "_key")
    if by_palace:
        full = full.join(queries.select(query_id, "palace"), [query_id, "palace"], "left_semi")
    keep = ["palace"] if "palace" in payload else []
    return full.select(query_id, "rank", "original_id", *keep, *hit_fields(full))


def diary_search(queries: DataFrame, drawers: DataFrame, k: int = 5, *, agent=None, topic=None, session_id=None) -> DataFrame:
    entries = drawer_key(diary_entries(drawers, agent, session_id, topic))
    hits = top_k(with_vector(queries, "query"), entries, k, item_id="_key")
    return hits.join(entries.select("_key", "original_id", "date", "filed_at", "topic", "document"), "_key").select(
        "query_id", "rank", "original_id",
        F.coalesce("date", F.lit("")).alias("date"), F.coalesce("filed_at", F.lit("")).alias("timestamp"),
        F.coalesce("topic", F.lit("")).alias("topic"), F.col("document").alias("content"),
        similarity(F.col("score")).alias("similarity"),
    )


# --- duplicates -----------------------------------------------------------------------


def check_duplicates(
    candidates: DataFrame, drawers: DataFrame, threshold: float = fixed.DUPLICATE_THRESHOLD,
    k: int = fixed.DUPLICATE_K, skip_same_id: bool = False,
) -> DataFrame:
    """Up to k near copies of every candidate within its palace.

    ``candidates`` has (query_id, palace, content[, vector]); a copy whose
    trimmed text is equal is flagged ``exact_match``.
    """
    candidates = with_vector(candidates, "content")
    hits = top_k(
        candidates, drawers, k, item_id="original_id", group="palace", skip_same_id=skip_same_id,
        min_score=threshold - 0.0006,
    ).withColumn("similarity", similarity(F.col("score"))).where(F.col("similarity") >= threshold)
    texts = drawers.select("palace", "original_id", "wing", "room", "document")
    own = candidates.select("query_id", "palace", "content")
    return (
        hits.join(own, "query_id").join(texts, ["palace", "original_id"])
        .select(
            "query_id", "rank", "original_id",
            tx.or_default(F.col("wing"), "?").alias("wing"), tx.or_default(F.col("room"), "?").alias("room"),
            "similarity", (tx.strip(F.col("document")) == tx.strip(F.col("content"))).alias("exact_match"),
            tx.preview(F.col("document"), 200).alias("content"),
        )
    )


def exact_copies(rows: DataFrame, *, key: str = "original_id", text: str = "document", scope=()) -> DataFrame:
    """Rows whose trimmed text occurs more than once: (key, first_id, copies).

    Works on a 128-bit digest.  Counting is partially aggregated, and texts
    copied very often are joined back by broadcast (see ``skew``), so a third
    of all rows being one text does not land in one task.
    """
    keyed = rows.select(key, *scope, F.md5(tx.strip(F.col(text))).alias("_text"))
    groups = keyed.groupBy(*scope, "_text").agg(F.min(key).alias("first_id"), F.count("*").alias("copies"))
    repeated = groups.where(F.col("copies") > 1)
    return join_unique(keyed, repeated, [*scope, "_text"], weight="copies").select(key, *scope, "first_id", "copies")


def reject_exact(candidates: DataFrame, drawers: DataFrame) -> DataFrame:
    """Candidates marked ``duplicate`` when their text is stored already, or came
    earlier in the same batch (smaller seq)."""
    batch = candidates.withColumn("_text", F.md5(tx.strip(F.col("content"))))
    first = batch.groupBy("palace", "_text").agg(F.min("seq").alias("_first"), F.count("*").alias("_n"))
    # Both sides have one row per text here, so a text copied very often is
    # still one row when it meets the stored ones.
    stored = drawers.select("palace", F.md5(tx.strip(F.col("document"))).alias("_text")).groupBy("palace", "_text").agg(
        F.lit(True).alias("_stored")
    )
    known = first.join(stored, ["palace", "_text"], "left")
    return (
        join_unique(batch, known, ["palace", "_text"], weight="_n")
        .withColumn("duplicate", F.coalesce("_stored", F.lit(False)) | (F.col("seq") > F.col("_first")))
        .drop("_text", "_first", "_n", "_stored")
    )


# --- routed search -----------------------------------------------------------------------


def search_routed(
    requests: DataFrame, palaces: DataFrame, drawers: DataFrame, memory: DataFrame | None = None,
    k: int = fixed.SEARCH_K, *, wing=None, hall=None, room=None, closet=None,
    default_palace: str = fixed.DEFAULT_PALACE,
) -> tuple[DataFrame, DataFrame]:
    """Route every query to a palace, search it, and try the others if weak.

    ``requests`` has (query_id, query[, vector, palace]).  A given palace is
    used as is.  Otherwise an exact routing-memory entry wins, then the best
    ranked palace.  Weak results (score < 0.05 or coverage < 0.3, with at least
    two candidates) are compared with every other palace.

    Returns (hits, routes): hits like ``search``; one route row per query.
    """
    requests = with_vector(requests, "query")
    if "palace" not in requests.columns:
        requests = requests.withColumn("palace", F.lit(None).cast("string"))
    asked = requests.select("query_id", "query", "vector", F.nullif("palace", F.lit("")).alias("given"))
    asked = asked.withColumn("normalized_query", tx.normalize_text(F.col("query")))
    if memory is not None:
        cached = memory.select(
            "normalized_query", F.col("palace").alias("cached"), F.col("hit_count").alias("cached_hits")
        )
        asked = asked.join(cached, "normalized_query", "left")
    else:
        asked = asked.withColumn("cached", F.lit(None).cast("string")).withColumn("cached_hits", F.lit(None).cast("bigint"))
    ranked = routing.rank_palaces(asked, palaces, text="query")
    top = F.get(F.col("candidates"), F.lit(0))
    by_memory = F.col("given").isNull() & F.col("cached").isNotNull()
    ranked = (
        ranked.withColumn("palace", F.coalesce("given", "cached", top["name"], F.lit(default_palace)))
        .withColumn("memory_hit", by_memory)
        .withColumn(
            "routing_score",
            F.when(F.col("given").isNull(), F.get(
                F.filter("candidates", lambda c: c["name"] == F.coalesce(F.col("cached"), top["name"])), F.lit(0)
            )["score"]),
        )
    )

    filtered = path_match(drawers, wing, hall, room, closet)
    # Searched twice, and often worked out from the texts.
    vectors = kept(filtered.select("palace", "original_id", "vector"))
    first = search(ranked.select("query_id", "query", "vector", "palace"), filtered, k, by_palace=True, vectors=vectors)
    judged = routing.result_quality(first, ranked)
    tried = F.col("given").isNull() & (F.size("candidates") >= 2) & routing.weak(
        F.col("quality_score"), F.col("answer_coverage")
    )
    # Everything below reads the judged queries and their hits several times.
    judged = cut_lineage(judged.withColumn("fallback_checked", tried))
    first = cut_lineage(first)

    # Weak queries meet every other palace, as (query, palace) pairs.
    pairs = (
        judged.where("fallback_checked")
        .select("query_id", "query", "vector", F.col("palace").alias("_now"), F.explode("candidates").alias("c"))
        .where(F.col("c.name") != F.col("_now"))
        .select(
            F.concat_ws("\x01", F.col("query_id").cast("string"), "c.name").alias("pair_id"),
            "query_id", "query", "vector", F.col("c.name").alias("palace"), F.col("c.semantic_score"), F.col("c.score").alias("routing_score"),
        )
    )
    others = search(pairs, filtered, k, by_palace=True, query_id="pair_id", vectors=vectors)
    other_quality = routing.result_quality(others, pairs, key="pair_id")
    cols = ["query_id", "palace", "is_current", "semantic_score", "answer_coverage", "quality_score", "routing_score"]
    options = judged.select(
        "query_id", "palace", F.lit(True).alias("is_current"), F.lit(None).cast("double").alias("semantic_score"),
        "answer_coverage", "quality_score", "routing_score",
    ).unionByName(other_quality.withColumn("is_current", F.lit(False)).select(cols))
    chosen = routing.choose_fallback(options)

    routes = (
        judged.select(
            "query_id", "query", "given", "normalized_query", F.col("palace").alias("_primary"), "memory_hit", "fallback_checked",
            # A strong memory hit never ranked anything.
            F.when(
                F.col("given").isNotNull() | (F.col("memory_hit") & ~routing.weak(F.col("quality_score"), F.col("answer_coverage"))),
                F.array().cast(judged.schema["candidates"].dataType),
            ).otherwise(F.col("candidates")).alias("routing_candidates"),
        )
        .join(chosen.withColumnRenamed("palace", "searched_palace").drop("is_current"), "query_id")
        .withColumn("fallback_used", F.col("searched_palace") != F.col("_primary"))
        .withColumn("fallback_reason", F.when(F.col("fallback_used"), "top_results_semantically_weak"))
        .withColumn(
            "remember",
            F.col("given").isNull() & F.coalesce(F.col("quality_score") >= fixed.REMEMBER_QUALITY, F.lit(False)),
        )
        .withColumn("source", F.when(F.col("fallback_used"), "fallback_success").otherwise("direct_hit"))
        .withColumn("routing_memory_refreshed", F.col("remember") & F.col("memory_hit") & F.col("fallback_used"))
        .drop("_primary", "semantic_score")
    )
    keep = chosen.select("query_id", "palace")
    moved = others.join(pairs.select("pair_id", "query_id"), "pair_id").drop("pair_id")
    every = first.unionByName(moved.select(first.columns))
    return every.join(keep, ["query_id", "palace"], "left_semi"), routes
