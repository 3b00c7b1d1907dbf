"""Queries on search, duplicates, routing, consolidation and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.functions.vectors import embed, top_k
from loci.operators import consolidate, evaluate, routing, search
from loci.plans import workload as w
from loci.plans.catalog import query
from loci.plans.workload import Tables

_R3 = "floor({0} * 1000 + 0.5) / 1000"
_COS = "round(coalesce(list_cosine_similarity(q.vector, v.vector), 0.0), 9)"


def _scopes(t: Tables) -> DataFrame:
    return w.palaces(t).select(F.col("name").alias("query_id"), F.col("name").alias("palace"), "vector")


def _each(t: Tables) -> DataFrame:
    return w.vectors(t).select(F.col("original_id").alias("query_id"), "palace", "vector")


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "original_id", search.similarity(F.col("score")).alias("similarity"))


def _top_sql(queries: str, condition: str, k: int, tail: str = "") -> str:
    return f"""
WITH {w.VECTORS_SQL},
scored AS (
  SELECT q.query_id, v.original_id, v.palace, {_COS} AS score FROM ({queries}) q, vecs v WHERE {condition}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_id) AS rank FROM scored)
SELECT query_id, rank, original_id, {_R3.format('score')} AS similarity FROM ranked WHERE rank <= {k} {tail}
"""


_SCOPES_SQL = "SELECT name AS query_id, name AS palace, vector FROM palaces"
_EACH_SQL = "SELECT original_id AS query_id, palace, vector FROM vecs"


@query("topk_cosine", _top_sql(_SCOPES_SQL, "true", 5))
def topk_cosine(t):
    """Nearest drawers, of any palace, to every palace's scope vector."""
    return _shown(top_k(_scopes(t), w.vectors(t), 5, item_id="original_id"))


@query("topk_cosine_filtered", _top_sql(_SCOPES_SQL, "q.palace = v.palace", 5))
def topk_cosine_filtered(t):
    """Nearest drawers within the palace itself."""
    return _shown(top_k(_scopes(t), w.vectors(t), 5, item_id="original_id", group="palace"))


@query("batch_topk_per_query", _top_sql(_EACH_SQL, "q.query_id <> v.original_id", 5))
def batch_topk(t):
    """Five nearest neighbours of every vector."""
    return _shown(top_k(_each(t), w.vectors(t), 5, item_id="original_id", skip_same_id=True))


@query("near_topk_min_score", _top_sql(_EACH_SQL, "q.query_id <> v.original_id", 10, "AND score >= 0.25"))
def near_topk(t):
    """Up to ten neighbours of every vector from a similarity on."""
    return _shown(top_k(_each(t), w.vectors(t), 10, item_id="original_id", skip_same_id=True, min_score=0.25))


@query("search_hits", f"""
WITH {w.VECTORS_SQL}, {w.DRAWERS_SQL},
scored AS (SELECT q.name AS query_id, v.original_id, {_COS} AS score FROM palaces q, vecs v),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_id) AS rank FROM scored)
SELECT query_id, rank, original_id, document AS text, wing, wing_name, hall, CAST(NULL AS VARCHAR) AS hall_name, room, room_name,
       closet, CAST(NULL AS VARCHAR) AS closet_name, coalesce(regexp_extract(source_file, '[^/]+$'), '?') AS source_file,
       {_R3.format('score')} AS similarity
FROM ranked LEFT JOIN drawers USING (original_id) WHERE rank <= 5
""")
def search_hits(t):
    """Search hits with all their fields, where a vector has no drawer row without its path."""
    items = w.vectors(t).drop("palace").join(w.drawers(t).drop("palace"), "original_id", "left")
    return search.search(_scopes(t), items, 5)


# --- duplicates ---------------------------------------------------------------------------


@query("check_duplicates", f"""
WITH {w.VECTORS_SQL}, {w.DRAWERS_SQL},
scored AS (
  SELECT q.original_id AS query_id, v.original_id, {_COS} AS score FROM vecs q, vecs v
  WHERE q.palace = v.palace AND q.original_id <> v.original_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_id) AS rank FROM scored)
SELECT query_id, rank, r.original_id, coalesce(d.wing, '?') AS wing, coalesce(d.room, '?') AS room, {_R3.format('score')} AS similarity,
       trim(d.document, ' ' || chr(9) || chr(10) || chr(13)) = trim(c.document, ' ' || chr(9) || chr(10) || chr(13)) AS exact_match,
       CASE WHEN length(d.document) > 200 THEN left(d.document, 200) || '...' ELSE d.document END AS content
FROM ranked r LEFT JOIN drawers d ON d.original_id = r.original_id LEFT JOIN drawers c ON c.original_id = r.query_id
WHERE rank <= 5 AND {_R3.format('score')} >= 0.3
""")
def check_duplicates(t):
    """Near copies of every drawer within its palace, from similarity 0.3 on."""
    texts = w.drawers(t).select("original_id", "wing", "room", "document")
    items = w.vectors(t).join(texts, "original_id", "left")
    asked = items.select(F.col("original_id").alias("query_id"), "palace", F.col("document").alias("content"), "vector")
    return search.check_duplicates(asked, items, 0.3, 5, skip_same_id=True)


@query("exact_duplicates", """
SELECT doc_id AS original_id, first_id, copies FROM (
  SELECT doc_id, min(doc_id) OVER p AS first_id, count(*) OVER p AS copies
  FROM documents WINDOW p AS (PARTITION BY trim(text, ' ' || chr(9) || chr(10) || chr(13))))
WHERE copies > 1
""")
def exact_duplicates(t):
    """Documents whose text occurs more than once, with the first of its copies."""
    return search.exact_copies(w.drawers(t))


@query("reject_exact", """
SELECT doc_id AS seq, row_number() OVER (PARTITION BY lang, trim(text, ' ' || chr(9) || chr(10) || chr(13)) ORDER BY doc_id) > 1
       OR EXISTS (SELECT 1 FROM benchmark b WHERE b.text = trim(d.text, ' ' || chr(9) || chr(10) || chr(13)) AND d.lang = 'en') AS duplicate
FROM documents d
""")
def reject_exact(t):
    """Which documents a save would refuse: copies of stored passages or of earlier documents."""
    asked = t.documents.select(F.col("doc_id").alias("seq"), F.col("lang").alias("palace"), F.col("text").alias("content"))
    stored = t.benchmark.select(F.lit("en").alias("palace"), F.col("text").alias("document"))
    return search.reject_exact(asked, stored).select("seq", "duplicate")


# --- routing ---------------------------------------------------------------------------------

_RANK_SQL = f"""
WITH {w.VECTORS_SQL},
scores AS (
  SELECT v.original_id, v.palace, q.name, {_COS} AS semantic, least(0.12, ln(1 + q.usage_count) * 0.02) AS usage, q.usage_count
  FROM palaces q, vecs v),
ranked AS (
  SELECT *, semantic + usage AS score,
         row_number() OVER (PARTITION BY original_id ORDER BY semantic + usage DESC, semantic DESC, name) AS rank FROM scores),
best AS (
  SELECT original_id, palace, max(CASE WHEN rank = 1 THEN name END) AS best_name, max(CASE WHEN rank = 1 THEN score END) AS best_score,
         max(CASE WHEN name = palace THEN score END) AS current_score FROM ranked GROUP BY original_id, palace)
"""


@query("palace_rank", _RANK_SQL + """
SELECT original_id, rank, name, round(semantic, 6) AS semantic_score, round(usage, 6) AS usage_boost, round(score, 6) AS score, usage_count
FROM ranked
""")
def palace_rank(t):
    """All palaces ranked for every vector."""
    ranked = routing.rank_palaces(w.vectors(t), w.palaces(t), text=None)
    return ranked.select("original_id", F.posexplode("candidates").alias("pos", "c")).select(
        "original_id", (F.col("pos") + 1).alias("rank"), "c.name",
        F.round("c.semantic_score", 6).alias("semantic_score"), F.round("c.usage_boost", 6).alias("usage_boost"),
        F.round("c.score", 6).alias("score"), "c.usage_count",
    )


@query("best_palace", f"""
WITH {w.VECTORS_SQL},
scores AS (SELECT v.original_id, q.name, {_COS} AS semantic FROM palaces q, vecs v)
SELECT original_id, name AS best_palace FROM scores
QUALIFY row_number() OVER (PARTITION BY original_id ORDER BY semantic DESC, name) = 1
""")
def best_palace(t):
    """The semantically nearest palace of every vector."""
    return routing.best_palace(w.vectors(t), w.palaces(t), text=None).select("original_id", "best_palace")


@query("assess_explicit_routing", _RANK_SQL + """
SELECT original_id, round(current_score, 6) AS routing_confidence, best_name AS routing_best_palace,
       best_name <> palace AND best_score >= 0.05 AND best_score - current_score >= 0.02 AS needs_review,
       CASE WHEN best_name <> palace AND best_score >= 0.05 AND best_score - current_score >= 0.02
            THEN 'explicit_palace_differs_from_semantic_best_match' ELSE 'explicit_palace_confirmed' END AS routing_reason
FROM best
""")
def assess_explicit_routing(t):
    """Does the palace of every vector agree with the best match?"""
    found = routing.assess_explicit(w.vectors(t), w.palaces(t), text=None)
    return found.select(
        "original_id", F.round("routing_confidence", 6).alias("routing_confidence"), "routing_best_palace", "needs_review", "routing_reason"
    )


_AUDIT_SQL = _RANK_SQL + """,
decided AS (
  SELECT *, CASE WHEN best_name = palace THEN 'current_palace_best_match' WHEN best_score < 0.05 THEN 'best_score_below_threshold'
                 WHEN best_score - current_score < 0.02 THEN 'score_gap_too_small' ELSE 'better_palace_match_found' END AS reason FROM best)
"""


@query("audit_decisions", _AUDIT_SQL + """
SELECT original_id AS drawer_id, palace AS current_palace, CASE WHEN reason = 'better_palace_match_found' THEN 'move' ELSE 'keep' END AS action,
       reason, best_name AS suggested_palace, round(current_score, 6) AS current_score, round(best_score, 6) AS best_score,
       reason = 'better_palace_match_found' AS flagged
FROM decided
""")
def audit_decisions(t):
    """Keep or move, and why, for every drawer."""
    found = consolidate.audit(w.vectors(t), w.palaces(t), text=False)
    return found.select(
        "drawer_id", "current_palace", "action", "reason", "suggested_palace",
        F.round("current_score", 6).alias("current_score"), F.round("best_score", 6).alias("best_score"), "flagged",
    )


@query("audit_summary", _AUDIT_SQL + """
SELECT palace AS current_palace, count(*) AS scanned, count(*) FILTER (reason = 'better_palace_match_found') AS moves,
       CAST(0 AS BIGINT) AS deletes, CAST(0 AS BIGINT) AS needs_review
FROM decided GROUP BY palace
""")
def audit_summary(t):
    """What an audit of every palace would change."""
    return consolidate.summary(consolidate.audit(w.vectors(t), w.palaces(t), text=False))


@query("move_targets", f"""
WITH {w.VECTORS_SQL}, {w.DRAWERS_SQL},
home AS (SELECT v.original_id, v.palace, v.vector, CAST((CAST(v.palace AS INT) + 1) % 10 AS VARCHAR) AS to_palace,
                coalesce(d.wing_name, 'Recovered Memory') AS wing_name, coalesce(d.room_name, 'Unsorted') AS room_name,
                coalesce(d.closet, 'Recovered') AS closet FROM vecs v LEFT JOIN drawers d USING (original_id)),
scored AS (SELECT q.original_id AS drawer_id, v.original_id AS near, {_COS} AS score
           FROM home q JOIN home v ON v.palace = q.to_palace),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY drawer_id ORDER BY score DESC, near) = 1)
SELECT b.drawer_id, round(b.score, 6) AS matched_similarity, CASE WHEN b.score >= 0.82 THEN n.wing_name ELSE o.wing_name END AS wing_name,
       CASE WHEN b.score >= 0.82 THEN n.room_name ELSE o.room_name END AS room_name,
       CASE WHEN b.score >= 0.82 THEN n.closet ELSE o.closet END AS closet_name
FROM best b JOIN home o ON o.original_id = b.drawer_id JOIN home n ON n.original_id = b.near
""")
def move_targets(t):
    """Where every drawer would be filed if it moved to the next palace."""
    paths = w.drawers(t).select("original_id", "wing", "wing_name", "hall", "room", "room_name", "closet")
    items = w.vectors(t).join(paths, "original_id", "left")
    moves = items.select(
        F.col("original_id").alias("drawer_id"), ((F.col("palace").cast("int") + 1) % 10).cast("string").alias("to_palace"), "vector"
    )
    near = consolidate.nearest_paths(moves, items).withColumnRenamed("drawer_id", "original_id")
    rows = items.join(near, "original_id", "left")
    names = ("wing_name", "hall_name", "room_name", "closet_name")
    chosen = consolidate.choose_path(
        consolidate.path_names(rows), {n: F.col(f"matched_{n}") for n in names}, F.col("matched_similarity")
    )
    return rows.select(
        F.col("original_id").alias("drawer_id"), F.round("matched_similarity", 6).alias("matched_similarity"),
        *[chosen[n].alias(n) for n in ("wing_name", "room_name", "closet_name")],
    )


@query("usage_boost", """
SELECT user_id, count(*) AS uses, round(least(0.12, ln(1 + count(*)) * 0.02), 6) AS boost FROM events GROUP BY user_id
""")
def usage_boost(t):
    """Boost of a palace by how often it was used."""
    used = t.events.groupBy("user_id").agg(F.count("*").alias("uses"))
    return used.withColumn("boost", F.round(routing.usage_boost(F.col("uses")), 6))


@query("palace_usage", """
SELECT event_type AS name, count(*) AS usage_count, max(strftime(ts, '%Y-%m-%d %H:%M:%S.%f')) AS last_used_at FROM events GROUP BY event_type
""")
def palace_usage(t):
    """Usage figures of palaces from the usage log."""
    log = t.events.select(F.col("event_type").alias("name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
    known = log.select("name").distinct()
    return routing.with_usage(known, log).select("name", "usage_count", "last_used_at")


@query("routing_memory", """
SELECT trim(regexp_replace(lower(event_type || ' ' || props), '[^a-z0-9]+', ' ', 'g')) AS normalized_query,
       arg_max(event_type || '_' || (user_id % 3), event_id) AS palace, arg_max(user_id, event_id) AS last_user, count(*) AS hit_count
FROM events GROUP BY 1
""")
def routing_memory(t):
    """Routing memory from a log of routed queries: last palace and hits per query."""
    log = t.events.select(
        F.concat_ws(" ", "event_type", "props").alias("query"),
        F.concat_ws("_", "event_type", (F.col("user_id") % 3).cast("string")).alias("palace"),
        F.col("user_id").alias("source"), F.col("ts"), F.col("event_id").alias("seq"),
    )
    return routing.remember(log).select("normalized_query", "palace", F.col("source").alias("last_user"), "hit_count")


def _normalized_sql(expr: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({expr})), '[^a-z0-9]+', ' ', 'g'))"


_FIELD_SQL = f"""
WITH ctx AS (SELECT conv_id, turn, {_normalized_sql('text')} AS n FROM conversations),
c2 AS (SELECT conv_id, turn, n, list_distinct(list_filter(string_split(n, ' '), lambda x: x <> '')) AS tokens,
              list_filter(string_split(n, ' '), lambda x: x <> '') AS seq FROM ctx),
c3 AS (SELECT *, list_distinct(list_concat(CASE WHEN len(seq) > 0 THEN [array_to_string(seq, ' ')] ELSE [] END,
              list_transform(range(1, len(seq)), lambda i: seq[i] || ' ' || seq[i + 1]))) AS phrases FROM c2),
pal AS (SELECT 'item ' || item_id AS name, {_normalized_sql('text')} AS body, {_normalized_sql("'item ' || item_id")} AS nname,
               {_normalized_sql("split_part(text, ' ', 1)")} AS k1, {_normalized_sql("split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)")} AS k2
        FROM benchmark),
pairs AS (
  SELECT c.*, p.*, list_distinct(list_filter(string_split(p.body, ' '), lambda x: x <> '')) AS btok,
         list_distinct(list_filter(string_split(p.nname, ' '), lambda x: x <> '')) AS ntok FROM c3 c, pal p),
scored AS (
  SELECT conv_id, turn, name, n,
    least(0.12, coalesce(len(list_intersect(tokens, btok)) / nullif(len(tokens), 0), 0) * 0.12 * 0.6
      + coalesce(len(list_filter(phrases, lambda x: contains(body, x))) / nullif(len(phrases), 0), 0) * 0.12 * 0.4) AS description,
    least(0.08, coalesce(len(list_intersect(tokens, ntok)) / nullif(len(tokens), 0), 0) * 0.08 * 0.6
      + coalesce(len(list_filter(phrases, lambda x: contains(nname, x))) / nullif(len(phrases), 0), 0) * 0.08 * 0.4) AS names,
    least(0.18, (CASE WHEN k1 = '' THEN 0 WHEN list_contains(phrases, k1) THEN 0.14
                      ELSE coalesce(len(list_intersect(tokens, string_split(k1, ' '))) / nullif(len(tokens), 0), 0) * 0.08 END)
              + (CASE WHEN k2 = '' THEN 0 WHEN list_contains(phrases, k2) THEN 0.14
                      ELSE coalesce(len(list_intersect(tokens, string_split(k2, ' '))) / nullif(len(tokens), 0), 0) * 0.08 END)) AS keywords
  FROM pairs),
boosted AS (SELECT conv_id, turn, name, CASE WHEN n = '' THEN 0 ELSE round(least(0.25, description + names + keywords), 9) END AS boost FROM scored)
SELECT conv_id, turn, name, round(boost, 6) AS field_boost FROM boosted
QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY boost DESC, name) = 1
"""


@query("field_boost", _FIELD_SQL)
def field_boost(t):
    """The palace whose texts agree most with each message."""
    one = F.array(F.lit(1.0).cast("float"))
    parts = F.split("text", " ")
    known = t.benchmark.select(
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"), F.col("text").alias("description"),
        F.array(F.get(parts, F.lit(0)), F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))).alias("keywords"), one.alias("vector"),
    )
    said = t.conversations.select("conv_id", "turn", "text", one.alias("vector"))
    ranked = routing.rank_palaces(said, known)
    best = F.array_min(F.transform("candidates", lambda c: F.struct((-F.round(c["field_boost"], 9)).alias("k"), c["name"].alias("name"))))
    return ranked.select("conv_id", "turn", best.alias("b")).select(
        "conv_id", "turn", "b.name", F.round(F.lit(0.0) - F.col("b.k"), 6).alias("field_boost")
    )


_QUALITY_SQL = f"""
WITH {w.VECTORS_SQL},
asked AS (SELECT p.name AS query_id, b.text AS query, p.vector FROM palaces p JOIN benchmark b ON b.item_id = CAST(p.name AS INT)),
scored AS (SELECT q.query_id, v.original_id, {_COS} AS score FROM asked q, vecs v),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_id) AS rank FROM scored),
top AS (
  SELECT query_id, max({_R3.format('score')}) FILTER (rank = 1) AS best, avg({_R3.format('score')}) FILTER (rank <= 3) AS avg3,
         string_agg(d.text, ' ' ORDER BY rank) AS corpus
  FROM hits LEFT JOIN documents d ON d.doc_id = original_id WHERE rank <= 5 GROUP BY query_id),
asp AS (SELECT query_id, list_filter(string_split({_normalized_sql('query')}, ' '), lambda x: length(x) >= 4) AS long FROM asked),
a2 AS (SELECT query_id, list_distinct(list_concat(long, CASE WHEN len(long) > 1 THEN [array_to_string(long, ' ')] ELSE [] END)) AS aspects FROM asp),
c AS (SELECT t.*, CASE WHEN len(aspects) = 0 THEN 1 ELSE len(list_filter(aspects, lambda x: contains({_normalized_sql('corpus')}, x))) / len(aspects) END AS cov
      FROM top t JOIN a2 USING (query_id))
SELECT query_id, round(best, 6) AS best_similarity, round(avg3, 6) AS avg_top_3_similarity, round(cov, 6) AS answer_coverage,
       round(best * 0.55 + avg3 * 0.25 + cov * 0.2, 6) AS quality_score FROM c
"""


@query("result_quality", _QUALITY_SQL)
def result_quality(t):
    """Quality of the hits of a question per palace."""
    asked = _scopes(t).join(t.benchmark.select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query")), "query_id")
    texts = t.documents.select(F.col("doc_id").alias("original_id"), "text")
    hits = _shown(top_k(asked, w.vectors(t), 5, item_id="original_id")).join(texts, "original_id", "left")
    judged = routing.result_quality(hits, asked)
    names = ("best_similarity", "avg_top_3_similarity", "answer_coverage", "quality_score")
    return judged.select("query_id", *[F.round(n, 6).alias(n) for n in names])


@query("fallback_choice", """
WITH tried AS (
  SELECT user_id AS query_id, event_type AS palace, event_type = 'click' AS is_current, count(*) AS semantic_score,
         round(avg(CAST(props->>'$.k' AS INT)) / 100, 1) AS answer_coverage,
         CASE WHEN count(*) % 7 = 0 THEN NULL ELSE round(sum(value) / count(*) / 100, 2) END AS quality_score
  FROM events GROUP BY user_id, event_type)
SELECT query_id, palace, answer_coverage, quality_score FROM tried
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY quality_score IS NULL, answer_coverage DESC, quality_score DESC NULLS LAST,
                           is_current DESC, semantic_score DESC, palace) = 1
""")
def fallback_choice(t):
    """Best of the palaces tried per query: coverage first, then score, ties to the current one."""
    k = F.get_json_object("props", "$.k").cast("int")
    n = F.count("*")
    tried = t.events.groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("palace")).agg(
        n.alias("semantic_score"), F.round(F.avg(k) / 100, 1).alias("answer_coverage"),
        F.when(n % 7 != 0, F.round(F.sum("value") / n / 100, 2)).alias("quality_score"),
    ).withColumn("is_current", F.col("palace") == "click")
    return routing.choose_fallback(tried).select("query_id", "palace", "answer_coverage", "quality_score")


# --- the hashing embedder, and searches that start from text -------------------------------------

_HASHED = """
{name}_tok AS (SELECT id, UNNEST(list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS tok FROM ({source})),
{name}_bkt AS (
  SELECT id, CAST(('0x' || left(md5(tok), 6)) AS INT) % 384 AS b,
         sum(CASE WHEN CAST(('0x' || substr(md5(tok), 7, 1)) AS INT) % 2 = 1 THEN -1 ELSE 1 END) AS x FROM {name}_tok GROUP BY 1, 2),
{name}_vec AS (SELECT id, b, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM {name}_bkt WHERE x <> 0)
"""


def hashed_sql(name: str, source: str) -> str:
    return _HASHED.format(name=name, source=source).strip()


@query("embed_hash", f"""
WITH {hashed_sql('d', 'SELECT doc_id AS id, text AS body FROM documents')}
SELECT id AS doc_id, count(*) AS filled, CAST(sum(b + 1) AS BIGINT) AS bucket_sum, round(sum(x), 3) AS total FROM d_vec GROUP BY id
""")
def embed_hash(t):
    """Figures of the hashed vectors of all documents."""
    v = t.documents.select("doc_id", embed(F.col("text")).alias("v"))
    at = F.filter(F.transform("v", lambda x, i: F.when(x != 0, i + 1)), lambda i: i.isNotNull())
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.select("doc_id", F.size(at).cast("bigint").alias("filled"), F.aggregate(at, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bucket_sum"), F.round(total, 3).alias("total")).where("filled > 0")


_TEXT_TOP_SQL = f"""
WITH {hashed_sql('d', 'SELECT doc_id AS id, text AS body FROM documents')},
{hashed_sql('q', 'SELECT item_id AS id, text AS body FROM benchmark')},
dots AS (SELECT q.id AS query_id, d.id AS original_id, round(sum(q.x * d.x), 5) AS score FROM q_vec q JOIN d_vec d USING (b) GROUP BY 1, 2),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_id) AS rank FROM dots)
"""


def _text_hits(t: Tables, k: int) -> DataFrame:
    """Documents for every benchmark passage, by hashed vectors (scores to five places)."""
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), "text", embed(F.col("text")).alias("vector"))
    items = t.documents.select(F.col("doc_id").alias("original_id"), "text", embed(F.col("text")).alias("vector"))
    return top_k(asked, items, k, item_id="original_id")


@query("text_search_best", _TEXT_TOP_SQL + "SELECT query_id, round(score, 3) AS similarity FROM hits WHERE rank = 1")
def text_search_best(t):
    """How near the best document comes to every passage."""
    return _text_hits(t, 1).select("query_id", F.round("score", 3).alias("similarity"))


@query("recall_by_text", _TEXT_TOP_SQL + """
SELECT h.query_id AS question_id, bool_or(contains(lower(d.text), lower(b.text)) OR contains(lower(b.text), lower(d.text))) AS recall_hit
FROM hits h JOIN documents d ON d.doc_id = h.original_id JOIN benchmark b ON b.item_id = h.query_id WHERE rank <= 10 GROUP BY 1
""")
def recall_by_text(t):
    """Is a passage found inside one of its ten nearest documents?"""
    hits = _text_hits(t, 10).join(t.documents.select(F.col("doc_id").alias("original_id"), "text"), "original_id")
    asked = t.benchmark.select(F.col("item_id").alias("question_id"), "text")
    return evaluate.recall_by_text(hits.withColumnRenamed("query_id", "question_id"), asked, asked)


def routed_sql(contexts: str, palaces: str, fields: tuple[str, ...]) -> str:
    """CTEs that rank palaces (name, scope, keywords, usage_count, ...) for texts (id, body): ``ranked`` (id, name, semantic, score, rank)."""
    weights = dict(routing._FIELD_WEIGHTS)
    overlap = "CASE WHEN len(toks) > 0 AND len({0}) > 0 THEN len(list_intersect(toks, {0})) / len(toks) ELSE 0 END"
    scores = []
    for f in fields:
        text = f"n_{f}"
        words = f"list_distinct(string_split({text}, ' '))"
        phrase = f"CASE WHEN len(said) > 0 THEN len(list_filter(said, lambda x: contains({text}, x))) / len(said) ELSE 0 END"
        w8 = f"{weights[f]}::DOUBLE"
        scores.append(f"CASE WHEN length({text}) > 0 THEN least({w8}, ({overlap.format(words)}) * {w8} * 0.6::DOUBLE + ({phrase}) * {w8} * 0.4::DOUBLE) ELSE 0 END")
    one = f"CASE WHEN list_contains(said, k) THEN 0.14::DOUBLE ELSE ({overlap.format("list_distinct(string_split(k, ' '))")}) * 0.08::DOUBLE END"
    normalized = ", ".join(f"{_normalized_sql(f)} AS n_{f}" for f in fields)
    return f"""
ctx AS ({contexts}), pal AS (SELECT *, {normalized} FROM ({palaces})),
{hashed_sql('rc', 'SELECT id, body FROM ctx')}, {hashed_sql('rp', 'SELECT name AS id, scope AS body FROM pal')},
rdots AS (SELECT c.id, p.id AS name, round(sum(c.x * p.x), 9) AS dot FROM rc_vec c JOIN rp_vec p USING (b) GROUP BY 1, 2),
worded AS (SELECT id, list_filter(string_split({_normalized_sql('body')}, ' '), lambda x: x <> '') AS ws FROM ctx),
phrased AS (SELECT id, list_distinct(ws) AS toks, CASE WHEN len(ws) > 0 THEN list_distinct(list_concat([array_to_string(ws, ' ')],
    list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) ELSE CAST([] AS VARCHAR[]) END AS said FROM worded),
boosted AS (
  SELECT f.id, p.name, coalesce(dot, 0) AS semantic, CASE WHEN usage_count > 0 THEN least(0.12, ln(1 + usage_count) * 0.02) ELSE 0 END AS usage,
         CASE WHEN len(toks) > 0 THEN least(0.25, {' + '.join(scores)} + least(0.18, coalesce(list_sum(list_transform(keys, lambda k: {one})), 0))) ELSE 0 END AS field
  FROM phrased f, pal p LEFT JOIN rdots ON rdots.id = f.id AND rdots.name = p.name),
ranked AS (SELECT id, name, semantic, semantic + field + usage AS score,
                  row_number() OVER (PARTITION BY id ORDER BY semantic + field + usage DESC, semantic DESC, name) AS rank FROM boosted)
""".strip()


def _routed_search_sql(memory: str) -> str:
    """Routes of benchmark passages; ``memory`` gives (normalized_query, palace)."""
    asp = f"list_filter(string_split({_normalized_sql('query')}, ' '), lambda x: length(x) >= 4)"
    palaces = "SELECT lang AS name, count(*) AS usage_count, max_by(text, doc_id) AS scope, CAST([] AS VARCHAR[]) AS keys FROM documents GROUP BY lang"
    return f"""
WITH {routed_sql("SELECT item_id AS id, text AS body FROM benchmark", palaces, ("name", "scope"))},
{hashed_sql('d', 'SELECT doc_id AS id, text AS body FROM documents')}, {hashed_sql('q', 'SELECT item_id AS id, text AS body FROM benchmark')},
memory AS ({memory}),
asked AS (SELECT item_id AS query_id, text AS query, coalesce(m.palace, r.name) AS palace FROM benchmark JOIN ranked r ON r.id = item_id AND rank = 1
          LEFT JOIN memory m ON m.normalized_query = {_normalized_sql('text')}),
dots AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum(q.x * d.x), 9) AS dot FROM q_vec q JOIN d_vec d USING (b) GROUP BY 1, 2),
every AS (SELECT item_id AS query_id, d.doc_id, lang AS palace, d.text, coalesce(dot, 0) AS score FROM benchmark, documents d LEFT JOIN dots ON dots.query_id = item_id AND dots.doc_id = d.doc_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id, palace ORDER BY score DESC, doc_id) AS rank FROM every QUALIFY rank <= 5),
top AS (SELECT query_id, palace, max({_R3.format('score')}) FILTER (rank = 1) AS best, avg({_R3.format('score')}) FILTER (rank <= 3) AS avg3, string_agg(text, ' ' ORDER BY rank) AS corpus
        FROM hits GROUP BY query_id, palace),
aspects AS (SELECT query_id, list_distinct(list_concat({asp}, CASE WHEN len({asp}) > 1 THEN [array_to_string({asp}, ' ')] ELSE [] END)) AS asp FROM asked),
judged AS (SELECT t.*, CASE WHEN len(asp) = 0 THEN 1 ELSE len(list_filter(asp, lambda x: contains({_normalized_sql('corpus')}, x))) / len(asp) END AS cov FROM top t JOIN aspects USING (query_id)),
scored AS (SELECT query_id, palace, cov, best * 0.55 + avg3 * 0.25 + cov * 0.2 AS quality FROM judged),
own AS (SELECT a.query_id, a.palace, quality < 0.05 OR cov < 0.3 AS weak FROM asked a JOIN scored USING (query_id, palace)),
options AS (
  SELECT s.*, s.palace = o.palace AS is_current, o.palace AS home, weak, CASE WHEN s.palace <> o.palace THEN semantic END AS semantic
  FROM scored s JOIN own o USING (query_id) LEFT JOIN ranked r ON r.id = s.query_id AND r.name = s.palace WHERE s.palace = o.palace OR weak)
SELECT query_id, palace AS searched_palace, weak AS fallback_checked, palace <> home AS fallback_used, round(cov, 6) AS answer_coverage, round(quality, 6) AS quality_score,
       quality >= 0.05 AS remember, CASE WHEN palace <> home THEN 'fallback_success' ELSE 'direct_hit' END AS source
FROM options QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cov DESC, quality DESC, is_current DESC, semantic DESC NULLS LAST, palace) = 1
"""


def _languages(t):
    """Languages as palaces, their last document being the scope."""
    # Texts in the state of an aggregate would have every text sorted.
    last = t.documents.groupBy("lang").agg(F.count("*").alias("usage_count"), F.max("doc_id").alias("last"))
    texts = t.documents.join(
        F.broadcast(last.select(F.col("lang").alias("name"), "last")), F.col("lang").eqNullSafe(F.col("name")) & (F.col("doc_id") == F.col("last"))
    ).groupBy("name").agg(F.max("text").alias("scope"))
    known = last.withColumnRenamed("lang", "name").alias("k").join(texts.alias("x"), F.col("k.name").eqNullSafe(F.col("x.name")), "left")
    return known.select("k.name", "usage_count", "scope").withColumn("vector", embed(F.col("scope")))


_REMEMBERED_SQL = f"""
SELECT {{0}} AS normalized_query, max_by(CASE item_id % 3 WHEN 0 THEN 'de' ELSE 'fr' END, item_id) AS palace FROM benchmark WHERE item_id % 3 <> 1 GROUP BY 1
"""


@query("search_routed", _routed_search_sql("SELECT CAST(NULL AS VARCHAR) AS normalized_query, CAST(NULL AS VARCHAR) AS palace WHERE false"))
def search_routed(t):
    """Passages routed to a language, searched there, with a fall-back to the others."""
    known = _languages(t)
    items = w.drawers(t).withColumn("vector", embed(F.col("document")))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    _, routes = search.search_routed(asked, known, items)
    return routes.select(
        "query_id", "searched_palace", "fallback_checked", "fallback_used", F.round("answer_coverage", 6).alias("answer_coverage"),
        F.round("quality_score", 6).alias("quality_score"), "remember", "source",
    )


@query("search_remembered", _routed_search_sql(_REMEMBERED_SQL.format(_normalized_sql("text"))))
def search_remembered(t):
    """The same passages, two thirds of which were asked before and go where the routing memory says first."""
    known = _languages(t)
    items = w.drawers(t).withColumn("vector", embed(F.col("document")))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    log = asked.where(F.col("query_id") % 3 != 1).select(
        "query", F.when(F.col("query_id") % 3 == 0, "de").otherwise("fr").alias("palace"), F.lit("direct_hit").alias("source"),
        F.lit("2026-01-01").alias("ts"), F.col("query_id").alias("seq"))
    _, routes = search.search_routed(asked, known, items, routing.remember(log))
    return routes.select(
        "query_id", "searched_palace", "fallback_checked", "fallback_used", F.round("answer_coverage", 6).alias("answer_coverage"),
        F.round("quality_score", 6).alias("quality_score"), "remember", "source",
    )


@query("diary_search", f"""
WITH {hashed_sql('d', "SELECT event_id AS id, event_type || ' ' || props AS body FROM events")},
{hashed_sql('q', "SELECT DISTINCT event_type AS id, event_type || ' k 7' AS body FROM events")},
dots AS (SELECT q.id AS query_id, d.id AS original_id, round(sum(q.x * d.x), 5) AS score FROM q_vec q JOIN d_vec d USING (b) GROUP BY 1, 2),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_id) AS rank FROM dots)
SELECT query_id, rank, round(score, 3) AS similarity FROM hits WHERE rank <= 5
""")
def diary_search(t):
    """The diary entries nearest to a question per topic."""
    kinds = t.events.select(F.col("event_type").alias("query_id")).distinct()
    asked = kinds.withColumn("query", F.concat("query_id", F.lit(" k 7")))
    entries = w.diary(t).withColumn("document", F.concat_ws(" ", "topic", "document")).withColumn("vector", embed(F.col("document")))
    return search.diary_search(asked, entries).select("query_id", "rank", F.round("similarity", 3).alias("similarity"))


# --- evaluation ---------------------------------------------------------------------------------


@query("recall_at_k", f"""
WITH {w.VECTORS_SQL},
scored AS (SELECT q.original_id AS question_id, v.original_id AS corpus_id, {_COS} AS score FROM vecs q, vecs v WHERE q.original_id <> v.original_id),
hits AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, corpus_id) AS rank FROM scored),
ev AS (SELECT original_id AS question_id, lead(original_id, o) OVER (PARTITION BY palace, o ORDER BY original_id) AS corpus_id
       FROM vecs, (SELECT UNNEST([1, 2, 3]) AS o)),
ev2 AS (SELECT * FROM ev WHERE corpus_id IS NOT NULL),
has AS (SELECT DISTINCT question_id FROM ev2),
hit AS (SELECT DISTINCT h.question_id FROM hits h JOIN ev2 USING (question_id, corpus_id) WHERE rank <= 10)
SELECT v.original_id AS question_id, CASE WHEN has.question_id IS NOT NULL THEN hit.question_id IS NOT NULL END AS recall_hit
FROM vecs v LEFT JOIN has ON has.question_id = v.original_id LEFT JOIN hit ON hit.question_id = v.original_id
""".replace("lead(original_id, o) OVER (PARTITION BY palace, o ORDER BY original_id)", "CASE o WHEN 1 THEN lead(original_id, 1) OVER (PARTITION BY palace, o ORDER BY original_id) WHEN 2 THEN lead(original_id, 2) OVER (PARTITION BY palace, o ORDER BY original_id) ELSE lead(original_id, 3) OVER (PARTITION BY palace, o ORDER BY original_id) END"))
def recall_at_k(t):
    """Was one of the next three vectors of the label among the ten nearest?"""
    hits = top_k(_each(t), w.vectors(t), 10, item_id="original_id", skip_same_id=True)
    got = hits.select(F.col("query_id").alias("question_id"), F.col("original_id").alias("corpus_id"), "rank")
    return evaluate.recall_by_id(got, _evidence(t), w.vectors(t).select(F.col("original_id").alias("question_id")), k=10)


def _evidence(t: Tables) -> DataFrame:
    # The label order is numbered by a sort over the whole table, not in one
    # task per label, and each position is joined with the three after it.
    from loci.operators.skew import running_count

    rows = running_count(w.vectors(t).select("palace", "original_id"), ["palace"], "original_id", F.lit(True), "n")
    ahead = rows.select("palace", F.col("original_id").alias("corpus_id"), F.explode(F.array(*[F.col("n") - i for i in (1, 2, 3)])).alias("n"))
    return rows.join(ahead, ["palace", "n"]).select(F.col("original_id").alias("question_id"), "corpus_id")


@query("category_summary", """
WITH r AS (SELECT event_type AS category, CASE WHEN CAST(props->>'$.k' AS INT) % 5 <> 0 THEN value > 20 END AS recall_hit,
                  CASE WHEN user_id % 3 <> 0 THEN CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END END AS llm_score FROM events)
SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category, count(*) AS questions, count(recall_hit) AS with_recall,
       count(*) FILTER (recall_hit) AS recall_hits, round(coalesce(avg(CAST(recall_hit AS INT)), 0), 6) AS recall, round(avg(llm_score), 6) AS llm_accuracy
FROM r GROUP BY ROLLUP (category)
""")
def category_summary(t):
    """Recall and answer accuracy per category and overall."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = t.events.select(
        F.col("event_type").alias("category"), F.when(k % 5 != 0, F.col("value") > 20).alias("recall_hit"),
        F.when(F.col("user_id") % 3 != 0, F.when(F.col("value") > 30, 1.0).otherwise(0.0)).alias("llm_score"),
    )
    out = evaluate.summarize(rows)
    return out.withColumns({"recall": F.round("recall", 6), "llm_accuracy": F.round("llm_accuracy", 6)})


_F1_TOK = "list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')"


@query("token_f1", f"""
WITH pairs AS (SELECT a.conv_id * 1000 + a.turn AS pair_id, a.text AS pred, b.text AS truth
               FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
p AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, UNNEST({_F1_TOK.format('pred')}) AS w FROM pairs) GROUP BY 1, 2),
q AS (SELECT pair_id, w, count(*) AS n FROM (SELECT pair_id, UNNEST({_F1_TOK.format('truth')}) AS w FROM pairs) GROUP BY 1, 2),
c AS (SELECT p.pair_id, sum(least(p.n, q.n)) AS common FROM p JOIN q USING (pair_id, w) GROUP BY 1),
np AS (SELECT pair_id, sum(n) AS n FROM p GROUP BY 1), nq AS (SELECT pair_id, sum(n) AS n FROM q GROUP BY 1)
SELECT pairs.pair_id, CAST(coalesce(common, 0) AS BIGINT) AS common,
       round(CASE WHEN coalesce(common, 0) > 0 THEN 2.0 * common / (np.n + nq.n) ELSE 0 END, 6) AS f1
FROM pairs LEFT JOIN c USING (pair_id) LEFT JOIN np USING (pair_id) LEFT JOIN nq USING (pair_id)
""")
def token_f1(t):
    """Token F1 of every message against the one after it."""
    c = t.conversations
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("truth"))
    pairs = c.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), F.col("text").alias("pred"), "truth")
    return evaluate.token_f1(pairs).select("pair_id", F.col("common").cast("bigint").alias("common"), F.round("f1", 6).alias("f1"))


@query("substring_match", """
SELECT a.conv_id, a.turn, contains(lower(a.text), lower(b.text)) OR contains(lower(b.text), lower(a.text)) AS matched,
       coalesce(nullif(regexp_extract(upper(a.text), '\\b([ABCD])\\b', 1), ''), '-') AS choice
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
""")
def substring_match(t):
    """Does one of two neighbouring messages contain the other; the first multiple-choice letter."""
    c = t.conversations
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    return c.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn", evaluate.substring_match(F.col("text"), F.col("other")).alias("matched"),
        F.coalesce(evaluate.multiple_choice(F.col("text")), F.lit("-")).alias("choice"),
    )
