"""Queries on status, filters, recall, diary, the essential story, storage and saving."""

from __future__ import annotations

from pyspark.sql import functions as F

from loci.functions import text as tx
from loci.operators import filters, memory, routing, saving, store
from loci.plans import workload as w
from loci.plans.catalog import query
from loci.plans.retrieval_queries import routed_sql

_D = f"WITH {w.DRAWERS_SQL}\n"


@query("status_grouping_sets", _D + """
SELECT CASE WHEN grouping(wing) = 0 THEN 'wing' WHEN grouping(room) = 0 THEN 'room' ELSE 'total' END AS level,
       coalesce(wing, room, 'total') AS name, count(*) AS drawers
FROM drawers GROUP BY GROUPING SETS ((), (wing), (room))
""")
def status_grouping_sets(t):
    """Total, wing and room counts in one pass."""
    return memory.status(w.drawers(t))


@query("list_wings", _D + "SELECT wing, count(*) AS drawers FROM drawers GROUP BY wing")
def list_wings(t):
    return memory.list_wings(w.drawers(t))


@query("list_rooms", _D + "SELECT room, count(*) AS drawers FROM drawers WHERE wing = 'fr' GROUP BY room")
def list_rooms(t):
    return memory.list_rooms(w.drawers(t), wing="fr")


@query("wing_room_counts", _D + "SELECT wing, room, count(*) AS drawers FROM drawers GROUP BY wing, room")
def wing_room_counts(t):
    return memory.wing_rooms(w.drawers(t))


@query("where_and", _D + "SELECT original_id, closet FROM drawers WHERE wing = 'de' AND importance = 3")
def where_and(t):
    where = {"$and": [{"wing": "de"}, {"importance": 3.0}]}
    return filters.apply_where(w.drawers(t), where).select("original_id", "closet")


@query("where_or", _D + "SELECT original_id, wing, room FROM drawers WHERE wing = 'es' OR room = 'src3'")
def where_or(t):
    return filters.apply_where(w.drawers(t), {"$or": [{"wing": "es"}, {"room": "src3"}]}).select("original_id", "wing", "room")


@query("where_nested", _D + """
SELECT original_id, wing, room FROM drawers
WHERE (wing = 'en' AND room = 'src1') OR ((wing = 'fr' OR wing = 'de') AND importance = 5)
""")
def where_nested(t):
    where = {"$or": [{"wing": "en", "room": "src1"}, {"$and": [{"$or": [{"wing": "fr"}, {"wing": "de"}]}, {"importance": 5.0}]}]}
    return filters.apply_where(w.drawers(t), where).select("original_id", "wing", "room")


@query("get_ordered", _D + """
SELECT original_id, importance, room FROM drawers WHERE wing = 'en' ORDER BY importance DESC, original_id LIMIT 25
""")
def get_ordered(t):
    """Filtered drawers by importance, the first 25."""
    return store.get_ordered(w.drawers(t), "importance", where={"wing": "en"}, limit=25).select("original_id", "importance", "room")


_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
_FLAT = f"regexp_replace(trim(document, {_BLANKS}), '\\s+', ' ', 'g')"


@query("recall_rooms", _D + f"""
SELECT original_id, room, wing, hall, importance, '' AS filed_at,
       CASE WHEN length({_FLAT}) > 300 THEN left({_FLAT}, 297) || '...' ELSE {_FLAT} END AS content
FROM drawers
""")
def recall_rooms(t):
    """Every drawer in recall form."""
    return memory.recall(w.drawers(t), limit=None)


@query("recall_room_limit", _D + f"""
SELECT original_id, room, wing, hall, importance, '' AS filed_at,
       CASE WHEN length({_FLAT}) > 300 THEN left({_FLAT}, 297) || '...' ELSE {_FLAT} END AS content
FROM drawers WHERE wing = 'en' AND room = 'src7' ORDER BY original_id
""")
def recall_room_limit(t):
    """All drawers of a room."""
    return memory.recall(w.drawers(t), wing="en", room="src7")


_L1_SQL = _D + """
, top AS (SELECT palace, original_id, room, source_file, document, importance,
                 row_number() OVER (PARTITION BY palace ORDER BY importance DESC, original_id) AS position FROM drawers)
"""


@query("l1_essential_top15", _L1_SQL + "SELECT palace, original_id, room, importance, position FROM top WHERE position <= 15")
def l1_essential(t):
    """The fifteen most important drawers of every palace."""
    return memory.essential_rows(w.drawers(t)).select("palace", "original_id", "room", "importance", "position")


_L1_TEXT = _L1_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""",
lines AS (
  SELECT palace, room, row_number() OVER (PARTITION BY palace ORDER BY room, position) AS n,
         lag(room) OVER (PARTITION BY palace ORDER BY room, position) IS DISTINCT FROM room AS opens,
         '  - ' || CASE WHEN length({_FLAT}) > 200 THEN left({_FLAT}, 197) || '...' ELSE {_FLAT} END || ' (' || regexp_extract(source_file, '[^/]+$') || ')' AS line
  FROM top WHERE position <= 15),
fold AS (
  SELECT palace, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS total, false AS closed, '## L1 — ESSENTIAL STORY' AS out FROM lines GROUP BY palace
  UNION ALL
  SELECT f.palace, l.n,
    f.total + CASE WHEN l.opens THEN length(l.room) + 3 ELSE 0 END
      + CASE WHEN (f.closed AND NOT l.opens) OR f.total + CASE WHEN l.opens THEN length(l.room) + 3 ELSE 0 END + length(l.line) > 3200 THEN 0 ELSE length(l.line) END,
    (f.closed AND NOT l.opens) OR f.total + CASE WHEN l.opens THEN length(l.room) + 3 ELSE 0 END + length(l.line) > 3200,
    f.out || CASE WHEN l.opens THEN chr(10) || chr(10) || '[' || l.room || ']' ELSE '' END
      || CASE WHEN f.closed AND NOT l.opens THEN ''
              WHEN f.total + CASE WHEN l.opens THEN length(l.room) + 3 ELSE 0 END + length(l.line) > 3200 THEN chr(10) || '  ... (more available via search)'
              ELSE chr(10) || l.line END
  FROM fold f JOIN lines l ON l.palace = f.palace AND l.n = f.n + 1)
SELECT palace, out AS l1_essential FROM fold QUALIFY row_number() OVER (PARTITION BY palace ORDER BY n DESC) = 1
"""


@query("l1_char_budget", _L1_TEXT)
def l1_char_budget(t):
    """The essential story of every palace within 3,200 characters."""
    return memory.essential_story(w.drawers(t))


@query("illuminate", f"""
WITH RECURSIVE {w.DRAWERS_SQL},
used AS (SELECT palace AS name, count(*) AS n FROM drawers GROUP BY palace),
pick AS (SELECT name FROM used ORDER BY (name = 'fr') DESC, name LIMIT 1),
""" + _L1_TEXT.split("\n, ", 1)[1].replace("FROM drawers)", "FROM drawers WHERE palace IN (SELECT name FROM pick))").rsplit("SELECT palace, out", 1)[0] + """
SELECT palace, 'about ' || palace AS description, CAST(NULL AS VARCHAR) AS wing_focus, 'default fallback' AS reason,
       '## L0 — IDENTITY' || chr(10) || '(' || palace || ' — no body content)' AS l0_identity, out AS l1_essential,
       CAST(NULL AS VARCHAR) AS l1_recent_saves
FROM fold QUALIFY row_number() OVER (PARTITION BY palace ORDER BY n DESC) = 1
""")
def illuminate(t):
    """Identity and story of the default palace."""
    items = w.drawers(t)
    known = items.groupBy(F.col("palace").alias("name")).agg(F.count("*").alias("usage_count")).select(
        "name", F.concat(F.lit("about "), "name").alias("description"), F.lit("").alias("wing_focus"), F.lit(None).cast("string").alias("l0_body"),
        (F.col("name") == "fr").alias("is_default"), "usage_count",
    )
    return memory.illuminate(known, items)


_DIARY = f"WITH {w.DIARY_SQL}\n"


@query("diary_recent", _DIARY + """
SELECT wing, row_number() OVER (PARTITION BY wing ORDER BY filed_at DESC, original_id DESC) AS position, original_id, date,
       filed_at AS timestamp, topic, document AS content
FROM diary QUALIFY position <= 10
""")
def diary_recent(t):
    """The ten newest entries of every agent."""
    return memory.diary_read(w.diary(t))


@query("diary_topic_filter", _DIARY + """
SELECT wing, row_number() OVER (PARTITION BY wing ORDER BY filed_at DESC, original_id DESC) AS position, original_id, date,
       filed_at AS timestamp, topic, document AS content
FROM diary WHERE topic = 'error' QUALIFY position <= 5
""")
def diary_topic(t):
    """The five newest entries of every agent on one topic."""
    return memory.diary_read(w.diary(t), last_n=5, topic="error")


@query("diary_agent", _DIARY + """
SELECT wing, row_number() OVER (ORDER BY filed_at DESC, original_id DESC) AS position, original_id, date,
       filed_at AS timestamp, topic, document AS content
FROM diary WHERE wing = 'wing_7' QUALIFY position <= 10
""")
def diary_agent(t):
    """The ten newest entries of one agent."""
    return memory.diary_read(w.diary(t), agent="7")


@query("diary_rows", """
SELECT 'diary_wing_agent_' || user_id || '_' || left(regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '[-:T]', '', 'g'), 15)
       || '_' || left(md5(left(props, 50)), 8) AS original_id, event_type AS topic, strftime(ts, '%Y-%m-%d') AS date
FROM events
""")
def diary_rows(t):
    """Events written as diary entries."""
    entries = t.events.select(
        F.concat(F.lit("Agent "), F.col("user_id").cast("string")).alias("agent"), F.col("props").alias("entry"), F.col("event_type").alias("topic"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"),
    )
    return saving.diary_rows(entries, "").select("original_id", "topic", "date")


@query("list_identities", """
SELECT lang AS name, 'about ' || lang AS description, CAST(NULL AS VARCHAR) AS wing_focus, lang AS scope, lang = 'en' AS is_default, count(*) AS usage_count
FROM documents GROUP BY lang
""")
def list_identities(t):
    """The registered palaces with their figures."""
    known = t.documents.groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("usage_count")).select(
        "name", F.concat(F.lit("about "), "name").alias("description"), F.array().cast("array<string>").alias("keywords"),
        F.lit("").alias("wing_focus"), F.col("name").alias("scope"), (F.col("name") == "en").alias("is_default"), "usage_count",
        F.lit(None).cast("string").alias("last_used_at"),
    )
    return routing.list_palaces(known).drop("keywords", "last_used_at")


@query("palace_create", r"""
SELECT c_custkey AS id, regexp_replace(lower(trim('  ' || c_mktsegment || '  ' || c_name || ' ')), '\s+', '_', 'g') AS name,
       CAST(NULL AS VARCHAR) AS error, regexp_replace(lower(trim('  ' || c_mktsegment || '  ' || c_name || ' ')), '\s+', '_', 'g') AS scope
FROM customer
""")
def palace_create(t):
    """Names of new palaces put in order."""
    asked = t.customer.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("  "), "c_mktsegment", F.lit("  "), "c_name", F.lit(" ")).alias("name"), F.lit("").alias("scope")
    )
    return routing.create_palace_rows(asked).select("id", "name", "error", "scope")


# --- storage -------------------------------------------------------------------------------


_LOG_SQL = """
log AS (
  SELECT CAST(o_custkey % 7 AS VARCHAR) AS palace, CAST(o_custkey AS VARCHAR) AS original_id, o_orderkey AS seq,
         'order ' || o_orderkey || ' ' || o_orderpriority AS document, CASE WHEN o_orderstatus = 'P' THEN 'delete' ELSE 'upsert' END AS op
  FROM orders),
now AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY palace, original_id ORDER BY seq DESC) = 1)
"""


def _log(t):
    rows = t.orders.select(
        (F.col("o_custkey") % 7).cast("string").alias("palace"), F.col("o_custkey").cast("string").alias("original_id"),
        F.col("o_orderkey").alias("seq"), F.concat_ws(" ", F.lit("order"), F.col("o_orderkey").cast("string"), "o_orderpriority").alias("document"),
        F.when(F.col("o_orderstatus") == "P", "delete").otherwise("upsert").alias("_op"), F.lit(None).cast("array<float>").alias("vector"),
    )
    ups = store.as_upserts(rows.where("_op = 'upsert'"), 1, F.col("seq"))
    keyed = rows.where("_op = 'delete'").withColumn("point_id", tx.point_id(F.col("original_id")))
    return ups.unionByName(store.as_deletes(keyed, 1, F.col("seq")))


@query("store_current", f"WITH {_LOG_SQL} SELECT palace, original_id, document, seq FROM now WHERE op = 'upsert'")
def store_current(t):
    """What an order log leaves: last write per customer, cancelled ones gone."""
    return store.current(_log(t)).select("palace", "original_id", "document", "seq")


@query("store_delete_where", f"WITH {_LOG_SQL} SELECT palace, original_id FROM now WHERE op = 'upsert' AND palace <> '3'")
def store_delete_where(t):
    """The same after one palace was deleted by filter."""
    log = _log(t)
    gone = store.delete_where(store.current(log), {"palace": "3"}, 2)
    return store.current(log.unionByName(gone)).select("palace", "original_id")


@query("drawer_ids", """
SELECT doc_id, 'drawer_' || lang || '_' || source || '_' || left(md5('docs/' || doc_id || '.txt' || (n_chars % 9)), 16) AS drawer_id,
       lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
         || substr('89ab', (CAST(('0x' || substr(h, 17, 1)) AS INT) & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS point_id
FROM (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('loci.' || doc_id)) AS h FROM documents)
""")
def drawer_ids(t):
    """Drawer and storage ids of documents."""
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return t.documents.select(
        "doc_id", tx.mined_drawer_id(F.col("lang"), F.col("source"), path, F.col("n_chars") % 9).alias("drawer_id"),
        tx.point_id(F.col("doc_id").cast("string")).alias("point_id"),
    )


# --- saving ---------------------------------------------------------------------------------


@query("save_validation", """
SELECT conv_id, turn,
  CASE WHEN trim(text) = '' THEN 'content is required'
       WHEN role = 'system' THEN 'palace is required'
       WHEN turn = 5 THEN 'wing, hall, room, and closet are required'
       WHEN length(text) % 11 = 0 THEN 'topic is required (kebab-case string)'
       WHEN conv_id % 7 > 5 OR conv_id % 7 < 1 THEN 'importance is required (number 1-5, where 5=critical, 3=normal, 1=trivial)' END AS error
FROM conversations
""")
def save_validation(t):
    """What is wrong with messages as save requests."""
    asked = t.conversations.select(
        "conv_id", "turn", F.col("text").alias("content"), F.when(F.col("role") != "system", F.lit("p")).otherwise(" ").alias("palace"),
        F.lit("w").alias("wing"), F.when(F.col("turn") != 5, "h").alias("hall"), F.lit("r").alias("room"), F.lit("c").alias("closet"),
        F.when(F.length("text") % 11 != 0, "t").alias("topic"), (F.col("conv_id") % 7).cast("string").alias("importance"),
    )
    return asked.select("conv_id", "turn", saving.save_error(asked).alias("error"))


@query("argument_coercion", """
SELECT event_id, TRY_CAST(CASE WHEN event_type = 'view' THEN event_type ELSE CAST(user_id AS VARCHAR) END AS BIGINT) AS limit_n,
       TRY_CAST(CASE WHEN event_type = 'error' THEN 'x' || value ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS threshold
FROM events
""")
def argument_coercion(t):
    """Numbers that came as text."""
    asked = t.events.select(
        "event_id", F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(F.col("user_id").cast("string")).alias("limit_n"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("x"), F.col("value").cast("string"))).otherwise(F.col("value").cast("string")).alias("threshold"),
    )
    return saving.coerce(asked, {"limit_n": "integer", "threshold": "number"})


_SAVED_SQL = f"""
WITH requests AS (
  SELECT conv_id * 1000 + turn AS seq, text AS content, role AS wing, 'turn' || turn AS room, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM conversations),
fresh AS (
  SELECT * FROM requests r WHERE bare <> '' AND wing <> ''
  AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.lang = 'en' AND trim(d.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = r.bare)
  QUALIFY row_number() OVER (PARTITION BY bare ORDER BY seq) = 1),
{routed_sql("SELECT seq AS id, concat_ws(chr(10), content, wing, 'talk', room, 'all') AS body FROM fresh",
            "SELECT lang AS name, '' AS description, lang AS scope, '' AS l0_body, [lang] AS keys, count(*) AS usage_count FROM documents GROUP BY lang",
            ("name", "description", "scope", "l0_body"))},
best AS (SELECT id, max(name) FILTER (rank = 1) AS best, max(score) FILTER (rank = 1) AS best_score, max(score) FILTER (name = 'en') AS own FROM ranked GROUP BY id),
judged AS (SELECT *, best <> 'en' AND best_score >= 0.05 AND best_score - own >= 0.02 AS review FROM best)
SELECT seq, 'dra_' || left(md5(left(content, 100) || '2026-01-01T00:00:00Z' || '#' || seq), 12) AS original_id, wing AS wing_name, room AS room_name,
       best AS routing_best_palace, review AS needs_review,
       CASE WHEN review THEN 'explicit_palace_differs_from_semantic_best_match' ELSE 'explicit_palace_confirmed' END AS routing_reason
FROM fresh JOIN judged ON id = seq
"""


@query("save_batch", _SAVED_SQL)
def save_batch(t):
    """Messages filed as drawers: answers with routing, after duplicates and errors."""
    known = t.documents.groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("usage_count")).select(
        "name", F.lit("").alias("description"), F.array(F.col("name")).alias("keywords"), F.col("name").alias("scope"),
        F.lit("").alias("l0_body"), "usage_count",
    )
    from loci.functions.vectors import embed
    known = known.withColumn("vector", embed(F.col("scope")))
    asked = t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit("en").alias("palace"), F.col("text").alias("content"),
        F.col("role").alias("wing"), F.lit("talk").alias("hall"), F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("room"),
        F.lit("all").alias("closet"), F.col("role").alias("topic"), F.lit(3).alias("importance"),
    )
    stored = w.drawers(t).select("palace", "document")
    saved = saving.save_batch(asked, stored, known, version=1, now="2026-01-01T00:00:00Z")
    return saved.log.select("seq", "original_id", "wing_name", "room_name", "routing_best_palace", "needs_review", "routing_reason")


@query("user_message_counts", """
SELECT conv_id, count(*) AS user_messages, count(*) // 2 AS saves_due FROM conversations WHERE role = 'user' GROUP BY conv_id
""")
def user_message_counts(t):
    """Saves due per conversation, one every two user messages."""
    from loci.streaming.counters import saves_due

    return saves_due(t.conversations.select("conv_id", "role", F.col("text").alias("content")), "conv_id", every=2)


@query("event_sessions", """
WITH a AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
b AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM a)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events FROM b GROUP BY user_id, n
""")
def event_sessions(t):
    """Events of a user without a break of more than six hours."""
    from loci.streaming.sessions import sessions

    return sessions(t.events, "user_id", "ts", 6 * 3600)
