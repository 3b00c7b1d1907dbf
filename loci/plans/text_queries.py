"""Queries on chunks, transcripts, rooms, memory types, entities, dates and chat formats."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.functions import text as tx
from loci.operators import chunking, classify, entities, registry, relations, transcripts
from loci.plans import workload as w
from loci.plans.catalog import query
from loci.plans.retrieval_queries import hashed_sql
from loci.plans.workload import Tables, sql_text
from loci.sources import chat, gitignore

_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


# --- chunks ----------------------------------------------------------------------------------


def _chunk_sql(source: str, before: str = "") -> str:
    """Chunks (doc_id, content, chunk_index) of texts (doc_id, t) without blanks at their ends."""
    return f"""
WITH RECURSIVE {before}doc AS ({source}),
step AS (
  SELECT doc_id, t, CAST(0 AS BIGINT) AS pos0, CAST(-1 AS BIGINT) AS stop, CAST(0 AS BIGINT) AS n FROM doc WHERE t <> ''
  UNION ALL
  SELECT doc_id, t, CASE WHEN stop < 0 THEN 0 ELSE stop - 100 END,
    CASE WHEN b + 800 >= length(t) THEN length(t)
         WHEN pp > b + 400 THEN pp WHEN lp > b + 400 THEN lp ELSE b + 800 END, n + 1
  FROM (SELECT *, b + 802 - CASE WHEN strpos(reverse(substr(t, b + 1, 802)), chr(10) || chr(10)) > 0 THEN strpos(reverse(substr(t, b + 1, 802)), chr(10) || chr(10)) + 1 ELSE 99999999 END AS pp,
               b + 801 - CASE WHEN strpos(reverse(substr(t, b + 1, 801)), chr(10)) > 0 THEN strpos(reverse(substr(t, b + 1, 801)), chr(10)) ELSE 99999999 END AS lp
        FROM (SELECT *, CASE WHEN stop < 0 THEN 0 ELSE stop - 100 END AS b FROM step WHERE stop < length(t))))
SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_index
FROM (SELECT doc_id, n, trim(substr(t, pos0 + 1, stop - pos0), {_BLANKS}) AS content FROM step WHERE n > 0) WHERE length(content) >= 50
"""


@query("chunk_text", _chunk_sql(f"SELECT doc_id, trim(text, {_BLANKS}) AS t FROM documents"))
def chunk_text(t):
    """Every document cut into drawers of about 800 characters."""
    out = chunking.chunk_text(t.documents.select("doc_id", F.col("text").alias("document")))
    return out.select("doc_id", "content", F.col("chunk_index").cast("bigint").alias("chunk_index"))


@query("chunk_exchanges", f"""
WITH {w.TRANSCRIPTS_SQL},
ln AS (SELECT doc_id, UNNEST(string_split(document, chr(10))) AS raw, generate_subscripts(string_split(document, chr(10)), 1) AS n FROM transcripts),
l2 AS (SELECT doc_id, n, trim(raw, {_BLANKS}) AS line FROM ln),
l3 AS (SELECT *, sum(CASE WHEN starts_with(line, '>') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS grp,
              sum(CASE WHEN starts_with(line, '>') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS quoted FROM l2),
l4 AS (SELECT *, min(CASE WHEN starts_with(line, '---') THEN n END) OVER (PARTITION BY doc_id, grp) AS rule FROM l3),
l5 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp ORDER BY n) AS k FROM l4 WHERE grp > 0 AND quoted >= 3 AND line <> '' AND (rule IS NULL OR n < rule)),
ex AS (SELECT doc_id, grp, max(CASE WHEN k = 1 THEN line END) AS q, string_agg(line, ' ' ORDER BY n) FILTER (k >= 2) AS a FROM l5 GROUP BY doc_id, grp),
pa AS (SELECT doc_id, UNNEST(string_split(document, chr(10) || chr(10))) AS p0, generate_subscripts(string_split(document, chr(10) || chr(10)), 1) AS i FROM transcripts),
pt AS (SELECT doc_id, i, trim(p0, {_BLANKS}) AS p FROM pa),
kind AS (SELECT l.doc_id, max(quoted) AS quoted, max(n) AS total, (SELECT count(*) FROM pt WHERE pt.doc_id = l.doc_id AND p <> '') AS paras FROM l3 l GROUP BY l.doc_id),
parts AS (
  SELECT doc_id, grp AS ord, CASE WHEN coalesce(a, '') <> '' THEN q || chr(10) || a ELSE q END AS content FROM ex
  UNION ALL SELECT doc_id, i, p FROM pt JOIN kind USING (doc_id) WHERE quoted < 3 AND NOT (paras <= 1 AND total > 20)
  UNION ALL SELECT doc_id, (n - 1) // 25, trim(string_agg(raw, chr(10) ORDER BY n), {_BLANKS}) FROM ln JOIN kind USING (doc_id)
            WHERE quoted < 3 AND paras <= 1 AND total > 20 GROUP BY doc_id, (n - 1) // 25)
SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS chunk_index FROM parts WHERE length(content) > 30
""")
def chunk_exchanges(t):
    """Transcripts cut into a user line with its answer."""
    out = chunking.chunk_exchanges(w.transcripts(t))
    return out.select("doc_id", "content", F.col("chunk_index").cast("bigint").alias("chunk_index"))


# --- messages and sessions -----------------------------------------------------------------------

_PAIRS = """
WITH kept AS (SELECT conv_id, turn, role, text, lead(role) OVER c AS next_role, lead(text) OVER c AS next_text, lag(role) OVER c AS prev_role
              FROM conversations WHERE role IN ('user', 'assistant') WINDOW c AS (PARTITION BY conv_id ORDER BY turn)),
blocks AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text END AS user_text,
                  CASE WHEN role = 'assistant' THEN text WHEN next_role = 'assistant' THEN next_text END AS assistant_text
           FROM kept WHERE NOT (role = 'assistant' AND coalesce(prev_role, '') = 'user'))
"""


def _messages(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role", F.col("text").alias("content"))


@query("message_pairing", _PAIRS + "SELECT * FROM blocks")
def message_pairing(t):
    """User messages with the answer right after them."""
    return transcripts.pair_messages(_messages(t))


@query("transcript_blocks", _PAIRS + f"""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS chunk_index, content
FROM (SELECT conv_id, turn, concat_ws(chr(10), '> ' || user_text, assistant_text) AS content FROM blocks) WHERE length(trim(content, {_BLANKS})) > 30
""")
def transcript_blocks(t):
    """The same in transcript form, numbered per conversation."""
    return transcripts.number_blocks(transcripts.pair_messages(_messages(t)))


_HEADER = fixed.SESSION_HEADER
_MEGA_SQL = f"""
mega AS (SELECT doc_id, replace(replace(replace(text, ' ', chr(10)), ',' || chr(10),
  chr(10) || '{_HEADER}1.0' || chr(10) || '⏺ 9:05 AM Monday, March 30, 2026' || chr(10) || '> Fix the build for Sam, please!' || chr(10)),
  chr(10) || 'of' || chr(10), chr(10) || 'Ctrl+E to show previous messages' || chr(10)) AS content FROM documents),
ln AS (SELECT doc_id, UNNEST(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS n FROM mega),
cnt AS (SELECT doc_id, CASE WHEN max(n) IS NOT NULL AND arg_max(line, n) = '' THEN max(n) ELSE max(n) + 1 END AS total FROM ln GROUP BY doc_id),
hit AS (SELECT doc_id, n FROM (SELECT doc_id, n, line, bool_or(contains(line, 'Ctrl+E') OR contains(line, 'previous messages'))
          OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS restored FROM ln) WHERE contains(line, '{_HEADER}') AND NOT restored),
span AS (SELECT h.doc_id, h.n AS first_line, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.n) AS part,
                lead(h.n, 1) OVER (PARTITION BY h.doc_id ORDER BY h.n) AS nxt, count(*) OVER (PARTITION BY h.doc_id) AS sessions FROM hit h)
"""


@query("session_boundaries", f"""
WITH {_MEGA_SQL}
SELECT s.doc_id, part, first_line, coalesce(nxt, total) - first_line AS line_count FROM span s JOIN cnt USING (doc_id)
WHERE sessions >= 2
""")
def session_boundaries(t):
    """Sessions inside long transcripts."""
    out = transcripts.split_sessions(_mega(t))
    return out.select(
        F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("doc_id"), F.col("part").cast("bigint").alias("part"),
        F.col("first_line").cast("bigint").alias("first_line"), F.col("line_count").cast("bigint").alias("line_count"),
    )


def _mega(t: Tables) -> DataFrame:
    header = f"\n{_HEADER}1.0\n⏺ 9:05 AM Monday, March 30, 2026\n> Fix the build for Sam, please!\n"
    text = F.replace(F.replace("text", F.lit(" "), F.lit("\n")), F.lit(",\n"), F.lit(header))
    text = F.replace(text, F.lit("\nof\n"), F.lit("\nCtrl+E to show previous messages\n"))
    return t.documents.select(F.concat(F.lit("log "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), text.alias("content"))


@query("session_figures", """
SELECT doc_id, CASE WHEN contains(text, ', ') THEN '2026-03-30_905AM' END AS stamp, '> Fix the build for ' || source || ', please & now!' AS prompt,
       left(regexp_replace(trim(regexp_replace('Fix the build for ' || source || ', please & now!', '[^A-Za-z0-9_\\s-]', '', 'g')), '\\s+', '-', 'g'), 60) AS subject,
       CASE WHEN lang = 'en' THEN 'Sam' ELSE 'Alice,Sam' END AS people
FROM documents
""")
def session_figures(t):
    """Timestamp, people and subject of a session's lines."""
    prompt = F.concat(F.lit("> Fix the build for "), "source", F.lit(", please & now!"))
    docs = t.documents.withColumn("prompt", prompt)
    lines = F.array(
        F.lit("> cd work"), F.when(F.contains("text", F.lit(", ")), F.lit("⏺ 9:05 AM Monday, March 30, 2026")).otherwise(F.lit("none")),
        F.lit("hello sam"), F.when(F.col("lang") == "en", F.lit("bens book")).otherwise(F.lit("said Alice.")), F.col("prompt"),
    )
    docs = docs.withColumn("lines", lines)
    return docs.select(
        "doc_id", transcripts.session_timestamp(F.col("lines"))["human"].alias("stamp"), "prompt",
        transcripts.session_subject(F.col("lines")).alias("subject"), F.array_join(transcripts.session_people(F.col("lines")), ",").alias("people"),
    )


# --- topics, rooms ---------------------------------------------------------------------------------


def _convo_sql(text: str, topics=fixed.CONVO_TOPICS) -> str:
    scores = [
        f"{{'s': -({' + '.join(f'CAST(contains({text}, {sql_text(k)}) AS INT)' for k in words)}), 'i': {i}, 'n': '{room}'}}"
        for i, (room, words) in enumerate(topics.items())
    ]
    best = f"list_sort([{', '.join(scores)}])[1]"
    return f"CASE WHEN ({best}).s < 0 THEN ({best}).n ELSE 'general' END"


@query("convo_room", f"WITH {w.NOTES_SQL} SELECT event_id, {_convo_sql('lower(note)')} AS room FROM notes")
def convo_room(t):
    """Topic of every note."""
    return w.notes(t).select("event_id", classify.convo_room(F.col("note"), window=None).alias("room"))


@query("hall_of", f"WITH {w.NOTES_SQL} SELECT event_id, {_convo_sql('lower(note)', fixed.HALL_KEYWORDS)} AS hall FROM notes")
def hall_of(t):
    """Hall of every note by the configured keywords."""
    return w.notes(t).select("event_id", classify.hall_of(F.col("note")).alias("hall"))


_ROOMS = [
    {"name": "weblog", "keywords": ["blog"]}, {"name": "french", "keywords": ["fr"]}, {"name": "spanish", "keywords": ["es"]},
    {"name": "Deals", "keywords": ["page", "nav"]}, {"name": "tion", "keywords": ["ti"]},
]


def _room_sql(rooms: list[dict]) -> str:
    def over(a, b):
        return f"(contains({a}, {sql_text(b)}) OR contains({sql_text(b)}, {a}))"

    def hit(part):
        return "CASE " + " ".join(
            "WHEN " + " OR ".join(over(part, k.lower()) for k in [r["name"], *r["keywords"]]) + f" THEN '{r['name']}'" for r in rooms
        ) + " END"

    def count(k):
        return f"(length(txt) - length(replace(txt, {sql_text(k.lower())}, ''))) // {len(k)}"

    scores = ", ".join(
        f"{{'s': -({' + '.join(count(k) for k in [*r['keywords'], r['name']])}), 'i': {i}, 'n': '{r['name']}'}}" for i, r in enumerate(rooms)
    )
    names = "CASE " + " ".join(f"WHEN {over('stem', r['name'].lower())} THEN '{r['name']}'" for r in rooms) + " END"
    return f"""
WITH {w.FILES_SQL},
p AS (SELECT page_id, string_split(lower(path), '/') AS parts, lower(document) AS txt, lower(regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1')) AS stem FROM files),
d AS (SELECT *, list_filter(list_transform(parts[:len(parts) - 1], lambda x: {hit('x')}), lambda r: r IS NOT NULL)[1] AS by_folder,
             list_sort([{scores}])[1] AS best FROM p)
SELECT page_id, coalesce(by_folder, {names}, CASE WHEN best.s < 0 THEN best.n END, 'general') AS room FROM d
"""


_TONGUES = [{"name": "english", "keywords": ["en"]}, {"name": "french", "keywords": ["fr"]}, {"name": "german", "keywords": ["de"]}]


@query("chunk_pages", f"""
SELECT c.doc_id AS page_id, r.room, c.chunk_index, length(c.content) AS n_chars
FROM ({_chunk_sql(f"SELECT page_id AS doc_id, trim(html, {_BLANKS}) AS t FROM pages")}) c JOIN ({_room_sql(_TONGUES)}) r ON r.page_id = c.doc_id
""")
def chunk_pages(t):
    """Every page cut into drawers, per room of its path."""
    docs = w.files(t).withColumn("room", classify.detect_room(F.col("path"), F.col("document"), _TONGUES))
    out = chunking.chunk_text(docs)
    return out.select("page_id", "room", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.length("content").cast("bigint").alias("n_chars"))


@query("detect_room", _room_sql(_ROOMS))
def detect_room(t):
    """Room of every page: by folder, by name, by keywords."""
    return w.files(t).select("page_id", classify.detect_room(F.col("path"), F.col("document"), _ROOMS, window=None).alias("room"))


_FOLDERS = ("docs", "api", "front-end", "node_modules", "Random Stuff", "qa", "x1")


@query("rooms_from_folders", f"""
WITH dirs AS (SELECT DISTINCT n_name AS project, lower(c_mktsegment) AS top, list_value({', '.join(f"'{x}'" for x in _FOLDERS)})[CAST(c_custkey % 7 + 1 AS INT)] AS sub
              FROM customer JOIN nation ON c_nationkey = n_nationkey),
every AS (SELECT DISTINCT project, 1 AS depth, CASE WHEN sub IN ('docs', 'x1') THEN sub ELSE top END AS dir, CASE WHEN sub IN ('docs', 'x1') THEN sub ELSE top END AS path FROM dirs
          UNION SELECT DISTINCT project, 2, sub, top || '/' || sub FROM dirs WHERE sub NOT IN ('docs', 'x1')),
map AS (SELECT * FROM (VALUES ('docs', 'documentation'), ('api', 'backend'), ('front_end', 'frontend'), ('qa', 'testing')) m(k, v)),
named AS (SELECT e.*, coalesce(m.v, CASE WHEN depth = 1 AND length(dir) > 2 THEN replace(replace(lower(dir), '-', '_'), ' ', '_') END) AS name
          FROM every e LEFT JOIN map m ON m.k = replace(lower(dir), '-', '_') WHERE dir <> 'node_modules'),
firsts AS (SELECT project, name, arg_min(dir, (depth, path)) AS dir FROM named WHERE name IS NOT NULL GROUP BY ALL)
SELECT project, name, 'Files from ' || dir || '/' AS description, name || ',' || lower(dir) AS keywords FROM firsts
UNION ALL SELECT DISTINCT project, 'general', 'Files that don''t fit other rooms', '' FROM dirs
""")
def rooms_from_folders(t):
    """Rooms of projects (one per nation) from their folders."""
    sub = F.element_at(F.array(*[F.lit(x) for x in _FOLDERS]), (F.col("c_custkey") % 7 + 1).cast("int"))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("project"), F.lower("c_mktsegment").alias("top"), sub.alias("sub")
    )
    alone = F.col("sub").isin("docs", "x1")
    paths = F.when(alone, F.array("sub")).otherwise(F.array("top", F.concat_ws("/", "top", "sub")))
    found = classify.rooms_from_folders(rows.select("project", F.explode(paths).alias("path")))
    return found.select("project", "name", "description", F.array_join("keywords", ",").alias("keywords"))


@query("rooms_from_files", """
WITH f AS (SELECT n_name AS project, replace(replace(lower(c_mktsegment || '-' || list_value('api test', 'meeting notes', 'plan', 'cost', 'readme')[CAST(c_custkey % 5 + 1 AS INT)] || c_custkey), '-', '_'), ' ', '_') AS name
           FROM customer JOIN nation ON c_nationkey = n_nationkey),
map AS (SELECT * FROM (VALUES """ + ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(fixed.FOLDER_ROOMS.items())) + """) m(k, room, ord)),
c AS (SELECT project, room, count(*) AS n, min(ord) AS ord FROM f JOIN map ON contains(name, k) GROUP BY ALL HAVING count(*) >= 2)
SELECT project, room AS name, n FROM c
""")
def rooms_from_files(t):
    """Rooms of projects from words in their file names."""
    word = F.element_at(F.array(*[F.lit(x) for x in ("api test", "meeting notes", "plan", "cost", "readme")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("project"), F.concat(F.col("c_mktsegment"), F.lit("-"), word, F.col("c_custkey").cast("string")).alias("path")
    )
    return classify.rooms_from_files(rows).where("n > 0").select("project", "name", "n")


# --- memory types ------------------------------------------------------------------------------------


def _re2(patterns, text: str) -> str:
    return " + ".join(f"len(regexp_extract_all({text}, {sql_text(p)}))" for p in patterns)


_MARKS = f"WITH {w.NOTES_SQL}, m AS (SELECT event_id, note, " + ", ".join(
    f"{_re2(ps, 'lower(note)')} AS {k}_score" for k, ps in fixed.MEMORY_MARKERS.items()
) + " FROM notes)\n"


@query("marker_counts", _MARKS + "SELECT event_id, " + ", ".join(f"CAST({k}_score AS BIGINT) AS {k}_score" for k in fixed.MEMORY_MARKERS) + " FROM m")
def marker_counts(t):
    """Marker hits of every note per memory type."""
    rows = w.notes(t).withColumns({f"{k}_score": s.cast("bigint") for k, s in classify.marker_scores(F.col("note")).items()})
    return rows.select("event_id", *[f"{k}_score" for k in fixed.MEMORY_MARKERS])


_WORDS = "list_distinct(regexp_extract_all(lower(note), '[A-Za-z0-9_]+'))"


def _list(words) -> str:
    return "[" + ", ".join(sql_text(x) for x in words) + "]"


_MOOD = f"""CASE WHEN len(list_intersect({_WORDS}, {_list(fixed.POSITIVE_WORDS)})) > len(list_intersect({_WORDS}, {_list(fixed.NEGATIVE_WORDS)})) THEN 'positive'
 WHEN len(list_intersect({_WORDS}, {_list(fixed.POSITIVE_WORDS)})) < len(list_intersect({_WORDS}, {_list(fixed.NEGATIVE_WORDS)})) THEN 'negative' ELSE 'neutral' END"""
_RESOLVED = "regexp_matches(lower(note), " + sql_text("|".join(f"(?:{p})" for p in fixed.RESOLUTION_PATTERNS)) + ")"


@query("sentiment", f"WITH {w.NOTES_SQL} SELECT event_id, {_MOOD} AS mood, {_RESOLVED} AS resolved FROM notes")
def sentiment(t):
    """Mood of every note, and whether it tells of a solution."""
    return w.notes(t).select("event_id", classify.sentiment(F.col("note")).alias("mood"), classify.has_resolution(F.col("note")).alias("resolved"))


_CODE = " OR ".join(f"regexp_matches(line, {sql_text(p)})" for p in fixed.CODE_LINE_PATTERNS)
_PROSE_SQL = f"""
seg AS (SELECT event_id, trim(UNNEST(string_split(note, chr(10) || chr(10))), {_BLANKS}) AS segment,
               generate_subscripts(string_split(note, chr(10) || chr(10)), 1) AS pos FROM notes),
pl AS (SELECT event_id, pos, segment, UNNEST(string_split(segment, chr(10))) AS raw, generate_subscripts(string_split(segment, chr(10)), 1) AS n FROM seg WHERE segment <> ''),
pf AS (SELECT *, trim(raw, {_BLANKS}) AS line, starts_with(trim(raw, {_BLANKS}), '```') AS fence FROM pl),
pg AS (SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY event_id, pos ORDER BY n) % 2 = 1 AS inside FROM pf),
pk AS (SELECT event_id, pos, any_value(segment) AS segment, string_agg(raw, chr(10) ORDER BY n) FILTER (NOT fence AND NOT inside AND NOT (
         line <> '' AND ({_CODE} OR (length(line) > 10 AND length(regexp_replace(line, '[^a-zA-Z]', '', 'g')) < 0.4 * length(line))))) AS kept FROM pg GROUP BY ALL),
prose AS (SELECT event_id, pos, segment, coalesce(nullif(trim(coalesce(kept, ''), {_BLANKS}), ''), segment) AS note FROM pk)
"""


@query("code_line_filter", f"WITH {w.NOTES_SQL}, {_PROSE_SQL} SELECT event_id, pos, note AS prose FROM prose")
def code_line_filter(t):
    """The prose of every paragraph of a note."""
    segs = w.notes(t).select("event_id", F.posexplode(tx.paragraphs(F.col("note"))).alias("i", "segment"))
    return segs.select("event_id", (F.col("i") + 1).cast("bigint").alias("pos"), classify.prose(F.col("segment")).alias("prose"))


@query("memory_type", f"WITH {w.NOTES_SQL}, {_PROSE_SQL}, m AS (SELECT event_id, pos, segment, note, " + ", ".join(
    f"{_re2(ps, 'lower(note)')} AS {k}" for k, ps in fixed.MEMORY_MARKERS.items()
) + f""" FROM prose WHERE length(segment) >= 20),
b AS (SELECT *, list_sort([{', '.join(f"{{'s': -{k}, 'i': {i}, 'n': '{k}'}}" for i, k in enumerate(fixed.MEMORY_MARKERS))}])[1] AS best, {_MOOD} AS mood, {_RESOLVED} AS resolved FROM m),
c AS (SELECT *, least(1.0, (-best.s + CASE WHEN length(segment) > 500 THEN 2 WHEN length(segment) > 200 THEN 1 ELSE 0 END) / 5.0) AS confidence FROM b WHERE best.s < 0)
SELECT event_id, segment AS content, row_number() OVER (PARTITION BY event_id ORDER BY pos) - 1 AS chunk_index, confidence,
  CASE WHEN best.n <> 'problem' THEN best.n WHEN resolved AND emotional > 0 AND mood = 'positive' THEN 'emotional' WHEN resolved THEN 'milestone'
       WHEN mood = 'positive' AND milestone > 0 THEN 'milestone' WHEN mood = 'positive' AND emotional > 0 THEN 'emotional' ELSE 'problem' END AS memory_type
FROM c WHERE confidence >= 0.3
""")
def memory_type(t):
    """Typed memories of every note."""
    out = classify.extract_memories(w.notes(t).select("event_id", "note"), "note", "event_id")
    return out.select("event_id", "content", F.col("chunk_index").cast("bigint").alias("chunk_index"), "confidence", "memory_type")


# --- entities -------------------------------------------------------------------------------------------


def _candidate_sql() -> str:
    return f"""
WITH s AS (SELECT doc_id, UNNEST(regexp_extract_all(text, '\\b([A-Z][a-z]{{1,19}})\\b')) AS name FROM documents),
m AS (SELECT doc_id, UNNEST(regexp_extract_all(text, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+)\\b')) AS name FROM documents),
n AS (SELECT doc_id, name FROM s WHERE NOT list_contains(stop.w, lower(name))
      UNION ALL SELECT doc_id, name FROM m WHERE len(list_intersect(regexp_split_to_array(lower(name), '\\s+'), stop.w)) = 0)
SELECT doc_id, name, count(*) AS frequency FROM n GROUP BY ALL HAVING count(*) >= 3
""".replace("stop.w", "STOPLIST")


@query("entity_candidates", _candidate_sql().replace("STOPLIST", _list(fixed.STOPWORDS)))
def entity_candidates(t):
    """Capitalised names seen at least three times in a document."""
    docs = t.documents.select("doc_id", F.col("text").alias("document"))
    return entities.candidates(docs, by=("doc_id",))


_STORY_SQL = """
story AS (
  SELECT c_custkey AS id, upper(left(w, 1)) || substr(w, 2) AS name,
    CASE c_custkey % 5
      WHEN 0 THEN N || ' said hello. Hey ' || N || ', thanks! ' || N || ' told her story.' || chr(10) || N || ': I think she knows.' || chr(10) || 'He likes ' || N
      WHEN 1 THEN 'We built ' || N || ' and shipped ' || N || ' v2.' || chr(10) || 'Run pip install ' || N || ' or import ' || N || ', see ' || N || '.py and ' || N || '-core'
      WHEN 2 THEN N || ' here.' || chr(10) || 'they met ' || N || chr(10) || chr(10) || chr(10) || N || ' there'
      WHEN 3 THEN 'A ' || N || ', a ' || N || ', one more ' || N || ' ' || c_acctbal
      ELSE N || ' wrote the ' || N || ' architecture.' || chr(10) || 'deploying ' || N || ' with dear ' || N || ' and the ' || N || ' system' END AS document
  FROM (SELECT *, lower(c_mktsegment) AS w, upper(left(lower(c_mktsegment), 1)) || substr(lower(c_mktsegment), 2) AS N FROM customer))
"""


def _stories(t: Tables) -> DataFrame:
    n = F.initcap(F.lower("c_mktsegment"))

    def made(text: str):
        parts = [p for p in re.split(r"(\{N\}|\{B\})", text) if p]
        return F.concat(*[n if p == "{N}" else F.col("c_acctbal").cast("string") if p == "{B}" else F.lit(p) for p in parts])

    kind = F.col("c_custkey") % 5
    text = (
        F.when(kind == 0, made("{N} said hello. Hey {N}, thanks! {N} told her story.\n{N}: I think she knows.\nHe likes {N}"))
        .when(kind == 1, made("We built {N} and shipped {N} v2.\nRun pip install {N} or import {N}, see {N}.py and {N}-core"))
        .when(kind == 2, made("{N} here.\nthey met {N}\n\n\n{N} there")).when(kind == 3, made("A {N}, a {N}, one more {N} {B}"))
        .otherwise(made("{N} wrote the {N} architecture.\ndeploying {N} with dear {N} and the {N} system"))
    )
    return t.customer.select(F.col("c_custkey").alias("id"), n.alias("name"), text.alias("document"))


def _named_count(pattern: str, flags: str = "i") -> str:
    left, *rest = pattern.split("{name}")
    joined = " || name || ".join([sql_text(f"(?{flags})" + left), *[sql_text(r) for r in rest]])
    return f"len(regexp_extract_all(document, {joined}))"


_PRONOUN_SQL = r"'\b(she|her|hers|he|him|his|they|them|their)\b'"
_SEEN = "len(regexp_extract_all(document, '\\b' || name || '\\b'))"


def _score_sql(story: str, seen: str = _SEEN) -> str:
    """Scores of the names of stories (id, name, document)."""
    return f"""
WITH {story},
sl AS (SELECT id, name, UNNEST(string_split(document, chr(10))) AS line, generate_subscripts(string_split(document, chr(10)), 1) AS n FROM story),
near AS (SELECT id, contains(lower(line), lower(name)) AS has, bool_or(regexp_matches(lower(line), {_PRONOUN_SQL})) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS pron FROM sl),
ph AS (SELECT id, count(*) FILTER (has AND pron) AS pronouns FROM near GROUP BY id),
sc AS (SELECT story.id, name, document,
  [{', '.join(_named_count(p, 'mi') for p in fixed.DIALOGUE_PATTERNS)}] AS dia, [{', '.join(_named_count(p) for p in fixed.PERSON_VERB_PATTERNS)}] AS verbs,
  [{', '.join(_named_count(p) for p in fixed.PROJECT_VERB_PATTERNS)}] AS proj, pronouns, {_named_count(fixed.DIRECT_PATTERN)} AS direct,
  {_named_count(fixed.VERSIONED_PATTERN)} AS vers, {_named_count(fixed.CODE_REF_PATTERN)} AS code,
  {seen} AS frequency FROM story JOIN ph USING (id)),
s2 AS (SELECT *, list_sum(dia) * 3 + list_sum(verbs) * 2 + pronouns * 2 + direct * 4 AS ps, list_sum(proj) * 2 + vers * 3 + code * 3 AS js,
  list_concat(list_transform(list_filter(dia, lambda x: x > 0), lambda x: 'dialogue'), list_transform(list_filter(verbs, lambda x: x > 0), lambda x: 'action'),
    CASE WHEN pronouns > 0 THEN ['pronoun'] ELSE [] END, CASE WHEN direct > 0 THEN ['addressed'] ELSE [] END) AS kinds FROM sc WHERE frequency >= 3)
"""


_SCORE_SQL = _score_sql(_STORY_SQL)
_DOC_STORIES = f"""
story AS (SELECT c.doc_id || ':' || c.name AS id, c.doc_id, c.name, c.frequency, d.text AS document
          FROM ({_candidate_sql().replace("STOPLIST", _list(fixed.STOPWORDS))}) c JOIN documents d USING (doc_id))
"""


@query("entity_signals", _SCORE_SQL + "SELECT id, name, frequency, CAST(ps AS BIGINT) AS person_score, CAST(js AS BIGINT) AS project_score FROM s2")
def entity_signals(t):
    """Person and project scores of the names in little stories."""
    out = entities.detect_entities(_stories(t).drop("name"), key="id")
    return out.select("id", "name", "frequency", F.col("person_score").cast("bigint").alias("person_score"), F.col("project_score").cast("bigint").alias("project_score"))


_CLASS_SQL = """
SELECT id, name, CASE WHEN ps + js = 0 THEN 'uncertain' WHEN ps / (ps + js) >= 0.7 AND len(list_distinct(kinds)) >= 2 AND ps >= 5 THEN 'person'
   WHEN ps / (ps + js) >= 0.7 THEN 'uncertain' WHEN ps / (ps + js) <= 0.3 THEN 'project' ELSE 'uncertain' END AS type,
 floor(100 * CASE WHEN ps + js = 0 THEN least(0.4, frequency / 50) WHEN ps / (ps + js) >= 0.7 AND len(list_distinct(kinds)) >= 2 AND ps >= 5 THEN least(0.99, 0.5 + ps / (ps + js) * 0.5)
   WHEN ps / (ps + js) >= 0.7 THEN 0.4 WHEN ps / (ps + js) <= 0.3 THEN least(0.99, 0.5 + (1 - ps / (ps + js)) * 0.5) ELSE 0.5 END + 0.5) / 100 AS confidence
FROM s2
"""


@query("entity_classes", _SCORE_SQL + _CLASS_SQL)
def entity_classes(t):
    """Person, project or uncertain, with confidence."""
    return entities.detect_entities(_stories(t).drop("name"), key="id").select("id", "name", "type", "confidence")


@query("best_entities", _score_sql(_DOC_STORIES, "story.frequency") + f"""
, typed AS ({_CLASS_SQL.replace("SELECT id, name,", "SELECT id, name, frequency,", 1)}),
named AS (SELECT *, CAST(split_part(id, ':', 1) AS BIGINT) AS original_id FROM typed)
SELECT original_id, name, type, confidence, frequency,
       row_number() OVER (PARTITION BY original_id, type ORDER BY CASE WHEN type = 'uncertain' THEN CAST(frequency AS DOUBLE) ELSE confidence END DESC, frequency DESC, name) AS position
FROM named
""")
def best_entities(t):
    """The report of the surest entities per document."""
    found = entities.detect_entities(t.documents.select(F.col("doc_id").alias("original_id"), F.col("text").alias("document")))
    return entities.best_entities(found).select("original_id", "name", "type", "confidence", "frequency", "position")


# --- registry ----------------------------------------------------------------------------------------------


_SAID = {
    0: "{N} said it was late and I went with {N}", 1: "have you {N} seen it? if you {N} again", 2: "{N} again and with {N}", 3: "nothing about it",
}
_WHO = ("Grace", "Max", "Riley", "Atlas", "rose")


def _said_sql() -> str:
    whens = " ".join(
        f"WHEN {k} THEN " + " || ".join(sql_text(p) if p != "{N}" else "word" for p in re.split(r"(\{N\})", v) if p) for k, v in _SAID.items()
    )
    return f"""
said AS (SELECT event_id, word, CASE event_id % 4 {whens} END AS context
         FROM (SELECT event_id, list_value({', '.join(f"'{x}'" for x in _WHO)})[CAST(user_id % 5 + 1 AS INT)] AS word FROM events))
"""


def _said(t: Tables) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(x) for x in _WHO]), (F.col("user_id") % 5 + 1).cast("int"))
    rows = t.events.select("event_id", word.alias("word"))
    text = F.lit("")
    for k, v in _SAID.items():
        text = F.when(F.col("event_id") % 4 == k, F.concat(*[F.lit(p) if p != "{N}" else F.col("word") for p in re.split(r"(\{N\})", v) if p])).otherwise(text)
    return rows.withColumn("context", text)


def _people(t: Tables) -> tuple[DataFrame, DataFrame]:
    spark = t.spark
    people = registry.seed_people(
        spark.createDataFrame([("Grace", "sister", "personal", 1), ("Maxwell", "boss", "work", 2), ("Rose", None, None, 3)], "name string, relationship string, context string, ord bigint"),
        spark.createDataFrame([("Max", "Maxwell")], "alias string, canonical string"),
    )
    return people, spark.createDataFrame([("Atlas", 1)], "name string, ord bigint")


def _hits_sql(patterns) -> str:
    made = []
    for p in patterns:
        left, *rest = p.split("{name}")
        joined = " || lower(word) || ".join([sql_text(left), *[sql_text(r) for r in rest]])
        made.append(f"CAST(regexp_matches(lower(context), {joined}) AS INT)")
    return " + ".join(made)


@query("registry_lookup", f"""
WITH {_said_sql()},
h AS (SELECT *, {_hits_sql(fixed.PERSON_CONTEXTS)} AS p, {_hits_sql(fixed.CONCEPT_CONTEXTS)} AS c, lower(word) IN ('grace', 'max', 'rose') AS known FROM said)
SELECT event_id, word, CASE WHEN known AND c > p THEN 'concept' WHEN known THEN 'person' WHEN word = 'Atlas' THEN 'project' ELSE 'unknown' END AS type,
  round(CASE WHEN known AND c > p THEN least(0.9, 0.7 + c * 0.1) WHEN known AND p > c THEN least(0.95, 0.7 + p * 0.1) WHEN known OR word = 'Atlas' THEN 1.0 ELSE 0.0 END, 6) AS confidence,
  CASE WHEN known AND c <> p THEN word WHEN word = 'Max' THEN 'Maxwell' WHEN word = 'rose' THEN 'Rose' ELSE word END AS entity_name
FROM h
""")
def registry_lookup(t):
    """What a word means in its sentence, given the registry."""
    people, projects = _people(t)
    out = registry.lookup(_said(t), people, projects)
    return out.select("event_id", "word", "type", F.round("confidence", 6).alias("confidence"), "entity_name")


@query("people_in_queries", f"""
WITH {_said_sql()},
h AS (SELECT *, {_hits_sql(fixed.PERSON_CONTEXTS)} AS p, {_hits_sql(fixed.CONCEPT_CONTEXTS)} AS c FROM said WHERE contains(context, word))
SELECT event_id AS query_id, CASE word WHEN 'Max' THEN n ELSE upper(left(word, 1)) || substr(word, 2) END AS canonical
FROM h, (SELECT UNNEST(['Max', 'Maxwell']) AS n) WHERE p > c AND lower(word) IN ('grace', 'max', 'rose') AND (word = 'Max' OR n = 'Max')
""")
def people_in_queries(t):
    """People of the registry that sentences mention."""
    people, _ = _people(t)
    return registry.people_in_queries(_said(t).select(F.col("event_id").alias("query_id"), F.col("context").alias("query")), people)


@query("unknown_candidates", f"WITH {_said_sql()} SELECT event_id AS query_id, word FROM said WHERE contains(context, word) AND word = 'Riley'")
def unknown_candidates(t):
    """Capitalised words that the registry does not know."""
    people, projects = _people(t)
    asked = _said(t).select(F.col("event_id").alias("query_id"), F.col("context").alias("query"))
    return registry.unknown_candidates(asked, people, projects)


# --- dates, segments, linking ---------------------------------------------------------------------------------

_DATED_SQL = """
dated AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CASE o_orderkey % 6 WHEN 0 THEN 'From ' || strftime(o_orderdate, '%Y/%m/%d') || ' on, until ' || strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') || '.'
    WHEN 1 THEN 'Started ' || strftime(o_orderdate, '%Y-%m-%d') || ' x' || strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN 'It was dün or mañana, he said.'
    WHEN 3 THEN 'Aujourd''hui and yesterday' WHEN 4 THEN 'no date at all' ELSE 'aujourd hui, BUGÜN' END AS note FROM orders)
"""


def _dated(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    iso = F.date_format(d, "yyyy-MM-dd")
    text = (
        F.when(k == 0, F.concat(F.lit("From "), F.date_format(d, "yyyy/MM/dd"), F.lit(" on, until "), F.date_format(F.date_add(d.cast("date"), 30), "yyyy-MM-dd"), F.lit(".")))
        .when(k == 1, F.concat(F.lit("Started "), iso, F.lit(" x"), iso)).when(k == 2, F.lit("It was dün or mañana, he said."))
        .when(k == 3, F.lit("Aujourd'hui and yesterday")).when(k == 4, F.lit("no date at all")).otherwise(F.lit("aujourd hui, BUGÜN"))
    )
    return t.orders.select("o_orderkey", iso.alias("day"), text.alias("note"))


@query("temporal_info", f"""
WITH {_DATED_SQL},
x AS (SELECT o_orderkey, day, CAST(day AS DATE) AS d, o_orderkey % 6 AS k FROM dated),
y AS (SELECT o_orderkey, day, k, CASE k WHEN 0 THEN [strftime(d + INTERVAL 30 DAY, '%Y-%m-%d'), day] WHEN 1 THEN [day] WHEN 2 THEN [strftime(d - INTERVAL 1 DAY, '%Y-%m-%d'), strftime(d + INTERVAL 1 DAY, '%Y-%m-%d')]
        WHEN 3 THEN [day, strftime(d - INTERVAL 1 DAY, '%Y-%m-%d')] WHEN 5 THEN [day] ELSE [] END AS dates FROM x)
SELECT o_orderkey, array_to_string(dates, ',') AS dates, coalesce(dates[1], day) AS valid_from, CASE WHEN len(dates) > 1 THEN dates[len(dates)] END AS ended,
       k < 2 AS has_explicit_date, k IN (2, 3, 5) AS has_relative_date FROM y
""")
def temporal_info(t):
    """Dates that sentences name or mean."""
    out = relations.with_temporal(_dated(t), "note", F.col("day"))
    return out.select("o_orderkey", F.array_join("temporal.dates", ",").alias("dates"), "temporal.valid_from", "temporal.ended", "temporal.has_explicit_date", "temporal.has_relative_date")


@query("temporal_explicit_dates", f"""
WITH {_DATED_SQL}
SELECT o_orderkey, array_to_string(list_concat(regexp_extract_all(note, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b'),
  list_transform(regexp_extract_all(note, '\\b(\\d{{4}}/\\d{{2}}/\\d{{2}})\\b'), lambda x: replace(x, '/', '-'))), ',') AS dates FROM dated
""")
def temporal_explicit(t):
    return _dated(t).select("o_orderkey", F.array_join(relations.explicit_dates(F.col("note")), ",").alias("dates"))


@query("segments", f"""
SELECT doc_id, n - 1 AS pos, segment FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, segment FROM (
    SELECT doc_id, trim(UNNEST(string_split(m, chr(1))), {_BLANKS}) AS segment, generate_subscripts(string_split(m, chr(1)), 1) AS i
    FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\\n+', chr(1), 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g') AS m FROM documents)) WHERE length(segment) >= 12)
""")
def segments(t):
    """Sentences and lines of documents."""
    return t.documents.select("doc_id", F.posexplode(relations.segments(F.col("text"))).alias("pos", "segment")).withColumn("pos", F.col("pos").cast("bigint"))


@query("normalize_text", """
SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS normalized FROM documents
""")
def normalize_text(t):
    """Documents as plain lower-case words."""
    return t.documents.select("doc_id", tx.normalize_text(F.col("text")).alias("normalized"))


_FACT_NOTES = "{S} depends on Redis. The `{B} kit` is part of the stack {S}. {S} no longer depends on Redis."


def _sentences(t: Tables) -> DataFrame:
    f = w.facts(t).where(F.col("valid_to").isNull())
    slots = {"{S}": F.replace(F.initcap("subject"), F.lit("#"), F.lit("")), "{B}": F.col("object"), "{D}": F.col("valid_from")}
    text = F.concat(*[slots.get(p, F.lit(p)) for p in re.split(r"(\{[SBD]\})", _FACT_NOTES) if p])
    return f.select(F.col("seq").alias("original_id"), text.alias("document"), F.col("valid_from").alias("filed_at"))


_BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _list_sql(values) -> str:
    return "(" + ", ".join(sql_text(v) for v in values) + ")"


def linked_sql(source: str) -> str:
    """CTEs from (id, body): ``segs`` (id, pos, segment) and ``linked`` (id, pos, ord, name, type, confidence, source)."""
    return rf"""
cut AS (SELECT id, string_split(regexp_replace(regexp_replace(body, '\n+', chr(1), 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM ({source})),
trimmed AS (SELECT id, trim(UNNEST(parts), {_BLANK_SQL}) AS segment, generate_subscripts(parts, 1) AS i FROM cut),
segs AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos, segment FROM trimmed WHERE length(segment) >= {fixed.SEGMENT_MIN}),
phrases AS (SELECT id, pos, regexp_extract_all(segment, {sql_text(fixed.QUOTED_PATTERN)}) AS found FROM segs),
words AS (SELECT id, pos, regexp_extract_all(segment, '\b({fixed.TOKEN_PATTERN})\b', 1) AS found FROM segs),
spelt AS (
  SELECT id, pos, 'quoted' AS kind, trim(substr(x, 2, length(x) - 2), {_BLANK_SQL}) AS word, i
  FROM (SELECT id, pos, UNNEST(found) AS x, generate_subscripts(found, 1) AS i FROM phrases)
  UNION ALL SELECT id, pos, 'candidate', UNNEST(found), generate_subscripts(found, 1) FROM words),
listed AS (
  SELECT id, pos, kind, word, row_number() OVER (PARTITION BY id, pos ORDER BY kind DESC, min(i)) - 1 AS spot FROM spelt
  WHERE word <> '' AND (kind = 'quoted' OR lower(word) NOT IN {_list_sql(fixed.PERSON_HINTS)}) GROUP BY id, pos, kind, word),
known AS (SELECT * FROM (VALUES ('grace', 'Grace', 'person'), ('max', 'Maxwell', 'person'), ('maxwell', 'Maxwell', 'person'), ('rose', 'Rose', 'person'), ('atlas', 'Atlas', 'project')) AS v(key, canonical, what)),
looked AS (SELECT l.*, coalesce(canonical, word) AS entity, coalesce(what, 'unknown') AS what FROM listed l LEFT JOIN known ON key = lower(word)),
typed AS (
  SELECT *, CASE WHEN what <> 'unknown' THEN what WHEN lower(entity) IN {_list_sql(fixed.TOOL_HINTS)} THEN 'tool'
      WHEN lower(entity) IN {_list_sql(fixed.ORG_SUFFIXES)} OR regexp_matches(lower(entity), ' (?:{"|".join(fixed.ORG_SUFFIXES)})$') THEN 'org'
      WHEN regexp_matches(lower(entity), '{fixed.PROJECT_WORDS}') THEN 'project'
      WHEN regexp_matches(entity, '\b[A-Z][a-z]+\b') AND len(regexp_split_to_array(entity, '\s+')) <= 3 THEN 'person' ELSE 'concept' END AS type,
    CASE WHEN kind = 'quoted' THEN CASE WHEN what = 'unknown' THEN 0.55::DOUBLE ELSE 1 END
      WHEN what <> 'unknown' THEN 1 WHEN regexp_matches(left(word, 1), '\p{{Lu}}') OR lower(word) IN {_list_sql(fixed.TOOL_HINTS)} THEN {fixed.ENTITY_CONFIDENCE} ELSE 0.35 END AS confidence
  FROM looked),
linked AS (
  SELECT id, pos, min(spot) AS ord,
         max_by(CASE WHEN kind = 'candidate' AND type = 'person' THEN array_to_string(list_transform(regexp_split_to_array(entity, '\s+'), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ') ELSE entity END, spot) AS name,
         max_by(type, spot) AS type, max_by(confidence, spot) AS confidence, max_by(CASE WHEN what = 'unknown' THEN kind ELSE 'registry' END, spot) AS source
  FROM typed WHERE confidence >= {fixed.ENTITY_CONFIDENCE} GROUP BY id, pos, lower(entity))
""".strip()


_SENTENCES_SQL = """
SELECT seq AS id, valid_from AS day, replace(upper(left(subject, 1)) || substr(subject, 2), '#', '') || ' depends on Redis. The `' || object || ' kit` is part of the stack '
  || replace(upper(left(subject, 1)) || substr(subject, 2), '#', '') || '. ' || replace(upper(left(subject, 1)) || substr(subject, 2), '#', '') || ' no longer depends on Redis.' AS body
FROM facts WHERE valid_to IS NULL
""".strip()


@query("link_entities", f"WITH {w.FACTS_SQL}, {linked_sql(_SENTENCES_SQL)} SELECT id AS original_id, pos, ord, name, type, confidence, source FROM linked")
def link_entities(t):
    """Entities in sentences about orders."""
    people, projects = _people(t)
    docs = relations.with_alone(_sentences(t).select("original_id", "document"), ["original_id"])
    segs = docs.select("original_id", "_alone", F.posexplode(relations.segments(F.col("document"))).alias("pos", "segment"))
    return relations.link_entities(segs, people, projects, key=("original_id", "pos"))


@query("link_entities_in_documents", f"""
WITH {linked_sql("SELECT doc_id AS id, text AS body FROM documents")} SELECT id AS original_id, pos, ord, name, type, confidence, source FROM linked
""")
def link_entities_in_documents(t):
    """Entities in the sentences of all documents."""
    people, projects = _people(t)
    segs = t.documents.select(F.col("doc_id").alias("original_id"), F.posexplode(relations.segments(F.col("text"))).alias("pos", "segment"))
    return relations.link_entities(segs, people, projects, key=("original_id", "pos"))


def facts_sql(source: str) -> str:
    """CTEs from (id, day, body) without dates in it: ``found`` (original_id, pos, subject, predicate, object, confidence, valid_from, ended)."""
    examples = ", ".join(f"({n}, {sql_text(p['id'])}, {sql_text(mode)}, {sql_text(x)})" for n, p in enumerate(fixed.PREDICATES) for mode in ("active", "ended") for x in p[mode])
    fits = "CASE n " + " ".join(
        f"WHEN {n} THEN CASE WHEN s.type IN {_list_sql((*p['subjects'], 'unknown'))} AND o.type IN {_list_sql((*p['objects'], 'unknown'))} THEN 1.0::DOUBLE"
        f" WHEN s.type = 'unknown' OR o.type = 'unknown' THEN 0.82 ELSE 0.35 END" for n, p in enumerate(fixed.PREDICATES)) + " END"
    return f"""
{linked_sql(source)},
body_days AS (SELECT id, day FROM ({source})),
several AS (SELECT id, pos FROM linked GROUP BY id, pos HAVING count(*) >= 2),
asked AS (SELECT row_number() OVER () AS row, s.* FROM segs s SEMI JOIN several USING (id, pos)),
examples AS (SELECT row_number() OVER () AS row, * FROM (VALUES {examples}) AS v(n, predicate, mode, sentence)),
{hashed_sql('a', 'SELECT row AS id, segment AS body FROM asked')},
{hashed_sql('x', 'SELECT row AS id, sentence AS body FROM examples')},
dots AS (SELECT a.id AS row, n, predicate, mode, round(sum(a.x * x.x), 9) AS dot FROM a_vec a JOIN x_vec x USING (b) JOIN examples e ON e.row = x.id GROUP BY a.id, x.id, n, predicate, mode),
best AS (SELECT row, n, predicate, greatest(0, max(dot) FILTER (mode = 'active')) AS active, greatest(0, max(dot) FILTER (mode = 'ended')) AS ended FROM dots GROUP BY row, n, predicate),
every AS (SELECT row, n, predicate, coalesce(active, 0) AS active, coalesce(ended, 0) AS ended
          FROM (SELECT row, n, predicate FROM asked, (SELECT DISTINCT n, predicate FROM examples)) LEFT JOIN best USING (row, n, predicate)),
scored AS (
  SELECT k.id, k.pos, s.ord AS i, o.ord AS j, n, predicate, s.name AS subject, o.name AS object, ended > active + 0.03::DOUBLE AS is_end, {fits} AS fit,
         greatest(active, ended) * 0.7::DOUBLE + fit * 0.2::DOUBLE + (s.confidence + o.confidence) / 2 * 0.1::DOUBLE AS score
  FROM asked k JOIN linked s ON s.id = k.id AND s.pos = k.pos JOIN linked o ON o.id = k.id AND o.pos = k.pos AND o.ord <> s.ord JOIN every USING (row)),
chosen AS (SELECT * FROM scored WHERE fit >= 0.5 QUALIFY row_number() OVER (PARTITION BY id, pos ORDER BY score DESC, i, j, n) = 1),
found AS (
  SELECT id AS original_id, min(pos) AS pos, subject, predicate, object, round(min_by(score, pos), 4) AS confidence,
         CASE WHEN NOT is_end THEN any_value(day) END AS valid_from, CASE WHEN is_end THEN any_value(day) END AS ended
  FROM chosen JOIN body_days USING (id) WHERE score >= {fixed.FACT_CONFIDENCE} GROUP BY id, subject, predicate, object, is_end)
""".strip()


@query("extract_facts", f"WITH {w.FACTS_SQL}, {facts_sql(_SENTENCES_SQL)} SELECT * FROM found")
def extract_facts(t):
    """The best relation of each of those sentences."""
    people, projects = _people(t)
    protos = relations.prototypes(t.spark)
    return relations.extract_facts(_sentences(t), people, projects, protos=protos).select(
        "original_id", "pos", "subject", "predicate", "object", F.round("confidence", 4).alias("confidence"), "valid_from", "ended"
    )


# --- files and chat formats --------------------------------------------------------------------------------------

_IGNORE = [("", "# notes\n*.html\n!4*.html\n/de/\nspam*\n"), ("fr", "8??\n!85[0-9]\n")]


@query("gitignore_decisions", f"""
WITH {w.FILES_SQL},
p AS (SELECT DISTINCT path, regexp_extract(path, '[^/]*$') AS leaf FROM files WHERE path <> '')
SELECT path, CASE WHEN starts_with(path, 'fr/') AND regexp_matches(path, '(^|/)85[0-9](/|$)') THEN false
    WHEN starts_with(path, 'fr/') AND regexp_matches(substr(path, 4), '(^|/)8[^/][^/](/|$)') THEN true
    WHEN regexp_matches(path, '(^|/)spam[^/]*(/|$)') THEN true WHEN starts_with(path, 'de/') THEN true
    WHEN regexp_matches(path, '(^|/)4[^/]*\\.html(/|$)') THEN false WHEN regexp_matches(path, '(^|/)[^/]*\\.html(/|$)') THEN true END AS ignored FROM p
""")
def gitignore_decisions(t):
    """Which page paths a set of ignore rules takes out."""
    rules = gitignore.parse_rules(t.spark.createDataFrame(_IGNORE, "base string, content string"))
    paths = w.files(t).where("path <> ''").select("path", F.lit(False).alias("is_dir")).distinct()
    return gitignore.decisions(paths, rules).select("path", "ignored")


def _chat_files(t: Tables) -> DataFrame:
    """Each user message and its answer as a file in one of five formats."""
    b = transcripts.pair_messages(_messages(t)).where(F.col("user_text").isNotNull() & F.col("assistant_text").isNotNull())
    u, a = F.col("user_text"), F.col("assistant_text")
    line = lambda role, text: F.to_json(F.struct(F.lit(role).alias("type"), F.struct(text.alias("content")).alias("message")))
    event = lambda kind, text: F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(F.lit(kind).alias("type"), text.alias("message")).alias("payload")))
    role = lambda r, text: F.struct(F.lit(r).alias("role"), F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"))
    node = lambda parent, r, text, child: F.struct(
        F.lit(parent).alias("parent"), F.struct(F.struct(F.lit(r).alias("role")).alias("author"), F.struct(F.array(text).alias("parts")).alias("content")).alias("message"),
        F.array(*[F.lit(c) for c in child]).cast("array<string>").alias("children"),
    )
    said = lambda who, text: F.struct(F.lit("message").alias("type"), F.lit(who).alias("user"), text.alias("text"))
    kind = (F.col("conv_id") + F.col("turn")) % 5
    content = (
        F.when(kind == 0, F.concat_ws("\n", line("user", u), F.lit("{broken"), line("assistant", a)))
        .when(kind == 1, F.concat_ws("\n", F.lit('{"type":"session_meta"}'), event("user_message", u), event("agent_message", a)))
        .when(kind == 2, F.to_json(F.array(role("human", u), role("ai", a))))
        .when(kind == 3, F.to_json(F.struct(F.create_map(F.lit("m1"), node("m0", "user", u, ["m2"]), F.lit("m2"), node("m1", "assistant", a, []),
                                                         F.lit("m0"), node(None, "system", F.lit(""), ["m1"])).alias("mapping"))))
        .otherwise(F.to_json(F.array(said("U1", u), said("U2", a))))
    )
    return b.select("conv_id", "turn", F.lit("export.json").alias("path"), content.alias("content"))


@query("chat_parsers", _PAIRS + f"""
SELECT conv_id, turn, list_value('session_jsonl', 'event_jsonl', 'role_list', 'message_tree', 'channel_list')[CAST((conv_id + turn) % 5 + 1 AS INT)] AS format,
       '> ' || trim(user_text, {_BLANKS}) || chr(10) || trim(assistant_text, {_BLANKS}) || chr(10) AS transcript
FROM blocks WHERE user_text IS NOT NULL AND assistant_text IS NOT NULL
""")
def chat_parsers(t):
    """Five chat export formats read into one transcript form."""
    return chat.normalize(_chat_files(t)).select("conv_id", "turn", "format", "transcript")
