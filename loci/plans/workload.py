"""The driver tables seen as drawers, palaces, facts, notes and transcripts.

Each view exists twice, as a DataFrame and as the text of a SQL common table
expression, so queries and their SQL checks start from the same data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loci.session import tune

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """The Parquet tables of one folder, opened when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


# --- drawers: one per document -----------------------------------------------------------

DRAWERS_SQL = """
drawers AS (
  SELECT lang AS palace, lang AS wing, lang AS wing_name, 'hall_' || (n_chars % 3) AS hall,
         source AS room, source AS room_name, source || '_' || (n_chars % 4) AS closet,
         doc_id AS original_id, text AS document, CAST(1 + (n_chars % 5) AS DOUBLE) AS importance,
         'docs/' || source || '/doc_' || doc_id || '.txt' AS source_file, n_chars
  FROM documents)
"""


def drawers(t: Tables) -> DataFrame:
    return t.documents.select(
        F.col("lang").alias("palace"), F.col("lang").alias("wing"), F.col("lang").alias("wing_name"),
        F.concat(F.lit("hall_"), (F.col("n_chars") % 3).cast("string")).alias("hall"),
        F.col("source").alias("room"), F.col("source").alias("room_name"),
        F.concat_ws("_", "source", (F.col("n_chars") % 4).cast("string")).alias("closet"),
        F.col("doc_id").alias("original_id"), F.col("text").alias("document"),
        (F.lit(1) + F.col("n_chars") % 5).cast("double").alias("importance"),
        F.concat(F.lit("docs/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_file"),
        F.lit(None).cast("string").alias("filed_at"), "n_chars",
    )


# --- vectors: one drawer per embedding, one palace per label -----------------------------

VECTORS_SQL = """
vecs AS (
  SELECT CAST(label AS VARCHAR) AS palace, vec_id AS original_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
dims AS (SELECT palace, original_id, UNNEST(vector) AS x, generate_subscripts(vector, 1) AS i FROM vecs),
palaces AS (
  SELECT m.palace AS name, list(m.x ORDER BY m.i) AS vector, any_value(c.n) AS usage_count
  FROM (SELECT palace, i, avg(x) AS x FROM dims GROUP BY palace, i) m
  JOIN (SELECT palace, count(*) AS n FROM vecs GROUP BY palace) c ON c.palace = m.palace
  GROUP BY m.palace)
"""


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(
        F.col("label").cast("string").alias("palace"), F.col("vec_id").alias("original_id"), F.col("embedding").alias("vector")
    )


def palaces(t: Tables) -> DataFrame:
    """One palace per label: the mean of its vectors, used as often as it has rows."""
    rows = vectors(t)
    # A vector has a fixed number of elements, so this gathers that many values.
    mean = (
        rows.select("palace", F.posexplode("vector").alias("i", "x")).groupBy("palace", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("x")).groupBy("palace")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))
    )
    used = rows.groupBy("palace").agg(F.count("*").alias("usage_count"))
    return mean.join(used, "palace").withColumnRenamed("palace", "name")


# --- facts: customers and the brands they ordered -------------------------------------------

FACTS_SQL = """
raw_facts AS (
  SELECT 'customer#' || o_custkey AS subject, o_orderpriority AS predicate, p_brand AS object,
         strftime(o_orderdate, '%Y-%m-%d') AS valid_from,
         CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%d') END AS valid_to,
         (l_orderkey * 8 + l_linenumber) * 1048576 + CAST('0x' || left(md5(concat_ws('|', l_partkey, l_suppkey, o_custkey, o_orderpriority,
           strftime(o_orderdate, '%Y-%m-%d'), l_linestatus, strftime(l_shipdate, '%Y-%m-%d'))), 5) AS BIGINT) AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
facts AS (
  SELECT *, 'default' AS namespace, replace(replace(lower(subject), ' ', '_'), '''', '') AS subject_id,
         replace(lower(predicate), ' ', '_') AS pred, replace(replace(lower(object), ' ', '_'), '''', '') AS object_id
  FROM raw_facts)
"""


def facts(t: Tables) -> DataFrame:
    line = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_shipdate")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    part = t.part.select("p_partkey", "p_brand")
    # Parts first: a brand is all they add to a line, an order adds more, and where both are shuffled the second join carries it.
    joined = line.join(part, line.l_partkey == part.p_partkey).join(orders, line.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.concat(F.lit("customer#"), F.col("o_custkey").cast("string")).alias("subject"),
        F.col("o_orderpriority").alias("predicate"), F.col("p_brand").alias("object"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"),
        F.when(F.col("l_linestatus") == "F", F.date_format("l_shipdate", "yyyy-MM-dd")).alias("valid_to"),
        fact_order().alias("seq"),
    )


def fact_order() -> Column:
    """Order of the facts: line by line, repeated line numbers by a hash of what the row says.

    Rows alike in all of it say the same and may tie.  It fits a bigint up to order 10^12.
    """
    said = F.concat_ws(
        "|", "l_partkey", "l_suppkey", "o_custkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"), "l_linestatus",
        F.date_format("l_shipdate", "yyyy-MM-dd"),
    )
    line = F.col("l_orderkey").cast("bigint") * 8 + F.col("l_linenumber")
    return line * (1 << 20) + F.conv(F.left(F.md5(said), F.lit(5)), 16, 10).cast("bigint")


# --- notes: a sentence or two per event, one wording per event type ----------------------------

_NOTES = {
    "error": "Turns out the root cause was a broken cache; the bug in module {k} keeps crashing and we are stuck.",
    "click": "We decided to use plan {k} instead of plan {u} because the architecture is better than the old pattern.",
    "view": "I prefer tabs over spaces and we always keep the default style; please never use mock {k}.",
    "signup": "It works! We finally fixed the error, shipped version {k} and it is 2x faster; user {u} is happy.",
    "purchase": "I love this and I feel grateful, I'm sorry I was worried about order {k}.\n\n"
                "```\nimport os\n```\n$ pip install thing{k}\nUser {u} said that it was wonderful and amazing.",
}


def _note_parts(text: str) -> list[tuple[str, str]]:
    """('text', words) and ('slot', name) pieces of a wording."""
    out, rest = [], text
    while rest:
        at = min((rest.find(s) for s in ("{k}", "{u}") if s in rest), default=-1)
        if at < 0:
            out.append(("text", rest))
            break
        if at:
            out.append(("text", rest[:at]))
        out.append(("slot", rest[at + 1]))
        rest = rest[at + 3:]
    return out


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _note_sql() -> str:
    slots = {"k": "(props->>'$.k')", "u": "CAST(user_id AS VARCHAR)"}
    whens = [
        f"WHEN '{kind}' THEN " + " || ".join(sql_text(v) if p == "text" else slots[v] for p, v in _note_parts(words))
        for kind, words in _NOTES.items()
    ]
    return "CASE event_type " + " ".join(whens) + " ELSE '' END"


NOTES_SQL = f"""
notes AS (SELECT event_id, user_id, event_type, ts, {_note_sql()} AS note FROM events)
"""


def notes(t: Tables) -> DataFrame:
    slots = {"k": F.get_json_object("props", "$.k"), "u": F.col("user_id").cast("string")}
    text = F.lit("")
    for kind, words in _NOTES.items():
        built = F.concat(*[F.lit(v) if p == "text" else slots[v] for p, v in _note_parts(words)])
        text = F.when(F.col("event_type") == kind, built).otherwise(text)
    return t.events.select("event_id", "user_id", "event_type", "ts", text.alias("note"))


# --- diary: events as entries of agents -----------------------------------------------------------

DIARY_SQL = """
diary AS (
  SELECT 'wing_' || user_id AS wing, event_id AS original_id, event_type AS topic, props AS document,
         strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS filed_at, strftime(ts, '%Y-%m-%d') AS date
  FROM events)
"""


def diary(t: Tables) -> DataFrame:
    return t.events.select(
        F.concat(F.lit("wing_"), F.col("user_id").cast("string")).alias("wing"), F.lit("diary").alias("room"),
        F.col("event_id").alias("original_id"), F.col("event_type").alias("topic"), F.col("props").alias("document"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("filed_at"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.lit(None).cast("string").alias("session_id"),
    )


# --- transcripts made of documents: a comma starts a quoted line, a full stop ends one -------------

TRANSCRIPTS_SQL = """
transcripts AS (
  SELECT doc_id, '> ' || replace(replace(text, '. ', '.' || chr(10)), ', ', ',' || chr(10) || '> ') AS document FROM documents)
"""


def transcripts(t: Tables) -> DataFrame:
    text = F.replace(F.replace("text", F.lit(". "), F.lit(".\n")), F.lit(", "), F.lit(",\n> "))
    return t.documents.select("doc_id", F.concat(F.lit("> "), text).alias("document"))


# --- files: pages under their path ----------------------------------------------------------------

FILES_SQL = r"""
files AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS project,
         regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/+$', '') AS path, html AS document
  FROM pages)
"""


def files(t: Tables) -> DataFrame:
    return t.pages.select(
        "page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("project"),
        F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), "/+$", "").alias("path"),
        F.col("html").alias("document"),
    )
