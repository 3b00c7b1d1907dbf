"""Queries on hybrid re-ranking and on the inverted file of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.operators import hybrid, ivf
from loci.plans import workload as w
from loci.plans.catalog import query
from loci.plans.retrieval_queries import _COS, _R3, _each, _shown
from loci.plans.workload import Tables

# --- hybrid re-ranking: benchmark passages ask for the documents that have a vector ----------------------

_ASKED_SQL = r"""
items AS (
  SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS vector, text, DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS date, 'hall_' || (n_chars % 3) AS hall
  FROM embeddings JOIN documents ON vec_id = doc_id),
questions AS (
  SELECT b.item_id AS query_id, CAST(embedding AS DOUBLE[]) AS vector, DATE '2024-12-31' AS question_date,
         CASE WHEN b.item_id % 4 <> 0 THEN 'hall_' || (b.item_id % 3) END AS hall, 'hall_' || ((b.item_id + 1) % 3) AS second_hall,
         'Who wrote "' || regexp_extract(b.text, '^\S+ \S+ \S+') || '" ' || b.text
           || CASE b.item_id % 6 WHEN 0 THEN ' two weeks ago' WHEN 1 THEN ' a month ago' WHEN 2 THEN ' 3 days ago' WHEN 3 THEN ' recently' WHEN 4 THEN ' last month' ELSE '' END AS question
  FROM benchmark b JOIN embeddings ON vec_id = b.item_id)
"""


def _asked(t: Tables) -> tuple[DataFrame, DataFrame]:
    docs = t.documents.select(
        F.col("doc_id").alias("item_id"), "text", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("date"),
        F.concat(F.lit("hall_"), (F.col("n_chars") % 3).cast("string")).alias("hall"),
    )
    vectors = t.embeddings.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    ago = F.when(F.col("item_id") % 6 == 0, " two weeks ago").when(F.col("item_id") % 6 == 1, " a month ago").when(F.col("item_id") % 6 == 2, " 3 days ago")
    ago = ago.when(F.col("item_id") % 6 == 3, " recently").when(F.col("item_id") % 6 == 4, " last month").otherwise("")
    hall = F.when(F.col("item_id") % 4 != 0, F.concat(F.lit("hall_"), (F.col("item_id") % 3).cast("string")))
    questions = t.benchmark.select("item_id", "text").join(vectors, "item_id").select(
        F.col("item_id").alias("query_id"), "vector", F.lit("2024-12-31").cast("date").alias("question_date"), hall.alias("hall"),
        F.concat(F.lit("hall_"), ((F.col("item_id") + 1) % 3).cast("string")).alias("second_hall"),
        F.concat(F.lit('Who wrote "'), F.regexp_extract("text", r"^\S+ \S+ \S+", 0), F.lit('" '), "text", ago).alias("question"),
    )
    return questions, docs.join(vectors, "item_id")


def _back_sql() -> str:
    text, whens = "lower(question)", []
    for unit, days, window in hybrid._AGO:
        said = rf"regexp_extract({text}, '(^|[^a-z0-9])(\d{{1,4}}|an?|a couple of|{'|'.join(hybrid._NUMBERS)}) {unit}s? ago([^a-z0-9]|$)', 2)"
        numbers = " ".join(f"WHEN '{x}' THEN {n}" for n, x in enumerate(hybrid._NUMBERS, 1))
        count = f"CASE {said} WHEN 'a' THEN 1 WHEN 'an' THEN 1 WHEN 'a couple of' THEN 2 {numbers} ELSE TRY_CAST({said} AS INT) END"
        whens.append(f"WHEN {said} <> '' THEN {{'days': {count} * {days}, 'range': {window}}}")
        whens.append(f"WHEN regexp_matches({text}, '(^|[^a-z0-9])last {unit}([^a-z0-9]|$)') THEN {{'days': {days}, 'range': {window}}}")
    return f"CASE {' '.join(whens)} WHEN contains({text}, 'recently') THEN {{'days': 14, 'range': 14}} END"


_STOP_SQL = "(" + ", ".join(f"'{x}'" for x in fixed.KEYWORD_STOP_WORDS) + ")"
_SHARE = "CASE WHEN len({0}) > 0 THEN len(list_filter({0}, lambda x: contains(lower(text), x))) / len({0}) ELSE 0 END"

_HYBRID_SQL = rf"""
WITH {_ASKED_SQL.strip()},
near AS (
  SELECT q.query_id, v.item_id, {_COS} AS score FROM questions q, items v
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= {fixed.HYBRID_CANDIDATES}),
own AS (
  SELECT q.query_id, v.item_id, {_COS} AS score FROM questions q JOIN items v ON q.hall = v.hall
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) <= 10),
asks AS (
  SELECT query_id, question_date, hall AS own_hall, second_hall, {_back_sql()} AS back,
         list_distinct(list_filter(list_transform(regexp_extract_all(question, '"([^"]+)"', 1), lambda x: lower(trim(x))), lambda x: x <> '')) AS quotes,
         list_filter(list_distinct(list_transform(regexp_extract_all(regexp_replace(question, '^\s*\S+', ''), '(^|[^\p{{L}}\p{{N}}])(\p{{Lu}}\p{{L}}+)', 2), lambda x: lower(x))), lambda x: x NOT IN {_STOP_SQL}) AS names,
         list_filter(list_distinct(regexp_split_to_array(lower(question), '[^\p{{L}}\p{{N}}]+')), lambda x: length(x) >= {fixed.KEYWORD_LENGTH} AND x NOT IN {_STOP_SQL}) AS words
  FROM questions),
kw AS (SELECT *, list_filter(words, lambda x: NOT list_contains(names, x)) AS keys FROM asks),
told AS (SELECT *, regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+') AS terms FROM items),
s AS (
  SELECT n.query_id, n.item_id, n.score,
         CASE WHEN len(keys) > 0 THEN len(list_filter(keys, lambda x: list_contains(terms, x))) / len(keys) ELSE 0 END AS overlap,
         {_SHARE.format('quotes')} AS quoted, {_SHARE.format('names')} AS named,
         coalesce(greatest(0, {fixed.DATE_BOOST} * (1 - abs(date_diff('day', question_date - CAST(back.days AS INT), date)) / back.range)), 0) AS dated,
         CASE WHEN hall = own_hall THEN {fixed.HALL_BOOST} WHEN hall = second_hall THEN {fixed.SECOND_HALL_BOOST} ELSE 0 END AS housed,
         CASE WHEN own.query_id IS NOT NULL THEN {fixed.FOUND_IN_HALL_BOOST} ELSE 0 END AS valid
  FROM near n JOIN kw USING (query_id) JOIN told ON told.item_id = n.item_id LEFT JOIN own ON own.query_id = n.query_id AND own.item_id = n.item_id),
f AS (
  SELECT query_id, item_id, score, round(overlap, 9) AS overlap,
         round((1 - score) * (1 - CAST({fixed.KEYWORD_BOOST} AS DOUBLE) * overlap) * (1 - CAST({fixed.QUOTE_BOOST} AS DOUBLE) * quoted) * (1 - CAST({fixed.NAME_BOOST} AS DOUBLE) * named)
               * (1 - CAST(dated AS DOUBLE)) * (1 - CAST(housed AS DOUBLE)) * (1 - CAST(valid AS DOUBLE)), 9) AS fused
  FROM s)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY fused, item_id) AS rank, item_id, overlap, round(fused, 6) AS fused FROM f
QUALIFY rank <= 10
"""


@query("hybrid_rerank", _HYBRID_SQL)
def hybrid_rerank(t):
    """The ten best documents of every benchmark passage: nearest by vector, re-ranked by keywords, quotes, names, date and hall."""
    questions, items = _asked(t)
    found = hybrid.search(questions, items, hybrid.postings(items))
    return found.select("query_id", "rank", "item_id", "overlap", F.round("fused", 6).alias("fused"))


@query("keyword_frequencies", r"""
WITH terms AS (SELECT DISTINCT doc_id, UNNEST(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS term FROM documents)
SELECT term, count(*) AS df FROM terms WHERE term <> '' GROUP BY term
""")
def keyword_frequencies(t):
    """In how many documents each term of the inverted index is."""
    docs = t.documents.select(F.col("doc_id").alias("item_id"), "text")
    return hybrid.frequencies(hybrid.postings(docs))


# --- the inverted file ----------------------------------------------------------------------------------


@query("ivf_topk", f"""
WITH {w.VECTORS_SQL},
scored AS (SELECT q.original_id AS query_id, v.original_id, {_COS} AS score FROM vecs q, vecs v WHERE q.original_id <> v.original_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_id) AS rank FROM scored)
SELECT query_id, rank, original_id, {_R3.format('score')} AS similarity FROM ranked WHERE rank <= 10
""")
def ivf_topk(t):
    """Ten nearest vectors of every vector through the inverted file, certified."""
    index = ivf.build(w.vectors(t), 32, item_id="original_id")
    return _shown(ivf.search(_each(t), index, 10, 4, certified=True, item_id="original_id", skip_same_id=True))
