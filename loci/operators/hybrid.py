"""Hybrid retrieval: nearest drawers by vector, re-ranked by keywords, quoted phrases, names, dates and halls.

Keywords are looked up in an inverted index: postings (term, item_id, tf) and document
frequencies (term, df), built once for all items and kept sorted by term, so a batch of
questions reads the row groups of its own terms.  Only candidates are scored, by a join on
(term, item_id), so a term that every item has costs a question no more than its candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loci.functions import fixed
from loci.functions.vectors import top_k

_SPLIT = r"[^\p{L}\p{N}]+"
_NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
# A wording with how many days one unit is, and the days around the date that still count.
_AGO = (("day", 1, 2), ("week", 7, 5), ("month", 30, 10), ("year", 365, 30))


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), lambda x: x != "")


# --- the index ----------------------------------------------------------------------------------


def postings(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(term, item_id, tf) of all items."""
    return items.select(F.col(item_id).alias("item_id"), F.explode(terms(F.col(text))).alias("term")).groupBy("term", "item_id").agg(F.count(F.lit(1)).alias("tf"))


def frequencies(index: DataFrame) -> DataFrame:
    """(term, df): how many items have a term."""
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def write_index(items: DataFrame, folder: str, item_id: str = "item_id", text: str = "text") -> None:
    """Store postings and frequencies by term: each file holds a range of terms, in order, so scans of a few terms skip the rest."""
    index = postings(items, item_id, text)
    index.repartitionByRange("term", "item_id").sortWithinPartitions("term", "item_id").write.mode("overwrite").parquet(f"{folder}/postings")
    stored = items.sparkSession.read.parquet(f"{folder}/postings")
    frequencies(stored).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/frequencies")


def read_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/frequencies")


# --- what a question asks for ----------------------------------------------------------------------


def names(question: Column) -> Column:
    """Capitalised words of a question, but for its first word and stop words, in lower case."""
    words = F.regexp_extract_all(F.regexp_replace(F.coalesce(question, F.lit("")), r"^\s*\S+", ""), F.lit(r"(?<![\p{L}\p{N}])(\p{Lu}\p{L}+)"), 1)
    return F.filter(F.array_distinct(F.transform(words, F.lower)), lambda x: ~x.isin(*fixed.KEYWORD_STOP_WORDS))


def keywords(question: Column) -> Column:
    """Distinct words of three characters or more that are no stop words and no names."""
    found = F.filter(terms(question), lambda x: (F.char_length(x) >= fixed.KEYWORD_LENGTH) & ~x.isin(*fixed.KEYWORD_STOP_WORDS))
    return F.array_except(F.array_distinct(found), names(question))


def quotes(question: Column) -> Column:
    """Phrases in double quotes, in lower case."""
    found = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit('"([^"]+)"'), 1)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: x != ""))


def days_back(question: Column) -> Column:
    """(days, window) that a question looks back, or null: "four weeks ago", "a couple of days ago", "last month", "recently"."""
    text = F.lower(F.coalesce(question, F.lit("")))
    out = F.when(F.contains(text, F.lit("recently")), F.struct(F.lit(14).alias("days"), F.lit(14).alias("window")))
    for unit, days, window in reversed(_AGO):
        said = F.regexp_extract(text, rf"(?<![a-z0-9])(\d{{1,4}}|an?|a couple of|{'|'.join(_NUMBERS)}) {unit}s? ago(?![a-z0-9])", 1)
        count = F.when(said.isin("a", "an"), 1).when(said == "a couple of", 2)
        for n, word in enumerate(_NUMBERS, 1):
            count = count.when(said == word, n)
        count = count.otherwise(said.cast("int"))
        last = F.when(F.regexp_like(text, F.lit(rf"(?<![a-z0-9])last {unit}(?![a-z0-9])")), F.struct(F.lit(days).alias("days"), F.lit(window).alias("window")))
        out = F.when(said != "", F.struct((count * days).alias("days"), F.lit(window).alias("window"))).otherwise(F.coalesce(last, out))
    return out


# --- re-ranking --------------------------------------------------------------------------------------


def _overlap(asked: DataFrame, candidates: DataFrame, index: DataFrame, df: DataFrame | None, count: Column | None) -> DataFrame:
    """(query_id, item_id, overlap): share of a question's keywords that the item has, by number or by rarity."""
    words = asked.select("query_id", F.explode(keywords(F.col("question"))).alias("term"))
    if df is None:
        words = words.withColumn("weight", F.lit(1.0))
    else:
        words = words.join(df, "term", "left").withColumn("weight", F.log1p(count / (1.0 + F.coalesce("df", F.lit(0))))).drop("df")
    total = words.groupBy("query_id").agg(F.sum("weight").alias("all"))
    held = index.join(words.select("term").distinct(), "term", "left_semi").select("term", "item_id")
    found = candidates.select("query_id", "item_id").join(words, "query_id").join(held, ["term", "item_id"]).groupBy("query_id", "item_id").agg(F.sum("weight").alias("some"))
    return found.join(total, "query_id").select("query_id", "item_id", F.coalesce(F.try_divide("some", "all"), F.lit(0.0)).alias("overlap"))


def rerank(
    questions: DataFrame, candidates: DataFrame, items: DataFrame, index: DataFrame, df: DataFrame | None = None,
    validated: DataFrame | None = None,
) -> DataFrame:
    """Candidates with their fused distance and new rank: (query_id, item_id, score, overlap, fused, rank).

    ``questions`` has (query_id, question) and may have question_date, hall and second_hall; ``candidates``
    (query_id, item_id, score); ``items`` (item_id, text) and may have date and hall.  With ``df`` keywords count by their
    rarity, else alike.  ``validated`` lists (query_id, item_id) that a search of the question's own hall found.
    Ties go to the smaller item_id.
    """
    asks = questions.select(
        "query_id", quotes(F.col("question")).alias("_quotes"), names(F.col("question")).alias("_names"), days_back(F.col("question")).alias("_back"),
        *[(F.col(c) if c in questions.columns else F.lit(None).cast(t)).alias(f"_{c}") for c, t in (("question_date", "date"), ("hall", "string"), ("second_hall", "string"))],
    )
    told = items.select("item_id", F.lower(F.coalesce("text", F.lit(""))).alias("_text"),
                        *[(F.col(c) if c in items.columns else F.lit(None).cast(t)).alias(f"_item_{c}") for c, t in (("date", "date"), ("hall", "string"))])
    count = F.lit(1.0) if df is None else items.select(F.count(F.lit(1)).alias("n")).scalar()
    overlap = _overlap(questions, candidates, index, df, count)
    rows = candidates.select("query_id", "item_id", "score").join(told, "item_id").join(asks, "query_id").join(overlap, ["query_id", "item_id"], "left")
    if validated is not None:
        rows = rows.join(validated.select("query_id", "item_id").distinct().withColumn("_valid", F.lit(True)), ["query_id", "item_id"], "left")
    else:
        rows = rows.withColumn("_valid", F.lit(None).cast("boolean"))

    def share(list_: str) -> Column:
        hit = F.size(F.filter(list_, lambda x: F.contains(F.col("_text"), x)))
        return F.when(F.size(list_) > 0, hit / F.size(list_)).otherwise(0.0)

    target = F.date_sub("_question_date", F.col("_back.days"))
    off = F.abs(F.datediff("_item_date", target)) / F.col("_back.window")
    boosts = [
        fixed.KEYWORD_BOOST * F.coalesce("overlap", F.lit(0.0)),
        fixed.QUOTE_BOOST * share("_quotes"),
        fixed.NAME_BOOST * share("_names"),
        F.coalesce(F.greatest(F.lit(0.0), fixed.DATE_BOOST * (1.0 - off)), F.lit(0.0)),
        F.when(F.col("_item_hall") == F.col("_hall"), fixed.HALL_BOOST).when(F.col("_item_hall") == F.col("_second_hall"), fixed.SECOND_HALL_BOOST).otherwise(0.0),
        F.when(F.col("_valid"), fixed.FOUND_IN_HALL_BOOST).otherwise(0.0),
    ]
    fused = 1.0 - F.col("score")
    for b in boosts:
        fused = fused * (1.0 - b)
    best = Window.partitionBy("query_id").orderBy("fused", "item_id")
    scored = rows.select("query_id", "item_id", "score", F.round(F.coalesce("overlap", F.lit(0.0)), 9).alias("overlap"), F.round(fused, 9).alias("fused"))
    return scored.withColumn("rank", F.row_number().over(best))


def search(questions: DataFrame, items: DataFrame, index: DataFrame, df: DataFrame | None = None, k: int = 10, candidates: int = fixed.HYBRID_CANDIDATES) -> DataFrame:
    """Best k items of every question: nearest by vector, then re-ranked.

    ``questions`` (query_id, question, vector, ...) and ``items`` (item_id, text, vector, ...) as in ``rerank``.  Where
    questions name a hall, items of that hall alone are searched first, and what is found there counts more.
    """
    near = top_k(questions, items, candidates)
    validated = None
    if "hall" in questions.columns and "hall" in items.columns:
        halls = questions.where(F.col("hall").isNotNull())
        validated = top_k(halls, items.where(F.col("hall").isNotNull()), k, group="hall")
    return rerank(questions, near, items, index, df, validated).where(F.col("rank") <= k)
