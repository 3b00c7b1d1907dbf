"""Retrieval quality: recall per question, token F1, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.functions.vectors import embed, top_k


def f1_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: w != "")


def token_f1(pairs: DataFrame, key: str = "pair_id", pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Token-multiset F1 of (key, pred, truth).

    Tokens are counted per side by (key, token), so long texts cost one
    aggregation and nothing quadratic.
    """
    sides = F.array(
        F.struct(F.lit(1).alias("p"), F.lit(0).alias("t"), f1_tokens(F.col(pred)).alias("w")),
        F.struct(F.lit(0).alias("p"), F.lit(1).alias("t"), f1_tokens(F.col(truth)).alias("w")),
    )
    rows = pairs.select(key, F.explode(sides).alias("s")).select(key, "s.p", "s.t", F.explode("s.w").alias("w"))
    counts = rows.groupBy(key, "w").agg(F.sum("p").alias("np"), F.sum("t").alias("nt"))
    sums = counts.groupBy(key).agg(
        F.sum(F.least("np", "nt")).alias("common"), F.sum("np").alias("n_pred"), F.sum("nt").alias("n_truth")
    )
    joined = pairs.select(key).join(sums, key, "left")
    common = F.coalesce("common", F.lit(0))
    score = F.when(common > 0, 2.0 * common / (F.col("n_pred") + F.col("n_truth"))).otherwise(0.0)
    return joined.select(key, common.alias("common"), score.alias("f1"))


def substring_match(a: Column, b: Column) -> Column:
    """Either text contains the other, ignoring case."""
    x, y = F.lower(a), F.lower(b)
    return F.contains(x, y) | F.contains(y, x)


def multiple_choice(text: Column) -> Column:
    found = F.regexp_extract(F.upper(F.coalesce(text, F.lit(""))), r"(?<![A-Za-z0-9_])([ABCD])(?![A-Za-z0-9_])", 1)
    return F.nullif(found, F.lit(""))


def session_of(dialog_id: Column) -> Column:
    """D3:12 -> session_3; anything else unchanged."""
    n = F.regexp_extract(dialog_id, r"^D(\d+):", 1)
    return F.when(n != "", F.concat(F.lit("session_"), n)).otherwise(dialog_id)


def recall_by_id(retrieved: DataFrame, evidence: DataFrame, questions: DataFrame, key: str = "question_id", k: int | None = None) -> DataFrame:
    """(key, recall_hit): was any evidence item retrieved; null without evidence.

    ``retrieved`` has (key, rank, corpus_id), ``evidence`` (key, corpus_id).
    """
    got = retrieved if k is None else retrieved.where(F.col("rank") <= k)
    hit = got.join(evidence, [key, "corpus_id"], "left_semi").select(key).distinct().withColumn("_hit", F.lit(True))
    has = evidence.select(key).distinct().withColumn("_has", F.lit(True))
    return questions.select(key).join(has, key, "left").join(hit, key, "left").select(
        key, F.when(F.col("_has"), F.coalesce("_hit", F.lit(False))).alias("recall_hit")
    )


def recall_by_text(retrieved: DataFrame, evidence: DataFrame, questions: DataFrame, key: str = "question_id") -> DataFrame:
    """Like recall_by_id, with evidence given as texts that contain, or are
    contained in, a retrieved text.  Both sides are joined by question first.
    """
    both = retrieved.select(key, "text").join(evidence.select(key, F.col("text").alias("_ev")), key)
    hit = both.where(substring_match(F.col("text"), F.col("_ev"))).select(key).distinct().withColumn("_hit", F.lit(True))
    has = evidence.select(key).distinct().withColumn("_has", F.lit(True))
    return questions.select(key).join(has, key, "left").join(hit, key, "left").select(
        key, F.when(F.col("_has"), F.coalesce("_hit", F.lit(False))).alias("recall_hit")
    )


def first_ids(corpus: DataFrame) -> DataFrame:
    """Corpus id per distinct text, the first one: (content, corpus_id)."""
    usable = corpus.where(F.trim("content") != "")
    return usable.groupBy("content").agg(F.min_by("corpus_id", "ord").alias("corpus_id"))


# --- whole evaluations -----------------------------------------------------------------------------


def retrieved(corpus: DataFrame, questions: DataFrame, k: int = 10, *, own: bool = False) -> DataFrame:
    """Best k corpus texts per question: (question_id, rank, corpus_id, text).

    Equal texts are filed once, under their first id.  With ``own`` a question only searches texts of its own entry
    (``owner``), and equal texts are filed once per entry; small entries then share tasks, and large ones are cut.
    """
    if own:
        usable = corpus.where(F.trim("content") != "")
        filed = usable.groupBy("owner", "content").agg(F.min_by("corpus_id", "ord").alias("corpus_id"))
        filed = filed.withColumn("item_id", F.concat_ws("\x01", "corpus_id", "owner"))
    else:
        filed = first_ids(corpus).withColumn("item_id", F.col("corpus_id"))
    items = filed.withColumn("vector", embed(F.col("content")))
    asked = questions.withColumn("vector", embed(F.col("question")))
    hits = top_k(asked, items, k, query_id="question_id", group="owner" if own else None)
    return hits.join(filed.select("item_id", "corpus_id", F.col("content").alias("text")), "item_id").select("question_id", "rank", "corpus_id", "text")


def recall_by_session(found: DataFrame, evidence: DataFrame, questions: DataFrame, key: str = "question_id") -> DataFrame:
    """Like ``recall_by_id`` where an id may also begin with an evidence id, as a turn's with its session's."""
    both = found.select(key, "corpus_id").join(evidence.select(key, F.col("corpus_id").alias("_ev")), key)
    hit = both.where(F.col("corpus_id").startswith(F.col("_ev"))).select(key).distinct().withColumn("_hit", F.lit(True))
    has = evidence.select(key).distinct().withColumn("_has", F.lit(True))
    return questions.select(key).join(has, key, "left").join(hit, key, "left").select(
        key, F.when(F.col("_has"), F.coalesce("_hit", F.lit(False))).alias("recall_hit"))


def evaluate_set(data, k: int = 10, granularity: str | None = None, *, own: bool = False) -> DataFrame:
    """(question_id, category, question, answer, recall_hit) of a question set (see ``sources.benchmarks``).

    Answers of a language model, where there are any, are joined by the caller and scored by ``token_f1``.
    """
    from loci.sources import benchmarks as sets

    questions = data.questions()
    corpus = data.corpus(granularity, own=own) if granularity else data.corpus(own=own)
    found = retrieved(corpus, questions, k, own=own)
    if isinstance(data, sets.EvidenceTalk):
        hits = recall_by_text(found, data.evidence(), questions)
    elif isinstance(data, sets.LongMemory) and granularity == "turn":
        hits = recall_by_session(found, data.evidence(), questions)
    elif isinstance(data, sets.LongTalk):
        hits = recall_by_id(found, data.evidence(granularity or "session"), questions)
    else:
        hits = recall_by_id(found, data.evidence(), questions)
    return questions.select("question_id", "category", "question", "answer").join(hits, "question_id")


def save_results(results: DataFrame, folder: str) -> None:
    """Results as JSON lines, a file per partition."""
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def summarize(results: DataFrame, category: str = "category") -> DataFrame:
    """Recall and mean answer score, per category and overall (category null).

    ``results`` has (category, recall_hit, llm_score); nulls are left out.
    """
    hit = F.col("recall_hit").cast("int")
    named = results.withColumn(category, F.coalesce(category, F.lit("unknown")))
    out = named.rollup(category).agg(
        F.count("*").alias("questions"), F.count("recall_hit").alias("with_recall"), F.coalesce(F.sum(hit), F.lit(0)).alias("recall_hits"),
        F.coalesce(F.avg(hit), F.lit(0.0)).alias("recall"), F.avg("llm_score").alias("llm_accuracy"),
        F.grouping(category).alias("_all"),
    )
    return out.withColumn(category, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(category))).drop("_all")

