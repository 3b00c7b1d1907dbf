"""Language identification, word first: known words by their log frequency in each language, unseen ones by character n-grams.

Words are runs of letters, lower-cased.  A known word scores its smoothed log
frequency in every language.  An unseen word is cut into character n-grams with
word ends, longest order first; the longest order of which the model knows any
n-gram scores their mean log frequency.  Scores add up to a posterior over languages.

All words and n-grams of the training texts are counted and kept, as tables.  The
``head`` most frequent words are broadcast, so most occurrences are added up where the
text is read; that bound only decides where a word is looked up.  The other words of
each text join the tables, once per distinct word and then per text.  Scores are
whole millionths, so sums do not depend on their order and reruns agree.
Ties go to the language first by code point.

Null texts and texts without a letter are ``und`` with score 0, and so is
everything where there is nothing to learn from.  Rows are judged one by one, so
repeated rows agree; long texts are read whole; an empty table gives an empty result.
Only doc_id, text and lang are read, so extra columns do not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.llm.common import numbered, texts_of, written
from loci.operators.skew import join_unique

ORDERS = (4, 3, 2, 1)
HEAD = 100_000
SMOOTHING = 0.5
SCALE = 1_000_000
UNKNOWN = "und"
_FLUSH = 400_000  # distinct tokens a task holds before it hands on partial counts
_LETTERS = regex.compile(r"\p{L}+")


def words_of(token: bytes) -> list[str]:
    return _LETTERS.findall(token.decode("utf-8", "replace").lower())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Partial counts (lang, word, n) of a task's texts."""
    tokens: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = Counter()
        for lang, found in tokens.items():
            for token, n in found.items():
                for word in words_of(token):
                    rows[lang, word] += n
        tokens.clear()
        langs, words = [k[0] for k in rows], [k[1] for k in rows]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(rows.values()), pa.int64())], ["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            if text:
                tokens.setdefault(lang, Counter()).update(text.split())
        if sum(map(len, tokens.values())) > _FLUSH:
            yield flush()
    if tokens:
        yield flush()


def word_counts(training: DataFrame) -> DataFrame:
    """(lang, word, n) over all texts of a table (lang, text)."""
    found = training.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
    return written(found.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")


def _grams(marked: Column, k: int) -> Column:
    """The n-grams of order k of a word with its ends marked; a shorter one is its own."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(marked) - (k - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substring(marked, i, F.lit(k)))


def gram_counts(counts: DataFrame) -> DataFrame:
    """(lang, gram, n) for the n-grams of all orders of words with their ends marked."""

    grams = F.flatten(F.array(*[_grams(F.col("w"), k) for k in ORDERS]))
    spread = counts.select("lang", "n", F.concat(F.lit("^"), "word", F.lit("$")).alias("w")).select("lang", "n", F.explode(grams).alias("gram"))
    return spread.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages with their priors, and tables (word or gram, n, scores) of all that was counted; scores are whole millionths."""

    langs: list[str]
    prior: list[int]
    words: DataFrame
    grams: DataFrame


def _scored(counts: DataFrame, name: str, langs: list[str], totals: dict[str, int]) -> DataFrame:
    """(name, n, scores) for every counted entry: smoothed log frequency in each language."""
    per = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)) for lang in langs]
    held = written(counts.groupBy(name).agg(F.sum("n").alias("n"), F.array(*per).cast("array<bigint>").alias("per")), f"{name}s")
    kinds = held.count()
    scores = [
        F.round((F.log(F.col("per")[i] + F.lit(SMOOTHING)) - F.lit(float(np.log(totals.get(lang, 0) + SMOOTHING * max(1, kinds))))) * SCALE)
        for i, lang in enumerate(langs)
    ]
    return held.select(name, "n", F.array(*scores).cast("array<bigint>").alias("scores"))


def _totals(counts: DataFrame) -> dict[str, int]:
    return {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}


def fit(training: DataFrame) -> Model:
    """Learn from a table (lang, text) without null languages."""
    counts = word_counts(training)
    totals = _totals(counts)
    langs = sorted(totals, key=lambda x: x.encode())
    everything = sum(totals.values())
    prior = [round(float(np.log(totals[x] / everything)) * SCALE) for x in langs]
    grams = written(gram_counts(counts), "gram-counts")
    return Model(langs, prior, _scored(counts, "word", langs, totals), _scored(grams, "gram", langs, _totals(grams)))


def frequent(words: DataFrame, most: int, many: int) -> tuple[list[str], np.ndarray]:
    """The most frequent words and their scores in ``many`` languages; at most ``most`` rows."""
    # Written first, so the driver gets these rows alone and not every partition's best.
    best = written(words.orderBy(F.desc("n"), "word").limit(most), "frequent").collect()
    return [r["word"] for r in best], np.array([r["scores"] for r in best], np.int64).reshape(len(best), many)


class _Counter:
    """Adds up the scores of a text's frequent words and lists its other words; remembers tokens already cut."""

    def __init__(self, words: list[str], scores: np.ndarray, most: int = 500_000):
        self.row, self.scores, self.most = {w: i for i, w in enumerate(words)}, scores, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((1024, self.scores.shape[1]), np.int64)
        self.words, self.rare = np.zeros(1024, np.int64), np.zeros(1024, bool)
        self.others: dict[int, list[str]] = {}

    def learn(self, tokens: list[bytes]) -> None:
        first, count = len(self.place), len(tokens)
        while first + count > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.words = np.concatenate([self.words, np.zeros_like(self.words)])
            self.rare = np.concatenate([self.rare, np.zeros_like(self.rare)])
        rows, owner = [], []
        for at, token in enumerate(tokens, first):
            found = words_of(token)
            self.words[at] = len(found)
            for word in found:
                row = self.row.get(word)
                if row is None:
                    self.others.setdefault(at, []).append(word)
                    self.rare[at] = True
                else:
                    rows.append(row)
                    owner.append(at)
        np.add.at(self.table, owner, self.scores[rows])
        self.place.update(zip(tokens, range(first, first + count), strict=True))

    def count(self, texts: list[bytes | None]) -> Iterable[tuple[int, np.ndarray, Counter]]:
        """For each text: number of words, summed scores of its frequent words, and its other words."""
        if len(self.place) > self.most:
            self.clear()
        for at in numbered([(t or b"").split() for t in texts], self.place, self.learn):
            others = Counter()
            for i in at[self.rare[at]].tolist():
                others.update(self.others[i])
            yield int(self.words[at].sum()), self.table[at].sum(axis=0), others


_COUNTED = "row long, doc_id long, n_words long, sums array<bigint>, others array<struct<word: string, n: bigint>>"


def _counted(docs: DataFrame, words: list[str], scores: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast({"parts": (words, scores)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        # A worker keeps its broadcast values from task to task, and with them the tokens it has cut.
        held = shared.value
        if "counter" not in held:
            held["counter"] = _Counter(*held["parts"])
        for batch in batches:
            found = list(held["counter"].count(texts_of(batch.column(2))))
            names = [list(o) for _, _, o in found]
            ends = pa.array(np.cumsum([0, *map(len, names)]), pa.int32())
            pairs = pa.StructArray.from_arrays(
                [pa.array([w for n in names for w in n], pa.string()), pa.array([n for _, _, o in found for n in o.values()], pa.int64())], ["word", "n"])
            columns = [
                batch.column(0), batch.column(1), pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([s.tolist() for _, s, _ in found], pa.list_(pa.int64())), pa.ListArray.from_arrays(ends, pairs),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "sums", "others"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return written(rows.mapInArrow(run, _COUNTED), "counted")


def _added(column: str, count: int, times: Column | None = None) -> Column:
    """Sum of arrays place by place."""
    return F.array(*[F.sum(F.col(column)[i] * times if times is not None else F.col(column)[i]) for i in range(count)]).alias(column)


def unseen_scores(words: DataFrame, model: Model) -> DataFrame:
    """(word, n, scores) of words (word, n) that the model has not counted, by the longest n-grams it has."""
    many, out, left = len(model.langs), None, words
    for k in ORDERS:
        marked = F.concat(F.lit("^"), "word", F.lit("$"))
        cut = left.select("word", "n", F.explode(_grams(marked, k)).alias("gram"))
        known = join_unique(cut, model.grams.select("gram", F.col("n").alias("seen"), "scores"), ["gram"], "seen")
        mean = known.groupBy("word", "n").agg(_added("scores", many), F.count(F.lit(1)).alias("found"))
        mean = mean.select("word", "n", F.transform("scores", lambda s: F.round(s / F.col("found")).cast("bigint")).alias("scores"))
        mean = written(mean, f"unseen-{k}")
        out = mean if out is None else out.unionByName(mean)
        left = written(left.join(mean.select("word"), "word", "left_anti"), f"left-{k}")
        if left.isEmpty():
            break
    return out


def _verdict(model: Model) -> list[Column]:
    """lang_pred and score from the column ``total``."""
    if not model.langs:
        return [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")]
    best = F.array_max("total")
    odds = [F.exp((F.col("total")[i] - best) / SCALE) for i in range(len(model.langs))]
    share = F.lit(1.0) / sum(odds[1:], odds[0])
    lang = F.element_at(F.array(*map(F.lit, model.langs)), F.array_position("total", best).cast("int"))
    judged = F.col("n_words") > 0
    return [F.when(judged, lang).otherwise(UNKNOWN).alias("lang_pred"), F.when(judged, share).otherwise(0.0).alias("score")]


def identify(docs: DataFrame, learn_from: Column, head: int = HEAD) -> DataFrame:
    """doc_id, lang_pred and score of every text, learnt from the rows where ``learn_from`` holds and lang is known."""
    model = fit(docs.where(learn_from & F.col("lang").isNotNull()))
    many = len(model.langs)
    if not many:
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(0).alias("n_words")).select("doc_id", *_verdict(model))
    counted = _counted(docs, *frequent(model.words, head, many))
    rare = written(counted.select("row", F.explode("others").alias("o")).select("row", "o.word", F.col("o.n").alias("times")), "rare")
    asked = rare.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # Both sides have one row per word.
    looked = written(asked.join(model.words.select("word", "scores"), "word", "left"), "asked")
    unseen = written(unseen_scores(looked.where("scores IS NULL").select("word", "n"), model), "unseen")
    scores = looked.where("scores IS NOT NULL").unionByName(unseen)
    sums = join_unique(rare, scores, ["word"], "n").groupBy("row").agg(_added("scores", many, F.col("times")))
    prior = [F.lit(p).cast("bigint") for p in model.prior]
    alone = counted.select("row", "doc_id", "n_words", F.array(*[F.col("sums")[i] + p for i, p in enumerate(prior)]).alias("total"), (F.size("others") > 0).alias("more"))
    joined = alone.where("more").join(sums, "row", "left").withColumn(
        "total", F.array(*[F.col("total")[i] + F.coalesce(F.col("scores")[i], F.lit(0)) for i in range(many)]))
    found = alone.where(~F.col("more")).select("doc_id", "n_words", "total").unionByName(joined.select("doc_id", "n_words", "total"))
    return found.select("doc_id", *_verdict(model))


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether a document belongs to the fold kept for testing; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
