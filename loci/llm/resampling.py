"""Importance resampling towards a target: hashed features, weights from an array, a seeded draw ranked by radix sort.

Features are runs of consecutive words; each falls into one of ``buckets`` by its crc32.
The counts of all buckets in the raw texts and in the target texts give an array of
gains, the floored thousandfold log ratio of their smoothed frequencies.  A document's
weight is the floored mean gain of its features.  Gumbel noise, seeded by the doc_id,
added to the weight makes the highest scores a draw without replacement in proportion to
the weights.  Among documents with enough words the share with the highest scores is
drawn; a distributed radix sort ranks them by score and doc_id.  Coarse counts of scores
tell first which documents cannot be drawn, and those take no part in the sort.

Null texts have no words.  A document without features weighs 0.  A null doc_id hashes
as an empty text and comes after all others of its score.  Repeated rows are rows of
their own with the same score and ranks next to each other.  Long texts are read whole.
With an empty target every gain is the log ratio of smoothing alone; an empty table
gives an empty result.  Only doc_id and text are read, so other columns do not matter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.llm.common import crc32_sql, texts_of, written
from loci.llm.radix import ranked, unsigned

BUCKETS = 10_000
RUNS = (1, 1)
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
_BIN = 64  # width of the coarse score counts
_REMEMBERED = 500_000
# Lower-cases A-Z and makes a space of every other ASCII character that is no letter or digit.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32) for c in range(256))


class Features:
    """Bucket numbers of a text's features; remembers those of words."""

    def __init__(self, runs: tuple[int, int] = RUNS, buckets: int = BUCKETS):
        self.runs, self.buckets = runs, buckets
        self.known: dict[bytes, int] = {}

    def _words(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        gaps = np.flatnonzero(at < 0)
        if len(gaps):
            found = [zlib.crc32(words[i]) % self.buckets for i in gaps]
            at[gaps] = found
            if len(self.known) > _REMEMBERED:
                self.known.clear()
            self.known.update((words[i], b) for i, b in zip(gaps, found) if len(words[i]) <= 64)
        return at

    def of(self, text: bytes | None) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every feature."""
        words = (text or b"").translate(_FOLD).split()
        found = []
        for k in range(self.runs[0], self.runs[1] + 1):
            if k == 1:
                found.append(self._words(words))
            else:
                runs = (b" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
                found.append(np.fromiter((zlib.crc32(r) % self.buckets for r in runs), np.int64))
        return len(words), np.concatenate(found) if found else np.zeros(0, np.int64)


def bucket_counts(texts: DataFrame, runs: tuple[int, int] = RUNS, buckets: int = BUCKETS, text: str = "text") -> np.ndarray:
    """Occurrences of features in each bucket over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        features, sums = Features(runs, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for one in texts_of(batch.column(0)):
                sums += np.bincount(features.of(one)[1], minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["bucket", "n"])

    per_task = texts.select(text).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in per_task.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed frequencies of each bucket."""
    all_raw, all_target, k = int(raw.sum()), int(target.sum()), len(raw)
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (all_raw + k) / ((s + 1) * (all_target + k)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, runs: tuple[int, int] = RUNS) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        features = Features(runs, len(gain))
        for batch in batches:
            rows = []
            for text in texts_of(batch.column(1)):
                n_words, at = features.of(text)
                rows.append((n_words, len(at), int(gain[at].sum()) // len(at) if len(at) else 0))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Floored thousandfold Gumbel noise of a doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def _floor_of_draw(counts: list[tuple[int, int]], wanted: int) -> int | None:
    """The highest bin such that the bins from it on hold what is wanted."""
    for bin_, n in sorted(counts, reverse=True):
        wanted -= n
        if wanted <= 0:
            return bin_
    return None


def resampled(
    docs: DataFrame, target: DataFrame, runs: tuple[int, int] = RUNS, buckets: int = BUCKETS, min_words: int = MIN_WORDS,
    percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document."""
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    scored = written(weighed(docs, gain, runs).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    fits = F.col("n_words") >= min_words
    bin_ = F.floor(F.col("score") / _BIN)
    # Scores are logarithms, so there are a few thousand bins at most.
    counts = [(r["bin"], r["n"]) for r in scored.where(fits).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()]
    draw = percent * sum(n for _, n in counts) // 100
    lowest = _floor_of_draw(counts, draw) if draw else None
    columns = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("bigint").alias("rank")
    if lowest is None:
        return scored.select(*columns, unranked)
    competes = fits & (bin_ >= lowest)
    top = F.lit((max(b for b, _ in counts) + 1) * _BIN).cast("bigint")
    keys = [top - F.col("score"), F.isnull("doc_id").cast("bigint"), unsigned(F.coalesce("doc_id", F.lit(0)))]
    sorted_rows = ranked(scored.where(competes).select(*columns), keys)
    drawn = sorted_rows.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return scored.where(~competes).select(*columns, unranked).unionByName(drawn)


_WORDS_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = rf"""
WITH w AS (
  SELECT 0 AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS_SQL}')) AS word FROM documents
  UNION ALL
  SELECT 1, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS_SQL}')) FROM benchmark
), b AS (
  SELECT word, {crc32_sql("word")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM w)
), f AS (
  SELECT side, id, bucket, count(*) AS n FROM w JOIN b USING (word) GROUP BY ALL
), c AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM f GROUP BY bucket
), g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + {BUCKETS} AS DOUBLE)
                                     / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS gain FROM c
), d AS (
  SELECT id AS doc_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM f JOIN g USING (bucket) WHERE side = 0 GROUP BY id
), s AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
         CAST('0x' || left(sha256('{SEED}:' || doc_id), 8) AS BIGINT) AS h
  FROM documents LEFT JOIN d USING (doc_id)
), r AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM s
), k AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= {MIN_WORDS}) OVER () AS many FROM r
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {MIN_WORDS} AND place <= {PERCENT} * many // 100 THEN place END AS rank FROM k
"""
