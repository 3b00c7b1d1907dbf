"""Repeated passages by sharded FM-indexes.

A window is ``length`` consecutive words.  Windows that occur again anywhere are found in
shards that together hold every window that can have a twin:

1. Each window has an anchor, the smallest hash among its GRAM-word sequences.  Equal
   windows have equal anchors.  Neighbouring windows mostly share one, so a document is a
   few runs of windows, and a run's words are a segment.
2. Anchors are counted over all documents.  A window whose anchor occurs once has no
   twin, so only segments with repeated anchors go on.
3. Segments are dealt to shards by anchor, equal segments as one row with a count.  An
   anchor with more than HOT runs is dealt window by window, by a hash of the whole window
   instead, so a passage that everybody quotes is spread over all tasks and collapses to
   its few distinct windows.
4. Each shard builds a compressed FM-index over about SHARD_WORDS words (a segment that
   came twice or more is entered twice) and streams its segments through backward search
   over the wavelet matrix, which reports the stretches of ``length`` words or more that
   occur at least twice.

Words are told apart by their bytes, never by hash alone, within a shard.

Null text has no words.  Documents with fewer than ``length`` words stay whole.  Repeated
rows are each other's twins.  Extra columns do not matter.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.llm.common import WORD, fresh, texts_of, written
from loci.llm.fm_index import FMIndex, repeated_windows

LENGTH = 35
GRAM = 8
HOT = 2000
LONGEST_RUN = 256
SHARD_WORDS = 400_000
MAX_WORDS_SEEN = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def anchors(hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of a text given as word hashes, and all its gram hashes."""
    n = len(hashes) - gram + 1
    grams = np.zeros(n, np.uint64)
    for j in range(gram):
        grams = grams * _BASE + hashes[j : j + n]
    grams = _mix(grams)
    width, reach = length - gram + 1, 1
    least = grams
    while 2 * reach <= width:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if reach < width:
        shift = width - reach
        least = np.minimum(least[: len(least) - shift], least[shift:])
    return least, grams


class WordHashes:
    """64-bit hashes of words; each distinct word is hashed once."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.seen) > MAX_WORDS_SEEN:
            self.seen = {}
        seen, digest = self.seen, xxhash.xxh64_intdigest
        for word in set(words).difference(seen):
            seen[word] = digest(word)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def _runs(length: int, gram: int):
    """Rows (doc, digest, anchor, start, windows, times) for the runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows, starts, sizes, values, times = [], [], [], [], []
            for i, text in enumerate(texts_of(batch.column(2))):
                words = (text or b"").split()
                if len(words) < length:
                    continue
                least, grams = anchors(hashes.of(words), length, gram)
                cut = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [len(least)]])
                if (np.diff(cut) > LONGEST_RUN).any():
                    cut = np.unique(np.concatenate([np.arange(a, b, LONGEST_RUN) for a, b in zip(cut[:-1], cut[1:], strict=True)] + [cut]))
                begin = cut[:-1]
                value = least[begin]
                again = np.sort(grams)
                again = again[1:][again[1:] == again[:-1]]
                rows.append(np.full(len(begin), i))
                starts.append(begin)
                sizes.append(np.diff(cut))
                values.append(value)
                times.append(1 + np.isin(value, again) if len(again) else np.ones(len(begin), np.int64))
            if rows:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(values).view(np.int64)),
                    pa.array(np.concatenate(starts), pa.int32()), pa.array(np.concatenate(sizes), pa.int32()), pa.array(np.concatenate(times), pa.int32()),
                ], ["doc", "digest", "anchor", "start", "windows", "times"])

    return run


def _segments(length: int):
    """Rows (doc, digest, start, windows, route, segment) for the marked runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows, starts, sizes, routes, segments = [], [], [], [], []
            for i, (text, runs) in enumerate(zip(texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                words = (text or b"").split()
                for one in runs:
                    start, windows = one["start"], one["windows"]
                    if one["hot"]:
                        for at in range(start, start + windows):
                            segment = b" ".join(words[at : at + length])
                            rows.append(i)
                            starts.append(at)
                            sizes.append(1)
                            routes.append(xxhash.xxh64_intdigest(segment) - (1 << 63))
                            segments.append(segment)
                    else:
                        rows.append(i)
                        starts.append(start)
                        sizes.append(windows)
                        routes.append(one["anchor"])
                        segments.append(b" ".join(words[start : start + windows + length - 1]))
                if len(segments) > 20_000 or i == batch.num_rows - 1:
                    at = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(at), batch.column(1).take(at), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()),
                        pa.array(routes, pa.int64()), pa.array(segments, pa.binary()).cast(pa.string()),
                    ], ["doc", "digest", "start", "windows", "route", "segment"])
                    rows, starts, sizes, routes, segments = [], [], [], [], []

    return run


def _search(length: int, shard_words: int):
    """Rows (route, name, flags): for each distinct segment one byte per window, 1 where it is repeated.

    Rows come sorted by route; whole routes are gathered until a shard is full.
    """

    def shard(rows: list[tuple[int, int, bytes, int]]) -> pa.RecordBatch:
        words: dict[bytes, int] = {}
        texts, owner = [], []
        for k, (_, _, segment, count) in enumerate(rows):
            ids = np.fromiter((words.setdefault(w, len(words) + 1) for w in segment.split(b" ")), np.int64)
            ids = np.append(ids, 0)
            for _ in range(2 if count > 1 else 1):
                texts.append(ids)
                owner.append(k)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        once = np.flatnonzero(np.diff(np.array(owner), prepend=-1))
        windows = sizes[once] - length
        text = np.concatenate(texts)
        flags = repeated_windows(FMIndex(text), text, starts[once], windows, length).astype(np.uint8).tobytes()
        ends = np.cumsum(windows)
        pieces = [flags[b - n : b] for b, n in zip(ends.tolist(), windows.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(pieces, pa.binary())],
            ["route", "name", "flags"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                if size >= shard_words and row[0] != last:
                    yield shard(held)
                    held, size = [], 0
                held.append(row)
                size += row[2].count(b" ") + 2
                last = row[0]
        if held:
            yield shard(held)

    return run


def _key() -> list[Column]:
    """Identity of a document: doc_id and a hash of its text, so repeated ids with other texts stay apart."""
    return [F.col("doc_id").cast("bigint").alias("doc"), F.xxhash64("text", F.col("doc_id").isNull()).alias("digest")]


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc, digest, hits): for each document with repeated windows, runs of them as (start, flags)."""
    keyed = docs.select(*_key(), "text")
    runs = written(keyed.mapInArrow(_runs(length, gram), "doc long, digest long, anchor long, start int, windows int, times int"), "runs")
    counts = runs.groupBy("anchor").agg(F.sum("times").alias("n"), F.count(F.lit(1)).alias("runs")).where("n > 1")
    counts = written(counts.select("anchor", (F.col("runs") > hot).alias("hot")), "anchors")
    marked = runs.join(counts, "anchor").groupBy("doc", "digest").agg(F.collect_set(F.struct("start", "windows", "anchor", "hot")).alias("runs"))
    marked = marked.toDF("doc2", "digest2", "runs")
    texts = keyed.join(marked, F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("digest") == F.col("digest2"))).select("doc", "digest", "text", "runs")
    segments = texts.mapInArrow(_segments(length), "doc long, digest long, start int, windows int, route long, segment string")
    segments = written(segments.withColumn("name", F.xxhash64("segment")), "segments")
    distinct = segments.groupBy("route", "name", "segment").agg(F.count(F.lit(1)).alias("n"))
    dealt = distinct.repartition("route").sortWithinPartitions("route", "name", "segment")
    flags = dealt.select("route", "name", "segment", "n").mapInArrow(_search(length, shard_words), "route long, name long, flags binary")
    flags = written(flags.where(F.instr(F.hex("flags"), "01") > 0), "flags")
    hits = segments.select("doc", "digest", "start", "route", "name").join(flags, ["route", "name"])
    return hits.groupBy("doc", "digest").agg(F.collect_set(F.struct("start", "flags")).alias("hits"))


def covered(n_words: int, hits: list[tuple[int, bytes]], length: int) -> np.ndarray:
    """Which words lie in a repeated window."""
    edges = np.zeros(n_words + 1, np.int64)
    for start, flags in hits:
        at = start + np.flatnonzero(np.frombuffer(flags, np.uint8))
        edges[at] += 1
        edges[at + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def _cleaned(length: int):
    """n_words, n_removed and the text of the kept words, joined by one space."""

    @F.arrow_udf(returnType="n_words long, n_removed long, text string")
    def clean(column: pa.Array, hits: pa.Array) -> pa.Array:
        totals, gone, kept = [], [], []
        for text, found in zip(texts_of(column), hits.to_pylist(), strict=True):
            words = (text or b"").split()
            totals.append(len(words))
            if found:
                out = covered(len(words), [(h["start"], h["flags"]) for h in found], length)
                gone.append(int(out.sum()))
                words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
            else:
                gone.append(0)
            kept.append(b" ".join(words))
        return pa.StructArray.from_arrays(
            [pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "text"])

    return clean


def with_repeats_removed(docs: DataFrame, length: int = LENGTH, **options: int) -> tuple[DataFrame, str]:
    """The documents and, in an added column, (n_words, n_removed, text) without repeated passages; also that column's name."""
    doc, digest, hits, out = fresh(docs, "doc", "digest", "hits", "cleaned")
    found = repeated(docs, length, **options).toDF(doc, digest, hits)
    match = docs["doc_id"].cast("bigint").eqNullSafe(found[doc]) & (F.xxhash64(docs["text"], docs["doc_id"].isNull()) == found[digest])
    joined = docs.join(found, match, "left")
    return joined.withColumn(out, _cleaned(length)(F.col("text"), F.col(hits))).select(*docs.columns, out), out


def removed(docs: DataFrame, length: int = LENGTH, **options: int) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the SHA-256 of what is kept."""
    cleaned, out = with_repeats_removed(docs.select("doc_id", "text"), length, **options)
    c = F.col(out)
    return cleaned.select("doc_id", c["n_words"].alias("n_words"), c["n_removed"].alias("n_removed"), F.sha2(c["text"], 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH, **options: int) -> DataFrame:
    """The documents with repeated passages cut out of their texts; untouched texts stay as they are.

    n_chars, where there is such a column, follows the new text.
    """
    cleaned, out = with_repeats_removed(docs, length, **options)
    text = F.when(F.col(out)["n_removed"] > 0, F.col(out)["text"]).otherwise(F.col("text"))
    columns = {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(out)["n_removed"] > 0, F.char_length(F.col(out)["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + {LENGTH - 1}], ' ') AS g FROM d, UNNEST(range(1, len(ws) - {LENGTH - 2})) t(i)),
twice AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT * FROM windows SEMI JOIN twice USING (g)), UNNEST(range({LENGTH})) s(k)),
words AS (SELECT doc_id, p, ws[p] AS w FROM d, UNNEST(range(1, len(ws) + 1)) t(p)),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS said, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
