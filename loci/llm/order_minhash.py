"""Document fingerprints by Order MinHash: short tuples of minimal k-mers, kept in text order.

A k-mer is K code points with the number of its occurrence in the text (first,
second, ...), so repeats count and every k-mer is distinct.  Each gets a 64-bit
hash whose top bits put it in one of SKETCHES bins; each bin keeps its TUPLE smallest
k-mers, orders them by place in the text and hashes that tuple.  Two texts agree
in a bin when the same k-mers are minimal and stand in the same order, which
falls with the edit distance and not only with the shared vocabulary.  One sort
of the hashes serves all bins.

Texts shorter than K have one k-mer, the text itself.  Empty bins carry a fixed
mark and do not count for likeness; two texts without any k-mer are alike (1.0).
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.llm.common import fresh

K = 6
SKETCH_BITS = 6
SKETCHES = 1 << SKETCH_BITS
TUPLE = 2
EMPTY = 0
# Rows a range of doc_ids has about; ranges are dealt to tasks by hash.
RANGES_PER_TASK = 8

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACE = np.uint64(24)
_SHIFT_1, _SHIFT_2, _SHIFT_3 = np.uint64(30), np.uint64(27), np.uint64(31)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT_1)) * _MIX_1
    x = (x ^ (x >> _SHIFT_2)) * _MIX_2
    return x ^ (x >> _SHIFT_3)


def sketch(codes: np.ndarray, k: int = K, tuple_size: int = TUPLE) -> np.ndarray:
    """Signature of a text given as code points: one 32-bit number per bin."""
    out = np.zeros(SKETCHES, np.uint32)
    n = len(codes)
    if not n:
        return out
    wide = codes.astype(np.uint64)
    width = min(k, n)
    grams = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        grams *= _BASE
        grams += wide[j : n - width + 1 + j] + np.uint64(1)
    # 40 bits of hash above 24 bits of place: plain sorts give the order of both.
    bits = _PLACE if n < 1 << 24 else np.uint64(n.bit_length())
    where = np.arange(len(grams), dtype=np.uint64)
    keys = np.sort(((_mix(grams) >> bits) << bits) | where)
    values = keys >> bits
    new = np.concatenate([[True], values[1:] != values[:-1]])
    if not new.all():  # number the occurrences, and let the number change the hash of all but the first
        runs = np.flatnonzero(new)
        nth = np.arange(len(keys)) - np.repeat(runs, np.diff(np.append(runs, len(keys))))
        again = np.flatnonzero(nth)
        moved = _mix(values[again] + nth[again].astype(np.uint64) * _BASE)
        keys[again] = ((moved >> bits) << bits) | (keys[again] & ((np.uint64(1) << bits) - np.uint64(1)))
        keys.sort()
    bins = np.searchsorted(keys, np.arange(SKETCHES, dtype=np.uint64) << np.uint64(64 - SKETCH_BITS))
    sizes = np.minimum(np.diff(np.append(bins, len(keys))), tuple_size)
    slots = bins[:, None] + np.arange(tuple_size)
    used = np.arange(tuple_size) < sizes[:, None]
    slots = np.where(used, slots, 0)
    places = np.where(used, (keys[slots] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), n)
    hashes = np.where(used, keys[slots] >> bits, np.uint64(0))
    by_place = np.take_along_axis(hashes, np.argsort(places, axis=1, kind="stable"), axis=1)
    digest = np.zeros(SKETCHES, np.uint64)
    for j in range(tuple_size):
        digest = _mix(digest * _BASE + by_place[:, j] + np.uint64(1))
    filled = sizes > 0
    out[filled] = (digest[filled] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those filled in either signature."""
    filled = (a != EMPTY) | (b != EMPTY)
    return float((a[filled] == b[filled]).mean()) if filled.any() else 1.0


def _codes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def _hex(signature: np.ndarray) -> str:
    return struct.pack(f">{SKETCHES}I", *signature.tolist()).hex()


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _pairs(k: int, tuple_size: int):
    """Compare each document with the next; rows come by range, each range with the first row of the next at its end."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held = None  # range, doc_id, text, code points, signature of the row before
        for batch in batches:
            rows = []
            for span, guard, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                codes = _codes(text)
                here = (span, doc, text or "", codes, sketch(codes, k, tuple_size))
                if held is not None and held[0] == span:
                    _, one, before, own, signature = held
                    n = len(own)
                    half = n // 2
                    edited = before[: n - half] + here[2][:half]
                    other = sketch(np.concatenate([own[: n - half], codes[:half]]), k, tuple_size)
                    rows.append((
                        one, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _hex(signature), _hex(other),
                        likeness(signature, other), likeness(signature, here[4]),
                    ))
                held = None if guard else here
            if rows:
                names = [x.split()[0] for x in OUT.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names)

    return compare


def with_next(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows (span, guard, doc_id, text): spans of neighbouring doc_ids, in each the first row of the next span as guard.

    Only span borders reach the driver, RANGES_PER_TASK for each task.
    """
    spark = docs.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = tasks * RANGES_PER_TASK
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    found = narrow.agg(F.percentile_approx("doc_id", [i / spans for i in range(1, spans)], min(100 * spans, 1_000_000))).first()[0]
    borders = np.array(sorted(set(found or [])), np.int64)

    @F.arrow_udf(returnType="long")
    def span_of(ids: pa.Array) -> pa.Array:
        known = np.searchsorted(borders, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right") + 1
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, known), pa.int64())

    # The least row of each span, ties by text hash and then by row number within equal ones.
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("span", span_of("doc_id"))
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("digest"))
    firsts = rows.groupBy("span").agg(F.min(key).alias("first")).orderBy("span").collect()
    if not firsts:
        return rows.select("span", F.lit(False).alias("guard"), "doc_id", "text")
    heads = [(firsts[(i + 1) % len(firsts)]["first"], firsts[i]["span"]) for i in range(len(firsts))]
    guards = spark.createDataFrame([(h[0], h[1], int(s)) for h, s in heads], "head long, digest long, before long")
    at_head = rows.join(F.broadcast(guards), F.col("doc_id").eqNullSafe(F.col("head")) & (F.xxhash64("text") == F.col("digest")), "left")
    both = F.when(F.col("before").isNull(), F.array(F.struct(F.col("span"), F.lit(False).alias("guard")))).otherwise(
        F.array(F.struct(F.col("span"), F.lit(False).alias("guard")), F.struct(F.col("before").alias("span"), F.lit(True).alias("guard")))
    )
    return at_head.select(F.explode(both).alias("x"), "doc_id", "text").select("x.span", "x.guard", "doc_id", "text")


def neighbours(docs: DataFrame, k: int = K, tuple_size: int = TUPLE) -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness.

    The edited text has its last half of code points replaced by the first as
    many of the next document by doc_id (after the last: the first).  Null text
    is empty; null doc_ids come first; equal doc_ids are ordered by a hash of the
    text.  A single row is its own next.  An empty table gives no rows.
    """
    rows = with_next(docs)
    (digest,) = fresh(rows, "digest")
    dealt = rows.withColumn(digest, F.xxhash64("text")).repartition("span").sortWithinPartitions("span", "guard", F.col("doc_id").asc_nulls_first(), digest)
    return dealt.select("span", "guard", "doc_id", "text").mapInArrow(_pairs(k, tuple_size), OUT)
