"""Near copies: 5-word shingles, Jaccard 0.8 or more, checked on the whole shingle sets.

A text is the set of its shingle hashes; equal sets count once.  Candidates come
from two look-ups.  One is op9's multi-index of SimHash fingerprints, here of the set:
what hangs together by three bits is one bucket.  At Jaccard 0.8 most pairs differ
in more bits than that, so MinHash gives the others: BANDS keys, each of ROWS minima; a pair
at 0.8 shares no key with chance (1 - 0.8^5)^20 = 0.0004, a closer pair with less.  What shares
a bucket is compared by sketch (one byte of each of the 100 minima) and by size.
The sketch only sorts out pairs: SCREEN lies four standard errors below 0.8.

Links are found in two rounds, each checked on the whole sets.  In the first a
bucket gives a spanning forest of the pairs that look close (SURE), so a group of
copies never lists all its pairs.  In the second, buckets that the first has left in
several components get the whole sets, and every pair of different components above
SCREEN is tried there; only links that connect two components are handed on.

Buckets of over MAX_BUCKET rows are cut into blocks by a hash of the set; every
pair of blocks is a bucket of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loci.llm import simhash
from loci.llm.common import texts_of, written
from loci.llm.components import components

SHINGLE_WORDS = 5
JACCARD = 0.8
BANDS, ROWS = 20, 5
SURE, SCREEN = 0.85, 0.64
MAX_BUCKET = 2048
# A needed text's digest takes 8 bytes of every task; above this many they are joined by a shuffle.
MAX_BROADCAST = 1_000_000
_BLOCK = 8192

_draw = np.random.default_rng(42)
_TIMES = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes | None, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, a blank one none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, simhash.HASH_SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], simhash.HASH_SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)))


def name_of(found: np.ndarray) -> int:
    """One number for a set of shingles."""
    return xxhash.xxh3_64_intdigest(found.tobytes())


def minima(found: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the BANDS * ROWS hash functions."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _BLOCK):
        np.minimum(least, (found[None, at : at + _BLOCK] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1), out=least)
    return least


def print_of(found: np.ndarray) -> int:
    """SimHash fingerprint of a set of shingles; zero for none."""
    return simhash.majority(found) if len(found) else 0


def band_keys(least: np.ndarray) -> list[int]:
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)]


def sketch_of(least: np.ndarray) -> bytes:
    """One byte of each minimum, mixed, as the minima of a long text share their upper bits."""
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _longs(values: Iterable[int]) -> pa.Array:
    return pa.array(np.fromiter(values, np.uint64).view(np.int64))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """(doc_id, key, nokey, digest, fp, size, print, sketch, bands) for rows whose last column is the text."""
    for batch in batches:
        sets = [shingles(t) for t in texts_of(batch.column(batch.num_columns - 1))]
        least = [minima(x) for x in sets]
        bands = _longs(k for x, m in zip(sets, least, strict=True) for k in (band_keys(m) if len(x) else ()))
        offsets = np.concatenate([[0], np.cumsum([BANDS if len(x) else 0 for x in sets])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], _longs(map(name_of, sets)), pa.array([len(x) for x in sets], pa.int64()),
             _longs(map(print_of, sets)), pa.array([sketch_of(m) for m in least], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), bands)],
            [*batch.schema.names[:-1], "fp", "size", "print", "sketch", "bands"])


def _alike(sketch: np.ndarray, size: np.ndarray, at: int, rest: np.ndarray, least: float) -> np.ndarray:
    """Which of ``rest`` look at least so close to row ``at``."""
    a, b = size[at], size[rest]
    fits = rest[(np.minimum(a, b) >= JACCARD * np.maximum(a, b))]
    if not len(fits):
        return fits
    return fits[(sketch[fits] == sketch[at]).sum(axis=1) >= least * BANDS * ROWS]


def forest(sketch: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Row pairs of a spanning forest of those that look close."""
    pairs, rest = [], np.arange(len(size))
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = _alike(sketch, size, at, rest, SURE)
            if len(near):
                pairs += [(at, x) for x in near]
                frontier += near.tolist()
                rest = np.setdiff1d(rest, near, assume_unique=True)
    return pairs


def across(sketch: np.ndarray, size: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Near copies, by their whole sets, that connect the different components of a bucket; every pair above SCREEN is tried."""
    pairs, root = [], root.copy()
    for at in range(len(size) - 1):
        rest = np.arange(at + 1, len(size))
        rest = rest[root[rest] != root[at]]
        for x in _alike(sketch, size, at, rest, SCREEN) if len(rest) else ():
            if root[x] != root[at] and jaccard(sets[at], sets[x]) >= JACCARD:
                pairs.append((at, x))
                root[root == root[x]] = root[at]
    return pairs


def _bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Pairs (a, b) inside each bucket; rows (band, block, fp, size, sketch[, root, found]) come sorted by bucket.

    Without whole sets the pairs are to be checked, with them they are links.
    """
    held_key, held = None, []

    def close() -> Iterable[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        fp = rows.column(2).to_numpy()
        _, first = np.unique(fp, return_index=True)
        if len(first) < 2:
            return
        fp, size = fp[first], rows.column(3).to_numpy()[first]
        sketch = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)[first]
        if rows.num_columns > 5:
            sets = [np.frombuffer(rows.column(6)[i].as_py(), np.uint64) for i in first.tolist()]
            pairs = across(sketch, size, rows.column(5).to_numpy()[first], sets)
        else:
            pairs = forest(sketch, size)
        for at in range(0, len(pairs), 100_000):
            both = np.sort(fp[np.array(pairs[at : at + 100_000])], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        block = batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
            name = (key[a], block[a])
            if name != held_key:
                if held:
                    yield from close()
                held_key, held = name, []
            held.append(batch.slice(a, b - a))
    if held:
        yield from close()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """(fp, found) of the texts of a table (text), each set once a task."""
    seen = set()
    for batch in batches:
        names, sets = [], []
        for text in texts_of(batch.column(0)):
            found = shingles(text)
            if (name := name_of(found)) not in seen:
                seen.add(name)
                names.append(name)
                sets.append(found.tobytes())
        yield pa.RecordBatch.from_arrays([_longs(names), pa.array(sets, pa.binary())], ["fp", "found"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The pairs (a, b, one set, other set) that are near copies."""
    for batch in batches:
        one, other = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= JACCARD for x, y in zip(one, other, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets_of(wanted: DataFrame, own: DataFrame, docs: DataFrame) -> DataFrame:
    """(fp, found): the whole sets of a table (fp), from the texts."""
    needed = written(own.join(wanted.distinct(), "fp", "left_semi").select(F.col("digest").alias("d")).distinct(), "needed")
    texts = docs.select("text").join(F.broadcast(needed) if needed.count() <= MAX_BROADCAST else needed, F.xxhash64("text") == F.col("d"), "left_semi")
    return written(texts.mapInArrow(_sets, "fp long, found binary").groupBy("fp").agg(F.first("found").alias("found")), "sets")


def _checked(pairs: DataFrame, own: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs of sets (a, b) with Jaccard 0.8 or more, by the texts themselves."""
    pairs = written(pairs.distinct(), "pairs")
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("fp")), own, docs)
    left, right = sets.toDF("a", "one"), sets.toDF("b", "other")
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "one", "other")
    return written(rows.mapInArrow(_confirm, "a long, b long"), "links")


def _dealt(members: DataFrame, max_bucket: int) -> DataFrame:
    """Rows of each bucket together, in order; large buckets as pairs of blocks."""
    hot = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_bucket)
    hot = written(hot.select("band", F.ceil(F.col("n") * 2 / max_bucket).alias("blocks")), "hot")
    values = members.columns[1:]
    zero = F.lit(0).cast("bigint")
    if hot.isEmpty():
        rows = members.select("band", zero.alias("block"), *values)
    else:
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pairs = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda o: F.least(mine, o) * F.col("blocks") + F.greatest(mine, o))
        rows = members.join(hot, "band", "left").select("band", F.explode(F.coalesce(pairs, F.array(zero))).alias("block"), *values)
    return rows.repartition("band", "block").sortWithinPartitions("band", "block")


def _print_keys(own: DataFrame) -> DataFrame:
    """(band, fp): a bucket for each group of sets whose fingerprints hang together by three bits."""
    prints = own.where("size > 0").select("fp", "print")
    distinct = written(prints.select(F.col("print").alias("fp")).distinct(), "prints")
    roots = components(simhash.links(distinct)).toDF("print", "root")
    return prints.join(roots, "print", "left").select(F.xxhash64(F.coalesce("root", "print"), F.lit("print")).alias("band"), "fp")


def links(own: DataFrame, docs: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Near copies (a, b) that connect all found ones, from a table (fp, size, print, sketch, bands, digest) with one row per set."""
    keyed = written(own.select(F.explode("bands").alias("band"), "fp").unionByName(_print_keys(own)), "keyed")
    shared = keyed.groupBy("band").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("band")
    rows = keyed.join(shared, "band", "left_semi")
    members = written(rows.join(own.select("fp", "size", "sketch"), "fp").select("band", "fp", "size", "sketch"), "members")
    found = _checked(_dealt(members, max_bucket).mapInArrow(_bucket_pairs, "a long, b long"), own, docs)
    roots = components(found).toDF("fp", "root")
    rooted = members.join(roots, "fp", "left").select(*members.columns, F.coalesce("root", "fp").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    left = written(rooted.join(mixed, "band", "left_semi").select(*members.columns, "root"), "mixed")
    whole = left.join(_sets_of(left.select("fp"), own, docs), "fp").select(*left.columns, "found")
    more = written(_dealt(whole, max_bucket).mapInArrow(_bucket_pairs, "a long, b long"), "more")
    return found.unionByName(more)


def keep_first(docs: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One document of each group of near copies, as simhash.keep_first picks it; null and blank texts are one group."""
    schema = "doc_id long, key long, nokey boolean, digest long, fp long, size long, print long, sketch binary, bands array<long>"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *simhash.row_keys(["key", "nokey", "digest"]), "text")
    prints = written(rows.mapInArrow(_describe, schema), "sets_described")

    def linked(_: DataFrame) -> DataFrame:
        own = prints.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("size", "print", "sketch", "bands", "digest")])
        return links(written(own, "own"), docs, max_bucket)

    return simhash.first_of(docs, prints.select("doc_id", "key", "nokey", "digest", "fp"), linked)
