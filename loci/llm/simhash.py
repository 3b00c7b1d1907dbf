"""Near duplicates by SimHash and multi-index hashing.

Fingerprints have 64 bits.  Two that differ in at most three bits agree up to
one bit in one of their two 32-bit halves (else each half would differ in two
or more).  Each fingerprint is therefore filed under both halves, and looks
itself up under each half and under every half reached by setting one bit that
is clear; the pair that differs in that bit is found from the side where it is
clear.  What meets in a bucket is compared in full.  A bucket gives a spanning
forest of its links, never all pairs.

Buckets that could hold more than MAX_BUCKET rows are cut into blocks by a hash
of the fingerprint; every pair of blocks becomes a bucket of its own, so any
number of similar fingerprints is compared whole and by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loci.llm.common import fresh, texts_of, written
from loci.llm.components import components

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_DISTANCE = 3
HALF = 32
MAX_BUCKET = 8192
# Hot buckets up to this many are sent to every task (16 bytes each).
MAX_BROADCAST = 50_000


def fingerprint_of(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of one text: a bit is set if it is set in over half of the shingle hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], HASH_SEED) for a, b in zip(starts, stops, strict=True)], np.uint64, len(starts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        block = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """Fingerprint as a signed 64-bit number.  Null or blank text: zero."""

    @F.arrow_udf(returnType="long")
    def digest(column: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint_of(t, shingle) for t in texts_of(column)), np.uint64, len(column))
        return pa.array(values.view(np.int64), pa.int64())

    return digest(text)


def _half(side: int) -> Column:
    fp = F.col("fp")
    value = F.shiftrightunsigned(fp, HALF) if side else fp.bitwiseAND(F.lit((1 << HALF) - 1))
    return value.bitwiseOR(F.lit(side << HALF))


def _reached(key: Column) -> Column:
    """A half's own key and those with one clear bit set."""
    return F.concat(
        F.array(key),
        F.filter(
            F.transform(F.array(*[F.lit(1 << b) for b in range(HALF)]), lambda bit: key.bitwiseOR(bit)),
            lambda other: other != key,
        ),
    )


def _tree(values: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between fingerprints."""
    edges = []
    rest = values.copy()
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            at = frontier.pop()
            near = np.bitwise_count(rest ^ at) <= MAX_DISTANCE
            if near.any():
                found = rest[near]
                edges += [(int(at), int(x)) for x in found]
                frontier += list(found)
                rest = rest[~near]
    return edges


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Links inside each bucket; rows come sorted by bucket, one bucket is held at a time."""
    held_key, held = None, []

    def close() -> pa.RecordBatch | None:
        values = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        pairs = _tree(values) if len(values) > 1 else []
        if not pairs:
            return None
        both = np.array(pairs, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        block = batch.column(1).to_numpy(zero_copy_only=False)
        fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        # Only the first and last runs and those with two rows or more need a look.
        wanted = np.flatnonzero((stops - starts > 1) | (starts == 0) | (stops == len(key)))
        for i in wanted:
            a, b = starts[i], stops[i]
            name = (key[a], block[a])
            if name != held_key:
                if sum(map(len, held)) > 1 and (out := close()) is not None:
                    yield out
                held_key, held = name, []
            held.append(fp[a:b].copy())
    if sum(map(len, held)) > 1 and (out := close()) is not None:
        yield out


def links(fingerprints: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) that connect what lies within three bits; column fp holds distinct fingerprints."""
    sides = fingerprints.select("fp", F.explode(F.array(_half(0), _half(1))).alias("home"))
    # A bucket gets rows from at most 33 halves.  Were it to hold over max_bucket
    # rows, halves with at least max_bucket / 66 rows would bring over half of them.
    large = sides.groupBy("home").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max_bucket / 66)
    hot = large.select(F.explode(_reached(F.col("home"))).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))
    hot = written(hot.where(F.col("n") > max_bucket / 2).select("key", F.ceil(F.col("n") * 4 / max_bucket).alias("blocks")), "hot")
    rows = sides.select(F.explode(_reached(F.col("home"))).alias("key"), "fp")
    if (count := hot.count()) == 0:
        rows = rows.select("key", F.lit(0).cast("bigint").alias("block"), "fp")
    else:
        joined = rows.join(F.broadcast(hot) if count <= MAX_BROADCAST else hot, "key", "left")
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pairs = F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
            lambda other: F.least(mine, other) * F.col("blocks") + F.greatest(mine, other),
        )
        rows = joined.select("key", F.explode(F.coalesce(pairs, F.array(F.lit(0).cast("bigint")))).alias("block"), "fp")
    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(_bucket_links, "a long, b long")


def near_groups(fingerprints: DataFrame, link: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of a table (doc_id, fp); ``link`` finds their links.

    root is a fingerprint of the component, component_id its smallest doc_id;
    null only if all are null.
    """
    own = written(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(link(own.select("fp"))).toDF("fp", "root")
    linked = own.join(roots, "fp").groupBy("root").agg(F.min("first").alias("least"))
    named = roots.join(linked, "root").select("fp", "root", "least")
    return own.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id: one row per row of docs.

    Null and blank texts have fingerprint zero and are linked like any other.
    Repeated rows and equal texts share a component.  A null doc_id never names one.
    """
    prints = written(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("fp")), "fingerprints")
    named = written(near_groups(prints, lambda own: links(own, max_bucket)).drop("root"), "groups")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def row_keys(names: list[str]) -> list[Column]:
    """What tells a row apart: its doc_id, whether it has none, and a hash of its text."""
    key, nokey, digest = names
    return [F.coalesce("doc_id", F.lit(0)).cast("bigint").alias(key), F.isnull("doc_id").alias(nokey), F.xxhash64("text").alias(digest)]


def keep_first(docs: DataFrame, shingle: int = SHINGLE_WORDS, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One document of each group, with its own columns: that with the smallest doc_id.

    Of repeated rows with that doc_id, one with the smallest hash of its text
    stays.  In a group without any doc_id one row stays, likewise.
    """
    prints = docs.select("doc_id", *row_keys(["key", "nokey", "digest"]), fingerprint(F.col("text"), shingle).alias("fp"))
    return first_of(docs, written(prints, "fingerprints"), lambda own: links(own, max_bucket))


def first_of(docs: DataFrame, prints: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One document of each group, from a table (doc_id, key, nokey, digest, fp) of the same rows."""
    key, nokey, digest, turn = fresh(docs, "key", "nokey", "digest", "turn")
    named = near_groups(prints.select("doc_id", "fp"), link)
    best = (
        prints.join(named, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root").agg(F.min(F.struct("key", "nokey", "digest")).alias("pick")).select("pick.*").distinct().toDF(key, nokey, digest)
    )
    # One shuffle of the texts serves both the numbering of exact repeats and the join.
    repeats = Window.partitionBy(key, nokey, digest).orderBy(digest).rowsBetween(Window.unboundedPreceding, 0)
    dealt = docs.select("*", *row_keys([key, nokey, digest])).withColumn(turn, F.count(F.lit(1)).over(repeats)).where(F.col(turn) == 1)
    return dealt.join(best, [key, nokey, digest], "left_semi").select(*docs.columns)
