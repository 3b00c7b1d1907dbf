"""Vectors: the hashing embedder and the two blocked similarity kernels.

Spark has no vector built-ins, and higher-order functions over 384-element
arrays run outside code generation, so the arithmetic is done by numpy on
Arrow batches.  Spark still owns partitioning, merging and ranking.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

from loci.functions import fixed

# Largest matrix sent to the executors at a time; larger sides are cut in slices.
BLOCK_BYTES = 32 * 1024 * 1024
# Queries up to this size are sent to the items instead of shuffling the items to them.
FEW_BYTES = 8 * 1024 * 1024
# Rows of a block of items and of queries: they bound the work of a task, where narrow vectors leave a block many rows.
BLOCK_ITEMS = 32_768
BLOCK_QUERIES = 16_384
# Scores held at once by a task.
SCORE_CELLS = 4_000_000
# Texts whose words are spread out to vectors at a time.
EMBED_ROWS = 512
# Scores are compared after this rounding, so that equal vectors tie exactly
# whatever the summation order was, and the id decides.
SCORE_DIGITS = 9


def unit_rows(vectors) -> np.ndarray:
    """Stack to float64 and scale each row to length one (zero rows stay zero)."""
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


# --- embedding -----------------------------------------------------------------


def embedding_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def token_code(token: str, size: int) -> int:
    """Signed 1-based bucket of a token, from its md5."""
    digest = md5(token.encode()).hexdigest()
    bucket = int(digest[:6], 16) % size + 1
    return -bucket if int(digest[6], 16) % 2 else bucket


class _Codes(dict):
    """Codes of the words seen so far; emptied when it gets large."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, token):
        if len(self) > 200_000:
            self.clear()
        code = self[token] = token_code(token, self.size)
        return code


def _scatter(words: pa.ListArray, codes: _Codes) -> np.ndarray:
    """Vectors of a few lists of words; only distinct words become Python strings."""
    m = np.zeros((len(words), codes.size))
    flat = words.flatten().dictionary_encode()
    if len(flat):
        lengths = pc.list_value_length(words).fill_null(0).to_numpy()
        known = np.fromiter((codes[w] for w in flat.dictionary.to_pylist()), np.int64, len(flat.dictionary))
        flat = known[flat.indices.to_numpy()]
        np.add.at(m, (np.repeat(np.arange(len(words)), lengths), np.abs(flat) - 1), np.sign(flat))
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0).astype(np.float32)


def embed(text: Column, size: int = fixed.VECTOR_SIZE) -> Column:
    """Deterministic bag-of-words vector: signed token hashing, length one.

    A stand-in for a sentence model, which needs files this package does not
    ship; every operator takes any other vector column just as well.
    """

    @arrow_udf("array<float>")
    def scatter(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = _Codes(size)
        for words in batches:
            # Words stay in Arrow, and EMBED_ROWS texts at a time are spread out, so memory does not follow the texts' number or length.
            made = [_scatter(words.slice(at, EMBED_ROWS), codes).ravel() for at in range(0, len(words), EMBED_ROWS)]
            ends = np.arange(0, (len(words) + 1) * size, size, dtype=np.int32)
            yield pa.ListArray.from_arrays(ends, np.concatenate(made) if made else np.zeros(0, np.float32))

    return scatter(embedding_tokens(text))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns of one row; 0 when either has no length."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0),
            lambda acc, v: acc + F.coalesce(v, F.lit(0.0)),
        )

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


# --- top-k of many items for a batch of queries ----------------------------------


def _blocks(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """How many blocks of at most BLOCK_BYTES and about ``rows`` rows a vector table makes, per group where there is one."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"))
    count = F.greatest(F.ceil(F.col("n") * F.col("width") * 8 / BLOCK_BYTES), F.ceil(F.col("n") / rows), F.lit(1)).cast("int")
    return sizes.select(*keys, F.coalesce(count, F.lit(1)).alias("blocks"))


def _ids(values: pd.Series) -> np.ndarray:
    a = values.to_numpy()
    return a.astype(str) if a.dtype == object else a


def _keep_best(rows, k):
    """Best k per query of (query index, id, score) arrays, ties by id."""
    q, ids, s = rows
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    keep = np.arange(len(q)) - start < k
    return q[keep], ids[keep], s[keep]


def _least_needed(s, k):
    """A lower bound of every row's k-th best score."""
    wide = s.shape[1] // (4 * k)
    if wide > 4:
        # The k-th best of the bests of 4k stretches: k scores are at least that.
        s = s[:, : 4 * k * wide].reshape(len(s), 4 * k, wide).max(axis=2)
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]


def _block_hits(qm, xm, k, floor):
    """(query, item, score) of everything that can be in a query's best k."""
    usable = np.flatnonzero(np.isfinite(xm).all(axis=1))
    if len(usable) < len(xm):
        xm = xm[usable]
    # Scores are rounded only where they can matter; rounding moves none by more than this.
    slack = 10.0**-SCORE_DIGITS
    step = max(1, SCORE_CELLS // max(1, len(xm)))
    for lo in range(0, len(qm), step):
        s = qm[lo:lo + step] @ xm.T
        least = np.full(len(s), -np.inf if floor is None else floor)
        if s.shape[1] > k:
            least = np.maximum(least, _least_needed(s, k))
        qi, xi = np.nonzero(s >= least[:, None] - slack)
        found = np.round(s[qi, xi], SCORE_DIGITS)
        if floor is not None:
            some = found >= floor
            qi, xi, found = qi[some], xi[some], found[some]
        yield qi + lo, usable[xi], found


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of length one from an Arrow column of vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _best_of_few(asked: pa.Table, items: DataFrame, take: int, min_score: float | None, grouped: bool, schema: T.StructType) -> DataFrame:
    """Best ``take`` items of a few queries in every partition of the items, which stay where they are."""
    shared = items.sparkSession.sparkContext.broadcast(asked)
    names = schema.names

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        qm = _matrix(asked.column("vector").combine_chunks())
        groups: dict = {}
        if grouped:
            for i, g in enumerate(asked.column("_group").to_pylist()):
                groups.setdefault(g, []).append(i)
            groups = {g: np.array(at) for g, at in groups.items()}
        kept = None
        for batch in batches:
            ids, xm = _ids(pd.Series(batch.column(0).to_pandas())), _matrix(batch.column(1))
            parts = [(slice(None), np.arange(len(qm)))]
            if grouped:
                held = pd.Series(batch.column(2).to_pandas())
                parts = [(np.asarray(at), groups[g]) for g, at in held.groupby(held).indices.items() if g in groups]
            for at, rows in parts:
                own, own_ids = xm[at], ids[at]
                hits = [_keep_best((rows[qi], own_ids[xi], s), take) for qi, xi, s in _block_hits(qm[rows], own, take, min_score)]
                kept = _keep_best(tuple(np.concatenate(c) for c in zip(*([] if kept is None else [kept]), *hits)), take)
        if kept is not None and len(kept[0]):
            columns = [asked.column("_q").combine_chunks().take(pa.array(kept[0])), pa.array(kept[1].tolist(), batch.schema.types[0]), pa.array(kept[2])]
            yield pa.RecordBatch.from_arrays(columns, names)

    return items.mapInArrow(best, schema)


def top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    item_id: str = "item_id",
    vector: str = "vector",
    group: str | None = None,
    skip_same_id: bool = False,
    min_score: float | None = None,
) -> DataFrame:
    """Exact best-k items by cosine for every query: (query_id, item_id, score, rank).

    Queries of at most FEW_BYTES in all are sent to the items, which are then not
    shuffled.  Beyond that both sides stay distributed: each is cut by a hash of its ids
    into blocks of at most BLOCK_BYTES (and of some BLOCK_QUERIES or BLOCK_ITEMS rows); every query block meets every item block in one
    task, which multiplies them and keeps its own best k per query.  The best
    of all tasks are ranked per query.  With ``group`` set, a query only sees
    items with the same value in that column, and blocks are cut per group, so
    a large group is many tasks and a small one a single task.
    """
    keys = ["_group"] if group else []
    named = [F.col(group).alias("_group")] if group else []
    qcols = queries.select(F.col(query_id).alias("_q"), F.col(vector).alias("vector"), *named).where(F.col("vector").isNotNull())
    icols = items.select(F.col(item_id).alias("_i"), F.col(vector).alias("vector"), *named).where(F.col("vector").isNotNull())
    qtype, itype = qcols.schema["_q"].dataType, icols.schema["_i"].dataType
    schema = T.StructType([
        T.StructField(query_id, qtype), T.StructField(item_id, itype), T.StructField("score", T.DoubleType()),
    ])
    # One more candidate per query where the query itself is among the items.
    take = k + 1 if skip_same_id else k

    order = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(item_id))

    def ranked(found: DataFrame) -> DataFrame:
        if skip_same_id:
            found = found.where(F.col(query_id) != F.col(item_id))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    size = qcols.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if size[0] * (size[1] or 0) * 8 <= FEW_BYTES:
        found = _best_of_few(qcols.toArrow(), icols.select("_i", "vector", *keys), take, min_score, bool(group), schema)
        return ranked(found)

    grid = _blocks(qcols, keys, BLOCK_QUERIES).withColumnRenamed("blocks", "_qs")
    other = _blocks(icols, keys, BLOCK_ITEMS).withColumnRenamed("blocks", "_is")
    # Without a group this is one row; with one, a row per group of both sides.
    grid = grid.join(other, keys) if keys else grid.withColumn("_is", other.select("_is").scalar())

    def dealt(side: DataFrame, own: str, across: str, key: str) -> DataFrame:
        with_grid = side.join(grid, keys) if keys else side.withColumns({c: grid.select(c).scalar() for c in ("_qs", "_is")})
        block = F.pmod(F.xxhash64(key), F.col(own)).cast("int")
        return with_grid.select(
            *keys, key, "vector", block.alias("_own"), F.explode(F.sequence(F.lit(0), F.col(across) - 1)).alias("_other")
        )

    left = dealt(qcols, "_qs", "_is", "_q").withColumnsRenamed({"_own": "_qb", "_other": "_ib"})
    right = dealt(icols, "_is", "_qs", "_i").withColumnsRenamed({"_own": "_ib", "_other": "_qb"})

    def best(qs: pa.Table, xs: pa.Table) -> pa.Table:
        # Vectors and ids stay in Arrow; items are put in order of their ids, so that places decide ties.
        xs = xs.take(pc.sort_indices(xs, [("_i", "ascending")], null_placement="at_start"))
        kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        if len(qs) and len(xs):
            qm, xm = (_matrix(side.column("vector").combine_chunks()) for side in (qs, xs))
            hits = [_keep_best(found, take) for found in _block_hits(qm, xm, take, min_score)]
            kept = tuple(np.concatenate(c) for c in zip(*hits))
        return pa.Table.from_arrays([qs.column("_q").take(pa.array(kept[0])), xs.column("_i").take(pa.array(kept[1])), pa.array(kept[2])], schema.names)

    on = [*keys, "_qb", "_ib"]
    merged = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(best, schema)
    return ranked(merged)


# --- scores of a few candidates for every row of a big table ------------------------


def candidate_scores(rows_vector: Column, matrix: np.ndarray, spark) -> Column:
    """array<double> of the row's cosine with every row of a small matrix."""
    shared = spark.sparkContext.broadcast(matrix)

    @pandas_udf("array<double>")
    def score(vectors: pd.Series) -> pd.Series:
        empty = vectors.isna().to_numpy()
        if empty.all():
            return pd.Series([None] * len(vectors))
        out = np.zeros((len(vectors), len(shared.value)))
        out[~empty] = np.round(unit_rows(vectors[~empty]) @ shared.value.T, SCORE_DIGITS)
        return pd.Series([None if e else r for e, r in zip(empty, out)])

    return score(rows_vector)


def embedded_scores(text: Column, matrix: np.ndarray, spark) -> Column:
    """``candidate_scores`` of the text's vector, which itself stays in the task."""
    shared = spark.sparkContext.broadcast(matrix)

    @arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codes = _Codes(shared.value.shape[1])
        for words in batches:
            cut = (_scatter(words.slice(at, EMBED_ROWS), codes) for at in range(0, len(words), EMBED_ROWS))
            made = [np.round(unit_rows(m) @ shared.value.T, SCORE_DIGITS).ravel() for m in cut]
            ends = np.arange(0, (len(words) + 1) * len(shared.value), len(shared.value), dtype=np.int32)
            yield pa.ListArray.from_arrays(ends, np.concatenate(made) if made else np.zeros(0))

    return score(embedding_tokens(text))
