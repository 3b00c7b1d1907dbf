"""Quality by hierarchical empirical Bayes: a document's own evidence, weighed with what its host and path are like.

A logistic classifier on words and their shapes, fitted to a bounded sample of
labelled documents, gives each document a chance p of being good.  Chances are
summed by path and host.  The spread between sites beyond chance sets, by
moments, how strongly a site is drawn to the level above: a host's posterior is
(strength * global mean + sum p) / (strength + n), a path's the same towards its
host.  Sparse sites stay near the prior, large ones speak for themselves.  The
document's posterior odds are its own odds times the odds of its path (without
the document itself) over the global odds.

Null text has no words and the evidence of its shape figures alone.  A null host
or path is a site of its own.  Without labels of both kinds all evidence is 0.5.
Repeated rows count as often as they occur.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loci.llm.common import texts_of, written

BUCKETS = 2048
SHAPES = 256
DENSE = 5
FIT_ROWS = 4000  # labelled documents the classifier is fitted to, at most
SEED = 17
_RUNS = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[0-9]+"), b"9")]


def _shape(token: bytes) -> bytes:
    token = token[:24]
    for pattern, to in _RUNS:
        token = pattern.sub(to, token)
    return token[:8]


def _buckets(token: bytes) -> tuple[int, int]:
    return SHAPES + zlib.crc32(token) % (BUCKETS - SHAPES), zlib.crc32(_shape(token)) % SHAPES


class Features:
    """Shares of hashed words and word shapes, and a few figures, of one text after another."""

    def __init__(self, most: int = 500_000):
        self.seen: dict[bytes, tuple[int, int]] = {}
        self.most = most

    def of(self, text: bytes | None) -> np.ndarray:
        tokens = (text or b"").split()
        out = np.zeros(BUCKETS + DENSE, np.float32)
        n = len(tokens)
        out[-1] = 1.0
        if not n:
            return out
        if len(self.seen) > self.most:
            self.seen = {}
        seen = self.seen
        for token in set(tokens).difference(seen):
            seen[token] = _buckets(token)
        both = np.array([seen[t] for t in tokens], np.int64).ravel()
        out[:BUCKETS] = np.sqrt(np.bincount(both, minlength=BUCKETS) / n)
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[BUCKETS] = np.log1p(n) / 5
        out[BUCKETS + 1] = len(set(tokens)) / n
        out[BUCKETS + 2] = len(set(lines)) / max(1, len(lines))
        out[BUCKETS + 3] = min(1.0, n / 50)
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 2.0, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression by gradient steps with momentum."""
    w, v = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = 0.9 * v - rate * 0.1 * (x.T @ (p - y) / len(y) + ridge * w) * 4
        w = w + v
    return w


def evidence(text: Column, weights: np.ndarray) -> Column:
    """Chance of good by the text alone, kept within [0.001, 0.999]."""

    @F.arrow_udf(returnType="double")
    def chance(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = Features()
        for column in batches:
            odds = np.array([features.of(t) @ weights for t in texts_of(column)], float)
            yield pa.array(np.clip(1 / (1 + np.exp(-np.clip(odds, -30, 30))), 0.001, 0.999))

    return chance(text)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Fit to a hash sample of labelled documents; the sample's keys, at most about ``fit_rows``, are broadcast."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("y"))
    total = known.count()
    if total > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            rows = [features.of(t).tobytes() for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["y", "x"])

    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.col("y").cast("double").alias("y"), "text")
    rows = sample.mapInArrow(featured, "y double, x binary").collect()
    y = np.array([r["y"] for r in rows])
    if not rows or y.min() == y.max():
        return np.zeros(BUCKETS + DENSE)
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["x"], rows[i]["y"]))
    x = np.stack([np.frombuffer(rows[i]["x"], np.float32) for i in order])
    return fit_logistic(x, y[order])


def _strength(groups: DataFrame, mean: float) -> float:
    """Prior strength by moments: spread of group means beyond that of chance within groups."""
    found = groups.agg(
        (F.sum(F.col("n") * F.pow(F.col("sum") / F.col("n") - mean, 2)) / F.sum("n")).alias("between"),
        (F.sum(F.greatest(F.col("squares") / F.col("n") - F.pow(F.col("sum") / F.col("n"), 2), F.lit(0.0))) / F.sum("n")).alias("chance"),
    ).first()
    spread = max((found["between"] or 0.0) - (found["chance"] or 0.0), 1e-6)
    return float(np.clip(mean * (1 - mean) / spread - 1, 1.0, 1e5))


def _logit(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def judged(docs: DataFrame, labels: DataFrame, host: Column, path: Column, fit_rows: int = FIT_ROWS, threshold: float = 0.5) -> DataFrame:
    """doc_id, host, path, p_doc, p_host, p_path, p_good and kept: one row per row of docs."""
    weights = fit(docs, labels, fit_rows)
    rows = written(docs.select("doc_id", host.alias("host"), path.alias("path"), evidence(F.col("text"), weights).alias("p_doc")), "evidence")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("p_doc").alias("sum"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("squares")]
    paths = written(rows.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "sum", "squares")])
    total = hosts.agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).first()
    mean = float(np.clip((total["sum"] or 0.5) / (total["n"] or 1), 0.001, 0.999))
    k_host, k_path = _strength(hosts, mean), _strength(paths, mean)
    host_level = hosts.select(F.col("host").alias("h"), ((k_host * mean + F.col("sum")) / (k_host + F.col("n"))).alias("p_host"))
    sites = paths.join(host_level, F.col("host").eqNullSafe(F.col("h"))).select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "sum", "p_host")
    sites = written(sites, "sites")
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    others = (k_path * F.col("p_host") + F.col("sum") - F.col("p_doc")) / (k_path + F.col("n") - 1)
    odds = _logit(F.col("p_doc")) + _logit(others) - (np.log(mean) - np.log1p(-mean)).item()
    out = joined.withColumn("p_path", others).withColumn("p_good", 1 / (1 + F.exp(-odds)))
    return out.select("doc_id", "host", "path", "p_doc", "p_host", "p_path", "p_good", (F.col("p_good") >= threshold).alias("kept"))
