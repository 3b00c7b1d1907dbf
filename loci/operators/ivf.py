"""Nearest neighbours through an inverted file: vectors dealt to coarse centroids, a query looks into the nearest lists.

Centroids are fitted on a bounded sample (``sample`` rows, the least by a hash of their ids, so drawn from
all over the table); every row is then indexed.  A query's lists are searched by the
exact kernel, so scores are true cosines and only the choice of lists is approximate.
``certified`` removes that as well: a list whose angle to the query, less its own radius, cannot
reach the k-th score found so far holds nothing better; all other lists are searched in
a second pass.  Lists of any size are cut in blocks by the kernel, so one list with
a third of all rows is many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from loci.functions.vectors import top_k, unit_rows

SAMPLE = 20_000
ROUNDS = 12
# Angles are compared with this slack, above any rounding error of the kernel.
_SLACK = 1e-6


def fit_centroids(items: DataFrame, lists: int, item_id: str = "item_id", vector: str = "vector", sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means on at most ``sample`` rows; the result has at most ``lists`` rows of length one."""
    usable = items.where(F.col(vector).isNotNull())
    rows = usable.select(F.xxhash64(item_id).alias("h"), F.col(item_id).alias("i"), F.col(vector).alias("v")).orderBy("h", "i").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    points = unit_rows([r["v"] for r in rows])
    pick = np.random.default_rng(seed)
    centers = points[pick.choice(len(points), min(lists, len(points)), replace=False)]
    for _ in range(rounds):
        near = (points @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centers)
    return centers


@dataclass
class Index:
    """Centroids and the rows with their list number; ``radius`` has (list, n, radius), the largest angle of a row to its centroid."""

    centroids: np.ndarray
    rows: DataFrame
    radius: DataFrame

    def write(self, folder: str) -> None:
        """Store rows by list: each file holds a range of lists, so a search of a few lists skips the rest."""
        spark = self.rows.sparkSession
        self.rows.repartitionByRange("list").sortWithinPartitions("list").write.mode("overwrite").parquet(f"{folder}/rows")
        self.radius.write.mode("overwrite").parquet(f"{folder}/radius")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "list int, centroid array<double>").write.mode("overwrite").parquet(f"{folder}/centroids")

    @staticmethod
    def read(spark, folder: str) -> Index:
        held = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()
        return Index(np.array([r["centroid"] for r in held]), spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/radius"))


def build(items: DataFrame, lists: int, item_id: str = "item_id", vector: str = "vector", sample: int = SAMPLE) -> Index:
    """Index all rows with a vector; (item_id, vector, list) and whatever else the rows carry."""
    centroids = fit_centroids(items, lists, item_id, vector, sample)
    shared = items.sparkSession.sparkContext.broadcast(centroids)

    @pandas_udf("list int, angle double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        cos = unit_rows(vectors) @ shared.value.T
        best = cos.argmax(axis=1)
        return pd.DataFrame({"list": best.astype(np.int32), "angle": np.arccos(np.clip(cos[np.arange(len(best)), best], -1, 1))})

    placed = items.where(F.col(vector).isNotNull()).select("*", place(vector).alias("_p")).select(*items.columns, "_p.list", "_p.angle")
    radius = placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    return Index(centroids, placed.drop("angle"), radius)


def _nearest_lists(vector: Column, centroids: np.ndarray, probes: int, spark) -> Column:
    shared = spark.sparkContext.broadcast(centroids)

    @pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        cos = unit_rows(vectors) @ shared.value.T
        return pd.Series(list(np.argsort(-cos, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    return nearest(vector)


def _open_lists(vector: Column, worst: Column, done: Column, index: Index) -> Column:
    """Lists not searched yet that may hold something at least as good as the k-th score."""
    spark = index.rows.sparkSession
    angles = np.full(len(index.centroids), -1.0)  # lists without rows stay closed
    for r in index.radius.collect():  # one row per list
        angles[r["list"]] = r["radius"]
    shared = spark.sparkContext.broadcast((index.centroids, angles))

    @pandas_udf("array<int>")
    def still_open(vectors: pd.Series, floors: pd.Series, searched: pd.Series) -> pd.Series:
        centers, radii = shared.value
        units = unit_rows(vectors)
        away = np.arccos(np.clip(units @ centers.T, -1, 1)) - radii
        # A vector of length zero is at cosine 0 to everything.
        best = np.where(np.linalg.norm(units, axis=1, keepdims=True) > 0, np.cos(np.clip(away, 0, np.pi)), 0.0)
        reach = (best + _SLACK >= floors.fillna(-2.0).to_numpy()[:, None]) & (radii >= 0)
        return pd.Series([np.array(sorted(set(np.flatnonzero(r).tolist()) - set(s)), np.int32) for r, s in zip(reach, searched)])

    return still_open(vector, worst, done)


def search(queries: DataFrame, index: Index, k: int, probes: int = 8, *, certified: bool = False, query_id: str = "query_id", item_id: str = "item_id",
           vector: str = "vector", skip_same_id: bool = False) -> DataFrame:
    """Best k items for every query: (query_id, item_id, score, rank), from the ``probes`` nearest lists, or for certain.

    Zero vectors among the items score 0 wherever they lie; ties go to the smaller item_id, as in ``top_k``.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col(query_id).alias(query_id), F.col(vector).alias(vector)).where(F.col(vector).isNotNull())
    if not len(index.centroids):
        return top_k(asked, index.rows, k, query_id=query_id, item_id=item_id, vector=vector, skip_same_id=skip_same_id)
    first = asked.withColumn("_lists", _nearest_lists(F.col(vector), index.centroids, probes, spark))

    def looked(some: DataFrame) -> DataFrame:
        dealt = some.select(query_id, vector, F.explode("_lists").alias("list"))
        return top_k(dealt, index.rows, k, query_id=query_id, item_id=item_id, vector=vector, group="list", skip_same_id=skip_same_id).select(query_id, item_id, "score", "rank")

    found = looked(first)
    if not certified:
        return found
    worst = found.groupBy(query_id).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"))
    floor = F.when(F.col("n") == k, F.col("low"))
    more = first.join(worst, query_id, "left").withColumn("_lists", _open_lists(F.col(vector), floor, F.col("_lists"), index)).where(F.size("_lists") > 0)
    both = found.drop("rank").unionByName(looked(more).drop("rank"))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(item_id))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
