"""Drawer storage: an append-only log, its current view, and all changes to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loci.functions import text as tx
from loci.functions.vectors import embed
from loci.operators.filters import apply_where
from loci.schemas import DRAWER_LOG, conform

KEY = ("palace", "point_id")


def latest(log: DataFrame, keys, order: Column) -> DataFrame:
    """Last row per key by an order column; partially aggregated before the shuffle.

    Keys come from the grouping, so filters on them reach the scan.
    """
    rest = [c for c in log.columns if c not in keys]
    row = F.max_by(F.struct(*rest), order)
    return log.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(*log.columns)


def current(log: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The rows that are there now: last write per key wins, deletes vanish.

    With ``columns`` only those are read besides the key and order of writes.
    """
    if columns is not None:
        kept = dict.fromkeys([*KEY, "version", "seq", "op", *columns])
        log = log.select(*kept)
    found = latest(log, KEY, F.struct("version", "seq")).where(F.col("op") == "upsert")
    return found if columns is None else found.select(*columns)


def as_upserts(rows: DataFrame, version: Column | int = 0, seq: Column | None = None) -> DataFrame:
    """Log rows that add or replace drawers (embedding those without a vector)."""
    if "vector" not in rows.columns:
        rows = rows.withColumn("vector", embed(F.col("document")))
    if "point_id" not in rows.columns:
        rows = rows.withColumn("point_id", tx.point_id(F.col("original_id")))
    version = version if isinstance(version, Column) else F.lit(version)
    rows = rows.withColumn("op", F.lit("upsert")).withColumn("version", version)
    if seq is not None:
        rows = rows.withColumn("seq", seq)
    elif "seq" not in rows.columns:
        rows = rows.withColumn("seq", F.lit(0))
    return conform(rows, DRAWER_LOG)


def as_deletes(rows: DataFrame, version: Column | int = 0, seq: Column | None = None) -> DataFrame:
    """Tombstones for the keys of the given rows."""
    version = version if isinstance(version, Column) else F.lit(version)
    seq = F.lit(0) if seq is None else seq
    marked = rows.select(
        *KEY, *(c for c in ("original_id",) if c in rows.columns),
        F.lit("delete").alias("op"), version.alias("version"), seq.alias("seq"),
    )
    return conform(marked, DRAWER_LOG)


def delete_by_ids(drawers: DataFrame, ids: DataFrame, version=0) -> DataFrame:
    """Tombstones for drawers named by (palace, original_id)."""
    return as_deletes(drawers.join(ids, ["palace", "original_id"], "left_semi"), version)


def delete_where(drawers: DataFrame, where: dict, version=0) -> DataFrame:
    """Tombstones for every drawer that meets an equality filter."""
    return as_deletes(apply_where(drawers, where), version)


def get(drawers: DataFrame, where: dict | None = None, limit: int | None = None) -> DataFrame:
    """Filtered scan; the limit takes the smallest ids, so it is repeatable."""
    found = apply_where(drawers, where)
    return found if limit is None else found.orderBy("original_id").limit(limit)


def get_ordered(drawers, order_by: str, descending=True, where=None, limit: int | None = None) -> DataFrame:
    """Filtered rows ordered by a payload field, then id."""
    key = F.desc_nulls_last(order_by) if descending else F.asc_nulls_last(order_by)
    found = apply_where(drawers, where).orderBy(key, F.asc("original_id"))
    return found if limit is None else found.limit(limit)


def reembed(drawers: DataFrame) -> DataFrame:
    """Every vector rebuilt from its document."""
    return drawers.withColumn("vector", embed(F.col("document")))


def repair(log: DataFrame, version: int) -> DataFrame:
    """All current rows written again, as one consistent version."""
    return as_upserts(current(log).drop("op", "version", "seq"), version)


class DrawerTable:
    """A drawer log as Parquet on shared storage, partitioned by palace.

    Plain Parquet has no MERGE, so changes are appended and ``current()``
    resolves them.  Compaction writes the resolved rows into the next
    generation folder; readers follow the newest finished one.  One writer at
    a time is assumed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _generation(self) -> int:
        fs, root = self._fs()
        if not fs.exists(root):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        done = [
            int(n[4:]) for n in names
            if n.startswith("gen-")
            and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        ]
        return max(done, default=0)

    def _folder(self, generation: int | None = None) -> str:
        n = self._generation() if generation is None else generation
        return f"{self.path}/gen-{n:06d}"

    def create(self) -> DrawerTable:
        """Make the table if it is not there yet."""
        if not self.exists():
            self._write(self.spark.createDataFrame([], DRAWER_LOG), self._folder(0), "append")
        return self

    def exists(self) -> bool:
        fs, root = self._fs()
        return fs.exists(root) and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self._folder()))

    @staticmethod
    def _write(rows: DataFrame, folder: str, mode: str) -> None:
        rows.write.mode(mode).partitionBy("palace").parquet(folder)

    def log(self) -> DataFrame:
        return conform(self.spark.read.schema(DRAWER_LOG).parquet(self._folder()), DRAWER_LOG)

    def current(self, columns: list[str] | None = None) -> DataFrame:
        return current(self.log(), columns)

    def next_version(self) -> int:
        if not self.exists():
            return 1
        return (self.log().agg(F.max("version")).first()[0] or 0) + 1

    def append(self, rows: DataFrame) -> None:
        self.create()
        self._write(conform(rows, DRAWER_LOG), self._folder(), "append")

    def upsert(self, rows: DataFrame, seq: Column | None = None) -> None:
        self.append(as_upserts(rows, self.next_version(), seq))

    def delete(self, ids: DataFrame) -> None:
        self.append(delete_by_ids(self.current(), ids, self.next_version()))

    def delete_where(self, where: dict) -> None:
        self.append(delete_where(self.current(), where, self.next_version()))

    def drop_palace(self, palace: str) -> None:
        self.delete_where({"palace": palace})

    def count(self, palace: str | None = None) -> int:
        rows = self.current(["palace"])
        return (rows.where(F.col("palace") == palace) if palace else rows).count()

    def compact(self) -> None:
        n = self._generation()
        self._write(self.current(), self._folder(n + 1), "overwrite")
