"""Helpers the operators of this package share: written intermediate tables, Arrow functions, word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loci.session import shared_dir, tune

# A word is a run of anything but ASCII white space.  bytes.split() without an
# argument splits at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BATCH = 512
BYTES_PER_BATCH = 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings for whole texts in Arrow batches: few rows and few bytes at a time, so long texts fit."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, safe against lost executors.

    The folder goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loci-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those wanted that the table does not have in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def texts_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def numbered(cut: list[list[bytes]], place: dict[bytes, int], learn: Callable[[list[bytes]], None]) -> list[np.ndarray]:
    """Numbers of the words of several texts; words not in ``place`` yet go to ``learn`` first, all at once."""
    found = [np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words)) for words in cut]
    missing = [np.flatnonzero(at < 0).tolist() for at in found]
    new = {words[i] for words, gaps in zip(cut, missing, strict=True) for i in gaps}
    if new:
        learn(sorted(new))
        for words, at, gaps in zip(cut, found, missing, strict=True):
            if gaps:
                at[gaps] = [place[words[i]] for i in gaps]
    return found


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes, which it has no function for."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    spelt = f"hex(encode({text}))"
    octets = f"list_transform(range(length({spelt}) // 2), lambda i: CAST('0x' || substr({spelt}, 2 * i + 1, 2) AS BIGINT))"
    step = f"lambda c, x: xor(c >> 8, {table}[(xor(c, x) & 255) + 1])"
    return f"xor(list_reduce({octets}, {step}, 4294967295), 4294967295)"
