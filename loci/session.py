"""Spark session settings the engine relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# All of these can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "loci", master: str | None = None, **conf: str) -> SparkSession:
    """A session for the command line, tests and the bench."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read, for checkpoints and cut lineages.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests, a laptop) is a temporary folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="loci-ckpt-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut_lineage(df):
    """Reliable checkpoint in the shared folder (survives executor loss)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def kept(df):
    """The rows as Parquet in the shared folder, far smaller than a checkpoint's rows; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loci-kept/{uuid.uuid4().hex}"
    # Nobody reads the shuffles of this job again; else they lie there until the driver collects its garbage.
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(cleanup) if was is None else spark.conf.set(cleanup, was)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)
