"""Helpers that several training-data operators use."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules["trendloom"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only where the session names none and
    runs on one machine, as in tests, a local temporary folder is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trendloom-"))
    return sc.getCheckpointDir()


#: Whether a query's shuffle files go as soon as it ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, which cuts the
    lineage: a lost executor costs its running tasks only. Nothing reads the write's
    shuffle files after it, so they go at once rather than at some later garbage
    collection of the driver. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/trendloom-{uuid.uuid4().hex}"
    before = spark.conf.get(FILE_CLEANUP)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FILE_CLEANUP, before)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a batch for Python, and what the setting is where nobody has chosen it.
BATCH_ROWS, BATCH_SETTING, BATCH_DEFAULT = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def short_batches(spark: SparkSession) -> None:
    """Texts go to Python 1000 at a time: the buffers of 10,000 stay with the executor, on
    both sides, for as long as it lives. A session's own choice is left alone."""
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def observed(df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
    """materialise(), with aggregates over the rows that are worked out on the way."""
    seen = Observation()
    return materialise(df.observe(seen, *metrics)), seen.get


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """materialise(), with the number of rows."""
    out, seen = observed(df, F.count("*").alias("n"))
    return out, seen["n"]


def worker_tables() -> dict:
    """What this worker process keeps from task to task."""
    return sys.modules.setdefault("trendloom_worker_tables", types.ModuleType("trendloom_worker_tables")).__dict__


def forget_tables() -> None:
    """For the start of another operator's task: a worker that is used again would hold
    the last one's tables beside its own."""
    held = worker_tables()
    for name in ("key", "tables"):
        held.pop(name, None)


def hash_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def ascii_words(text: bytes) -> list[bytes]:
    """Maximal runs of anything but space, \\t, \\n, \\v, \\f and \\r."""
    return text.split()
