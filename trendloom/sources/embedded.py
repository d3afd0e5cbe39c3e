"""A cache of text vectors, keyed by model, precision and text."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: From so many runs' folders on, compact() is worth it.
MANY = 50

SCHEMA = "key string, vector array<float>"


def cache_key(text: Column, model: str, precision: str = "fp32") -> Column:
    """What a vector belongs to: the model, its precision unless that is the usual one, and
    the exact text, each ended by a zero."""
    head = model + "\0" + ("" if precision == "fp32" else precision + "\0")
    return F.sha2(F.concat(F.lit(head), F.coalesce(text, F.lit("")), F.lit("\0")), 256)


def cached(spark, store: str) -> DataFrame:
    """key, vector of all finished runs."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(store)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{store}/run-*/_SUCCESS"))
    paths = [str(s.getPath().getParent()) for s in (found or [])]
    return spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)


def embed(rows: DataFrame, text: str, encode: Callable[[list[str]], Iterable[list[float]]], store: str, model: str, precision: str = "fp32", batch: int = 256) -> tuple[DataFrame, int]:
    """rows with vector, and how many texts were encoded for it. Texts that the store has
    under this model aren't encoded again; of the others, each once however often it is
    repeated. A null text is an empty one.

    What is new is written to a folder of its own, that counts once Spark has marked it
    finished: tasks that are tried again, or a run that dies, leave nothing behind that is
    read. Keys that two runs at once have both written are one row."""
    spark = rows.sparkSession
    keyed = rows.withColumn("_key", cache_key(F.col(text), model, precision))
    known = cached(spark, store)
    missing = keyed.select(F.col("_key").alias("key"), F.coalesce(text, F.lit("")).alias("text")).dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                vectors = pa.array([list(map(float, v)) for v in encode(part.column("text").to_pylist())], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column("key"), vectors], names=["key", "vector"])

    seen = Observation()
    path = f"{store.rstrip('/')}/run-{uuid.uuid4().hex}"
    missing.mapInArrow(run, SCHEMA).observe(seen, F.count("*").alias("n")).write.parquet(path)
    vectors = cached(spark, store).groupBy("key").agg(F.first("vector").alias("vector"))
    return keyed.join(vectors.withColumnRenamed("key", "_key"), "_key", "left").select(*rows.columns, "vector"), seen.get["n"]


def compact(spark, store: str) -> None:
    """All runs' vectors in one new folder, each key once. The old folders go afterwards."""
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in (files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{store}/run-*")) or [])]
    cached(spark, store).groupBy("key").agg(F.first("vector").alias("vector")).write.parquet(f"{store.rstrip('/')}/run-{uuid.uuid4().hex}")
    for path in old:
        files.delete(path, True)
