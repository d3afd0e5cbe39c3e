"""A run over the chunks of a stream: each batch hands its registry and buffer on."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh_records(stream: DataFrame, record: str, time: str, late: str = "2 days") -> DataFrame:
    """The stream's records, each once: one that comes again within ``late`` of the
    watermark is dropped, and so is one that is older than the watermark. One without a
    time is dropped too, and one from the future: it would push the watermark ahead of all
    others."""
    sane = stream.where(F.col(time).isNotNull() & (F.col(time) <= F.current_timestamp()))
    return sane.withWatermark(time, late).dropDuplicatesWithinWatermark([record])


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


class Handover:
    """Tables that one batch leaves for the next, in a folder: each batch's own, and the
    number of the last finished one. A batch that is run again after a restart finds the
    tables of the one before it, and writes over its own; a finished one isn't run again."""

    def __init__(self, spark: SparkSession, folder: str, empty: dict[str, str]) -> None:
        self.spark, self.folder, self.empty = spark, folder.rstrip("/"), empty

    def finished(self) -> list[int]:
        files, _ = _files(self.spark, self.folder)
        found = files.globStatus(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch-*/DONE")) or []
        return sorted(int(s.getPath().getParent().getName().split("-")[1]) for s in found)

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """The table as the last batch (before one) left it; empty before the first."""
        done = [n for n in self.finished() if before is None or n < before]
        return self.spark.read.schema(self.empty[name]).parquet(f"{self.folder}/batch-{done[-1]}/{name}") if done else self.spark.createDataFrame([], self.empty[name])

    def write(self, number: int, tables: dict[str, DataFrame], note: dict | None = None) -> None:
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{self.folder}/batch-{number}/{name}")
        files, target = _files(self.spark, f"{self.folder}/batch-{number}/DONE")
        out = files.create(target, True)
        out.write(bytearray(json.dumps(note or {}).encode()))
        out.close()


def run_chunks(stream: DataFrame, handover: Handover, step: Callable[[DataFrame, dict[str, DataFrame], int], dict[str, DataFrame]], checkpoint: str):
    """Runs step(batch, tables of the batch before, number) for each micro-batch of what is
    there now, and hands its tables on. With checkpoint, a restart goes on where it stopped;
    a batch whose tables are finished is passed over."""

    def each(batch: DataFrame, number: int) -> None:
        if number in handover.finished():
            return
        before = {name: handover.read(name, number) for name in handover.empty}
        handover.write(number, step(batch, before, number))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
