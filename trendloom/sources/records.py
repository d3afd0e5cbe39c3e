"""Record sources: files with a declared schema, checked and cleaned while read; sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of prepared records, in files' order.
COLUMNS = ("tweet_id", "event_time", "author_id", "text", "brand")
RECORD_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in COLUMNS])


def read_records(spark: SparkSession, paths: list[str], fmt: str = "csv", key: str = "tweet_id", time: str = "event_time", text: str = "text", scope: str = "brand") -> DataFrame:
    """Rows of all files with a readable time; null text is empty, null scope unknown. Of
    rows with one key, that of the last file in the list stays, in a file the latest. A file
    without one of the four columns is refused by name; other columns are kept if the first
    file has them."""
    if not paths:
        raise ValueError("no files")

    def one(i: int, path: str) -> DataFrame:
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        rows = reader.csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
        missing = [c for c in (key, time, text, scope) if c not in rows.columns]
        if missing:
            raise ValueError(f"{path} has no column {', '.join(missing)}")
        return rows.select(*[F.col(c).cast("string") for c in rows.columns]).withColumn("_file", F.lit(i))

    files = [one(i, p) for i, p in enumerate(paths)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), files).select(*files[0].columns)
    rows = rows.withColumn(time, F.try_to_timestamp(time)).where(F.col(time).isNotNull())
    rows = rows.na.fill({text: "", scope: "unknown"})
    rest = [c for c in rows.columns if c not in (key, "_file")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_file", time)).alias("r"))
    return newest.select(key, "r.*")


def write_table(df: DataFrame, path: str, by: list[str] | None = None, only_rows: bool = False) -> bool:
    """Parquet, partitioned by columns if named; with only_rows, nothing is written for a
    table without rows. Whether it was written."""
    if only_rows and not df.limit(1).count():
        return False
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return True
