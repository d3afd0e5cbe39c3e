"""What a run leaves for the next: the registry as JSON, and the buffer of leftovers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of a buffer besides its vectors.
BUFFER = ("record_id", "segment_id", "segment_index", "event_time", "brand", "clean_text", "author_id")


def save_topics(topics: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept."""
    topics.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_topics(spark: SparkSession, path: str | None, schema: StructType) -> DataFrame:
    """The topics of one path, by lines or as one array; fields that schema hasn't are left
    out, fields that are missing are null. Without a path or a file, none."""
    try:
        whole = spark.read.schema(schema).option("multiLine", True).json(path) if path else None
        return whole if whole is not None and whole.limit(2).count() > 1 else spark.read.schema(schema).json(path) if path else spark.createDataFrame([], schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def save_buffer(rows: DataFrame, path: str, vector: str = "embedding") -> None:
    """Leftovers with their vectors, for a later run."""
    rows.select(*BUFFER, F.col(vector).cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def load_buffer(spark: SparkSession, path: str | None, width: int) -> tuple[DataFrame, str | None]:
    """The buffer, and why it is empty if it was refused: a column is missing, or a vector
    isn't of this width (it is of another model's space, and the two must not mix)."""
    schema = ", ".join(f"{c} {'int' if c == 'segment_index' else 'string'}" for c in BUFFER) + ", embedding array<float>"
    none = spark.createDataFrame([], schema)
    if not path:
        return none, None
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return none, None
    missing = [c for c in (*BUFFER, "embedding") if c not in rows.columns]
    if missing:
        return none, f"missing columns: {', '.join(missing)}"
    other = rows.where(F.coalesce(F.size("embedding"), F.lit(-1)) != width).limit(1).count()
    return (none, f"vectors are not all of width {width}") if other else (rows.select(*BUFFER, "embedding"), None)
