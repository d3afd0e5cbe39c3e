"""Records: deduplication, scopes, samples, pages and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.sources.stored import stored


def keep_last(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the last by order, nulls before all. Tasks reduce their own
    rows first, so a frequent key moves one row for each task."""
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(key, "_r.*").select(rows.columns)


def numbered(rows: DataFrame, order: list[Column | str], scope: str | None = None) -> DataFrame:
    """A written table: rows with _i, their place (from 0) in order, and _n, how many there
    are, in the whole or in their scope. Ranges are sorted in parallel and only their sizes
    meet, so a scope with a third of all rows is no task of its own."""
    keys = [*([scope] if scope else []), *order]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    spread = stored(spread.withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id() % F.lit(1 << 33)}))
    by = F.col(scope) if scope else F.lit(0)
    parts = spread.groupBy("_p", by.alias("_s")).agg(F.count("*").alias("_c"), F.min("_k").alias("_f"))
    upto = F.sum("_c").over(Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))  # a row for each partition and scope
    starts = parts.select(F.col("_p").alias("_q"), "_s", "_f", (upto - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy("_s")).alias("_n"))
    out = spread.join(starts, (F.col("_p") == F.col("_q")) & (by.eqNullSafe(F.col("_s"))))
    return out.withColumn("_i", F.col("_before") + F.col("_k") - F.col("_f")).select(*rows.columns, "_i", "_n")


def pool_small(rows: DataFrame, scope: str, record: str, least: int = 80, pool: str = "__POOL__") -> DataFrame:
    """scope, records, pool_key: scopes with fewer than least records share a pool."""
    n = rows.groupBy(scope).agg(F.countDistinct(record).alias("records"))
    return n.withColumn("pool_key", F.when(F.col("records") >= least, F.col(scope)).otherwise(pool))


def dominant(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, n: the most frequent value of each key; ties go to the lesser value."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), value)
    return n.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def systematic_sample(rows: DataFrame, scope: str, order: list[str], share: float) -> DataFrame:
    """Evenly spaced rows of each scope in order: indices floor(i * n / m) for
    m = ceil(share * n)."""
    rows = numbered(rows, order, scope).withColumn("_m", F.ceil(F.col("_n") * share))
    first = F.ceil(F.col("_i") * F.col("_m") / F.col("_n"))  # least j with floor(j * n / m) >= i
    taken = (F.floor(first * F.col("_n") / F.col("_m")) == F.col("_i")) & (first < F.col("_m"))
    return rows.where(taken).drop("_i", "_n", "_m")


def equal_chunks(rows: DataFrame, order: list[Column | str], chunks: int) -> DataFrame:
    """Adds chunk: contiguous slices of n div chunks rows, the last with the rest. A
    global order is part of the meaning."""
    rows = numbered(rows, order)
    size = F.greatest(F.floor(F.col("_n") / chunks), F.lit(1))
    return rows.withColumn("chunk", F.least(F.floor(F.col("_i") / size), F.lit(chunks - 1)).cast("int")).drop("_i", "_n")


def compare_ids(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: kept, lost, gained and retention of the ids of two runs."""
    a = before.select(key).distinct().withColumn("_a", F.lit(1))
    b = after.select(key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full")
    n = lambda c: F.count_if(c)
    row = both.agg(n(F.expr("_a = 1 and _b = 1")).alias("kept"), n(F.expr("_b is null")).alias("lost"), n(F.expr("_a is null")).alias("gained"))
    return row.withColumn("retention", F.col("kept") / F.greatest(F.col("kept") + F.col("lost"), F.lit(1)))


def cumulative_share(rows: DataFrame, group: str, item: str, size: str, share: float = 0.8) -> DataFrame:
    """group, total, items_for_share: how many of the largest items reach the share."""
    down = Window.partitionBy(group).orderBy(F.desc(size), item).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select(group, F.sum(size).over(down).alias("_run"), F.sum(size).over(Window.partitionBy(group)).alias("_all"))
    return run.groupBy(group).agg(F.max("_all").alias("total"), (F.count_if(F.col("_run") < F.col("_all") * share) + 1).alias("items_for_share"))


def due_buckets(rows: DataFrame, scope: str, time: str, least: int, days: int) -> DataFrame:
    """Scopes whose waiting rows are many enough or whose oldest has waited long enough,
    counted to the last time of all rows."""
    end = F.broadcast(rows.agg(F.max(time).alias("_end")))
    b = rows.groupBy(scope).agg(F.count("*").alias("waiting"), F.min(time).alias("oldest")).crossJoin(end)
    waited = F.datediff("_end", "oldest")
    return b.where((F.col("waiting") >= least) | (waited >= days)).select(scope, "waiting", waited.alias("waited_days"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A page of a report: number from 1, size between 1 and 200."""
    size = min(max(size, 1), 200)
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def next_reply(turns: DataFrame, thread: str, order: str, role: str, text: str, asker: str, answerer: str) -> DataFrame:
    """Each asker's turn with the role and length of the next turn of its thread, and
    whether that is an answer."""
    w = Window.partitionBy(thread).orderBy(order)
    rows = turns.select(thread, order, role, F.lead(role).over(w).alias("next_role"), F.length(F.lead(text).over(w)).alias("next_chars"))
    return rows.where(F.col(role) == asker).select(thread, order, (F.coalesce(F.col("next_role") == answerer, F.lit(False))).alias("answered"), "next_chars")
