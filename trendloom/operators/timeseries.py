"""Daily counts of distinct records, the dense grid, and the hot score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_counts(rows: DataFrame, time: str, topic: str, record: str) -> DataFrame:
    """date, topic_id, record_count of assigned rows (topic not null)."""
    named = rows.where(F.col(topic).isNotNull()).select(F.to_date(time).alias("date"), F.col(topic).alias("topic_id"), F.col(record).alias("_r"))
    return named.groupBy("date", "topic_id").agg(F.countDistinct("_r").alias("record_count"))


def complete_series(counts: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Counts for every topic on every day between the first and the last, 0 where there
    is none. The grid is days x topics; topics come from the registry if given."""
    topics = (topics if topics is not None else counts).select("topic_id").distinct()
    days = counts.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where("lo is not null")
    days = days.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    grid = topics.crossJoin(F.broadcast(days))  # one row a day: bounded by the calendar
    return grid.join(counts, ["date", "topic_id"], "left").select("date", "topic_id", F.coalesce("record_count", F.lit(0)).cast("long").alias("record_count"))


def _scaled(value: Column, name: str) -> Column:
    lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
    clipped = F.least(F.greatest(F.coalesce(value, F.lit(0.0)), lo), hi)
    return F.when(hi > lo, (clipped - lo) / (hi - lo)).otherwise(0.0)


def hot_scores(series: DataFrame, recent_days: int = 7, baseline_days: int = 28) -> DataFrame:
    """One row a topic of a dense series: volumes, growth, velocity, anomaly,
    persistence, their scores, hot_score and status. Windows end on the last day of all
    topics; scores are scaled between the 5th and the 95th percentile over topics."""
    latest = F.broadcast(series.agg(F.max("date").alias("_end")))
    days = series.crossJoin(latest).withColumn("_age", F.datediff("_end", "date")).where(F.col("_age") < baseline_days)
    n, age = F.col("record_count"), F.col("_age")
    recent, base = age < recent_days, age >= recent_days
    total = lambda when: F.sum(F.when(when, n).otherwise(0))
    rows = days.groupBy("topic_id").agg(
        total(recent).alias("recent_volume"),
        (total(base) / F.greatest(F.count_distinct(F.when(base, F.col("date"))), F.lit(1)) * 7).alias("baseline_volume"),
        ((total(age < 2) + 1) / (total((age >= 2) & (age < recent_days)) + 1)).alias("velocity_ratio"),
        F.avg(F.when(recent, (n > 0).cast("double"))).alias("persistence"),
    )
    rv, bv = F.col("recent_volume"), F.col("baseline_volume")
    rows = rows.withColumns({"growth_rate": (rv + 1) / (bv + 1) - 1, "anomaly_ratio": rv / (bv + 1)})
    parts = {
        "volume": rv.cast("double"),
        "growth": F.greatest(F.col("growth_rate"), F.lit(0.0)),
        "velocity": F.log1p(F.greatest(F.col("velocity_ratio"), F.lit(0.0))),
        "anomaly": F.log1p(F.greatest(F.col("anomaly_ratio"), F.lit(0.0))),
    }
    edges = [F.percentile(v, F.lit(q)).alias(f"_{k}_{e}") for k, v in parts.items() for e, q in (("lo", 0.05), ("hi", 0.95))]
    rows = rows.crossJoin(F.broadcast(rows.agg(*edges)))
    rows = rows.withColumns({f"{k}_score": _scaled(v, k) for k, v in parts.items()}).withColumn("recency_score", F.col("volume_score"))
    weights = {"volume_score": 0.25, "growth_score": 0.25, "velocity_score": 0.20, "anomaly_score": 0.15, "recency_score": 0.10, "persistence": 0.05}
    hot = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    g, h = F.col("growth_rate"), F.col("hot_score")
    status = (
        F.when(rv <= 2, "LOW_EVIDENCE").when((h >= 0.75) & (g > 0.5), "HOT").when((h >= 0.55) & (g > 0.2), "TRENDING")
        .when(g > 0.05, "GROWING").when(g < -0.2, "DECLINING").otherwise("STABLE")
    )
    return rows.withColumn("hot_score", hot).withColumn("status", status).select(
        "topic_id", "recent_volume", "baseline_volume", "velocity_ratio", "growth_rate", "anomaly_ratio", "persistence",
        *[f"{k}_score" for k in (*parts, "recency")], "hot_score", "status",
    )


def gate_alerts(hot: DataFrame, least_size: int = 30, least_coherence: float = 0.05) -> DataFrame:
    """HOT and TRENDING become GROWING where the topic doesn't deserve an alert; the
    first reason that holds is named. Needs coherence, size, residual, junk,
    substantive, campaign; a null coherence fails, a null judgement doesn't."""
    reason = F.coalesce(
        F.when(F.coalesce("coherence", F.lit(-1.0)) < least_coherence, "low_coherence"), F.when(F.col("size") < least_size, "below_min_size"),
        F.when(F.col("residual"), "residual_cluster"), F.when(F.col("junk"), "is_junk"),
        F.when(F.col("substantive").eqNullSafe(F.lit(False)), "llm_not_substantive"), F.when(F.col("campaign"), "campaign_cluster"),
    )
    raised = F.col("status").isin("HOT", "TRENDING")
    return hot.withColumn("alert_suppressed_reason", F.when(raised, reason)).withColumns(
        {"alert_suppressed": F.col("alert_suppressed_reason").isNotNull(), "status": F.when(F.col("alert_suppressed_reason").isNotNull(), "GROWING").otherwise(F.col("status"))}
    )
