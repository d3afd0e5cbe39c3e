"""Rows that compare runs: quality, events, whole arms, and what is new since the last run.

Each works on tables with a column that names the run, so that all runs are one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.operators.matching import topic_pairs

#: Statuses that alert, the status of new topics, and the coherence of good ones.
ALERTS, EMERGING, COHERENT = ("HOT", "TRENDING"), ("EMERGING", "MICRO_EMERGING"), 0.1


def quality_rows(topics: DataFrame, assigned: DataFrame, run: str = "run") -> DataFrame:
    """run, topics, junk, coherent, mean_coherence, median_coherence, median_size,
    largest, unassigned, unassigned_share. topics has size, coherence (or null) and
    is_junk; assigned has assignment_type. A run without topics has nulls for their
    measures; one without assignments a share of 0."""
    c = F.col("coherence")
    one = topics.groupBy(run).agg(
        F.count("*").alias("topics"), F.count_if(F.coalesce("is_junk", F.lit(False))).alias("junk"), F.count_if(c >= COHERENT).alias("coherent"),
        F.avg(c).alias("mean_coherence"), F.median(c).alias("median_coherence"), F.floor(F.median("size")).alias("median_size"), F.max("size").alias("largest"),
    )
    two = assigned.groupBy(run).agg(F.count_if(F.col("assignment_type") == "UNASSIGNED").alias("unassigned"), F.count("*").alias("_n"))
    rows = one.join(two, run, "full")
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in ("topics", "junk", "coherent")]
    share = F.coalesce(F.col("unassigned"), F.lit(0)) / F.greatest(F.coalesce(F.col("_n"), F.lit(0)), F.lit(1))
    return rows.select(run, *zero, "mean_coherence", "median_coherence", "median_size", "largest", F.coalesce("unassigned", F.lit(0)).alias("unassigned"), share.alias("unassigned_share"))


def fragmentation_rows(events: DataFrame, run: str = "run") -> DataFrame:
    """run, events, found, precision, recall, topics_for_share, spanned: means over the
    found events of event_recall()'s rows."""
    found = F.col("found")
    mean = lambda c: F.avg(F.when(found, F.col(c)))
    return events.groupBy(run).agg(
        F.count("*").alias("events"), F.count_if(found).alias("found"), mean("precision_in_topic").alias("precision"), mean("recall_in_best_topic").alias("recall"),
        mean("topics_for_share").alias("topics_for_share"), F.floor(mean("topics_spanned")).alias("spanned"),
    )


def near_duplicate_topics(topics: DataFrame, least: float, scope: str, run: str = "run") -> DataFrame:
    """run, near_duplicates: pairs of topics of one run and scope whose centroids are more
    similar than least."""
    both = topics.withColumn("_scope", F.to_json(F.struct(run, F.col(scope).alias("s"))))
    pairs = topic_pairs(both, least, "_scope").where(F.col("similarity") > least)
    named = both.select(F.col("topic_id").alias("a"), run)
    return pairs.join(named, "a").groupBy(run).agg(F.count("*").alias("near_duplicates"))


def arm_rows(topics: DataFrame, assigned: DataFrame, hot: DataFrame, events: DataFrame, record: str, scope: str, run: str = "run", alike: float = 0.92) -> DataFrame:
    """One wide row for each run: quality, negative coherence, inflation (records by topic
    over records), near-duplicate topics, events and alerts. topic_id is unique over all
    runs."""
    filed = assigned.where("topic_id is not null")
    inflation = filed.groupBy(run, "topic_id").agg(F.countDistinct(record).alias("_r")).groupBy(run).agg(F.sum("_r").alias("_all")).join(filed.groupBy(run).agg(F.countDistinct(record).alias("_one")), run)
    inflation = inflation.select(run, (F.col("_all") / F.greatest("_one", F.lit(1))).alias("inflation"))
    negative = topics.groupBy(run).agg(F.avg((F.col("coherence") < 0).cast("double")).alias("negative_share"))
    alerts = hot.where(F.col("status").isin(*ALERTS)).join(topics.select("topic_id", run, "coherence"), "topic_id").groupBy(run).agg(F.count("*").alias("alerts"), F.min("coherence").alias("worst_alert_coherence"))
    rows = quality_rows(topics, assigned, run).join(negative, run, "left").join(inflation, run, "left")
    rows = rows.join(near_duplicate_topics(topics, alike, scope, run), run, "left").join(alerts, run, "left").join(fragmentation_rows(events, run).drop("events"), run, "left")
    return rows.na.fill(0, ["near_duplicates", "alerts", "found"])


def overview(topics: DataFrame, run: str = "run") -> DataFrame:
    """topics (run, topic_id, status_lifecycle and others) with is_new: whether the run
    before, by name, hadn't the topic; of the first run, whether the topic is emerging."""
    runs = topics.select(run).distinct().withColumn("_before", F.lag(run).over(Window.orderBy(run)))  # a row for each run
    known = topics.select(F.col(run).alias("_before"), "topic_id").distinct().withColumn("_known", F.lit(True))
    rows = topics.join(F.broadcast(runs), run).join(known, ["_before", "topic_id"], "left")
    first = F.coalesce(F.col("status_lifecycle").isin(*EMERGING), F.lit(False))
    return rows.withColumn("is_new", F.when(F.col("_before").isNull(), first).otherwise(F.col("_known").isNull())).drop("_before", "_known")


def histogram(topics: DataFrame, *by: str) -> DataFrame:
    """by, topics, records: how many topics, and their sizes, by status, scope or both."""
    return topics.groupBy(*by).agg(F.count("*").alias("topics"), F.sum("size").alias("records"))
