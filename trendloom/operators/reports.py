"""Read-side queries: event recall, run cards, tagged records, label groups, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_recall(assigned: DataFrame, hits: DataFrame, record: str, share: float = 0.8, time: str | None = None, onsets: DataFrame | None = None, topics: DataFrame | None = None) -> DataFrame:
    """event, found, matched_records, topic_id, topic_size, recall_in_best_topic,
    precision_in_topic, topics_spanned, topics_for_share: where the assigned records of
    verified events (hits: event, record) landed. Records without a topic don't count;
    an event without any is not found, with 0 matched and spanned and nulls besides. Ties
    go to the lesser topic_id.

    With time (of assigned) and onsets (event, onset; events of these alone are listed
    too), first_seen of the best topic among the event's rows and lag_days from the onset;
    with topics (topic_id, is_junk, residual_cluster), these two of the best topic."""
    rows = assigned.where("topic_id is not null")
    pairs = rows.select(record, "topic_id").distinct()
    sizes = pairs.groupBy("topic_id").agg(F.count("*").alias("topic_size"))
    hits = hits.select("event", record).distinct()
    names = hits.select("event").distinct()
    if onsets is not None:
        names = names.unionByName(onsets.select("event")).distinct()
    matched = hits.join(pairs.select(record).distinct(), record, "left_semi").groupBy("event").agg(F.count("*").alias("matched_records"))
    landed = hits.join(pairs, record).groupBy("event", "topic_id").agg(F.count("*").alias("n"))
    down = Window.partitionBy("event").orderBy(F.desc("n"), "topic_id")  # a row for each topic
    run = landed.withColumns(
        {"_r": F.row_number().over(down), "_run": F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))}
    ).join(matched, "event")
    events = run.groupBy("event").agg(
        F.max(F.when(F.col("_r") == 1, F.col("topic_id"))).alias("topic_id"), F.max("n").alias("_best"), F.count("*").alias("topics_spanned"),
        (F.count_if(F.col("_run") < share * F.col("matched_records")) + 1).alias("topics_for_share"),
    )
    out = names.join(matched, "event", "left").join(events, "event", "left").join(sizes, "topic_id", "left")
    out = out.select(
        "event", F.col("matched_records").isNotNull().alias("found"), F.coalesce("matched_records", F.lit(0)).alias("matched_records"), "topic_id", "topic_size",
        (F.col("_best") / F.col("matched_records")).alias("recall_in_best_topic"), (F.col("_best") / F.col("topic_size")).alias("precision_in_topic"),
        F.coalesce("topics_spanned", F.lit(0)).alias("topics_spanned"), "topics_for_share",
    )
    if time and onsets is not None:
        seen = rows.join(hits, record).groupBy("event", "topic_id").agg(F.min(time).alias("first_seen"))
        lag = (F.unix_micros(F.col("first_seen").cast("timestamp")) - F.unix_micros(F.col("onset").cast("timestamp"))) / 86_400_000_000
        out = out.join(seen, ["event", "topic_id"], "left").join(onsets.select("event", "onset"), "event", "left").withColumn("lag_days", F.round(lag, 2))
    if topics is not None:
        out = out.join(topics.select("topic_id", "is_junk", "residual_cluster"), "topic_id", "left")
    return out


def run_card(assigned: DataFrame, record: str, segment: str) -> DataFrame:
    """One row: records, segments, topics, unassigned_share, inflation and median topic
    size of a run's assignments (topic_id null: unassigned)."""
    sizes = assigned.where("topic_id is not null").groupBy("topic_id").agg(F.countDistinct(record).alias("n"))
    middle = sizes.agg(F.count("*").alias("topics"), F.median("n").alias("median_size"))
    rows = assigned.agg(
        F.countDistinct(record).alias("records"), F.countDistinct(segment).alias("segments"),
        F.avg(F.col("topic_id").isNull().cast("double")).alias("unassigned_share"), (F.count("topic_id") / F.countDistinct(F.when(F.col("topic_id").isNotNull(), F.col(segment)))).alias("inflation"),
    )
    return rows.crossJoin(middle)  # one row each


def size_bands(topics: DataFrame) -> DataFrame:
    """band, topics, share of records: topics by size."""
    n = F.col("size")
    band = F.when(n < 30, "under 30").when(n < 100, "30 to 99").when(n < 500, "100 to 499").otherwise("500 or more")
    rows = topics.groupBy(band.alias("band")).agg(F.count("*").alias("topics"), F.sum("size").alias("_n"))
    total = F.broadcast(topics.agg(F.sum("size").alias("_t")))  # one row
    return rows.crossJoin(total).select("band", "topics", (F.col("_n") / F.col("_t")).alias("share"))


def tagged_records(records: DataFrame, assigned: DataFrame, record: str) -> DataFrame:
    """Records with topics: their topics, best first, as one string; empty without any.
    A record has few topics (segments are at most six, each of at most two)."""
    best = assigned.where("topic_id is not null").groupBy(record, "topic_id").agg(F.max("similarity").alias("_s"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("_s")).alias("s"), F.col("topic_id").cast("string").alias("t"))))
    tags = best.groupBy(record).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ",").alias("topics"))
    return records.join(tags, record, "left").withColumn("topics", F.coalesce("topics", F.lit("")))


def label_groups(topics: DataFrame, label: str) -> DataFrame:
    """label, topics, scopes, records: the topics of all scopes under one label."""
    return topics.groupBy(label).agg(F.count("*").alias("topics"), F.countDistinct("scope").alias("scopes"), F.sum("size").alias("records"))


def examples(assigned: DataFrame, topic: str, record: str, rank: list[Column], most: int) -> DataFrame:
    """The first rows of each topic by rank, each record once."""
    once = Window.partitionBy(topic, record).orderBy(*rank)
    kept = assigned.withColumn("_o", F.row_number().over(once)).where("_o = 1").drop("_o")
    order = Window.partitionBy(topic).orderBy(*rank, record)
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def hashed_sample(rows: DataFrame, group: str, text: str, most: int) -> DataFrame:
    """A repeatable sample of distinct texts of each group, in the order of a hash of both."""
    mark = F.sha2(F.concat_ws("|", F.col(group).cast("string"), F.col(text)), 256)
    marked = rows.where(F.col(text).isNotNull()).select(group, text).distinct().withColumn("_m", mark)
    order = Window.partitionBy(group).orderBy("_m", text)
    return marked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("_m")


def matched_threshold(scores: DataFrame, old: str, new: str, threshold: float) -> DataFrame:
    """One row: the share of rows at or over threshold by old, and the threshold of new
    that lets the same share in."""
    share = scores.agg(F.avg((F.col(old) >= threshold).cast("double")).alias("share")).first()["share"]
    at = F.percentile(F.col(new).cast("double"), F.lit(1.0 - (share or 0.0)))
    return scores.agg(F.lit(share).cast("double").alias("share"), at.alias("threshold"))


def growth_map(hot: DataFrame, share: float = 0.98) -> DataFrame:
    """topic_id, recent_volume, growth clipped at a high percentile over all topics."""
    edge = F.broadcast(hot.agg(F.percentile("growth_rate", F.lit(share)).alias("_edge")))  # one row
    return hot.crossJoin(edge).select("topic_id", "recent_volume", F.least("growth_rate", "_edge").alias("growth"))
