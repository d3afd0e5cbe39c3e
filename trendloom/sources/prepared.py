"""Source records prepared for a run: whose brand a message is about, and when it was sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the form of times in the raw source, without the day's name.
RAW_TIME = "MMM dd HH:mm:ss Z yyyy"


def support_accounts(raw: DataFrame) -> DataFrame:
    """handle: authors whose name isn't a number."""
    return raw.where(F.col("author_id").isNotNull() & ~F.col("author_id").rlike("^[0-9]+$")).select(F.col("author_id").alias("handle")).distinct()


def resolve_brand(raw: DataFrame) -> DataFrame:
    """Adds brand to incoming messages (tweet_id, author_id, inbound, text,
    response_tweet_id, in_response_to_tweet_id): the first support account that the text
    mentions, else the account that wrote the message it answers, else the one that wrote
    the first of its answers; null without any. Ids are unique."""
    inbound = raw.where(F.lower(F.trim("inbound")) == "true")
    accounts = support_accounts(raw)
    mentions = inbound.select("tweet_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?U)@(\w+)"), F.lit(1))).alias("_at", "handle"))
    mentioned = mentions.join(accounts, "handle", "left_semi").groupBy("tweet_id").agg(F.min_by("handle", "_at").alias("_mentioned"))
    wrote = raw.select("tweet_id", F.col("author_id").alias("handle")).join(accounts, "handle", "left_semi")
    by = lambda key, name: wrote.select(F.col("tweet_id").alias(key), F.col("handle").alias(name))
    # Most messages answer none or have no answer: a null key joins with nothing and needs no partner.
    first = F.when(F.col("response_tweet_id") != "", F.split("response_tweet_id", ",")[0])
    rows = inbound.withColumns({"_parent": F.when(F.col("in_response_to_tweet_id") != "", F.col("in_response_to_tweet_id")), "_reply": first})
    rows = rows.join(mentioned, "tweet_id", "left").join(by("_parent", "_asked"), "_parent", "left").join(by("_reply", "_answered"), "_reply", "left")
    return rows.withColumn("brand", F.coalesce("_mentioned", "_asked", "_answered")).select(*raw.columns, "brand")


def prepare(raw: DataFrame) -> DataFrame:
    """tweet_id, event_time (UTC), author_id, text, brand of incoming messages with a brand
    and a readable time."""
    time = F.try_to_timestamp(F.substring("created_at", 5, 100), F.lit(RAW_TIME))
    rows = resolve_brand(raw).where("brand is not null").withColumn("event_time", time)
    return rows.where("event_time is not null").select("tweet_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "author_id", "text", "brand")


def require(rows: DataFrame, *names: str) -> DataFrame:
    """rows, once it is sure that they have these columns."""
    missing = [n for n in names if n not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows
