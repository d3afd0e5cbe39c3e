"""Which pairs of topics are worth a judgement, and what comes of the judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.text import label_wordset
from trendloom.functions.vectors import dot, unit
from trendloom.operators.decisions import UNCLEAR
from trendloom.operators.matching import containment, topic_pairs

#: Evidence from which on a pair is reviewed.
CONTAINED, SHARED_WORDS, LIKE_LABELS = 0.25, 0.5, 0.80


def _sides(pairs: DataFrame, topics: DataFrame, *names: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(topics.select(F.col("topic_id").alias(side), *[F.col(n).alias(f"{n}_{side}") for n in names]), side)
    return pairs


def _likeness(pairs: DataFrame, topics: DataFrame) -> DataFrame:
    """pairs with words (shared over all words of both labels) and label_similarity (of
    label_vector; null without one)."""
    rows = topics.select("topic_id", "label", label_wordset(F.col("label")).alias("words"), F.when(F.col("label_vector").isNotNull(), unit(F.col("label_vector"))).alias("lv"))
    rows = _sides(pairs, rows, "label", "words", "lv")
    shared = F.size(F.array_intersect("words_a", "words_b")) / F.greatest(F.size(F.array_union("words_a", "words_b")), F.lit(1))
    same = (F.col("words_a") == F.col("words_b"))
    return rows.withColumns({"words": shared, "same_words": same, "label_similarity": dot(F.col("lv_a"), F.col("lv_b"))}).drop("words_a", "words_b", "lv_a", "lv_b")


def review_pairs(topics: DataFrame, members: DataFrame, scope: str, record: str, least: float, most: int) -> DataFrame:
    """a, b, similarity, containment, words, label_similarity: the ``most`` nearest pairs
    of named topics of one scope, at or over least by their centroids, that share a quarter
    of the lesser one's records, half of their labels' words, or much of their labels'
    meaning. topics has topic_id, centroid, the scope, label and label_vector."""
    named = topics.where(F.coalesce("label", F.lit("")) != UNCLEAR)
    pairs = topic_pairs(named, least, scope)
    shared = containment(members, "topic_id", record).select("a", "b", "containment")
    rows = _likeness(pairs, named).join(shared, ["a", "b"], "left").withColumn("containment", F.coalesce("containment", F.lit(0.0)))
    some = (F.col("containment") >= CONTAINED) | (F.col("words") >= SHARED_WORDS) | F.coalesce(F.col("label_similarity") >= LIKE_LABELS, F.lit(False))
    return rows.where(some).orderBy(F.desc("similarity"), "a", "b").limit(most).select("a", "b", "similarity", "containment", "words", "label_similarity")


def judged_pairs(pairs: DataFrame, answers: DataFrame, confident: float) -> DataFrame:
    """pairs with decision (error without one), confidence and merge: whether the judge's
    answer (a, b, decision, confidence) is ``same`` and confident enough."""
    rows = pairs.join(answers.select("a", "b", F.lower("decision").alias("decision"), "confidence"), ["a", "b"], "left")
    merge = (F.col("decision") == "same") & (F.col("confidence") >= confident)
    return rows.withColumns({"merge": F.coalesce(merge, F.lit(False)), "decision": F.coalesce(F.when(F.col("decision") != "", F.col("decision")), F.lit("error"))})


def semantic_merges(topics: DataFrame, scope: str, least: float, label_least: float | None) -> DataFrame:
    """a, b, similarity for plan_merges: pairs of named topics of one scope with centroids
    at or over least whose labels have the same words (label_least null) or are as similar
    as that; the similarity is that of the centroids plus that of the labels (1 for words)."""
    named = topics.where(F.coalesce("label", F.lit("")) != UNCLEAR)
    rows = _likeness(topic_pairs(named, least, scope), named)
    if label_least is None:
        rows = rows.where(F.col("same_words") & (F.col("words") > 0)).withColumn("label_similarity", F.lit(1.0))
    else:
        rows = rows.where(F.col("label_similarity") >= label_least)
    return rows.select("a", "b", (F.col("similarity") + F.col("label_similarity")).alias("similarity"))


def colliding_pairs(topics: DataFrame, scope: str, least: float) -> DataFrame:
    """scope, a, b, likeness: pairs of named topics of one scope that can't be told apart by
    their labels: similar ones, or the same words (likeness 1). Each topic is in one pair at
    most: the most alike first, ties by a, then b. A scope's colliding pairs are few; rounds
    of joins take every pair that leads both its topics' others."""
    named = topics.where(F.coalesce("label", F.lit("")) != UNCLEAR)
    rows = _likeness(topic_pairs(named, -2.0, scope), named)
    rows = rows.where(F.col("same_words") | F.coalesce(F.col("label_similarity") >= least, F.lit(False)))
    alike = F.greatest(F.coalesce("label_similarity", F.lit(-1.0)), F.when(F.col("same_words"), 1.0).otherwise(0.0))
    from trendloom.sources.stored import stored

    left, taken = stored(rows.select("a", "b", alike.alias("likeness"))), None
    while True:
        ends = left.select(F.col("a").alias("t"), "a", "b", "likeness").unionByName(left.select(F.col("b").alias("t"), "a", "b", "likeness"))
        order = Window.partitionBy("t").orderBy(F.desc("likeness"), "a", "b")
        first = ends.withColumn("_r", F.row_number().over(order)).where("_r = 1")
        now = stored(first.groupBy("a", "b", "likeness").agg(F.count("*").alias("n")).where("n = 2").drop("n"))
        taken = now if taken is None else taken.unionByName(now)
        if not now.limit(1).count():
            break
        used = now.select(F.col("a").alias("t")).unionByName(now.select(F.col("b").alias("t")))
        left = stored(left.join(used, left["a"] == used["t"], "left_anti").join(used, left["b"] == used["t"], "left_anti"))
    return taken.join(topics.select(F.col("topic_id").alias("a"), F.col(scope)), "a").select(scope, "a", "b", "likeness")


def renamed(topics: DataFrame, pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """topics with the new labels of pairs (a, b) that answers (a, b, label_a, label_b)
    tell apart: both given, and different in either case; final full stops go."""
    clean = lambda c: F.rtrim(F.trim(F.coalesce(c, F.lit(""))), F.lit("."))
    rows = pairs.select("a", "b").join(answers, ["a", "b"]).select("a", "b", clean("label_a").alias("la"), clean("label_b").alias("lb"))
    good = rows.where((F.col("la") != "") & (F.col("lb") != "") & (F.lower("la") != F.lower("lb")))
    new = good.select(F.col("a").alias("topic_id"), F.col("la").alias("_new")).unionByName(good.select(F.col("b").alias("topic_id"), F.col("lb").alias("_new")))
    return topics.join(new, "topic_id", "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")


def to_name(topics: DataFrame) -> DataFrame:
    """Adds ask: whether a topic with members needs a label from the model. A carried label
    is used again unless it is the one for an unclear topic, which is asked anew."""
    again = (F.coalesce("label_source", F.lit("")) == "llm_carried") & (F.coalesce("label", F.lit("")) != UNCLEAR)
    return topics.withColumn("ask", (F.col("size") > 0) & ~again)


def named(topics: DataFrame, answers: DataFrame, least: float) -> DataFrame:
    """topics with label, label_source and substantive by answers (topic_id, label,
    substantive, confidence). A judgement that lacks confidence abstains: the topic is
    unclear. Without an answer, the label stays as it was."""
    rows = topics.join(answers.select("topic_id", F.col("label").alias("_l"), F.col("substantive").alias("_s"), F.col("confidence").alias("_c")), "topic_id", "left")
    sure = F.coalesce(F.col("_c") >= least, F.lit(True))
    label = F.when(F.col("_l").isNull(), F.col("label")).when(sure, F.col("_l")).otherwise(UNCLEAR)
    source = F.when(F.col("_l").isNull(), F.col("label_source")).otherwise("llm")
    return rows.withColumns({"label": label, "label_source": source, "substantive": F.when(F.col("_l").isNotNull() & sure, F.col("_s"))}).drop("_l", "_s", "_c")
