"""Queries that compare runs, over the driver's tables, with their SQL. A run is a third of
the events by their number."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.functions import text as T
from trendloom.functions import vectors as V
from trendloom.operators import compare, reports
from trendloom.plans.queries import CENTRE, EVENTS, STOP, query, read, texts, topical


def _runs(spark, sf_dir):
    e = topical(spark, sf_dir).withColumns({"run": F.concat(F.lit("run"), F.col("event_id") % 3), "topic": F.col("topic_id")})
    e = e.withColumn("topic_id", F.when(F.col("value") >= 5, F.concat_ws("/", "run", "topic")))
    n = F.count("*")
    topics = e.where("topic_id is not null").groupBy("run", "topic_id", "event_type").agg(
        F.countDistinct("user_id").alias("records"), n.alias("size"), F.when(n % 4 != 0, (n % 7 - 2) / 20).alias("coherence"), (n % 5 == 0).alias("is_junk"),
    )
    kind = F.when(F.col("topic_id").isNull(), "UNASSIGNED").otherwise("EXISTING")
    return e.withColumn("assignment_type", kind), topics


RUNS = f"""e AS (SELECT 'run' || (event_id % 3) AS run, event_id, user_id, event_type, value, CASE WHEN value >= 5 THEN 'run' || (event_id % 3) || '/' || topic_id END AS topic_id FROM {EVENTS}),
t AS (SELECT run, topic_id, event_type, COUNT(*) AS size, CASE WHEN COUNT(*) % 4 <> 0 THEN (COUNT(*) % 7 - 2) / 20.0 END AS coherence, COUNT(*) % 5 = 0 AS is_junk FROM e WHERE topic_id IS NOT NULL GROUP BY 1, 2, 3)"""
QUALITY = """q AS (SELECT run, COUNT(*) AS topics, COUNT(*) FILTER (is_junk) AS junk, COUNT(*) FILTER (coherence >= .1) AS coherent, ROUND(AVG(coherence), 6) AS mean_coherence, ROUND(median(coherence), 6) AS median_coherence,
  CAST(floor(median(size)) AS BIGINT) AS median_size, MAX(size) AS largest FROM t GROUP BY 1), u AS (SELECT run, COUNT(*) FILTER (topic_id IS NULL) AS unassigned, ROUND(AVG(CASE WHEN topic_id IS NULL THEN 1.0 ELSE 0.0 END), 6) AS unassigned_share FROM e GROUP BY 1)"""


@query(f"WITH {RUNS}, {QUALITY} SELECT * FROM q JOIN u USING (run)")
def run_quality(spark, sf_dir):
    e, topics = _runs(spark, sf_dir)
    return compare.quality_rows(topics, e).withColumns({c: F.round(c, 6) for c in ("mean_coherence", "median_coherence", "unassigned_share")})


@query(f"""WITH {RUNS}, {QUALITY}, n AS (SELECT run, ROUND(AVG(CASE WHEN coherence < 0 THEN 1.0 WHEN coherence >= 0 THEN 0.0 END), 6) AS negative_share FROM t GROUP BY 1),
i AS (SELECT run, SUM(r) AS a FROM (SELECT run, topic_id, COUNT(DISTINCT user_id) AS r FROM e WHERE topic_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1), o AS (SELECT run, COUNT(DISTINCT user_id) AS o FROM e WHERE topic_id IS NOT NULL GROUP BY 1),
h AS (SELECT run, COUNT(*) AS alerts, MIN(coherence) AS worst_alert_coherence FROM t WHERE size % 6 = 0 GROUP BY 1),
x AS (SELECT run, 'large' AS event, user_id AS r FROM e WHERE value >= 60 UNION SELECT run, 'errors', user_id FROM e WHERE event_type = 'error'), p AS (SELECT DISTINCT run, user_id AS r, topic_id FROM e WHERE topic_id IS NOT NULL),
s AS (SELECT topic_id, COUNT(*) AS n FROM p GROUP BY 1), m AS (SELECT run, event, COUNT(DISTINCT r) AS n FROM x JOIN p USING (run, r) GROUP BY 1, 2), l AS (SELECT run, event, topic_id, COUNT(*) AS n FROM x JOIN p USING (run, r) GROUP BY 1, 2, 3),
w AS (SELECT l.*, row_number() OVER (PARTITION BY run, event ORDER BY l.n DESC, topic_id) AS i, SUM(l.n) OVER (PARTITION BY run, event ORDER BY l.n DESC, topic_id ROWS UNBOUNDED PRECEDING) AS so_far, m.n AS all_n FROM l JOIN m USING (run, event)),
v AS (SELECT run, event, MAX(topic_id) FILTER (i = 1) AS topic_id, MAX(n) AS best, MAX(all_n) AS all_n, COUNT(*) AS spanned, COUNT(*) FILTER (so_far < .8 * all_n) + 1 AS need FROM w GROUP BY 1, 2),
f AS (SELECT run, COUNT(*) AS found, ROUND(AVG(best / s.n::DOUBLE), 6) AS "precision", ROUND(AVG(best / all_n::DOUBLE), 6) AS recall, ROUND(AVG(need), 6) AS topics_for_share, CAST(floor(AVG(spanned)) AS BIGINT) AS spanned FROM v JOIN s USING (topic_id) GROUP BY 1)
SELECT q.*, unassigned, unassigned_share, negative_share, ROUND(a / o::DOUBLE, 6) AS inflation, 0::BIGINT AS near_duplicates, COALESCE(alerts, 0) AS alerts, ROUND(worst_alert_coherence, 6) AS worst_alert_coherence, found, "precision", recall, topics_for_share, spanned
FROM q JOIN u USING (run) JOIN n USING (run) JOIN i USING (run) JOIN o USING (run) LEFT JOIN h USING (run) LEFT JOIN f USING (run)""")
def run_arms(spark, sf_dir):
    e, topics = _runs(spark, sf_dir)
    hot = topics.select("topic_id", F.when(F.col("size") % 6 == 0, "HOT").otherwise("STABLE").alias("status"))
    marks = F.array(F.when(F.col("value") >= 60, F.lit("large")), F.when(F.col("event_type") == "error", F.lit("errors")))
    hits = e.select("user_id", "run", F.explode(F.array_compact(marks)).alias("event"))
    # A user of one run is a record of its own: events are told apart by run.
    name = lambda rows, c: rows.withColumn(c, F.concat_ws("/", "run", F.col(c).cast("string")))
    found = reports.event_recall(name(e, "user_id"), name(name(hits, "user_id"), "event"), "user_id").withColumn("run", F.split("event", "/")[0])
    none = topics.withColumn("centroid", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i == F.pmod(F.xxhash64("topic_id"), F.lit(4)) + 1, 1.0).otherwise(0.0)))
    none = none.withColumn("scope", F.col("topic_id"))  # every topic is a scope: there is no pair
    out = compare.arm_rows(none, e, hot, found, "user_id", "scope")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_coherence", "median_coherence", "unassigned_share", "negative_share", "inflation", "worst_alert_coherence", "precision", "recall", "topics_for_share")})


@query(f"""WITH c AS {CENTRE}, t AS (SELECT label % 2 AS run, label // 2 % 2 AS scope, label AS id, centroid FROM c)
SELECT a.run, COUNT(*) AS near_duplicates FROM t a JOIN t b ON a.run = b.run AND a.scope = b.scope AND a.id < b.id WHERE list_dot_product(a.centroid, b.centroid) > -.05 GROUP BY 1""")
def near_duplicate_topics(spark, sf_dir):
    topics = V.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding").select(F.col("label").alias("topic_id"), (F.col("label") % 2).alias("run"), F.floor(F.col("label") / 2 % 2).alias("scope"), "centroid")
    return compare.near_duplicate_topics(topics, -0.05, "scope")


@query(f"""WITH r AS (SELECT DISTINCT 'run' || (event_id % 3) AS run, event_type || '-' || (user_id % 20) AS topic_id FROM events WHERE value >= 40)
SELECT run, topic_id, CASE WHEN run = 'run0' THEN topic_id LIKE 'error%' ELSE topic_id NOT IN (SELECT topic_id FROM r p WHERE p.run = 'run' || (CAST(r.run[4] AS INT) - 1)) END AS is_new FROM r""")
def run_overviews(spark, sf_dir):
    e = topical(spark, sf_dir).where("value >= 40").select(F.concat(F.lit("run"), F.col("event_id") % 3).alias("run"), "topic_id").distinct()
    e = e.withColumn("status_lifecycle", F.when(F.col("topic_id").like("error%"), "EMERGING").otherwise("ACTIVE"))
    return compare.overview(e).select("run", "topic_id", "is_new")


@query(f"""WITH n AS (SELECT topic_id, event_type AS scope, COUNT(*) AS size FROM {EVENTS} GROUP BY 1, 2) SELECT scope, CASE WHEN size >= 100 THEN 'ACTIVE' ELSE 'EMERGING' END AS status, COUNT(*) AS topics, CAST(SUM(size) AS BIGINT) AS records FROM n GROUP BY 1, 2""")
def status_histogram(spark, sf_dir):
    n = topical(spark, sf_dir).groupBy("topic_id", F.col("event_type").alias("scope")).agg(F.count("*").alias("size"))
    return compare.histogram(n.withColumn("status", F.when(F.col("size") >= 100, "ACTIVE").otherwise("EMERGING")), "scope", "status")


@query(f"""SELECT doc_id FROM documents WHERE len(list_filter(regexp_extract_all(lower(COALESCE(text, '')), '\\p{{L}}+'), lambda w: length(w) >= 3 AND w NOT IN {STOP})) >= 40""")
def worded_documents(spark, sf_dir):
    return texts(spark, sf_dir).where(T.enough_words(F.col("text"), 40, STOP)).select("doc_id")
