"""Queries over the driver's tables, one for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import text as T
from trendloom.functions import vectors as V
from trendloom.operators import matching, records, terms, timeseries
from trendloom.sources.stored import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, for work on their texts: on all cores."""
    return spread(read(spark, sf_dir, "documents"))


def topical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assigned records: topic_id from type and user."""
    topic = F.concat_ws("-", "event_type", (F.col("user_id") % 20).cast("string"))
    return read(spark, sf_dir, "events").withColumn("topic_id", topic)


EVENTS = "(SELECT *, event_type || '-' || CAST(user_id % 20 AS VARCHAR) AS topic_id FROM events)"
COUNTS = f"(SELECT CAST(ts AS DATE) AS date, topic_id, COUNT(DISTINCT event_id) AS record_count FROM {EVENTS} GROUP BY 1, 2)"
SERIES = f"""(SELECT d.date, t.topic_id, COALESCE(c.record_count, 0) AS record_count
  FROM (SELECT CAST(UNNEST(generate_series(MIN(date), MAX(date), INTERVAL 1 DAY)) AS DATE) AS date FROM {COUNTS}) d
  CROSS JOIN (SELECT DISTINCT topic_id FROM {COUNTS}) t LEFT JOIN {COUNTS} c ON c.date = d.date AND c.topic_id = t.topic_id)"""


def _counts(spark, sf_dir):
    return timeseries.daily_counts(topical(spark, sf_dir), "ts", "topic_id", "event_id")


@query(f"SELECT date, topic_id, record_count FROM {COUNTS}")
def daily_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


@query(f"SELECT date, topic_id, record_count FROM {SERIES}")
def topic_timeseries(spark, sf_dir):
    return timeseries.complete_series(_counts(spark, sf_dir))


HOT = f"""WITH s AS {SERIES}, e AS (SELECT MAX(date) AS m FROM s),
d AS (SELECT s.*, date_diff('day', date, m) AS age FROM s, e WHERE date_diff('day', date, m) < 28),
a AS (SELECT topic_id, SUM(CASE WHEN age < 7 THEN record_count ELSE 0 END) AS rv,
  SUM(CASE WHEN age >= 7 THEN record_count ELSE 0 END) / GREATEST(COUNT(DISTINCT CASE WHEN age >= 7 THEN date END), 1)::DOUBLE * 7 AS bv,
  (SUM(CASE WHEN age < 2 THEN record_count ELSE 0 END) + 1)::DOUBLE / (SUM(CASE WHEN age BETWEEN 2 AND 6 THEN record_count ELSE 0 END) + 1) AS vel,
  AVG(CASE WHEN age < 7 THEN CAST(record_count > 0 AS INT) END) AS pers FROM d GROUP BY 1),
b AS (SELECT *, (rv + 1) / (bv + 1) - 1 AS g, rv / (bv + 1) AS an FROM a),
v AS (SELECT *, rv::DOUBLE AS x1, GREATEST(g, 0) AS x2, ln(1 + GREATEST(vel, 0)) AS x3, ln(1 + GREATEST(an, 0)) AS x4 FROM b),
p AS (SELECT {", ".join(f"quantile_cont(x{i}, {q}) AS {e}{i}" for i in (1, 2, 3, 4) for e, q in (("l", 0.05), ("h", 0.95)))} FROM v),
z AS (SELECT v.*, {", ".join(f"CASE WHEN h{i} > l{i} THEN (LEAST(GREATEST(x{i}, l{i}), h{i}) - l{i}) / (h{i} - l{i}) ELSE 0 END AS s{i}" for i in (1, 2, 3, 4))} FROM v, p),
f AS (SELECT *, .25 * s1 + .25 * s2 + .20 * s3 + .15 * s4 + .10 * s1 + .05 * pers AS hs FROM z)
SELECT topic_id, CAST(rv AS BIGINT) AS recent_volume, ROUND(bv, 6) AS baseline_volume, ROUND(vel, 6) AS velocity_ratio, ROUND(g, 6) AS growth_rate,
  ROUND(an, 6) AS anomaly_ratio, ROUND(pers, 6) AS persistence, ROUND(hs, 6) AS hot_score,
  CASE WHEN rv <= 2 THEN 'LOW_EVIDENCE' WHEN hs >= .75 AND g > .5 THEN 'HOT' WHEN hs >= .55 AND g > .2 THEN 'TRENDING'
    WHEN g > .05 THEN 'GROWING' WHEN g < -.2 THEN 'DECLINING' ELSE 'STABLE' END AS status FROM f"""


@query(HOT)
def hot_scores(spark, sf_dir):
    hot = timeseries.hot_scores(timeseries.complete_series(_counts(spark, sf_dir)))
    rounded = [F.round(c, 6).alias(c) for c in ("baseline_volume", "velocity_ratio", "growth_rate", "anomaly_ratio", "persistence", "hot_score")]
    return hot.select("topic_id", "recent_volume", *rounded, "status")


QUALITY = """(SELECT event_type AS topic_id, CASE WHEN COUNT(*) % 3 = 0 THEN NULL ELSE (COUNT(*) % 7) / 40.0 END AS coherence, COUNT(*) AS size,
  COUNT(*) % 5 = 0 AS residual, COUNT(*) % 11 = 0 AS junk, COUNT(*) % 2 = 0 AS substantive, FALSE AS campaign,
  CASE WHEN COUNT(*) % 2 = 0 THEN 'HOT' ELSE 'TRENDING' END AS status FROM events GROUP BY 1)"""


@query(f"""WITH q AS {QUALITY}, r AS (SELECT *, CASE WHEN COALESCE(coherence, -1) < .05 THEN 'low_coherence' WHEN size < 30 THEN 'below_min_size'
  WHEN residual THEN 'residual_cluster' WHEN junk THEN 'is_junk' WHEN substantive = FALSE THEN 'llm_not_substantive' WHEN campaign THEN 'campaign_cluster' END AS why FROM q)
SELECT topic_id, size, CASE WHEN why IS NULL THEN status ELSE 'GROWING' END AS status, why AS alert_suppressed_reason, why IS NOT NULL AS alert_suppressed FROM r""")
def alert_gate(spark, sf_dir):
    n = F.col("size")
    q = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic_id")).agg(F.count("*").alias("size"))
    q = q.select(
        "topic_id", "size", F.when(n % 3 != 0, n % 7 / 40.0).alias("coherence"), (n % 5 == 0).alias("residual"), (n % 11 == 0).alias("junk"),
        (n % 2 == 0).alias("substantive"), F.lit(False).alias("campaign"), F.when(n % 2 == 0, "HOT").otherwise("TRENDING").alias("status"),
    )
    return timeseries.gate_alerts(q).select("topic_id", "size", "status", "alert_suppressed_reason", "alert_suppressed")


def _normal_sql(t: str) -> str:
    t = f"regexp_replace(COALESCE({t}, ''), '[\\x{{200B}}\\r\\n]', ' ', 'g')"
    t = f"regexp_replace({t}, '(?:https?://|www\\.)\\S+', ' ', 'gi')"
    t = f"regexp_replace({t}, '(^|[^\\p{{L}}\\p{{N}}_])@[\\p{{L}}\\p{{N}}_]+', '\\1 ', 'g')"
    t = f"replace({t}, '#', ' ')"
    for mark in "!?.,":
        t = f"regexp_replace({t}, '\\{mark}{{3,}}', '{mark}', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_normal_sql('text')} AS clean_text FROM documents")
def normalized_text(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.normalize_text(F.col("text")).alias("clean_text"))


# A list whose last member is the chunk that is being packed ('' for none).
PACKED = """list_filter(list_reduce(list_prepend([''], list_transform(list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''), lambda s: [s])),
  lambda acc, s: CASE WHEN length(s[1]) > 450 THEN list_concat(acc, list_concat(list_transform(generate_series(0, length(s[1]) - 1, 390), lambda i: trim(substr(s[1], i + 1, 450))), ['']))
    WHEN acc[len(acc)] = '' THEN list_concat(acc[1:len(acc) - 1], s) WHEN length(acc[len(acc)]) + 1 + length(s[1]) <= 450 THEN list_concat(acc[1:len(acc) - 1], [acc[len(acc)] || ' ' || s[1]]) ELSE list_concat(acc, s) END), lambda c: c <> '')"""


@query(f"""WITH n AS (SELECT doc_id, {_normal_sql("text")} AS t FROM documents), k AS (SELECT doc_id, CASE WHEN length(t) <= 450 THEN [t] ELSE {PACKED} END AS k FROM n WHERE t <> ''),
f AS (SELECT doc_id, UNNEST(generate_series(0, LEAST(len(k), 6) - 1)) AS i, k FROM k)
SELECT CAST(doc_id AS VARCHAR) || '::' || CAST(i AS VARCHAR) AS segment_id, doc_id, CAST(i AS INT) AS segment_index, CAST(LEAST(len(k), 6) AS INT) AS segment_count,
  CASE WHEN len(k) > 6 THEN k[CAST(floor(i * (len(k) - 1) / 5.0) AS BIGINT) + 1] ELSE k[i + 1] END AS clean_text FROM f""")
def segments(spark, sf_dir):
    chunks = T.capped(T.packed_chunks(T.normalize_text(F.col("text"))))
    rows = texts(spark, sf_dir).select("doc_id", chunks.alias("c"))
    # Outer: Spark would else look whether there are chunks by working them all out before.
    rows = rows.select("doc_id", F.size("c").alias("segment_count"), F.posexplode_outer("c").alias("segment_index", "clean_text")).where("segment_index is not null")
    name = F.concat_ws("::", F.col("doc_id").cast("string"), F.col("segment_index").cast("string"))
    return rows.select(name.alias("segment_id"), "doc_id", "segment_index", "segment_count", "clean_text")


STOP = ("the", "and", "that", "with", "for", "der", "die", "und", "que", "les", "des", "las", "los")


@query(f"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(COALESCE(text, '')), '\\p{{L}}+'), lambda w: length(w) >= 3 AND w NOT IN {STOP})) AS INT) AS content_words FROM documents""")
def content_words(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", T.content_words(F.col("text"), STOP).alias("content_words"))


@query(f"""SELECT p_partkey, list_aggregate(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: w NOT IN {T.LABEL_FILLERS}))), 'string_agg', ' ') AS wordset FROM part""")
def label_wordsets(spark, sf_dir):
    words = F.array_join(T.label_wordset(F.col("p_name")), " ")
    return read(spark, sf_dir, "part").select("p_partkey", F.when(words != "", words).alias("wordset"))


@query("""SELECT doc_id FROM documents WHERE (contains(lower(text), 'license') OR contains(lower(text), 'copyright')) AND (contains(lower(text), 'version') OR contains(lower(text), 'cc'))""")
def keyword_events(spark, sf_dir):
    hit = T.keyword_hit(F.col("text"), [["license", "copyright"], ["version", "cc"]])
    return texts(spark, sf_dir).where(hit).select("doc_id")


CENTRE = """(WITH m AS (SELECT label, i, AVG(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT UNNEST(generate_series(1, 64)) AS i) GROUP BY 1, 2),
 n AS (SELECT label, GREATEST(sqrt(SUM(m * m)), 1e-12) AS n FROM m GROUP BY 1)
 SELECT label, list(m / n ORDER BY i) AS centroid FROM m JOIN n USING (label) GROUP BY label)"""


def _centroids(spark, sf_dir):
    return V.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding").withColumnRenamed("label", "topic_id")


@query(f"SELECT label AS topic_id, UNNEST(generate_series(0, 63))::INT AS pos, ROUND(UNNEST(centroid), 6) AS x FROM {CENTRE}")
def topic_centroids(spark, sf_dir):
    return _centroids(spark, sf_dir).select("topic_id", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


# Scopes: '1' has two topics of ten, '0' and '7' one in five, 2 and 3 none but the pool's.
OWNERS = "CASE label % 5 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '1' WHEN 3 THEN '__POOL__' ELSE '7' END"


@query(f"""WITH c AS (SELECT *, {OWNERS} AS scope FROM {CENTRE}), v AS (SELECT vec_id, CAST(vec_id % 4 AS VARCHAR) AS own, embedding::DOUBLE[] AS v FROM embeddings),
k AS (SELECT *, CASE WHEN own IN (SELECT scope FROM c) THEN own ELSE '__POOL__' END AS scope FROM v),
s AS (SELECT vec_id, label AS topic_id, list_dot_product(v, centroid) / GREATEST(sqrt(list_dot_product(v, v)), 1e-12) AS sim FROM k JOIN c USING (scope)),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic_id) AS rank, MAX(sim) OVER (PARTITION BY vec_id) AS best FROM s)
SELECT vec_id, CASE WHEN best >= .2 THEN topic_id END AS topic_id, ROUND(sim, 6) AS similarity, CAST(rank AS INT) AS rank, CASE WHEN best >= .2 THEN 'EXISTING' ELSE 'UNASSIGNED' END AS assignment_type
FROM r WHERE rank = 1 OR (rank = 2 AND sim >= .2 AND sim >= best - .05)""")
def topic_assignment(spark, sf_dir):
    n = F.col("topic_id") % 5
    owner = F.when(n == 0, "0").when(n <= 2, "1").when(n == 3, "__POOL__").otherwise("7")
    rows = read(spark, sf_dir, "embeddings").withColumn("scope", F.col("vec_id") % 4)
    out = matching.assign_topics(rows, _centroids(spark, sf_dir).withColumn("scope", owner), "vec_id", "embedding", 0.2, scope="scope")
    return out.withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH c AS {CENTRE} SELECT a.label AS a, b.label AS b, ROUND(list_dot_product(a.centroid, b.centroid), 6) AS similarity FROM c a JOIN c b ON a.label < b.label
  WHERE list_dot_product(a.centroid, b.centroid) >= -1""")
def topic_pairs(spark, sf_dir):
    return matching.topic_pairs(_centroids(spark, sf_dir), -1.0).withColumn("similarity", F.round("similarity", 6))


@query("""WITH r AS (SELECT DISTINCT event_type AS t, user_id AS r FROM events), n AS (SELECT t, COUNT(*) AS n FROM r GROUP BY 1),
s AS (SELECT x.t AS a, y.t AS b, COUNT(*) AS common FROM r x JOIN r y ON x.r = y.r AND x.t < y.t GROUP BY 1, 2)
SELECT a, b, common, ROUND(common / LEAST(p.n, q.n)::DOUBLE, 9) AS containment FROM s JOIN n p ON p.t = a JOIN n q ON q.t = b""")
def record_containment(spark, sf_dir):
    return matching.containment(read(spark, sf_dir, "events"), "event_type", "user_id").withColumn("containment", F.round("containment", 9))


@query("SELECT source, COUNT(DISTINCT doc_id) AS records, CASE WHEN COUNT(DISTINCT doc_id) >= 40 THEN source ELSE '__POOL__' END AS pool_key FROM documents GROUP BY 1")
def pooled_scopes(spark, sf_dir):
    return records.pool_small(read(spark, sf_dir, "documents"), "source", "doc_id", 40)


@query("""SELECT user_id, event_type, n FROM (SELECT user_id, event_type, COUNT(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def dominant_type(spark, sf_dir):
    return records.dominant(read(spark, sf_dir, "events"), "user_id", "event_type")


@query("""SELECT event_id, user_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def keep_last(spark, sf_dir):
    return records.keep_last(read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "ts", "event_type")


@query("""WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events),
m AS (SELECT event_type, n, CAST(ceil(n * 0.1) AS BIGINT) AS m FROM (SELECT DISTINCT event_type, n FROM n)),
k AS (SELECT event_type, floor(j * n / m::DOUBLE) AS i FROM m, LATERAL (SELECT UNNEST(generate_series(0, m - 1)) AS j))
SELECT n.event_id, n.event_type FROM n JOIN k ON n.event_type = k.event_type AND n.i = k.i""")
def systematic_sample(spark, sf_dir):
    return records.systematic_sample(read(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], 0.1).select("event_id", "event_type")


@query("""SELECT event_id, CAST(LEAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / GREATEST((SELECT COUNT(*) // 6 FROM events), 1)), 5) AS INT) AS chunk FROM events""")
def equal_chunks(spark, sf_dir):
    return records.equal_chunks(read(spark, sf_dir, "events"), ["ts", "event_id"], 6).select("event_id", "chunk")


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT MIN(event_type) FROM events)), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT MAX(event_type) FROM events)),
k AS (SELECT (SELECT COUNT(*) FROM a JOIN b USING (user_id)) AS kept, (SELECT COUNT(*) FROM a) AS na, (SELECT COUNT(*) FROM b) AS nb)
SELECT kept, na - kept AS lost, nb - kept AS gained, ROUND(kept / GREATEST(na, 1)::DOUBLE, 9) AS retention FROM k""")
def id_retention(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    ends = F.broadcast(e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi")))
    e = e.crossJoin(ends)
    out = records.compare_ids(e.where("event_type = lo"), e.where("event_type = hi"), "user_id")
    return out.withColumn("retention", F.round("retention", 9))


@query(f"""WITH n AS (SELECT event_type, topic_id, COUNT(*) AS n FROM {EVENTS} GROUP BY 1, 2),
r AS (SELECT event_type, SUM(n) OVER (PARTITION BY event_type ORDER BY n DESC, topic_id ROWS UNBOUNDED PRECEDING) AS run, SUM(n) OVER (PARTITION BY event_type) AS t FROM n)
SELECT event_type, CAST(MAX(t) AS BIGINT) AS total, CAST(COUNT(*) FILTER (run < t * .8) + 1 AS BIGINT) AS items_for_share FROM r GROUP BY 1""")
def topics_for_share(spark, sf_dir):
    n = topical(spark, sf_dir).groupBy("event_type", "topic_id").agg(F.count("*").alias("n"))
    return records.cumulative_share(n, "event_type", "topic_id", "n")


@query("""WITH e AS (SELECT MAX(ts) AS m FROM events), b AS (SELECT user_id, COUNT(*) AS waiting, date_diff('day', CAST(MIN(ts) AS DATE), CAST((SELECT m FROM e) AS DATE)) AS waited_days FROM events GROUP BY 1)
SELECT user_id, waiting, CAST(waited_days AS INT) AS waited_days FROM b WHERE waiting >= 80 OR waited_days >= 29""")
def due_buckets(spark, sf_dir):
    return records.due_buckets(read(spark, sf_dir, "events"), "user_id", "ts", 80, 29)


@query("SELECT event_id, event_type FROM events WHERE ts >= (SELECT MAX(ts) FROM events) - INTERVAL 14 DAY")
def pruned_buffer(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    end = F.broadcast(e.agg(F.max("ts").alias("_end")))
    return e.crossJoin(end).where(F.col("ts") >= F.col("_end") - F.expr("interval 14 days")).select("event_id", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def records_page(spark, sf_dir):
    return records.page(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 50)


@query("""WITH r AS (SELECT conv_id, turn, role, LEAD(role) OVER w AS nr, length(LEAD(text) OVER w) AS nc FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, COALESCE(nr = 'assistant', FALSE) AS answered, CAST(nc AS INT) AS next_chars FROM r WHERE role = 'user'""")
def reply_chain(spark, sf_dir):
    return records.next_reply(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", "user", "assistant")


WORDS = "regexp_extract_all(lower(COALESCE(text, '')), '\\p{L}{3,}')"


@query(f"""WITH w AS (SELECT DISTINCT lang, doc_id, UNNEST({WORDS}) AS term FROM documents), d AS (SELECT lang, term, COUNT(*) AS df FROM w GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY df DESC, term) AS rank FROM d) SELECT lang, term, df, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def top_terms(spark, sf_dir):
    return terms.top_terms(texts(spark, sf_dir), "lang", "doc_id", "text")


@query(f"""WITH w AS (SELECT source, UNNEST({WORDS}) AS term FROM documents), t AS (SELECT source, term, COUNT(*) AS n FROM w GROUP BY 1, 2),
s AS (SELECT source, term, ROUND(n / SUM(n) OVER (PARTITION BY source) * ln(1 + (SELECT COUNT(DISTINCT source) FROM t) / (COUNT(*) OVER (PARTITION BY term))::DOUBLE), 9) AS score FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS rank FROM s) SELECT source, term, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def class_tfidf(spark, sf_dir):
    return terms.class_tfidf(texts(spark, sf_dir), "source", "text")


KEY = f"trim(regexp_replace(regexp_replace(lower({_normal_sql('text')}), '[^\\p{{L}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH k AS (SELECT source, {KEY} AS k, COUNT(*) AS n FROM documents GROUP BY 1, 2)
SELECT source, CAST(SUM(n) AS BIGINT) AS members, ROUND(COALESCE(MAX(n) FILTER (k <> ''), 0) / SUM(n)::DOUBLE, 9) AS ratio FROM k GROUP BY 1""")
def duplicate_ratio(spark, sf_dir):
    return terms.duplicate_ratio(texts(spark, sf_dir), "source", "text").withColumn("ratio", F.round("ratio", 9))


@query(f"""WITH c AS {CENTRE}, s AS (SELECT vec_id, e.label AS own, c.label AS topic_id, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(embedding::DOUBLE[], centroid) DESC, c.label) AS r FROM embeddings e CROSS JOIN c),
t AS (SELECT own, topic_id, COUNT(*)::DOUBLE AS n FROM s WHERE r = 1 GROUP BY 1, 2),
a AS (SELECT SUM(n * (n - 1) / 2) AS sa FROM (SELECT SUM(n) AS n FROM t GROUP BY own)), b AS (SELECT SUM(n * (n - 1) / 2) AS sb FROM (SELECT SUM(n) AS n FROM t GROUP BY topic_id)),
k AS (SELECT SUM(n) AS n, SUM(n * (n - 1) / 2) AS sc FROM t)
SELECT CAST(n AS BIGINT) AS n, ROUND((sc - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 6) AS ari FROM a, b, k""")
def clustering_agreement(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    best = matching.assign_topics(e, _centroids(spark, sf_dir), "vec_id", "embedding", -2.0, k=1)
    return matching.rand_index(e.select("vec_id", "label").join(best, "vec_id"), "label", "topic_id").withColumn("ari", F.round("ari", 6))


@query("""SELECT event_type, CAST(COUNT(*) AS BIGINT) AS n, ROUND(quantile_cont(value, .05), 6) AS p05, ROUND(median(value), 6) AS p50, ROUND(quantile_cont(value, .95), 6) AS p95,
  ROUND(COUNT(*) / COUNT(DISTINCT user_id)::DOUBLE, 9) AS inflation FROM events GROUP BY 1""")
def run_summary(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), *[F.round(F.percentile("value", F.lit(q)), 6).alias(f"p{round(100 * q):02d}") for q in (0.05, 0.5, 0.95)],
        F.round(F.count("*") / F.countDistinct("user_id"), 9).alias("inflation"),
    )


@query("""WITH a AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 14) SELECT vec_id, ROUND(MAX(list_dot_product(embedding::DOUBLE[], v)), 6) AS nearest FROM embeddings, a GROUP BY 1 HAVING MAX(list_dot_product(embedding::DOUBLE[], v)) <= .6""")
def anchor_filter(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    anchors = F.broadcast(e.where("vec_id < 14").select(F.col("embedding").alias("v")))  # fourteen anchor vectors
    out = e.crossJoin(anchors).groupBy("vec_id").agg(F.max(V.dot(F.col("embedding"), F.col("v"))).alias("nearest")).where("nearest <= 0.6")
    return out.withColumn("nearest", F.round("nearest", 6))


TYPES = ("click", "error", "login", "logout", "purchase", "search", "signup", "view")


@query(f"SELECT CAST(ts AS DATE) AS date, {', '.join(f"COUNT(*) FILTER (event_type = '{t}') AS {t}" for t in TYPES)} FROM events GROUP BY 1")
def daily_pivot(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), "event_type")
    return e.groupBy("date").pivot("event_type", list(TYPES)).count().na.fill(0)
