"""Queries of term scores, coherence, flags, samples and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.functions import text as T
from trendloom.functions import vectors as V
from trendloom.operators import audits, matching, terms
from trendloom.plans.queries import CENTRE, EVENTS, STOP, WORDS, query, read, texts, topical

TOKENS = f"list_filter(regexp_extract_all(lower(COALESCE(text, '')), '[\\p{{L}}\\p{{N}}_\\p{{M}}]{{2,}}'), lambda w: w NOT IN {STOP})"
GRAMS = "list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))"


@query(f"""WITH d AS (SELECT lang, doc_id, {TOKENS} AS w FROM documents), g AS (SELECT lang, doc_id, UNNEST({GRAMS}) AS term FROM d), t AS (SELECT lang, doc_id, term, COUNT(*) AS n FROM g GROUP BY 1, 2, 3),
f AS (SELECT lang, term, COUNT(*) AS df, row_number() OVER (PARTITION BY lang ORDER BY SUM(n) DESC, term) AS r FROM t GROUP BY 1, 2), s AS (SELECT lang, COUNT(*) AS docs FROM documents GROUP BY 1),
w AS (SELECT t.lang, t.doc_id, t.term, s.docs, n * (ln((1 + docs) / (1 + df)::DOUBLE) + 1) AS w FROM t JOIN f ON f.lang = t.lang AND f.term = t.term AND f.r <= 1000 JOIN s ON s.lang = t.lang),
m AS (SELECT lang, doc_id, sqrt(SUM(w * w)) AS m FROM w GROUP BY 1, 2), k AS (SELECT w.lang, term, ROUND(SUM(w / m) / MAX(docs), 9) AS score FROM w JOIN m ON m.lang = w.lang AND m.doc_id = w.doc_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rank FROM k) SELECT lang, term, ROUND(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""")
def tfidf_terms(spark, sf_dir):
    return terms.tfidf_terms(texts(spark, sf_dir), "lang", "doc_id", "text", STOP).withColumn("score", F.round("score", 6))


FOLD = """list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(terms, lambda t: [t])), lambda acc, c: CASE WHEN len(acc) >= 5 OR len(list_filter(acc, lambda k:
  list_has_all(string_split(k, ' '), string_split(c[1], ' ')) OR list_has_all(string_split(c[1], ' '), string_split(k, ' ')))) > 0 THEN acc ELSE list_append(acc, c[1]) END)"""
NOISY = f"len(list_filter(string_split(term, ' '), lambda w: NOT (regexp_matches(w, '(?i)^(?:mobile_?care\\w*|__\\w+__|[0-9]+)$') OR w IN {T.NOISE_WORDS}))) = 0"


@query(f"""WITH d AS (SELECT source, {TOKENS} AS w FROM documents), g AS (SELECT source, UNNEST({GRAMS}) AS term FROM d), t AS (SELECT source, term, COUNT(*) AS n FROM g GROUP BY 1, 2),
s AS (SELECT source, term, ROUND(n / SUM(n) OVER (PARTITION BY source) * ln(1 + (SELECT COUNT(DISTINCT source) FROM t) / (COUNT(*) OVER (PARTITION BY term))::DOUBLE), 9) AS score FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS r FROM s), l AS (SELECT source, list(term ORDER BY r) AS terms FROM r WHERE r <= 60 AND NOT ({NOISY}) GROUP BY 1)
SELECT source, array_to_string({FOLD}, ' / ') AS label FROM l""")
def class_labels(spark, sf_dir):
    return terms.class_labels(texts(spark, sf_dir), "source", "text", STOP)


@query(f"""WITH w AS (SELECT source, UNNEST({WORDS}) AS term FROM documents), t AS (SELECT source, term, COUNT(*) AS n FROM w WHERE term NOT IN {STOP} GROUP BY 1, 2),
z AS (SELECT source, SUM(n) AS total FROM t GROUP BY 1), s AS (SELECT t.source, term, ROUND(n / total::DOUBLE * ln(1 + (SELECT AVG(total) FROM z) / SUM(n) OVER (PARTITION BY term)), 9) AS score FROM t JOIN z USING (source)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS rank FROM s) SELECT source, term, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def audit_terms(spark, sf_dir):
    return terms.audit_terms(texts(spark, sf_dir), "source", "text", STOP)


# DuckDB's word boundary knows ASCII only, so whole words are cut first.
PLAIN = (
    "list_filter(list_transform(regexp_extract_all(lower(COALESCE(text, '')), '[\\p{L}\\p{N}\\p{M}_'']+'), lambda w: trim(w, '''')), "
    "lambda w: regexp_full_match(w, '[a-z][a-z'']{2,}'))"
)
PAIRS = f"""w AS (SELECT DISTINCT lang, doc_id, UNNEST({WORDS}) AS term FROM documents), d AS (SELECT lang, term, COUNT(*) AS df FROM w GROUP BY 1, 2),
t AS (SELECT lang, term FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY df DESC, term) AS r FROM d) WHERE r <= 10), u AS (SELECT DISTINCT doc_id, UNNEST({PLAIN}) AS term FROM documents),
x AS (SELECT a.term AS a, b.term AS b, COUNT(*) AS nab FROM u a JOIN u b USING (doc_id) WHERE a.term IN (SELECT term FROM t) AND b.term IN (SELECT term FROM t) GROUP BY 1, 2),
p AS (SELECT s.lang, s.term AS a, o.term AS b, COALESCE(xa.nab, 0)::DOUBLE AS na, COALESCE(xb.nab, 0)::DOUBLE AS nb, COALESCE(x.nab, 0)::DOUBLE AS nab, (SELECT COUNT(DISTINCT doc_id) FROM documents)::DOUBLE AS n
  FROM t s JOIN t o USING (lang) LEFT JOIN x ON x.a = s.term AND x.b = o.term LEFT JOIN x xa ON xa.a = s.term AND xa.b = s.term LEFT JOIN x xb ON xb.a = o.term AND xb.b = o.term)"""
CONTEXT = """c AS (SELECT *, SUM(v) OVER (PARTITION BY lang, b) AS s FROM v), e AS (SELECT lang, a, SUM(v * s) / (sqrt(SUM(v * v)) * sqrt(SUM(s * s)) + 1e-12) AS c FROM c GROUP BY 1, 2), k AS (SELECT lang, AVG(c) AS c_v FROM e GROUP BY 1)"""


def _pairs(spark, sf_dir):
    docs = texts(spark, sf_dir)
    return terms.pair_counts(docs, terms.top_terms(docs, "lang", "doc_id", "text").select("lang", "term"), "lang", "doc_id", "text")


NPMI = "CASE WHEN na = 0 OR nb = 0 THEN 0 WHEN nab = 0 THEN -1 WHEN nab = n THEN 1 ELSE ln(nab * n / (na * nb)) / -ln(nab / n) END"


@query(f"WITH {PAIRS} SELECT lang, ROUND(AVG({NPMI}) FILTER (a < b), 6) AS coherence FROM p GROUP BY 1")
def npmi_coherence(spark, sf_dir):
    return terms.npmi(_pairs(spark, sf_dir), "lang").withColumn("coherence", F.round("coherence", 6))


@query(f"""WITH {PAIRS}, v AS (SELECT lang, a, b, CASE WHEN a = b THEN 1.0 ELSE ln((nab / n + 1e-12) / (na / n * nb / n)) / -ln(nab / n + 1e-12) END AS v FROM p WHERE na > 0 AND nb > 0), {CONTEXT},
m AS (SELECT lang, AVG(v) FILTER (a <> b) AS c_npmi FROM v GROUP BY 1) SELECT lang, ROUND(c_npmi, 6) AS c_npmi, ROUND(c_v, 6) AS c_v FROM m JOIN k USING (lang) WHERE c_npmi IS NOT NULL""")
def audit_coherence(spark, sf_dir):
    return terms.smoothed_coherence(_pairs(spark, sf_dir), "lang").withColumns({c: F.round(c, 6) for c in ("c_npmi", "c_v")})


@query(f"""WITH {PAIRS}, v AS (SELECT lang, a, b, COALESCE(ln((nab / n + 1e-12) / (GREATEST(na, 1e-12) / n * GREATEST(nb, 1e-12) / n + 1e-12)) / -ln(nab / n + 1e-12), 0) AS v FROM p), {CONTEXT},
m AS (SELECT lang, AVG(v) FILTER (a < b) AS c_npmi FROM v GROUP BY 1) SELECT lang, ROUND(c_npmi, 6) AS c_npmi, ROUND(c_v, 6) AS c_v FROM m JOIN k USING (lang) WHERE c_npmi IS NOT NULL""")
def benchmark_coherence(spark, sf_dir):
    return terms.benchmark_coherence(_pairs(spark, sf_dir), "lang").withColumns({c: F.round(c, 6) for c in ("c_npmi", "c_v")})


@query(f"WITH {PAIRS.split(', u AS')[0]} SELECT ROUND(COUNT(DISTINCT term) / COUNT(*)::DOUBLE, 9) AS diversity FROM t")
def term_diversity(spark, sf_dir):
    docs = texts(spark, sf_dir)
    return terms.diversity(terms.top_terms(docs, "lang", "doc_id", "text")).withColumn("diversity", F.round("diversity", 9))


@query(f"""WITH {PAIRS}, m AS (SELECT lang, AVG({NPMI}) FILTER (a < b) AS c FROM p GROUP BY 1), s AS (SELECT lang, COUNT(*) AS size FROM documents GROUP BY 1)
SELECT ROUND(SUM(c * size) / SUM(size), 6) AS coherence FROM m JOIN s USING (lang) WHERE c IS NOT NULL""")
def weighted_coherence(spark, sf_dir):
    sizes = texts(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("size"))
    return audits.weighted_mean(terms.npmi(_pairs(spark, sf_dir), "lang").join(sizes, "lang"), "coherence", "size").withColumn("coherence", F.round("coherence", 6))


CONTENT = f"len(list_filter(regexp_extract_all(lower(COALESCE(text, '')), '\\p{{L}}+'), lambda w: length(w) >= 3 AND w NOT IN {STOP + T.ACK_WORDS}))"


@query(f"SELECT role, COUNT(*) AS members, ROUND(AVG(CASE WHEN {CONTENT} = 0 THEN 1.0 ELSE 0.0 END), 9) AS ratio FROM conversations GROUP BY 1")
def acknowledgement_ratio(spark, sf_dir):
    return audits.empty_ratio(read(spark, sf_dir, "conversations"), "role", "text", STOP + T.ACK_WORDS).withColumn("ratio", F.round("ratio", 9))


@query(f"""WITH l AS (SELECT event_type AS topic_id, event_type || ' / thanks / ok yes / ' || event_type || ' ok' AS label FROM (SELECT DISTINCT event_type FROM events)),
k AS (SELECT topic_id, list_filter(list_transform(string_split(label, '/'), lambda t: trim(t)), lambda t: t <> '') AS k FROM l)
SELECT topic_id, ROUND(len(list_filter(k, lambda t: len(regexp_extract_all(lower(t), '\\p{{L}}+')) > 0 AND len(list_filter(regexp_extract_all(lower(t), '\\p{{L}}+'), lambda w: w NOT IN {T.ACK_WORDS})) = 0)) / GREATEST(len(k), 1)::DOUBLE, 9) AS ratio FROM k""")
def junk_terms(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("topic_id")).distinct()
    label = F.concat("topic_id", F.lit(" / thanks / ok yes / "), "topic_id", F.lit(" ok"))
    return e.select("topic_id", F.round(T.junk_term_ratio(label), 9).alias("ratio"))


@query(f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'rt 12' WHEN 1 THEN '__email__ via' WHEN 2 THEN lower(p_name) ELSE 'mobile_carexv' END AS term FROM part)
SELECT p_partkey, {NOISY.replace("string_split(term, ' ')", "list_filter(string_split(term, ' '), lambda w: w <> '')")} AS noise FROM t""")
def noise_terms(spark, sf_dir):
    k = F.col("p_partkey") % 4
    term = F.when(k == 0, "rt 12").when(k == 1, "__email__ via").when(k == 2, F.lower("p_name")).otherwise("mobile_carexv")
    return read(spark, sf_dir, "part").select("p_partkey", T.is_noise_term(term).alias("noise"))


@query("""WITH b AS (SELECT *, date_diff('day', (SELECT MIN(CAST(ts AS DATE)) FROM events), CAST(ts AS DATE)) // 7 AS batch FROM events), t AS (SELECT batch, user_id AS topic_id FROM b WHERE value >= 5 GROUP BY 1, 2),
f AS (SELECT topic_id, MIN(batch) AS first FROM t GROUP BY 1), n AS (SELECT t.batch, COUNT(*) AS topics, COUNT(*) FILTER (first = t.batch) AS fresh, COUNT(p.topic_id) AS kept FROM t JOIN f USING (topic_id) LEFT JOIN t p ON p.topic_id = t.topic_id AND p.batch = t.batch - 1 GROUP BY 1),
s AS (SELECT batch, COUNT(*) AS records, ROUND(AVG(CASE WHEN value >= 5 THEN 0.0 ELSE 1.0 END), 9) AS unassigned_share FROM b GROUP BY 1)
SELECT s.batch, records, unassigned_share, COALESCE(topics, 0) AS topics, COALESCE(fresh, 0) AS new_topics, CASE WHEN s.batch > 0 THEN ROUND(kept / GREATEST(q.n, 1)::DOUBLE, 9) END AS retention
FROM s LEFT JOIN n USING (batch) LEFT JOIN (SELECT batch + 1 AS batch, COUNT(*) AS n FROM t GROUP BY 1) q USING (batch)""")
def stream_audit(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    e = e.crossJoin(F.broadcast(e.agg(F.min(F.to_date("ts")).alias("_d"))))  # one row
    rows = e.select(F.floor(F.datediff("ts", "_d") / 7).alias("batch"), "event_id", F.when(F.col("value") >= 5, F.col("user_id")).alias("topic_id"))
    out = audits.stream_audit(rows, "event_id")
    return out.withColumns({c: F.round(c, 9) for c in ("unassigned_share", "retention")})


@query("""WITH s AS (SELECT event_type AS stage, SUM(value) AS seconds FROM events GROUP BY 1), m AS (SELECT * FROM (VALUES ('click', 'read'), ('view', 'read'), ('purchase', 'write')) v(stage, "group"))
SELECT COALESCE("group", 'other') AS "group", ROUND(SUM(seconds), 3) AS seconds FROM s LEFT JOIN m USING (stage) GROUP BY 1""")
def grouped_timing(spark, sf_dir):
    stages = read(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return audits.grouped_timing(stages, {"click": "read", "view": "read", "purchase": "write"}).withColumn("seconds", F.round("seconds", 3))


@query("""WITH f AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND contains(lower(o_orderstatus), 'o'))
SELECT *, (SELECT COUNT(*) FROM f) AS total FROM f ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20""")
def filtered_page(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    out = audits.filtered_page(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], 2, 20, equal={"o_orderpriority": "1-URGENT"}, holds={"o_orderstatus": "O"})
    return out.select("o_orderkey", "o_totalprice", "total")


@query("""WITH n AS (SELECT event_type, COUNT(*) AS n, row_number() OVER (ORDER BY COUNT(*), event_type) AS k, COUNT(*) OVER () AS c FROM events GROUP BY 1),
q AS (WITH RECURSIVE r AS (SELECT 0 AS k, 500::BIGINT AS remaining, NULL::VARCHAR AS event_type, 0::BIGINT AS quota UNION ALL
  SELECT n.k, r.remaining - LEAST(n.n, r.remaining // (n.c - n.k + 1)), n.event_type, LEAST(n.n, r.remaining // (n.c - n.k + 1)) FROM r JOIN n ON n.k = r.k + 1) SELECT event_type, quota FROM r WHERE k > 0),
i AS (SELECT event_type, event_id, quota, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events JOIN q USING (event_type)),
b AS (SELECT *, CASE WHEN i < (n % quota) * (n // quota + 1) THEN i // (n // quota + 1) ELSE n % quota + (i - (n % quota) * (n // quota + 1)) // (n // quota) END AS b FROM i WHERE quota > 0)
SELECT event_type, CAST(b AS BIGINT) AS bucket, MIN(event_id) AS event_id FROM b GROUP BY 1, 2""")
def quota_sample(spark, sf_dir):
    return audits.quota_sample(read(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "event_id", 500)


UNIT = "list_transform(embedding::DOUBLE[], lambda x: x / GREATEST(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12))"


@query(f"""WITH v AS (SELECT vec_id, {UNIT} AS v FROM embeddings), m AS (SELECT p.vec_id, MAX(list_dot_product(p.v, r.v)) AS best FROM v p JOIN v r ON p.vec_id % 4 = 0 AND r.vec_id % 4 <> 0 GROUP BY 1)
SELECT ROUND(AVG(1 - best), 6) AS drift FROM m""")
def manifold_drift(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings")
    return audits.drift(v.where("vec_id % 4 = 0"), v.where("vec_id % 4 != 0"), "vec_id", "embedding").withColumn("drift", F.round("drift", 6))


@query(f"""WITH c AS {CENTRE}, s AS (SELECT list_dot_product(a.centroid, b.centroid) AS s FROM c a JOIN c b ON a.label < b.label)
SELECT COUNT(*) FILTER (s >= .8 AND s < .85) AS weak, COUNT(*) FILTER (s >= .85 AND s < .92) AS middle, COUNT(*) FILTER (s >= .92) AS strong FROM (SELECT s + .9 AS s FROM s)""")
def similarity_bands(spark, sf_dir):
    centres = V.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding").withColumnRenamed("label", "topic_id")
    pairs = matching.topic_pairs(centres, -1.0)
    return matching.similarity_bands(pairs.withColumn("similarity", F.col("similarity") + 0.9))


@query(f"""WITH f AS (SELECT topic_id, MIN(CAST(ts AS DATE)) AS first FROM {EVENTS} GROUP BY 1), e AS (SELECT MIN(CAST(ts AS DATE)) + 3 AS cut FROM events)
SELECT CAST(ts AS DATE) AS date, CASE WHEN first < cut THEN 'established' ELSE 'emerging' END AS kind, COUNT(*) AS records FROM {EVENTS} x JOIN f USING (topic_id), e GROUP BY 1, 2""")
def volume_by_age(spark, sf_dir):
    e = topical(spark, sf_dir)
    return audits.volume_by_age(e, "ts", "topic_id", 3)


@query("""WITH h AS (SELECT event_id, ts, row_number() OVER (ORDER BY ts, event_id) AS r, COUNT(*) OVER () AS n FROM events), c AS (SELECT MIN(ts) AS cut FROM h WHERE r > floor(n * .8))
SELECT event_id, ts >= cut AS holdout FROM events, c""")
def time_holdout(spark, sf_dir):
    return audits.time_holdout(read(spark, sf_dir, "events"), "ts", 0.2).select("event_id", "holdout")


@query("""WITH c AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), r AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS r FROM c)
SELECT event_id, CASE WHEN r = 1 THEN 'holdout' ELSE 'history' END AS part FROM events JOIN r ON d = CAST(ts AS DATE) WHERE r <= 4""")
def chunk_window(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("chunk", F.to_date("ts"))
    return audits.chunk_window(rows, "chunk", 4).select("event_id", "part")
