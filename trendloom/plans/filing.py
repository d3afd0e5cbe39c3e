"""Queries of the incremental matcher, carried state, reviews, prepared sources, caches and
streams over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trendloom.functions import answers, text as T
from trendloom.functions import vectors as V
from trendloom.operators import decisions, matching, registry, reports, review, terms
from trendloom.plans.audits import NPMI, PAIRS
from trendloom.plans.queries import CENTRE, EVENTS, HOT, QUERIES, query, read, texts, topical
from trendloom.sources import embedded, prepared
from trendloom.sources.stored import shared_folder
from trendloom.streaming import centroids, runs


def _scratch(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def by_number(scope, options, posts):
    """A judge that any engine can be: a post's text is a number, which counts off the
    topics offered and the two exits, and is taken for a confidence."""
    out = []
    for text, topics in posts:
        names, n = sorted(topics, key=int), int(text)
        ends = [*names, decisions.OTHER, decisions.NO_ISSUE]
        choice = ends[n % len(ends)]
        chances = {t: 0.5 if i == (n + 1) % len(names) else 0.1 for i, t in enumerate(names)}
        out.append((choice, n % 10 / 10, chances) if n % 29 else None)
    return out


def _filed(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumns({"scope": (F.col("vec_id") % 3).cast("string"), "text": F.col("vec_id").cast("string")})
    topics = V.centroids(read(spark, sf_dir, "embeddings"), "label", "embedding").select(
        F.col("label").alias("topic_id"), "centroid", (F.col("label") % 2).cast("string").alias("scope"), F.concat(F.lit("Topic "), "label").alias("label"),
        F.lit("what it is about").alias("description"), F.array().cast("array<string>").alias("keywords"), (F.col("label") == 4).alias("suppressed"),
    )
    return e, topics


NEAR = f"""c AS (SELECT *, CAST(label % 2 AS VARCHAR) AS scope FROM {CENTRE}), v AS (SELECT vec_id, CAST(vec_id % 3 AS VARCHAR) AS scope, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT vec_id, label AS t, list_dot_product(v, centroid) / GREATEST(sqrt(list_dot_product(v, v)), 1e-12) AS s FROM v JOIN c USING (scope)),
n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, t) AS r FROM p),
b AS (SELECT v.vec_id, COALESCE(MAX(s) FILTER (r = 1), -1) AS best, COALESCE(MAX(s) FILTER (r = 2), -1) AS second FROM v LEFT JOIN n USING (vec_id) GROUP BY 1),
g AS (SELECT *, CASE WHEN best = -1 THEN 'none' WHEN best >= .5 AND best - second >= .05 THEN 'clear' WHEN best < .3 AND NOT (best >= .5 AND best - second >= .05) THEN 'miss' ELSE 'ask' END AS gate FROM b),
o AS (SELECT vec_id, list(t ORDER BY t) AS o FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, t) AS e FROM p WHERE t <> 4) WHERE e <= 12 GROUP BY 1)"""


@query(f"WITH {NEAR} SELECT g.vec_id, gate, ROUND(best, 6) AS best, CAST(COALESCE(len(o), 0) AS INT) AS offered FROM g LEFT JOIN o USING (vec_id)")
def filing_gates(spark, sf_dir):
    e, topics = _filed(spark, sf_dir)
    gated, short = decisions.gates(e, topics, "vec_id", "embedding", "scope")
    offered = short.groupBy("vec_id").agg(F.count("*").cast("int").alias("offered"))
    return gated.join(offered, "vec_id", "left").select("vec_id", "gate", F.round("best", 6).alias("best"), F.coalesce("offered", F.lit(0)).alias("offered"))


@query(f"""WITH {NEAR}, a AS (SELECT g.vec_id, best, o, len(o) AS m, vec_id % 29 = 0 AS mute, vec_id % (len(o) + 2) AS pick, vec_id % 10 / 10.0 AS sure, (vec_id + 1) % len(o) AS next FROM g JOIN o USING (vec_id) WHERE gate = 'ask'),
x AS (SELECT vec_id, t, s, 'EXISTING' AS k, NULL::DOUBLE AS c, r AS place FROM n JOIN g USING (vec_id) WHERE gate = 'clear' AND r <= 2 AND s >= .25
  UNION ALL SELECT vec_id, t, s, 'EXISTING_FALLBACK', NULL, r FROM n JOIN a USING (vec_id) WHERE mute AND r <= 2 AND s >= .25
  UNION ALL SELECT vec_id, NULL, best, CASE WHEN pick = m THEN 'DECIDED_OTHER' WHEN pick = m + 1 THEN 'DECIDED_NO_ISSUE' ELSE 'DECIDED_UNSURE' END, sure, 1 FROM a WHERE NOT mute AND (pick >= m OR sure < .5)
  UNION ALL SELECT a.vec_id, p.t, p.s, 'DECIDED', sure, 1 FROM a JOIN p ON p.vec_id = a.vec_id AND p.t = o[pick + 1] WHERE NOT mute AND pick < m AND sure >= .5
  UNION ALL SELECT a.vec_id, p.t, p.s, 'DECIDED', .5, 2 FROM a JOIN p ON p.vec_id = a.vec_id AND p.t = o[next + 1] WHERE NOT mute AND pick < m AND sure >= .5 AND next <> pick)
SELECT vec_id, t AS topic_id, ROUND(s, 6) AS similarity, k AS assignment_type, c AS confidence, place = 1 AS "primary" FROM x
UNION ALL SELECT vec_id, NULL, ROUND(best, 6), 'UNASSIGNED', NULL, TRUE FROM g WHERE vec_id NOT IN (SELECT vec_id FROM x)""")
def filed_segments(spark, sf_dir):
    e, topics = _filed(spark, sf_dir)
    out = decisions.assign_incremental(e, topics, "vec_id", "embedding", "scope", "text", lambda: by_number)
    return out.withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH p AS (SELECT event_id AS segment_id, topic_id, ROUND(value, 3) AS similarity FROM {EVENTS} WHERE event_id % 5 <> 0),
m AS (SELECT DISTINCT topic_id, CAST(split_part(topic_id, '-', 2) AS INT) AS n, split_part(topic_id, '-', 1) AS k FROM {EVENTS}),
r AS (SELECT topic_id, CASE WHEN n IN (1, 2) THEN k || '-3' ELSE topic_id END AS into_id, n FROM m),
l AS (SELECT DISTINCT segment_id, into_id AS topic_id, similarity FROM p JOIN r USING (topic_id) WHERE n <> 7)
SELECT segment_id, topic_id, similarity, 'EXISTING' AS assignment_type FROM l
UNION ALL SELECT segment_id, NULL, NULL, 'UNASSIGNED' FROM p WHERE segment_id NOT IN (SELECT segment_id FROM l)""")
def carried_decisions(spark, sf_dir):
    """Topics n 1 went into 2 and then 2 into 3, of each kind; those of n 7 are gone."""
    e = topical(spark, sf_dir).withColumnRenamed("event_id", "segment_id")
    previous = e.where("segment_id % 5 != 0").select("segment_id", "topic_id", F.round("value", 3).alias("similarity"), F.lit("EXISTING").alias("assignment_type"))
    kinds = e.select(F.split("topic_id", "-")[0].alias("k")).distinct()
    step = lambda a, b: kinds.select(F.concat("k", F.lit(f"-{a}")).alias("topic_id"), F.concat("k", F.lit(f"-{b}")).alias("into_id"))
    topics = e.select("topic_id").distinct().unionByName(step(1, 3).select(F.col("into_id").alias("topic_id"))).where(~F.col("topic_id").rlike("-7$"))
    return registry.carry_decisions(e, previous, topics, step(1, 2).unionByName(step(2, 3)))[0]


@query(f"""WITH o AS {CENTRE.replace("FROM embeddings", "FROM (SELECT * FROM embeddings WHERE vec_id % 2 = 0) e")}, w AS (SELECT label, COUNT(*) AS w FROM embeddings WHERE vec_id % 2 = 0 GROUP BY 1), i AS (SELECT UNNEST(generate_series(1, 64)) AS i),
u AS (SELECT label, i, SUM(embedding[i]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS x FROM embeddings, i WHERE vec_id % 2 = 1 AND label <> 3 GROUP BY 1, 2),
x AS (SELECT o.label, i.i, o.centroid[i.i] * w + COALESCE(u.x, 0) AS x FROM o JOIN w USING (label) CROSS JOIN i LEFT JOIN u ON u.label = o.label AND u.i = i.i), m AS (SELECT label, sqrt(SUM(x * x)) AS m FROM x GROUP BY 1),
s AS (SELECT label, SUM(x / m * centroid[i]) AS s FROM x JOIN m USING (label) JOIN o USING (label) GROUP BY 1)
SELECT x.label AS topic_id, CASE WHEN s < .9 AND x.label <> 3 THEN 'llm_stale' ELSE 'llm_carried' END AS label_source, CAST(i - 1 AS INT) AS pos, ROUND(x / m, 6) AS x FROM x JOIN m USING (label) JOIN s USING (label)""")
def updated_centroids(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    old = V.centroids(e.where("vec_id % 2 = 0"), "label", "embedding").select(F.col("label").alias("topic_id"), "centroid", F.col("size").alias("previous_size"), F.lit("llm_carried").alias("label_source"))
    new = e.where("vec_id % 2 = 1 and label != 3").select(F.col("label").alias("topic_id"), "embedding")
    out = registry.update_centroids(old, new, "embedding", 0.9)
    return out.select("topic_id", "label_source", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


RAW = """(SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS tweet_id, CASE WHEN role = 'assistant' THEN 'Shop' || (conv_id % 3) ELSE CAST(conv_id AS VARCHAR) END AS author_id, role <> 'assistant' AS inbound,
  CASE WHEN turn = 0 AND conv_id % 4 = 0 THEN 'hello @nobody and @Shop' || ((conv_id + 1) % 3) || ' ' ELSE '' END || 'turn' AS text, conv_id, turn,
  LAG(CASE WHEN role = 'assistant' THEN 'Shop' || (conv_id % 3) END) OVER w AS asked, LEAD(CASE WHEN role = 'assistant' THEN 'Shop' || (conv_id % 3) END) OVER w AS answered FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query(f"""SELECT tweet_id, CASE WHEN text LIKE '%@Shop%' THEN regexp_extract(text, '@(Shop[0-9])', 1) ELSE COALESCE(asked, answered) END AS brand FROM {RAW} WHERE inbound""")
def resolved_brands(spark, sf_dir):
    from pyspark.sql import Window

    c = read(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    name = lambda turn: (F.col("conv_id") * 100 + turn).cast("string")
    shop = lambda n: F.concat(F.lit("Shop"), (n % 3).cast("string"))
    helper = F.col("role") == "assistant"
    hello = F.when((F.col("turn") == 0) & (F.col("conv_id") % 4 == 0), F.concat(F.lit("hello @nobody and @"), shop(F.col("conv_id") + 1), F.lit(" "))).otherwise("")
    after = F.lead("turn").over(order)
    raw = c.select(
        name(F.col("turn")).alias("tweet_id"), F.when(helper, shop(F.col("conv_id"))).otherwise(F.col("conv_id").cast("string")).alias("author_id"), F.when(helper, "False").otherwise(" True").alias("inbound"),
        F.concat(hello, F.lit("turn")).alias("text"), F.coalesce(F.concat(name(after), F.lit(",999999999")), F.lit("")).alias("response_tweet_id"), F.coalesce(name(F.lag("turn").over(order)), F.lit("")).alias("in_response_to_tweet_id"),
    )
    return prepared.resolve_brand(raw).select("tweet_id", "brand")


@query(f"WITH {PAIRS.replace('FROM documents), d AS', 'FROM documents WHERE doc_id % 2 = 1), d AS', 1)} SELECT lang, ROUND(AVG({NPMI}) FILTER (a < b), 6) AS coherence FROM p GROUP BY 1")
def reference_coherence(spark, sf_dir):
    """Terms of the odd documents, over these and the even ones: counts of the even ones are
    added to those of the odd ones."""
    docs = texts(spark, sf_dir)
    window, reference = docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0")
    top = terms.top_terms(window, "lang", "doc_id", "text").select("lang", "term")
    count = lambda rows: terms.pair_counts(rows, top, "lang", "doc_id", "text")
    return terms.npmi(terms.add_counts(count(window), count(reference), "lang"), "lang").withColumn("coherence", F.round("coherence", 6))


@query("""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'Late parcels' WHEN 1 THEN 'plain text' WHEN 2 THEN NULL WHEN 3 THEN 'Late parcels' WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN 'second' WHEN 7 THEN 'Late parcels' ELSE NULL END AS label,
  CASE WHEN event_id % 9 = 0 THEN 'about them' END AS description, CASE event_id % 9 WHEN 0 THEN event_id % 2 = 0 END AS is_substantive,
  CASE event_id % 9 WHEN 0 THEN LEAST(event_id % 4 / 2.0, 1.0) WHEN 3 THEN 0.0 WHEN 7 THEN 0.25 END AS confidence, event_id % 9 IN (0, 3, 6, 7, 8) AS has_object FROM events""")
def parsed_answers(spark, sf_dir):
    n = F.col("event_id")
    wrap = lambda items: F.concat(F.lit('{"result": {"documents": [{"output": [{"key": "reasoning", "value": {"label": "no"}}'), items, F.lit("]}]}}"))
    item = lambda v: F.concat(F.lit(', {"key": "answer", "value": '), v, F.lit("}"))
    inner = F.concat(F.lit('{"label": " Late parcels.", "description": "about them ", "is_substantive": '), F.when(n % 2 == 0, "true").otherwise("false"), F.lit(', "confidence": '), (n % 4 / 2).cast("string"), F.lit("}"))
    body = (
        F.when(n % 9 == 0, wrap(item(inner))).when(n % 9 == 1, wrap(item(F.lit('"plain text."')))).when(n % 9 == 2, wrap(F.lit("")))
        .when(n % 9 == 3, wrap(item(F.lit('"{\\"label\\": \\"Late parcels\\", \\"confidence\\": -3, \\"is_substantive\\": \\"yes\\"}"'))))
        .when(n % 9 == 4, F.lit('{"result": {"documents": [{"out')).when(n % 9 == 5, F.lit(None)).when(n % 9 == 6, wrap(F.concat(item(F.lit("7")), item(F.lit('{"label": "second", "confidence": "high"}')))))
        .when(n % 9 == 7, wrap(item(F.lit('{"label": "Late parcels", "confidence": "0.25"}')))).otherwise(wrap(item(F.lit('{"other": 1}'))))
    )
    rows = read(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return rows.select("event_id", answers.label_answer(F.col("body")).alias("a"), answers.answer_object(F.col("body")).isNotNull().alias("has_object")).select("event_id", "a.*", "has_object")


def _reviewed(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    names = read(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("topic_id"), F.col("p_name").alias("label"))
    lv = V.centroids(e.where("vec_id % 2 = 0"), "label", "embedding").select(F.col("label").alias("topic_id"), F.col("centroid").alias("label_vector"))
    topics = V.centroids(e, "label", "embedding").withColumnRenamed("label", "topic_id").join(names, "topic_id").join(lv, "topic_id").withColumn("scope", F.col("topic_id") % 2)
    more = e.where("vec_id % 3 = 0").select((F.col("label") + 2).alias("topic_id"), "vec_id")
    return topics, e.select(F.col("label").alias("topic_id"), "vec_id").unionByName(more)


WORDS_OF = f"list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: w NOT IN {T.LABEL_FILLERS}))"
TOPICS = f"""t AS (SELECT c.label AS id, c.label % 2 AS scope, c.centroid, l.centroid AS lv, {WORDS_OF} AS w FROM {CENTRE} c JOIN part ON p_partkey = c.label + 1 JOIN {CENTRE.replace("FROM embeddings", "FROM (SELECT * FROM embeddings WHERE vec_id % 2 = 0) e")} l ON l.label = c.label),
p AS (SELECT a.scope, a.id AS a, b.id AS b, list_dot_product(a.centroid, b.centroid) AS s, len(list_intersect(a.w, b.w)) / GREATEST(len(list_distinct(list_concat(a.w, b.w))), 1)::DOUBLE AS words, list_sort(a.w) = list_sort(b.w) AS same, list_dot_product(a.lv, b.lv) AS ls FROM t a JOIN t b ON a.scope = b.scope AND a.id < b.id)"""


@query(f"""WITH {TOPICS}, m AS (SELECT DISTINCT label AS id, vec_id FROM embeddings UNION SELECT label + 2, vec_id FROM embeddings WHERE vec_id % 3 = 0), z AS (SELECT id, COUNT(*) AS n FROM m GROUP BY 1),
k AS (SELECT x.id AS a, y.id AS b, COUNT(*) AS n FROM m x JOIN m y ON x.vec_id = y.vec_id AND x.id < y.id GROUP BY 1, 2)
SELECT p.a, p.b, ROUND(s, 6) AS similarity, ROUND(COALESCE(k.n / LEAST(u.n, v.n)::DOUBLE, 0), 6) AS containment, ROUND(words, 6) AS words, ROUND(ls, 6) AS label_similarity FROM p LEFT JOIN k ON k.a = p.a AND k.b = p.b
JOIN z u ON u.id = p.a JOIN z v ON v.id = p.b WHERE s >= -.3 AND (COALESCE(k.n / LEAST(u.n, v.n)::DOUBLE, 0) >= .25 OR words >= .5 OR ls >= .8) ORDER BY s DESC, p.a, p.b LIMIT 12""")
def review_evidence(spark, sf_dir):
    topics, members = _reviewed(spark, sf_dir)
    out = review.review_pairs(topics, members, "scope", "vec_id", -0.3, 12)
    return out.withColumns({c: F.round(c, 6) for c in ("similarity", "containment", "words", "label_similarity")})


@query(f"""WITH RECURSIVE {TOPICS}, c AS (SELECT scope, a, b, GREATEST(ls, CASE WHEN same THEN 1.0 ELSE 0.0 END) AS k FROM p WHERE same OR ls >= -.05), q AS (SELECT *, row_number() OVER (ORDER BY k DESC, a, b) AS i FROM c),
g(i, used, scope, a, b, k, took) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, FALSE UNION ALL
  SELECT x.i, CASE WHEN ok THEN list_concat(used, [x.a, x.b]) ELSE used END, x.scope, x.a, x.b, x.k, ok FROM (SELECT g.used, q.*, NOT list_contains(g.used, q.a) AND NOT list_contains(g.used, q.b) AS ok FROM g JOIN q ON q.i = g.i + 1) x)
SELECT CAST(scope AS INT) AS scope, CAST(a AS INT) AS a, CAST(b AS INT) AS b, ROUND(k, 6) AS likeness FROM g WHERE took""")
def colliding_labels(spark, sf_dir):
    topics, _ = _reviewed(spark, sf_dir)
    return review.colliding_pairs(topics, "scope", -0.05).withColumn("likeness", F.round("likeness", 6))


@query("SELECT doc_id, length(COALESCE(text, ''))::FLOAT AS x, (length(COALESCE(text, '')) - length(replace(COALESCE(text, ''), 'a', '')))::FLOAT AS y FROM documents")
def embedded_texts(spark, sf_dir):
    """Half of the documents, then all of them, against one cache."""
    store, docs = _scratch(spark, "embedded"), read(spark, sf_dir, "documents").select("doc_id", "text")
    encode = lambda texts: [[len(t), t.count("a")] for t in texts]
    embedded.embed(docs.where("doc_id % 2 = 0"), "text", encode, store, "letters")
    out, _ = embedded.embed(docs, "text", encode, store, "letters")
    return out.select("doc_id", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


def _event_stream(spark, sf_dir, files: int = 4):
    """Events as a stream of files, in the order of their time."""
    folder = _scratch(spark, "chunks")
    e = topical(spark, sf_dir).select("event_id", "topic_id", "event_type", F.array(F.lit(1.0), F.col("value"), F.col("user_id").cast("double")).alias("v"), F.col("ts").cast("timestamp").alias("ts"))
    e.repartitionByRange(files, "ts").write.parquet(folder)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query(f"""WITH u AS (SELECT topic_id, ts, [1.0, value, user_id::DOUBLE] AS v, sqrt(1 + value * value + user_id * user_id) AS m FROM {EVENTS}), s AS (SELECT topic_id, SUM(v[1] / m) AS a, SUM(v[2] / m) AS b, SUM(v[3] / m) AS c, COUNT(*) AS size, MAX(ts) AS last_seen FROM u GROUP BY 1)
SELECT topic_id AS topic, size, last_seen, ROUND(a / sqrt(a * a + b * b + c * c), 6) AS x, ROUND(b / sqrt(a * a + b * b + c * c), 6) AS y FROM s""")
def streamed_centroids(spark, sf_dir):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", centroids.PROVIDER)
    out = _scratch(spark, "centroids")
    stream = centroids.running_centroids(_event_stream(spark, sf_dir), "topic_id", "v", "ts", late="60 days")
    keep = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", _scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).groupBy("topic").agg(F.max_by(F.struct("size", "last_seen", "centroid"), F.struct("batch", "size")).alias("r"))
    return rows.select("topic", "r.size", F.col("r.last_seen").cast("timestamp_ntz").alias("last_seen"), F.round(F.col("r.centroid")[0], 6).alias("x"), F.round(F.col("r.centroid")[1], 6).alias("y"))


@query(f"SELECT topic_id, COUNT(DISTINCT event_id) AS size, CAST(MIN(ts) AS TIMESTAMP) AS first_seen FROM {EVENTS} GROUP BY 1")
def streamed_registry(spark, sf_dir):
    """The registry after four chunks, each of which adds its records to what the one before
    left; every record comes twice."""
    stream = _event_stream(spark, sf_dir)
    fresh = runs.fresh_records(stream.unionByName(stream), "event_id", "ts", late="60 days")
    tables = runs.Handover(spark, _scratch(spark, "handover"), {"registry": "topic_id string, size long, first_seen timestamp"})

    def step(batch, before, number):
        new = batch.groupBy("topic_id").agg(F.count("*").alias("size"), F.min("ts").alias("first_seen"))
        return {"registry": before["registry"].unionByName(new).groupBy("topic_id").agg(F.sum("size").alias("size"), F.min("first_seen").alias("first_seen"))}

    runs.run_chunks(fresh, tables, step, _scratch(spark, "progress")).awaitTermination()
    return tables.read("registry").withColumn("first_seen", F.col("first_seen").cast("timestamp_ntz"))


@query(f"""WITH h AS ({HOT}) SELECT DISTINCT e.topic_id, e.kind, h.hot_score, h.status, h.recent_volume FROM (SELECT topic_id, event_type AS kind FROM {EVENTS}) e LEFT JOIN h USING (topic_id)""")
def hot_report(spark, sf_dir):
    topics = topical(spark, sf_dir).select("topic_id", F.col("event_type").alias("kind")).distinct()
    return registry.with_metrics(topics, QUERIES["hot_scores"](spark, sf_dir)).select("topic_id", "kind", "hot_score", "status", "recent_volume")


@query("""WITH d AS (SELECT *, doc_id % 7 || '-' || lang AS t FROM documents), m AS (SELECT t, i, AVG(v) AS m FROM (SELECT t, i, list_extract([1.0, n_chars / 1000.0, doc_id % 5], i) / sqrt(1 + (n_chars / 1000.0) * (n_chars / 1000.0) + (doc_id % 5) * (doc_id % 5)) AS v FROM d, (SELECT UNNEST([1, 2, 3]) AS i)) GROUP BY 1, 2),
n AS (SELECT t, sqrt(SUM(m * m)) AS n FROM m GROUP BY 1), s AS (SELECT t, COUNT(DISTINCT source) AS size, MIN(doc_id) AS first_seen, MAX(doc_id) AS last_seen FROM d GROUP BY 1)
SELECT t AS topic, size, first_seen, last_seen, CAST(i - 1 AS INT) AS pos, ROUND(m / n, 6) AS x FROM m JOIN n USING (t) JOIN s USING (t)""")
def made_topics(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    v = F.array(F.lit(1.0), F.col("n_chars") / 1000, (F.col("doc_id") % 5).cast("double"))
    rows = d.select(F.concat_ws("-", F.col("doc_id") % 7, "lang").alias("topic"), "source", V.unit(v).alias("v"), "doc_id")
    out = registry.make_topics(rows, "topic", "source", "v", "doc_id")
    return out.select("topic", "size", "first_seen", "last_seen", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH h AS ({HOT}), e AS (SELECT quantile_cont(growth_rate, .98) AS e FROM h) SELECT topic_id, recent_volume, ROUND(LEAST(growth_rate, e), 6) AS growth FROM h, e")
def growth_map(spark, sf_dir):
    return reports.growth_map(QUERIES["hot_scores"](spark, sf_dir)).withColumn("growth", F.round("growth", 6))


@query("""WITH c AS (SELECT event_type AS x, user_id % 6 AS y, COUNT(*)::DOUBLE AS n FROM events GROUP BY 1, 2), t AS (SELECT SUM(n) AS t FROM c), a AS (SELECT x, SUM(n) AS s FROM c GROUP BY 1), b AS (SELECT y, SUM(n) AS s FROM c GROUP BY 1),
m AS (SELECT SUM(n / t * ln(n * t / (a.s * b.s))) AS m FROM c JOIN a USING (x) JOIN b USING (y), t), hx AS (SELECT -SUM(s / t * ln(s / t)) AS h FROM a, t), hy AS (SELECT -SUM(s / t * ln(s / t)) AS h FROM b, t),
k AS (SELECT a.s AS x, b.s AS y, t, UNNEST(generate_series(GREATEST(1, (a.s + b.s - t)::BIGINT), LEAST(a.s, b.s)::BIGINT))::DOUBLE AS k FROM a, b, t),
e AS (SELECT SUM(k / t * ln(t * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t - x - y + k + 1))) AS e FROM k)
SELECT ROUND((m - e) / ((hx.h + hy.h) / 2 - e), 6) AS ami FROM m, hx, hy, e""")
def clustering_information(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("y", F.col("user_id") % 6)
    return matching.adjusted_information(e, "event_type", "y").withColumn("ami", F.round("ami", 6))
