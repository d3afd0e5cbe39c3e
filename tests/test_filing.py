"""Assignment at every size, decisions, carried state, caches and streams on small fixtures."""

import html
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions import answers
from trendloom.functions import text as T
from trendloom.operators import audits, decisions, matching, records, registry, reports, review
from trendloom.sources import embedded, prepared
from trendloom.streaming import centroids, runs


def vectors(n, seed=0, width=6):
    v = np.random.default_rng(seed).normal(size=(n, width))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def rows_of(df):
    return sorted((r["id"], r["topic_id"] is None, r["topic_id"] or 0, round(r["similarity"], 9), r["rank"], r["assignment_type"]) for r in df.collect())


@pytest.mark.parametrize("scope", [None, "scope"])
@pytest.mark.parametrize("k", [1, 3, 20])
def test_both_ways_of_assigning_are_one_rule(spark, monkeypatch, scope, k):
    """Repeated ids, ties, null vectors, scopes with pools and without topics."""
    v, t = vectors(60), vectors(25, 1)
    t[7] = t[3]
    data = [(i % 50, None if i == 5 else v[i].tolist(), str(i % 5)) for i in range(60)] + [(70, t[3].tolist(), "1"), (71, t[3].tolist(), None)]
    segments = spark.createDataFrame(data, "id long, v array<double>, scope string").repartition(4)
    topics = spark.createDataFrame([(j, t[j].tolist(), ["0", "1", "__POOL__"][j % 3]) for j in range(25)], "topic_id long, centroid array<double>, scope string")
    run = lambda: rows_of(matching.assign_topics(segments, topics, "id", "v", 0.3, k=k, margin=0.3, scope=scope))
    sent = run()
    monkeypatch.setattr(matching, "SENT_BYTES", 300)
    monkeypatch.setattr(matching, "PIECE_ROWS", 10)
    assert run() == sent
    assert len({r[0] for r in sent}) == len({d[0] for d in data})
    # Against the rule itself.
    want = []
    for i, x, s in data:
        seen = [j for j in range(25) if not scope or ["0", "1", "__POOL__"][j % 3] == (s if s in ("0", "1") else "__POOL__")]
        sims = sorted(((-float(np.dot(x, t[j]) / np.linalg.norm(x)), j) for j in seen), key=lambda p: (round(p[0], 12), p[1]))[:k] if x else []
        kept = [(j, -s_) for s_, j in sims if -s_ >= 0.3 and -s_ >= -sims[0][0] - 0.3]
        want += [(i, False, j, round(s_, 9), r + 1, "EXISTING") for r, (j, s_) in enumerate(kept)] or [(i, True, 0, round(-sims[0][0], 9) if sims else -1.0, 1, "UNASSIGNED")]
    assert sent == sorted(want)
    assert rows_of(matching.assign_topics(segments, topics.limit(0), "id", "v", 0.3)) == sorted((i, True, 0, -1.0, 1, "UNASSIGNED") for i, _, _ in data)


def test_greedy_needs_the_lead(spark):
    pairs = spark.createDataFrame([("s", 1, 10, 0.95), ("s", 1, 11, 0.2), ("s", 2, 10, 0.90), ("s", 2, 11, 0.60)], "scope string, new_id long, old_id long, similarity double")
    found = lambda margin: [(r.new_id, r.old_id) for r in registry.match_greedy(pairs, "scope", 0.5, margin).orderBy("new_id").collect()]
    assert found(0.1) == [(1, 10)] and found(0.0) == [(1, 10), (2, 11)]


def test_merges_of_equal_sizes_and_dominant_records(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9)], "a long, b long, similarity double")
    topics = spark.createDataFrame([(1, "x", 5, False), (2, "x", 5, False)], "topic_id long, scope string, size long, protected boolean")
    assert [(r.topic_id, r.into_id) for r in registry.plan_merges(pairs, topics, "scope", 0.5).collect()] == [(1, 2)]
    members = spark.createDataFrame([(1, "a", 7)] * 5 + [(1, "b", 8), (1, "b", 9)], "topic_id long, scope string, record long")
    twice = spark.createDataFrame([(1, "a", 3), (1, "b", 2)], "topic_id long, scope string, size long")
    assert [r.scope for r in registry.dedupe_ids(twice, members, "scope", "record").collect()] == ["b"]


def test_long_texts_are_packed_in_linear_time(spark):
    import time

    one = " ".join(f"Sentence number {i} has a few words{'!' if i % 3 else '.'}" for i in range(20_000))
    took = []
    for text in (one, one + " " + one):
        rows = spark.createDataFrame([(text,)], "t string").select(T.packed_chunks(F.col("t")).alias("c"))
        rows.collect()
        began = time.perf_counter()
        chunks = rows.first()["c"]
        took.append(time.perf_counter() - began)
        assert " ".join(chunks) == text and all(len(c) <= 450 for c in chunks) and all(len(a) + 1 + len(b.split("number")[0]) <= 900 for a, b in zip(chunks, chunks[1:]))
    assert took[1] < 4 * took[0] + 1 and took[1] < 8


def test_rows_are_numbered_by_ranges(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b" if i % 2 else None, i * 7 % 101) for i in range(500)], "id long, s string, x long")
    got = records.numbered(rows, ["x", "id"], "s").collect()
    want: dict = {}
    for r in sorted(rows.collect(), key=lambda r: (r.x, r.id)):
        want.setdefault(r.s, []).append(r.id)
    assert len(got) == 500 and all(want[r.s][r["_i"]] == r.id and r["_n"] == len(want[r.s]) for r in got)
    sizes = [r["count"] for r in records.equal_chunks(rows, ["x", "id"], 7).groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [71] * 6 + [74]
    assert audits.quota_sample(rows.where("s is not null"), "s", ["x", "id"], "id", 20).count() == 20


def test_recall_counts_assigned_records(spark):
    assigned = spark.createDataFrame([(1, "t"), (2, "t"), (3, "u"), (4, None)], "record long, topic_id string").withColumn("at", F.timestamp_micros(F.col("record") * 86_400_000_000))
    hits = spark.createDataFrame([("e", 1), ("e", 2), ("e", 3), ("e", 4), ("f", 4)], "event string, record long")
    onsets = spark.createDataFrame([("e", 0), ("g", 0)], "event string, m long").select("event", F.timestamp_micros("m").alias("onset"))
    flags = spark.createDataFrame([("t", True, False)], "topic_id string, is_junk boolean, residual_cluster boolean")
    got = {r.event: r for r in reports.event_recall(assigned, hits, "record", time="at", onsets=onsets, topics=flags).collect()}
    e = got["e"]
    assert (e.found, e.matched_records, e.topic_id, e.topics_spanned, e.topics_for_share, e.lag_days, e.is_junk) == (True, 3, "t", 2, 2, 1.0, True)
    assert abs(e.recall_in_best_topic - 2 / 3) < 1e-12
    assert [(got[k].found, got[k].matched_records, got[k].topic_id) for k in "fg"] == [(False, 0, None)] * 2


def asked(spark, n=200, scopes=3, wide=12):
    rng = np.random.default_rng(3)
    rows = [(i, f"s{i % scopes}", str(i), {str(t): f"option {t}" for t in sorted(rng.choice(60, size=wide, replace=False).tolist())}) for i in range(n)]
    return spark.createDataFrame(rows, "id long, scope string, text string, options map<string,string>")


def test_calls_are_bounded(spark):
    calls = decisions.packs(asked(spark), "id").collect()
    assert sorted(p["key"] for c in calls for p in c["posts"]) == list(range(200))
    for c in calls:
        assert 1 <= len(c["posts"]) <= 20 and len(c["options"]) <= 40
        assert set(c["options"]) == {t for p in c["posts"] for t in p["topics"]} and {p["key"] % 3 for p in c["posts"]} == {int(c["scope"][1])}
    # One question with more options than a call may have is a call of its own.
    wide = decisions.packs(asked(spark, 4, 1, 50), "id").collect()
    assert all(len(c["posts"]) == 1 and len(c["options"]) == 50 for c in wide)


def test_unanswered_questions_fail_the_batch(spark):
    calls = decisions.packs(asked(spark), "id")

    def client(missing):
        def call(scope, options, posts):
            out = [("nothing offered" if int(t) < missing else decisions.OTHER, 2.0, {}) for t, _ in posts]
            return out[: len(out)]

        return lambda: call

    good = decisions.decide(calls, "id", client(10)).collect()
    assert len(good) == 200 and sum(r.choice is None for r in good) == 10 and {r.confidence for r in good if r.choice} == {1.0}
    with pytest.raises(RuntimeError, match="11 of 200"):
        decisions.decide(calls, "id", client(11))

    def broken(scope, options, posts):
        raise OSError("no answer")

    with pytest.raises(RuntimeError, match="200 of 200"):
        decisions.decide(calls, "id", lambda: broken)
    assert decisions.decide(calls.limit(0), "id", lambda: broken).count() == 0


def test_options_are_short(spark):
    rows = spark.createDataFrame([("Late parcels", " they come  days late and nobody answers the phone at all ever ", []), ("Refunds", None, ["money", "back"]), ("Plain", "", None)], "label string, description string, keywords array<string>")
    got = [r[0] for r in rows.select(decisions.option_words()).collect()]
    assert got == ["Late parcels: they come days late and nobody answers the phone", "Refunds: money back", "Plain"]


def test_decisions_are_carried_along_chains(spark):
    history = spark.createDataFrame([(i,) for i in range(1, 8)], "segment_id long")
    previous = spark.createDataFrame([(1, "A", 0.9), (1, "B", 0.8), (2, "A", 0.7), (3, "gone", 0.6), (4, None, 0.1), (5, "D", 0.5), (9, "A", 0.9)], "segment_id long, topic_id string, similarity double").withColumn("assignment_type", F.lit("EXISTING"))
    topics = spark.createDataFrame([("C",), ("D",)], "topic_id string")
    plan = spark.createDataFrame([("A", "B"), ("B", "C")], "topic_id string, into_id string")
    rows, new = registry.carry_decisions(history, previous, topics, plan)
    assert sorted((r.segment_id, r.topic_id, r.similarity, r.assignment_type) for r in rows.collect()) == [
        (1, "C", 0.9, "EXISTING"), (2, "C", 0.7, "EXISTING"), (3, None, None, "UNASSIGNED"), (4, None, None, "UNASSIGNED"), (5, "D", 0.5, "EXISTING"),
    ]
    assert sorted(r.segment_id for r in new.collect()) == [6, 7]
    circle = spark.createDataFrame([("A", "B"), ("B", "A"), ("x", "y")], "topic_id string, into_id string")
    assert [(r.topic_id, r.into_id) for r in registry.final_targets(circle).collect()] == [("x", "y")]


def test_reviews(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long")
    given = spark.createDataFrame([(1, 2, "SAME", 0.9), (3, 4, "same", 0.3)], "a long, b long, decision string, confidence double")
    got = {r.a: (r.decision, r.merge) for r in review.judged_pairs(pairs, given, 0.7).collect()}
    assert got == {1: ("same", True), 3: ("same", False), 5: ("error", False)}
    topics = spark.createDataFrame([(i, f"old {i}") for i in range(1, 7)], "topic_id long, label string")
    names = spark.createDataFrame([(1, 2, "Late parcels.", "Lost parcels"), (3, 4, "Same", "same."), (5, 6, "One", None)], "a long, b long, label_a string, label_b string")
    new = {r.topic_id: r.label for r in review.renamed(topics, pairs, names).collect()}
    assert new == {1: "Late parcels", 2: "Lost parcels", **{i: f"old {i}" for i in range(3, 7)}}
    rows = spark.createDataFrame([(1, "A", "llm_carried", 3), (2, "Unclear topic", "llm_carried", 3), (3, "B", "terms", 3), (4, "C", "terms", 0)], "topic_id long, label string, label_source string, size long")
    assert [r.ask for r in review.to_name(rows).orderBy("topic_id").collect()] == [False, True, True, False]
    told = spark.createDataFrame([(1, "X", True, 0.9), (2, "Y", True, 0.1), (3, "Z", None, None)], "topic_id long, label string, substantive boolean, confidence double")
    out = {r.topic_id: (r.label, r.label_source, r.substantive) for r in review.named(rows, told, 0.5).collect()}
    assert out == {1: ("X", "llm", True), 2: ("Unclear topic", "llm", None), 3: ("Z", "llm", None), 4: ("C", "terms", None)}


def test_merges_by_labels(spark):
    v = [1.0, 0.0]
    rows = [(1, "x", v, "Flight delays and cancellations", [1.0, 0.0]), (2, "x", v, "cancellations, flight delays", [0.9, 0.1]), (3, "x", v, "Lost bags", [0.0, 1.0]), (4, "y", v, "Flight delays cancellations", v), (5, "x", v, "Unclear topic", v)]
    topics = spark.createDataFrame(rows, "topic_id long, scope string, centroid array<double>, label string, label_vector array<double>")
    assert [(r.a, r.b, r.similarity) for r in review.semantic_merges(topics, "scope", 0.5, None).collect()] == [(1, 2, 2.0)]
    assert [(r.a, r.b) for r in review.semantic_merges(topics, "scope", 0.5, 0.9).collect()] == [(1, 2)]


def test_broken_answers(spark):
    wrap = lambda *items: json.dumps({"result": {"documents": [{"output": list(items)}]}})
    bodies = [
        None, "", "{", "[]", "{}", json.dumps({"result": None}), json.dumps({"result": {"documents": [{}]}}), wrap("text", 3, None), wrap({"key": "reasoning", "value": {"label": "no"}}),
        wrap({"key": "a", "value": {"label": "Yes..", "is_substantive": 1, "confidence": 7}}), wrap({"key": "a", "value": "{broken"}, {"key": "b", "value": {"label": "second"}}),
        wrap({"value": {"label": ""}}, {"value": {"label": "third", "is_substantive": False, "description": " "}}), wrap({"value": "  "}, {"value": {"label": "fourth"}}),
    ]
    got = [r["a"] and tuple(r["a"]) for r in spark.createDataFrame(list(enumerate(bodies)), "i long, b string").orderBy("i").select(answers.label_answer(F.col("b")).alias("a")).collect()]
    assert got[:9] == [None] * 9
    assert got[9:12] == [("Yes", None, None, 1.0), ("{broken", None, None, None), ("third", None, False, None)]
    objects = [r["a"] for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(answers.answer_object(F.col("b")).cast("string").alias("a")).collect()]
    assert objects[10] == '{"label":"second"}' and objects[:9] == [None] * 9


def test_prepared_sources(spark):
    raw = spark.createDataFrame(
        [
            ("1", "77", "True", "@nobody hi @ShopB and @ShopA", "", "9", "Tue Oct 31 22:10:47 +0000 2017"), ("2", "77", "true ", "no one", "3,4", "", "Tue Oct 31 22:10:47 +0200 2017"),
            ("3", "ShopA", "False", "answer", "", "2", "Tue Oct 31 22:11:00 +0000 2017"), ("4", "ShopB", "False", "late", "", "2", "x"), ("5", "78", "True", "to b", "", "4", "not a time"),
            ("6", "79", "True", None, None, None, None), ("7", "78", "True", "to b", "", "4", "Wed Nov 01 00:00:00 +0000 2017"),
        ],
        "tweet_id string, author_id string, inbound string, text string, response_tweet_id string, in_response_to_tweet_id string, created_at string",
    )
    assert {r.tweet_id: r.brand for r in prepared.resolve_brand(raw).collect()} == {"1": "ShopB", "2": "ShopA", "5": "ShopB", "6": None, "7": "ShopB"}
    assert sorted((r.tweet_id, r.event_time, r.brand) for r in prepared.prepare(raw).collect()) == [("1", "2017-10-31 22:10:47", "ShopB"), ("2", "2017-10-31 20:10:47", "ShopA"), ("7", "2017-11-01 00:00:00", "ShopB")]
    with pytest.raises(ValueError, match="brand"):
        prepared.require(raw, "text", "brand")


def test_texts_are_encoded_once(spark, tmp_path):
    store = str(tmp_path / "cache")
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "")], "id long, t string")
    encode = lambda texts: [[float(len(t)), 1.0] for t in texts]
    out, n = embedded.embed(rows, "t", encode, store, "m")
    assert n == 3 and {r.id: r.vector[0] for r in out.collect()} == {1: 1.0, 2: 2.0, 3: 1.0, 4: 0.0, 5: 0.0}
    out, n = embedded.embed(rows.unionByName(rows), "t", lambda texts: 1 / 0, store, "m")
    assert n == 0 and out.count() == 10
    assert embedded.embed(rows, "t", encode, store, "m", "fp16")[1] == 3 and embedded.embed(rows, "t", encode, store, "other")[1] == 3
    # A run that died left a folder that isn't finished.
    spark.createDataFrame([("x", [1.0])], embedded.SCHEMA).write.parquet(f"{store}/run-dead")
    (tmp_path / "cache/run-dead/_SUCCESS").unlink()
    assert embedded.cached(spark, store).count() == 9
    embedded.compact(spark, store)
    assert embedded.cached(spark, store).count() == 9 and len(list((tmp_path / "cache").glob("run-*"))) == 1


def test_display_text(spark):
    texts = ["a &amp; b &lt;c&gt; &quot;d&quot; &#39;e&#x27; &amp;lt; &nbsp;x", "plain", None, "&bogus; &#0; &#1114112;"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(T.unescaped(F.col("t"))).collect()]
    assert got[:3] == [html.unescape(texts[0]), "plain", None] and got[3].startswith("&bogus;")


CHUNKS = [[("a", 1, 0), ("a", 2, 1), ("b", 3, 2)], [("b", 4, 3), ("c", 5, 4)], [("a", 6, 5), ("a", 6, 5)], [("d", 7, 40), ("c", 8, 41)]]


def write_chunk(spark, folder, n):
    rows = spark.createDataFrame([(t, r, [float(r), 1.0], d) for t, r, d in CHUNKS[n]], "topic string, record long, v array<double>, d long")
    rows.select("topic", "record", "v", F.timestamp_micros(F.col("d") * 86_400_000_000 + 1_700_000_000_000_000).alias("at")).coalesce(1).write.mode("append").parquet(folder)


def stream_of(spark, folder):
    return spark.readStream.schema("topic string, record long, v array<double>, at timestamp").option("maxFilesPerTrigger", 1).parquet(folder)


def final(spark, out):
    rows = spark.read.parquet(out)
    return {r.topic: (r.status, r.size, [round(x, 9) for x in r.centroid]) for r in sorted(rows.collect(), key=lambda r: (r.batch, r.status == "ACTIVE"))}


def test_registry_as_state_with_a_restart(spark, tmp_path):
    """Four chunks with a restart after two give what one run gives; a topic that isn't seen
    for long is retired, and numbers are above all earlier ones."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", centroids.PROVIDER)
    results, numbers = [], []
    for name, stops in (("once", [4]), ("twice", [2, 4])):
        folder, out, ids = str(tmp_path / name / "in"), str(tmp_path / name / "out"), str(tmp_path / name / "ids")
        done = 0
        for stop in stops:
            for n in range(done, stop):
                write_chunk(spark, folder, n)
            done = stop
            stream = stream_of(spark, folder)
            keep = lambda path: lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")
            start = lambda df, path, mode: df.writeStream.foreachBatch(keep(path)).outputMode(mode).option("checkpointLocation", path + "-progress").trigger(availableNow=True).start().awaitTermination()
            start(centroids.running_centroids(stream, "topic", "v", "at", late="1 day", days=20), out, "update")
            start(centroids.new_numbers(stream.withColumn("scope", F.lit("s")), "scope", "topic", "at", 10), ids, "append")
        results.append(final(spark, out))
        numbers.append(sorted((r.name, r.number) for r in spark.read.parquet(ids).collect()))
    assert results[0] == results[1] and numbers[0] == numbers[1] == [("a", 11), ("b", 12), ("c", 13), ("d", 14)]
    assert {t: r[:2] for t, r in results[0].items()} == {"a": ("RETIRED", 4), "b": ("RETIRED", 2), "c": ("ACTIVE", 2), "d": ("ACTIVE", 1)}


def test_chunks_are_handed_over_once(spark, tmp_path):
    """Repeated and late rows, rows without a time and from the future, a restart in the
    middle, and a batch that dies after its step."""
    folder = str(tmp_path / "in")
    schema = {"registry": "topic string, size long"}
    tables = runs.Handover(spark, str(tmp_path / "tables"), schema)
    dies = {"at": 1}

    def step(batch, before, number):
        if dies["at"] == number:
            dies["at"] = None
            raise OSError("lost")
        return {"registry": before["registry"].unionByName(batch.groupBy("topic").agg(F.count("*").alias("size"))).groupBy("topic").agg(F.sum("size").alias("size"))}

    def go():
        fresh = runs.fresh_records(stream_of(spark, folder), "record", "at", late="10 days")
        runs.run_chunks(fresh, tables, step, str(tmp_path / "progress")).awaitTermination()

    for n in range(3):
        write_chunk(spark, folder, n)
    with pytest.raises(Exception, match="lost"):
        go()
    go()
    assert {r.topic: r["size"] for r in tables.read("registry").collect()} == {"a": 3, "b": 2, "c": 1}
    write_chunk(spark, folder, 3)
    go()  # moves the watermark on
    odd = spark.createDataFrame([("late", 90), ("none", 91), ("future", 92), ("d", 93)], "topic string, record long").withColumn("v", F.array(F.lit(1.0)))
    day = F.when(F.col("topic") == "late", 1).when(F.col("topic") == "d", 42).when(F.col("topic") == "future", 90_000)
    odd.select("topic", "record", "v", F.timestamp_micros(day * 86_400_000_000 + 1_700_000_000_000_000).alias("at")).coalesce(1).write.mode("append").parquet(folder)
    go()
    go()
    assert {r.topic: r["size"] for r in tables.read("registry").collect()} == {"a": 3, "b": 2, "c": 2, "d": 2}


def test_state_files(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from trendloom.sources import state

    schema = StructType([StructField("topic_id", StringType()), StructField("size", LongType()), StructField("label", StringType())])
    topics = spark.createDataFrame([("a", 1, None), ("b", None, "B")], schema)
    state.save_topics(topics.withColumn("more", F.lit(1)), str(tmp_path / "t"))
    rows = lambda path: sorted(map(tuple, state.load_topics(spark, path, schema).collect()))
    assert rows(str(tmp_path / "t")) == [("a", 1, None), ("b", None, "B")]
    (tmp_path / "array.json").write_text('[\n {"topic_id": "x", "other": 2},\n {"topic_id": "y",\n  "size": 3}]')
    assert rows(str(tmp_path / "array.json")) == [("x", None, None), ("y", 3, None)]
    assert rows(None) == rows(str(tmp_path / "nowhere")) == []
    left = spark.createDataFrame([tuple("abcdefg")], ", ".join(f"{c} string" for c in state.BUFFER)).withColumns({"segment_index": F.lit(1), "embedding": F.array(F.lit(1.0), F.lit(2.0))})
    state.save_buffer(left, str(tmp_path / "b"))
    held, why = state.load_buffer(spark, str(tmp_path / "b"), 2)
    assert why is None and [list(r["embedding"]) for r in held.collect()] == [[1.0, 2.0]]
    held, why = state.load_buffer(spark, str(tmp_path / "b"), 3)
    assert held.count() == 0 and "width 3" in why
    left.drop("brand").write.parquet(str(tmp_path / "c"))
    held, why = state.load_buffer(spark, str(tmp_path / "c"), 2)
    assert held.count() == 0 and "brand" in why
    assert state.load_buffer(spark, None, 2)[0].count() == state.load_buffer(spark, str(tmp_path / "d"), 2)[0].count() == 0


def test_record_files(spark, tmp_path):
    from trendloom.sources.records import read_records, write_table

    (tmp_path / "a.csv").write_text('tweet_id,event_time,author_id,text,brand\n1,2024-01-01 00:00:00,u,"two\nlines ""quoted""",A\n2,not a time,u,x,A\n3,2024-01-02 00:00:00,u,,\n')
    (tmp_path / "b.csv").write_text("tweet_id,event_time,text,brand\n1,2023-01-01 00:00:00,later file,B\n4,2024-01-03 00:00:00,new,B\n4,2024-01-04 00:00:00,newest,B\n")
    rows = read_records(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r.tweet_id, r.text, r.brand, r.author_id) for r in rows.collect()) == [("1", "later file", "B", None), ("3", "", "unknown", "u"), ("4", "newest", "B", None)]
    one = read_records(spark, [str(tmp_path / "a.csv")]).where("tweet_id = '1'").first()
    assert one.text == 'two\nlines "quoted"'
    (tmp_path / "c.csv").write_text("tweet_id,text\n1,x\n")
    with pytest.raises(ValueError, match="event_time, brand"):
        read_records(spark, [str(tmp_path / "c.csv")])
    with pytest.raises(ValueError, match="no files"):
        read_records(spark, [])
    assert write_table(rows, str(tmp_path / "out"), ["brand"]) and spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert not write_table(rows.limit(0), str(tmp_path / "none"), only_rows=True) and not (tmp_path / "none").exists()


def test_windowed_volumes(spark, tmp_path):
    from trendloom.streaming import counts

    day = 86_400_000_000
    first = [("a", 1, 0.1), ("a", 1, 0.2), ("a", 2, 0.9), ("b", 3, 1.5), ("a", 4, 5.0)]
    second = [("a", 9, 0.5), ("a", 5, 5.1), ("b", 6, 9.0)]  # the first is later than the watermark
    results = {}
    for name, make in (("day", lambda s: counts.windowed_volumes(s, "at", "topic", "record", "1 day", "1 day")), ("hop", lambda s: counts.windowed_volumes(s, "at", "topic", "record", "2 days", "1 day", "1 day")), ("session", lambda s: counts.session_volumes(s, "at", "topic", "record", "6 hours", "1 day"))):
        folder, out = str(tmp_path / name / "in"), str(tmp_path / name / "out")
        for rows in (first, second, [("z", 0, 30.0)], [("z", 0, 60.0)]):
            made = spark.createDataFrame(rows, "topic string, record long, d double").select("topic", "record", F.timestamp_micros((F.col("d") * day).cast("long") + 1_700_006_400_000_000).alias("at"))
            made.coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema("topic string, record long, at timestamp").parquet(folder)
            make(stream).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", out + "-progress").trigger(availableNow=True).start().awaitTermination()
        start = F.round((F.unix_micros("window.start") - 1_700_006_400_000_000) / day, 2)
        results[name] = sorted((r.topic, r.s, r.records, r.rows) for r in spark.read.parquet(out).withColumn("s", start).where("topic != 'z'").collect())
    assert results["day"] == [("a", 0.0, 2, 3), ("a", 5.0, 2, 2), ("b", 1.0, 1, 1), ("b", 9.0, 1, 1)]
    assert ("a", 0.0, 2, 3) in results["hop"] and ("a", -1.0, 2, 3) in results["hop"]
    assert results["session"] == [("a", 0.1, 1, 2), ("a", 0.9, 1, 1), ("a", 5.0, 2, 2), ("b", 1.5, 1, 1), ("b", 9.0, 1, 1)]


def test_labels_and_bounds(spark, monkeypatch):
    from trendloom.operators import terms

    rows = spark.createDataFrame([("x", "b", 2), ("x", "a", 1), ("y", "c", 1)], "t string, term string, rank int")
    assert sorted(map(tuple, terms.joined_labels(rows, "t").collect())) == [("x", "a / b"), ("y", "c")]
    monkeypatch.setattr(registry, "MOST_PAIRS", 2)
    pairs = spark.createDataFrame([("s", 1, 2, 0.5)] * 3, "scope string, new_id long, old_id long, similarity double")
    with pytest.raises(ValueError, match="3 pairs"):
        registry.match_optimal(pairs, "scope", 0.1)
