"""Terms of topics against plain reckoning, with few and with all pairs counted."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import terms

STOP = ("the", "and")


def corpus(spark, n=300):
    rng = np.random.default_rng(11)
    words = np.array([f"w{i:02d}" for i in range(40)] + ["the", "and", "ça", "x"])
    share = 1 / np.arange(1, len(words) + 1)
    rows = [(i % 3 and i % 4, f"s{i % 2}", i - i % 2 * (i % 5 == 0), " ".join(rng.choice(words, size=rng.integers(0, 30), p=share / share.sum())) or None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "topic long, scope string, doc long, text string").repartition(3)


def listed(text):
    words = [w for w in (text or "").split() if len(w) > 1 and w not in STOP]
    return words + [" ".join(p) for p in zip(words, words[1:])]


@pytest.mark.parametrize("sent, held", [(200_000, 400_000), (0, 3), (60, 50)])
def test_tfidf_terms(spark, monkeypatch, sent, held):
    monkeypatch.setattr(terms, "SENT_TERMS", sent)
    monkeypatch.setattr(terms, "HELD_TERMS", held)
    rows, df = corpus(spark)
    want = set()
    for topic in {r[0] for r in rows}:
        docs = {}
        for t, _, d, text in rows:
            if t == topic:
                docs.setdefault(d, Counter()).update(listed(text))
        size = sum(r[0] == topic for r in rows)
        every, held_by = sum(docs.values(), Counter()), Counter(t for c in docs.values() for t in c)
        idf = {t: math.log((1 + size) / (1 + held_by[t])) + 1 for t in sorted(every, key=lambda t: (-every[t], t))[:12]}
        score = Counter()
        for c in docs.values():
            norm = math.sqrt(sum((c[t] * w) ** 2 for t, w in idf.items() if t in c))
            for t in idf:
                if t in c:
                    score[t] += c[t] * idf[t] / norm / size
        score = {t: round(v, 9) for t, v in score.items()}
        want |= {(topic, t, round(score[t], 6), k + 1) for k, t in enumerate(sorted(score, key=lambda t: (-score[t], t))[:4])}
    got = terms.tfidf_terms(df, "topic", "doc", "text", STOP, most=4, features=12).collect()
    assert {(r.topic, r.term, round(r.score, 6), r["rank"]) for r in got} == want


@pytest.mark.parametrize("sent, held", [(200_000, 400_000), (0, 3)])
def test_class_labels(spark, monkeypatch, sent, held):
    monkeypatch.setattr(terms, "SENT_TERMS", sent)
    monkeypatch.setattr(terms, "HELD_TERMS", held)
    rows, df = corpus(spark)
    by = {}
    for t, _, _, text in rows:
        by.setdefault(t, Counter()).update(listed(text))
    df_of = Counter(t for c in by.values() for t in c)
    want = {}
    for topic, c in by.items():
        score = {t: round(n / c.total() * math.log1p(len(by) / df_of[t]), 9) for t, n in c.items()}
        kept = []
        for t in sorted(score, key=lambda t: (-score[t], t))[:24]:
            if len(kept) < 2 and not any({*k.split()} <= {*t.split()} or {*t.split()} <= {*k.split()} for k in kept):
                kept.append(t)
        want[topic] = " / ".join(kept)
    assert {r.topic: r.label for r in terms.class_labels(df, "topic", "text", STOP, most=2).collect()} == want
    scoped = terms.class_labels(df, "topic", "text", STOP, most=2, scope="scope").collect()
    assert len(scoped) == len({r[:2] for r in rows})


def test_rare_pairs_are_not_counted(spark, monkeypatch):
    """Pairs of which no topic can have one among its best aren't counted at all."""
    sizes, counted = [], terms.gram_counts

    def spy(docs, keys, stop, pairs, wanted=None):
        out = counted(docs, keys, stop, pairs, wanted)
        sizes.append((pairs, out.count()))
        return out

    monkeypatch.setattr(terms, "gram_counts", spy)
    rows, df = corpus(spark, 600)
    pairs = len({(r[0], g) for r in rows for g in listed(r[3]) if " " in g})
    terms.class_labels(df, "topic", "text", STOP, most=1).collect()
    terms.tfidf_terms(df, "topic", "doc", "text", STOP, most=1, features=12).collect()
    assert [p for p, _ in sizes] == [False, True, False, True] and sizes[1][1] < pairs and sizes[3][1] < pairs / 3


def test_words_are_cut_once(spark, monkeypatch):
    """Passes read stored words, not texts, and count the same in pieces of any size."""
    plans, counted = [], terms.gram_counts

    def spy(docs, *args):
        plans.append(docs._jdf.queryExecution().optimizedPlan().toString())
        return counted(docs, *args)

    monkeypatch.setattr(terms, "gram_counts", spy)
    _, df = corpus(spark)

    def found():
        scores = terms.tfidf_terms(df, "topic", "doc", "text", STOP, most=4, features=12).withColumn("score", F.round("score", 6))
        return {*scores.collect()}, {*terms.class_labels(df, "topic", "text", STOP, most=2).collect()}

    whole = found()
    assert len(plans) == 4 and not any("lower(" in p for p in plans)
    monkeypatch.setattr(terms, "PIECE_BYTES", 50)
    monkeypatch.setattr(terms, "HELD_TERMS", 20)
    assert found() == whole


def test_words_are_those_of_the_sql(spark, tmp_path):
    """Digits and marks of all kinds are characters of words, as in the SQL."""
    from trendloom.plans.audits import class_labels, tfidf_terms
    from trendloom.plans.queries import SQL

    texts = ["x² ½cup x² Ⓐb ça c\u0327a\u0301 d\u200de", "a_b a‿b ½cup 12 Ⅻ ǅa x² Straße", "the and", None, "日本 語 日本-語x\n½cup\u00a0ça a'b"]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for query in (tfidf_terms, class_labels):
        got = query(spark, str(tmp_path))
        assert {*map(tuple, got.collect())} == {*con.sql(SQL[query.__name__]).select(*got.columns).fetchall()}


def test_texts_are_worked_out_once(spark):
    from trendloom.plans.queries import QUERIES

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(QUERIES["segments"](spark, "/root/testdata/sf0.001")).count("(?:https?://|www") == 1
    _, df = corpus(spark, 3)
    assert plan(terms.words(df, "text", "topic")).count("regexp_extract_all") == 1
