"""Matching and merging of topics against brute force."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from trendloom.operators import registry


def test_optimal_pairs_against_all_permutations():
    rng = np.random.default_rng(7)
    for n, m in [(1, 1), (2, 2), (3, 5), (5, 3), (4, 4), (6, 6), (1, 4)] * 6:
        gain = np.round(rng.normal(size=(n, m)), 1)
        got = registry.optimal_pairs(gain)
        assert len(got) == min(n, m) and len({i for i, _ in got}) == len({j for _, j in got}) == min(n, m)
        wide = gain if n <= m else gain.T
        best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(wide.shape[1]), wide.shape[0]))
        assert abs(sum(gain[i, j] for i, j in got) - best) < 1e-9


def test_two_want_one(spark):
    pairs = spark.createDataFrame([("x", 1, 10, 0.9), ("x", 2, 10, 0.8), ("x", 1, 11, 0.7), ("x", 2, 11, 0.1), ("y", 3, 12, 0.2)], "scope string, new_id long, old_id long, similarity double")
    optimal = registry.match_optimal(pairs, "scope", 0.3).collect()
    assert sorted((r.new_id, r.old_id) for r in optimal) == [(1, 11), (2, 10)]
    greedy = registry.match_greedy(pairs, "scope", 0.05).collect()
    assert sorted((r.new_id, r.old_id) for r in greedy) == [(1, 10), (2, 11), (3, 12)]
    leading = registry.match_greedy(pairs, "scope", 0.05, 0.3).collect()
    assert sorted((r.new_id, r.old_id) for r in leading) == [(2, 10), (3, 12)]


def test_merges_make_no_chains(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.9), (3, 4, 0.85), (5, 6, 0.99)], "a long, b long, similarity double")
    topics = spark.createDataFrame([(1, "x", 9, False), (2, "x", 5, False), (3, "x", 3, False), (4, "x", 2, False), (5, "y", 1, True), (6, "y", 8, False)], "topic_id long, scope string, size long, protected boolean")
    plan = registry.plan_merges(pairs, topics, "scope", 0.8).collect()
    assert sorted((r.topic_id, r.into_id) for r in plan) == [(2, 1), (4, 3)]


def test_merge_bounds(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95), (1, 3, 0.9), (4, 5, 0.8)], "a long, b long, similarity double")
    rows = [(1, "x", 9, False, ["7"]), (2, "x", 5, False, ["8"]), (3, "x", 3, False, []), (4, "x", 2, False, []), (5, "x", 1, False, [])]
    topics = spark.createDataFrame(rows, "topic_id long, scope string, size long, protected boolean, aliases array<string>")
    plan = lambda **more: sorted((r.topic_id, r.into_id) for r in registry.plan_merges(pairs, topics, "scope", 0.5, **more).collect())
    assert plan() == [(2, 1), (3, 1), (5, 4)] and plan(most_aliases=3) == [(2, 1), (5, 4)] and plan(most_aliases=2) == [(3, 1), (5, 4)] and plan(blocked=(1,)) == [(5, 4)]


def test_consolidation(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.9), (4, 5, 0.85), (6, 7, 0.8), (8, 9, 0.79)], "a long, b long, similarity double")
    rows = [(1, 9, False), (2, 5, False), (3, 3, False), (4, 2, True), (5, 1, True), (6, 2, True), (7, 7, False), (8, 3, True), (9, 9, False), (10, 0, False)]
    topics = spark.createDataFrame(rows, "topic_id long, size long, protected boolean")
    plan = lambda n: sorted((r.topic_id, r.into_id) for r in registry.consolidate(pairs, topics, n, 0.75).collect())
    assert plan(8) == [(2, 1)] and plan(2) == [(2, 1), (9, 8)] and plan(9) == plan(0) == []


def test_duplicates_go_into_the_largest(spark):
    pairs = spark.createDataFrame([(1, 2, 0.95), (2, 3, 0.95), (3, 4, 0.95)], "a long, b long, similarity double")
    topics = spark.createDataFrame([(1, "x", 5), (2, "x", 4), (3, "x", 3), (4, "x", 2)], "topic_id long, scope string, size long")
    assert sorted((r.topic_id, r.into_id) for r in registry.merge_duplicates(pairs, topics, "scope", 0.9).collect()) == [(2, 1), (4, 3)]


def test_deduped_ids_don_t_hang_on_how_rows_are_dealt(spark, tmp_path):
    """Sums whose last bit decides, events in several files, and rows without a type or an id,
    or twice: as one thread of the SQL has them."""
    import duckdb

    from trendloom.plans.lifecycle import deduped_topic_ids
    from trendloom.plans.queries import SQL

    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet").select("event_id", "user_id", "event_type", "value")
    copies = events.crossJoin(spark.range(6)).select((F.col("event_id") + 100000 * F.col("id")).alias("event_id"), "user_id", "event_type", "value")
    copies.repartitionByRange(9, "event_id").sortWithinPartitions("event_id").write.parquet(str(tmp_path / "events.parquet"))
    odd = [(1, 1, "b", 30.0), (1, 1, "b", 30.0), (2, 1, "a", 30.0), (3, 2, None, 40.5), (4, 2, "z", 40.0), (5, 3, None, 25.0), (None, 3, "c", 25.0), (None, 3, "c", 25.0), (6, 4, "x", None), (7, 5, "d", 9.0), (8, 5, None, 9.0)]
    spark.createDataFrame(odd, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "odd" / "events.parquet"))
    for folder in (tmp_path, tmp_path / "odd"):
        db = duckdb.connect(config={"threads": 1})
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        want = db.sql(SQL["deduped_topic_ids"]).fetchall()
        assert sorted(map(tuple, deduped_topic_ids(spark, str(folder)).collect()), key=repr) == sorted(want, key=repr)
