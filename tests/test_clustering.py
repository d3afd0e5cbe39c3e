"""Neighbours, spanning forests, clusters, linkages, groups and manifolds against plain reckoning."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import audits
from trendloom.operators import clustering as C
from trendloom.operators import graph as G
from trendloom.operators import manifold as M

SF = "/root/testdata/sf0.1"


def blobs(seed=1, sizes=(40, 30, 25), spread=0.15):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [4, 0, 0], [0, 5, 0], [3, 3, 6]])[: len(sizes)]
    x = np.concatenate([c + rng.normal(scale=spread, size=(n, 3)) for c, n in zip(centres, sizes)])
    return x, np.repeat(np.arange(len(sizes)), sizes)


def same(a, b):
    return len({*zip(a, b)}) == len({*a}) == len({*b})


def frame(spark, x, pools=("a",)):
    rows = [(i, pools[i % len(pools)], f"u{i % 5}", v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, pool string, author string, v array<double>").repartition(3)


def reach(x, samples):
    d = G.distances(x, x)
    core = np.sort(d, axis=1)[:, samples - 1]
    return np.maximum(np.maximum(d, core[:, None]), core[None, :])


def brute_forest(w):
    """All pairs, lightest first: (i, j, weight) of the spanning tree."""
    top, out = list(range(len(w))), []
    for h, i, j in sorted((w[i, j], i, j) for i, j in itertools.combinations(range(len(w)), 2)):
        if top[i] != top[j]:
            out.append((i, j, h))
            top = [top[i] if t == top[j] else t for t in top]
    return out


def brute_labels(x, least, samples, most=0):
    i, j, w = (np.array(c) for c in zip(*brute_forest(reach(x, samples))))
    return C.condensed_labels(i, j, w, len(x), least, most)


def test_condensed_labels_are_the_blobs():
    x, y = blobs()
    labels = brute_labels(np.concatenate([x, [[50.0, 50, 50], [-60, 0, 10]]]), 10, 5)
    assert same(labels[:-2], y) and (labels[-2:] == -1).all()
    none = np.zeros(0, int)
    assert (C.condensed_labels(none, none, none, 4, 10) == -1).all() and len(C.condensed_labels(none, none, none, 0, 5)) == 0
    capped = brute_labels(x, 5, 3, most=35)
    assert all((capped == c).sum() <= 35 for c in {*capped} - {-1})
    # Parts without an edge between them are clusters of their own.
    i, j = np.array([0, 1, 3, 4]), np.array([1, 2, 4, 5])
    assert C.condensed_labels(i, j, np.array([0.1, 0.2, 0.1, 0.2]), 6, 3).tolist() == [0, 0, 0, 1, 1, 1]


@pytest.mark.parametrize("seed, sizes, spread", [(1, (40, 30, 25), 0.15), (6, (30, 30, 30, 30), 0.6), (7, (50, 12, 9), 0.3)])
def test_every_row_has_the_brute_force_label(spark, seed, sizes, spread):
    x, _ = blobs(seed, sizes, spread)
    got = {r.id: r.label for r in C.cluster_pools(frame(spark, x), "pool", "id", "v", 8, 4).collect()}
    want = brute_labels(x, 8, 4)
    assert len(got) == len(x)
    labels = np.array([got[i] for i in range(len(x))])
    assert ((labels == -1) == (want == -1)).all() and same(labels, want)


def test_pools_over_many_leaves(spark, monkeypatch):
    """Leaves of 20 rows, spanning rounds by joins to the end: all rows have labels, and the
    blobs, pool by pool, are the clusters."""
    monkeypatch.setattr(G, "LEAF", 20)
    monkeypatch.setattr(G, "LAST_EDGES", 50)
    x, y = blobs(5, (120, 90, 60))
    df = frame(spark, np.concatenate([x, x[:1].repeat(80, axis=0)]), "ab").unionByName(spark.createDataFrame([(1000, "a", "u", None), (1001, "c", "u", [1.0, 2.0, 3.0])], "id long, pool string, author string, v array<double>"))
    got = {r.id: (r.pool, r.label) for r in C.cluster_pools(df, "pool", "id", "v", 12, 4).collect()}
    assert len(got) == len(x) + 82 and got[1000] == ("a", -1) and got[1001] == ("c", -1)
    for p in (0, 1):
        labels = np.array([got[i][1] for i in range(p, len(x), 2)])
        for c in {*labels} - {-1}:
            assert len({*y[p::2][labels == c]}) == 1
        assert (labels == -1).mean() < 0.2
    assert C.cluster_pools(df.limit(0), "pool", "id", "v", 12, 4).count() == 0


@pytest.mark.parametrize("last", [10**6, 0])
def test_spanning_forest_against_all_pairs(spark, monkeypatch, last):
    monkeypatch.setattr(G, "LAST_EDGES", last)
    x, _ = blobs(2, (12, 10))
    w = reach(x, 3)
    edges = spark.createDataFrame([("s", i, j, float(w[i, j])) for i, j in itertools.combinations(range(len(x)), 2)] + [("t", 1, 2, 0.5), ("t", 2, 3, 0.5), ("t", 1, 3, 0.5), ("t", 8, 9, 1.0)], "_s string, a long, b long, w double")
    got = [tuple(r) for r in G.spanning_forest(edges).select("_s", "a", "b", "w").collect()]
    assert sorted(r[1:3] for r in got if r[0] == "t") == [(1, 2), (1, 3), (8, 9)]
    assert abs(sum(r[3] for r in got if r[0] == "s") - sum(e[2] for e in brute_forest(w))) < 1e-9
    assert len([r for r in got if r[0] == "s"]) == len(x) - 1
    nodes = spark.createDataFrame([("t", k) for k in (1, 2, 3, 7, 8, 9)], "_s string, _k long")
    found = {r["_k"]: r["component"] for r in G.components(edges.where("_s = 't'"), nodes).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 7: 7, 8: 8, 9: 8}


def exact_neighbours(keys, x, k):
    d = np.round(G.distances(x, x), 7)
    np.fill_diagonal(d, np.inf)
    return {keys[i]: {keys[j] for j in np.argsort(d[i], kind="stable")[:k]} for i in range(len(x))}


def test_recall_of_neighbours(spark):
    """Against brute force, on 2000 vectors in leaves of 512."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = e.select("vec_id", "embedding").orderBy("vec_id").collect()
    want = exact_neighbours([r[0] for r in rows], np.array([r[1] for r in rows], float), 10)
    near = G.neighbours(G.leaves(e, "vec_id", "embedding"), 10)
    got = {r["_k"]: {n["b"] for n in r["near"]} for r in near.collect()}
    assert len(got) == len(rows) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(got[k] & want[k]) / 10 for k in want]) >= 0.9


def test_linkages_against_definitions():
    x, _ = blobs(3, (6, 5, 4), 1.0)
    d = G.distances(x, x)
    between = {
        "average": lambda a, b: d[np.ix_(a, b)].mean(), "complete": lambda a, b: d[np.ix_(a, b)].max(),
        "ward": lambda a, b: 2 * len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum(),
    }
    for kind, far in between.items():
        groups = [[i] for i in range(len(x))]
        while len(groups) > 4:
            a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: far(groups[p[0]], groups[p[1]]))
            groups[a] += groups.pop(b)
        labels = C.cut(C.agglomerate(d**2 if kind == "ward" else d, kind), len(x), 4)
        assert {frozenset(np.flatnonzero(labels == c)) for c in {*labels}} == {frozenset(g) for g in groups}, kind


def test_close_centres_and_silhouette():
    centres = np.array([[0.0, 0], [0.5, 0], [9, 0], [0, 9], [9, 9]])
    assert C.close_centres(centres, 0.3).tolist() == [0, 0, 2, 3, 4] and C.close_centres(centres, 0.0).tolist() == [0, 1, 2, 3, 4]
    x, y = blobs(4, (40, 40, 40, 40))
    d = G.distances(x, x)
    own = np.array([d[i, (y == y[i]) & (np.arange(len(x)) != i)].mean() for i in range(len(x))])
    other = np.array([min(d[i, y == c].mean() for c in range(4) if c != y[i]) for i in range(len(x))])
    assert abs(C.silhouette(x, y) - ((other - own) / np.maximum(own, other)).mean()) < 1e-6
    assert np.isnan(C.silhouette(x, np.zeros(len(x), int)))


def test_axes_of_variance(spark):
    x, _ = blobs(4, (40, 40, 40, 40))
    rows = spark.createDataFrame([("s", i, v.tolist()) for i, v in enumerate(x)] + [("t", 900, [1.0, 2.0, 3.0])], "_s string, _k long, _v array<double>").repartition(3)
    got = {r["_k"]: r["_x"] for r in C._reduced(rows, 2).collect()}
    p = np.array([got[i] for i in range(len(x))])
    assert p.shape == (160, 2) and got[900] == [1.0, 2.0, 3.0]
    assert np.allclose(np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2], np.cov(p.T).diagonal())


@pytest.mark.parametrize("marks", [1500, 40])
def test_large_clusters_are_split(spark, monkeypatch, marks):
    monkeypatch.setattr(C, "MARKS", marks)
    monkeypatch.setattr(C, "PIECE_ROWS", 50)
    x, y = blobs(4, (40, 40, 40, 40))
    rows = spark.createDataFrame([("s", i, v.tolist(), v.tolist(), 0) for i, v in enumerate(x)], "_s string, _k long, _v array<double>, _x array<double>, label long")
    got = {r["_k"]: r["child"] for r in C.split_large(rows, 40).collect()}
    assert len(got) == len(x) and same([got[i] for i in range(len(x))], y)
    alike = rows.withColumn("_v", F.array(F.lit(1.0), F.lit(2.0)))
    assert {r["child"] for r in C.split_large(alike, 40, 0.92).collect()} == {0}


def test_quality_parameters_micro_clusters_and_groups(spark):
    x, y = blobs(5, (30, 30, 30))
    df = frame(spark, x, "ab")
    best = C.choose_parameters(df, "pool", "id", "v", [(0, 6, 3), (0, 40, 3)]).collect()
    assert len(best) == 2 and all(r.least == 6 for r in best)
    micro = C.micro_clusters(df.where("id % 3 = 0"), "pool", "id", "v", "author", 2.0, 4, 2).collect()
    assert len(micro) == 30 and len({r.cluster for r in micro}) == 6
    assert all(y[r.id] == y[r.cluster] and r.id % 2 == r.cluster % 2 for r in micro)
    assert C.micro_clusters(df.where("id % 3 = 0"), "pool", "id", "v", "author", 2.0, 4, 6).count() == 0
    topics = spark.createDataFrame([(1, "x", [1.0, 0.0], 5), (2, "x", [0.99, 0.1], 9), (3, "x", [0.0, 1.0], 3), (4, "y", [1.0, 0.0], 2)], "topic_id long, scope string, centroid array<double>, size long")
    assert sorted((r.topic_id, r.group_id, r.group_size) for r in C.topic_groups(topics, "scope", 0.9).collect()) == [(1, "G_2", 2), (2, "G_2", 2)]
    q = {r.pool: r for r in C.pool_quality(df.withColumn("label", F.when(F.col("id") < 60, F.col("id") % 3).otherwise(-1)), "pool", "id", "v", "label").collect()}
    assert {p: (r.clusters, round(r.noise, 6)) for p, r in q.items()} == {"a": (3, round(1 / 3, 6)), "b": (3, round(1 / 3, 6))}


def test_micro_clusters_are_average_linkage(spark):
    x, _ = blobs(8, (14, 11, 9), 0.8)
    got = {r.id: r.cluster for r in C.micro_clusters(frame(spark, x), "pool", "id", "v", "author", 1.2, 1, 1).collect()}
    want = C.cut(C.agglomerate(G.distances(x, x), "average"), len(x), under=1.2)
    assert same([got[i] for i in range(len(x))], want)


def test_manifold(spark):
    x, y = blobs(9, (60, 60, 60))
    df = frame(spark, x + 5)
    model, meta = M.fit(df.where("id % 2 = 0"), "id", "v", n_components=2, n_neighbors=8)
    places = lambda rows: {r["id"]: r["place"] for r in M.transform(rows, model, meta, "id", "v").collect()}
    one = places(df)
    assert one == places(df.where("id >= 0").repartition(7)) and len(one) == len(x)
    p = np.array([one[i] for i in range(len(x))])
    assert p.shape == (180, 2) and C.silhouette(p, y) > 0.5
    empty = spark.createDataFrame([(1, None)], "id long, v array<double>")
    assert places(empty) == {1: None}
    with pytest.raises(ValueError, match="densMAP"):
        M.transform(df, model, {**meta, "densmap": True}, "id", "v")


def test_manifold_store(spark, tmp_path):
    """Fitted once, then reused; refit when the rows have moved, or when asked; refused
    where what it was made with isn't what is asked for."""
    x, _ = blobs(9, (60, 60, 60))
    near, far = frame(spark, x + 5), frame(spark, -(x + 5))
    store = str(tmp_path / "store")
    ask = lambda rows, **more: M.get_or_fit(rows, store, "id", "v", **{"n_neighbors": 8, "n_components": 2, **more})
    _, first, why = ask(near)
    assert why == "fitted"
    again, meta, why = ask(near, most_drift=0.5)
    assert why == "reused" and meta["version"] == first["version"] and again.count() == len(x)
    for key, other in (("n_neighbors", 9), ("n_components", 3), ("min_dist", 0.1), ("embedding_model", "other")):
        with pytest.raises(ValueError, match=key):
            ask(near, **{key: other})
    with pytest.raises(ValueError, match="input_dimension"):
        ask(near.withColumn("v", F.slice("v", 1, 2)))
    with pytest.raises(ValueError, match="scope"):
        ask(near, scope="pool")
    _, moved, why = ask(far, most_drift=0.5)
    assert why == "drifted" and moved["version"] != first["version"] and moved["refit_trigger"]["measured"] > 0.5
    assert M.current(spark, store)[1]["version"] == moved["version"]
    assert again.count() == len(x)  # readers of the old version still have it
    _, third, why = ask(far, refit=True)
    assert why == "refit" and third["version"] != moved["version"]
    assert M.get_or_fit(far, store, "id", "v", n_neighbors=8, n_components=2, densmap=True)[2] == "fitted" and M.current(spark, store)[1]["version"] == third["version"]


def test_grid_over_manifolds(spark):
    x, _ = blobs(9, (60, 60, 60))
    rows = M.choose_manifold(frame(spark, x + 5), "id", "v", [(2, 8, 150, 5), (2, 8, 15, 5)]).collect()
    assert [r.least for r in rows] == [15, 150] and rows[0].clusters >= 2 and rows[0].objective > 0 and rows[1].objective is None


def test_queries_without_sql(spark):
    from trendloom.plans import discovery

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    pools = discovery.pool_clusters(spark, sf).collect()
    assert len(pools) == len({r.vec_id for r in pools}) == n and {r.pool for r in pools} == {"P0", "P1"}
    for p in ("P0", "P1"):
        labels = [r.label for r in pools if r.pool == p and r.label >= 0]
        assert sorted({*labels}) == list(range(max(labels) + 1)) and max(labels) >= 1
    places = discovery.manifold_places(spark, sf).collect()
    assert len(places) == 3 * n and all(np.isfinite(r.x) for r in places)
    micro = discovery.micro_clusters(spark, sf).collect()
    assert micro and len({r.vec_id for r in micro}) == len(micro)


def test_drift_is_over_all_vectors(spark, monkeypatch):
    """More rows than any bound on probes or anchors, and blocks of a few rows."""
    monkeypatch.setattr(G, "BLOCK_ROWS", 700)
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(2200, 5)), rng.normal(size=(5300, 5))
    y[0] = 0
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    got = audits.drift(frame(spark, x), frame(spark, y), "id", "v").first()["drift"]
    assert abs(got - (1 - (unit(x) @ unit(y).T).max(axis=1)).mean()) < 1e-12
    assert audits.drift(frame(spark, x[:3]), frame(spark, x[:3]).limit(0), "id", "v").first()["drift"] is None


def test_exact_neighbours(spark, monkeypatch):
    """Of all pairs, over several blocks and steps, with copies and ties at the last place."""
    for name, value in (("BLOCK_ROWS", 150), ("STEP_ROWS", 16), ("STEP_COLUMNS", 40)):
        monkeypatch.setattr(G, name, value)
    monkeypatch.setattr(G, "LEAF", 64)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 6))
    x[600:640] = x[3]  # more copies than neighbours
    x[640:660] = np.round(x[640:660])
    near = {r["_k"]: [(n["d"], n["b"]) for n in r["near"]] for r in G.exact_neighbours(frame(spark, x), "id", "v", 5).collect()}
    d = np.round(np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)), 7)
    np.fill_diagonal(d, np.inf)
    assert near == {i: [(d[i, j], j) for j in np.argsort(d[i], kind="stable")[:5]] for i in range(len(x))}
    few = {r["_k"]: len(r["near"]) for r in G.exact_neighbours(frame(spark, x[:3]), "id", "v", 5).collect()}
    assert few == {0: 2, 1: 2, 2: 2} and G.exact_neighbours(frame(spark, x[:3]).limit(0), "id", "v", 5).count() == 0


def test_neighbour_graph_is_exact_beyond_a_leaf(spark):
    import duckdb

    from trendloom.plans import discovery
    from trendloom.plans.queries import SQL

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = db.sql(SQL["neighbour_graph"]).fetchall()
    assert sorted(map(tuple, discovery.neighbour_graph(spark, SF).select("vec_id", "neighbour", "place").collect())) == sorted(want)


def test_places_don_t_hang_on_the_rows_held_at_once(spark, monkeypatch):
    """A task holds the distances of a few rows only, at any size of its batches."""
    x, _ = blobs()
    model, meta = M.fit(frame(spark, x), "id", "v", n_components=2, n_neighbors=5)
    places = lambda: {r.id: r.place for r in M.transform(frame(spark, x), model, meta, "id", "v").collect()}
    whole = places()
    assert M.STEP_ROWS <= 256
    monkeypatch.setattr(M, "STEP_ROWS", 7)
    some = places()
    assert len(some) == len(x) and all(np.allclose(whole[k], some[k]) for k in whole)


def test_components_need_no_forest(spark, monkeypatch):
    monkeypatch.setattr(G, "LAST_EDGES", 20)
    monkeypatch.setattr(G, "spanning_forest", None)
    pairs = [(i, i + 2) for i in range(60)] + [(100, 105), (101, 105)]
    edges = spark.createDataFrame([("s", a, b) for a, b in pairs], "_s string, a long, b long")
    nodes = spark.createDataFrame([("s", k) for k in [*range(62), 100, 101, 105, 200]], "_s string, _k long")
    found = {r["_k"]: r["component"] for r in G.components(edges, nodes).collect()}
    assert found == {**{k: k % 2 for k in range(62)}, 100: 100, 101: 100, 105: 100, 200: 200}


def test_micro_clusters_are_of_all_rows(spark, monkeypatch):
    """Average linkage of every pair, beyond what a task holds and beyond any number of
    landmarks: in rounds, over blocks, with copies of a vector and clusters larger than a task's."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(230, 3)), blobs(8, (60, 50), 0.1)[0]])
    x[5:12] = x[4]
    for name, value in (("MARKS", 40), ("GROUP_CLUSTERS", 12), ("GROUP_ROWS", 30), ("BLOCK_CLUSTERS", 60), ("STEP_CELLS", 700)):
        monkeypatch.setattr(C, name, value, raising=False)
    df = frame(spark, x, "ab")
    for under in (0.9, 2.5):
        got = {r.id: r.cluster for r in C.micro_clusters(df, "pool", "id", "v", "author", under, 1, 1).collect()}
        assert len(got) == len(x)
        for start in (0, 1):
            at = np.arange(start, len(x), 2)
            want = C.cut(C.agglomerate(G.distances(x[at], x[at]), "average"), len(at), under=under)
            assert same([got[i] for i in at], want) and all(got[i] == at[want == c].min() for i, c in zip(at, want))
    none = C.micro_clusters(df.limit(0), "pool", "id", "v", "author", 1.0, 1, 1)
    assert none.count() == 0


def test_light_forest():
    """Of all pairs, and of rows with columns."""
    x = np.random.default_rng(3).normal(size=(40, 3))
    d = G.distances(x, x)
    np.fill_diagonal(d, np.inf)
    want = [w for _, _, w in brute_forest(G.distances(x, x)) if w < 0.9]
    assert len(want) < 39 and np.allclose(sorted(C.light_forest(d, True, 0.9)[2]), want)
    both = np.full((40, 40), np.inf)
    both[:25, 25:] = d[:25, 25:]
    want = [w for _, _, w in brute_forest(np.minimum(both, both.T)) if w < 0.9]
    i, j, w = C.light_forest(d[:25, 25:], False, 0.9)
    assert np.allclose(sorted(w), want) and np.allclose(both[np.minimum(i, j), np.maximum(i, j)], w)
