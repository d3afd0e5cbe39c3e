"""Queries of neighbours, clusters and manifolds over the driver's tables, with their SQL
where SQL can express them; the others are held to brute force by the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendloom.operators import clustering, graph, manifold
from trendloom.plans.queries import query, read


@query("""WITH d AS (SELECT a.vec_id AS k, b.vec_id AS b, ROUND(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 7) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, b) AS place FROM d) SELECT k AS vec_id, b AS neighbour, CAST(place AS INT) AS place FROM r WHERE place <= 10""")
def neighbour_graph(spark, sf_dir):
    """Exact, as the SQL is: of all pairs."""
    near = graph.exact_neighbours(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)
    return graph.ranked(near, "vec_id").drop("distance")


def _pooled(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").withColumn("pool", F.concat(F.lit("P"), F.col("label") % 2))


@query()
def pool_clusters(spark, sf_dir):
    return clustering.cluster_pools(_pooled(spark, sf_dir), "pool", "vec_id", "embedding", 8, 1, width=4, epsilon=0.2, most=60)


@query()
def pool_parameters(spark, sf_dir):
    out = clustering.choose_parameters(_pooled(spark, sf_dir), "pool", "vec_id", "embedding", [(0, 10, 5), (8, 10, 5), (16, 15, 10)], most_share=0.9)
    return out.withColumn("objective", F.round("objective", 6))


@query()
def micro_clusters(spark, sf_dir):
    rows = _pooled(spark, sf_dir).withColumn("author", F.col("vec_id") % 7)
    return clustering.micro_clusters(rows, "pool", "vec_id", "embedding", "author", 1.3, 4, 3)


@query("""WITH s AS (SELECT 'P' || (label % 2) AS pool, label, COUNT(*) AS n FROM embeddings GROUP BY 1, 2) SELECT pool, ROUND(SUM(n) FILTER (label > 7) / SUM(n)::DOUBLE, 9) AS noise,
  COUNT(*) FILTER (label <= 7) AS clusters, ROUND(MAX(n) FILTER (label <= 7) / SUM(n)::DOUBLE, 9) AS share FROM s GROUP BY 1""")
def pool_shares(spark, sf_dir):
    rows = _pooled(spark, sf_dir).withColumn("label", F.when(F.col("label") <= 7, F.col("label")).otherwise(-1))
    out = clustering.pool_quality(rows, "pool", "vec_id", "embedding", "label")
    return out.select("pool", F.round("noise", 9).alias("noise"), "clusters", F.round("share", 9).alias("share"))


@query()
def manifold_places(spark, sf_dir):
    """A manifold fitted on the even vectors places all of them."""
    e = read(spark, sf_dir, "embeddings")
    model, meta = manifold.fit(e.where("vec_id % 2 = 0"), "vec_id", "embedding", n_components=3)
    rows = manifold.transform(e, model, meta, "vec_id", "embedding")
    return rows.select("vec_id", F.posexplode("place").alias("axis", "x")).withColumn("x", F.round("x", 6))


@query()
def manifold_grid(spark, sf_dir):
    out = manifold.choose_manifold(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", [(3, 10, 10, 5), (3, 10, 20, 5), (5, 15, 10, 5)], most_share=0.9)
    return out.withColumns({"noise": F.round("noise", 6), "objective": F.round("objective", 6)})
