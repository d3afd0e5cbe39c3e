"""Vectors as arrays of numbers; sums are kept in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_NORM = 1e-12


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def unit(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(LEAST_NORM))
    return F.transform(v, lambda x: x.cast("double") / norm)


def centroids(members: DataFrame, topic: str, vector: str) -> DataFrame:
    """topic, centroid (unit mean), size. Partial sums by topic and place: no list of a
    topic's members is ever built."""
    places = members.select(topic, F.posexplode(vector).alias("_at", "_x"))
    means = places.groupBy(topic, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count("*").alias("_n"))
    rows = means.groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("_at", "_m"))).alias("_v"), F.max("_n").alias("size"))
    return rows.select(topic, unit(F.transform("_v", lambda s: s["_m"])).alias("centroid"), "size")
