"""Frozen manifolds: fitted on a bounded sample, kept as a table, and used to place any row.

The sample's neighbour graph and its fuzzy edges come from joins and leaves (graph.py).
Only the layout of the sample, of ``SAMPLE`` rows at most or so, is one task. Every other
row is placed by the weighted mean of its neighbours in the sample, which is the same each
time and needs nothing but the model.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.vectors import unit
from trendloom.operators import graph
from trendloom.operators.audits import drift
from trendloom.operators.graph import distances, matrix
from trendloom.sources.stored import stored

#: Rows of a scope that a manifold is fitted on, about; bytes of a model that tasks are sent; rows
#: whose distances to all of the sample a task holds at once.
SAMPLE, MODEL_BYTES, STEP_ROWS = 5000, 128 << 20, 128
#: What a saved manifold and a run must have in common.
KEYS = ("embedding_model", "input_dimension", "n_components", "n_neighbors", "min_dist", "densmap", "scope")
GLOBAL = "__global__"


def _smooth(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ascending distances, the nearest one over 0 and the width at which
    exp(-(d - nearest) / width) sum up to log2 of their number, by halving."""
    k = d.shape[1]
    near = np.where(d > 0, d, np.inf).min(axis=1)
    near = np.where(np.isfinite(near), near, 0.0)
    low, high, width = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(64):
        much = np.exp(-np.maximum(d - near[:, None], 0) / width[:, None]).sum(axis=1) > np.log2(k)
        high, low = np.where(much, width, high), np.where(much, low, width)
        width = np.where(np.isinf(high), width * 2, (low + high) / 2)
    return near, np.maximum(width, 1e-3 * np.maximum(d.mean(axis=1), 1e-12))


def fuzzy_edges(near: DataFrame) -> DataFrame:
    """_s, a, b, w (a < b) of neighbour lists (_s, _k, near): the chance that either of
    two rows holds the other for a neighbour."""

    def weigh(batches):
        for batch in batches:
            keys, lists = batch.column("_k"), batch.column("near").to_pylist()
            rows = []
            for i, found in enumerate(lists):
                d = np.array([[x["d"] for x in found]])
                close, width = _smooth(d)
                rows += [(i, x["b"], float(w)) for x, w in zip(found, np.exp(-np.maximum(d[0] - close[0], 0) / width[0]))]
            i, b, w = zip(*rows) if rows else ((), (), ())
            at = pa.array(i, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("_s").take(at), keys.take(at), pa.array(b, keys.type), pa.array(w, pa.float64())], names=["_s", "x", "y", "w"])

    kind = near.schema["_k"].dataType.simpleString()
    ways = near.where(F.size("near") > 0).mapInArrow(weigh, f"_s string, x {kind}, y {kind}, w double")
    both = ways.groupBy("_s", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("_t"), F.product("w").alias("_p"), F.count("*").alias("_n"))
    return both.select("_s", "a", "b", (F.col("_t") - F.when(F.col("_n") == 2, F.col("_p")).otherwise(0.0)).alias("w"))


def _layout(x: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, width: int, spread: float, seed: int, rounds: int = 150) -> np.ndarray:
    """Places of the sample: from its principal axes, edges pull by their weight and random
    others push, by ever smaller steps."""
    rng = np.random.default_rng(seed)
    centred = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:width] * np.sign(axes[np.arange(min(width, len(axes))), np.abs(axes[:width]).argmax(axis=1)])[:, None]
    y = centred @ axes.T
    y = np.pad(y, ((0, 0), (0, width - y.shape[1]))) if y.shape[1] < width else y
    y = 10 * y / max(np.abs(y).max(), 1e-12) + rng.normal(scale=1e-4, size=y.shape)
    n = len(x)
    i, j, w = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w])
    b = 1.0 / (1.0 + spread)
    for step in range(rounds):
        rate = 1.0 - step / rounds
        taken = rng.random(len(w)) < w
        p, q = i[taken], j[taken]
        gap = y[p] - y[q]
        square = (gap * gap).sum(axis=1, keepdims=True)
        pull = np.clip(-2 * b * gap / (1 + square), -4, 4)
        away = rng.integers(0, n, size=len(p))
        other = y[p] - y[away]
        far = (other * other).sum(axis=1, keepdims=True)
        push = np.clip(2 * b * other / ((0.01 + far) * (1 + far)), -4, 4) * (away != p)[:, None]
        move = np.zeros_like(y)
        np.add.at(move, p, pull + push)
        y += rate * np.clip(move, -4, 4)
    return y


def fit(rows: DataFrame, key: str, vector: str, scope: str | None = None, n_components: int = 5, n_neighbors: int = 15, min_dist: float = 0.0, densmap: bool = False, embedding_model: str = "given", seed: int = 42) -> tuple[DataFrame, dict]:
    """The model, a table _s, _k, _v (unit length), place of the sample (about SAMPLE rows
    of each scope, drawn by a hash of the key), and what it was made with (KEYS). Scopes
    are manifolds of their own; without one, there is one manifold."""
    base = rows.where(F.col(vector).isNotNull()).select((F.col(scope).cast("string") if scope else F.lit(GLOBAL)).alias("_s"), F.col(key).alias("_k"), unit(F.col(vector)).alias("_v"))
    sizes = base.groupBy("_s").agg(F.count("*").alias("_n"))
    drawn = F.pmod(F.xxhash64("_k", F.lit(13)), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("_n")
    some = stored(base.join(sizes, "_s").where(drawn).drop("_n"))
    near = graph.neighbours(graph.leaves(some, "_k", "_v", "_s"), n_neighbors)
    edges = stored(fuzzy_edges(near))

    def settle(part: pa.Table, links: pa.Table) -> pa.Table:
        part = part.sort_by("_k")
        at = pd.Index(part["_k"].to_pandas())
        links = links.sort_by([("a", "ascending"), ("b", "ascending")])
        i, j = (at.get_indexer(links[c].to_pandas()) for c in ("a", "b"))
        y = _layout(matrix(part["_v"]), i, j, links["w"].to_numpy(), n_components, min_dist, seed)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
        return part.select(["_s", "_k", "_v"]).append_column("place", lists)

    kind = base.schema["_k"].dataType.simpleString()
    model = stored(some.groupBy("_s").cogroup(edges.groupBy("_s")).applyInArrow(settle, f"_s string, _k {kind}, _v array<double>, place array<double>"))
    width = some.agg(F.max(F.size("_v"))).first()[0] or 0
    meta = dict(zip(KEYS, (embedding_model, width, n_components, n_neighbors, min_dist, bool(densmap), scope or "global")))
    return model, meta


def transform(rows: DataFrame, model: DataFrame, meta: dict, key: str, vector: str, scope: str | None = None) -> DataFrame:
    """key, place of every row: the mean of the places of its neighbours in the sample,
    weighted like edges. A scope without a manifold takes the global one, else the first;
    a null vector has no place. Each row depends on itself and the model alone. A densmap
    model places no rows but its own: it is refused."""
    if meta.get("densmap"):
        raise ValueError("a densMAP model can't place other rows")
    size = model.agg(F.sum((F.size("_v") + F.size("place")).cast("long") * 8)).first()[0] or 0
    if size > MODEL_BYTES:
        raise ValueError(f"the model has {size} bytes; {MODEL_BYTES} are sent to tasks at most")
    table = model.orderBy("_s", "_k").toArrow()  # MODEL_BYTES at most
    held: dict = {}
    for name in sorted(set(table["_s"].to_pylist())):
        part = table.filter(pa.compute.equal(table["_s"], name))
        held[name] = (matrix(part["_v"]), matrix(part["place"]))
    k = int(meta["n_neighbors"])
    first = GLOBAL if GLOBAL in held else next(iter(held), None)

    def place(batches):
        for batch in batches:
            there = batch.column("_v").is_valid().to_numpy(zero_copy_only=False)
            names = batch.column("_s").to_pylist()
            places: list = [None] * batch.num_rows
            groups: dict = {}
            for at, name in enumerate(names):
                if there[at] and held:
                    groups.setdefault(name if name in held else first, []).append(at)
            for name, rows_of in groups.items():
                x, y = held[name]
                for lo in range(0, len(rows_of), STEP_ROWS):
                    at = rows_of[lo : lo + STEP_ROWS]
                    d = distances(matrix(batch.column("_v").take(pa.array(at))), x)
                    near = np.argsort(d, axis=1, kind="stable")[:, :k]
                    some = np.take_along_axis(d, near, axis=1)
                    close, width = _smooth(some)
                    w = np.exp(-np.maximum(some - close[:, None], 0) / width[:, None])
                    for i, p in zip(at, (w[:, :, None] * y[near]).sum(axis=1) / w.sum(axis=1, keepdims=True)):
                        places[i] = p.tolist()
            yield pa.RecordBatch.from_arrays([batch.column("_k"), pa.array(places, pa.list_(pa.float64()))], names=["_k", "place"])

    named = rows.select(F.col(key).alias("_k"), (F.col(scope).cast("string") if scope else F.lit(GLOBAL)).alias("_s"), F.when(F.col(vector).isNotNull(), unit(F.col(vector))).alias("_v"))
    kind = rows.schema[key].dataType.simpleString()
    return named.mapInArrow(place, f"_k {kind}, place array<double>").withColumnRenamed("_k", key)


# The store: folders of versions, and one small file that names the current one.


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def current(spark: SparkSession, store: str) -> tuple[DataFrame, dict] | None:
    """The current model of a store with what it was made with; none in an empty one."""
    files, pointer = _file(spark, f"{store}/CURRENT")
    if not files.exists(pointer):
        return None
    meta = json.loads(spark.read.text(f"{store}/CURRENT").first()["value"])
    return spark.read.parquet(f"{store}/{meta['version']}"), meta


def save(model: DataFrame, meta: dict, store: str) -> dict:
    """Writes a new version, and only then lets CURRENT name it, by one rename: a reader
    finds the old version or the new one whole. The old version stays for its readers."""
    spark = model.sparkSession
    meta = {**meta, "version": f"v-{uuid.uuid4().hex}"}
    model.write.parquet(f"{store}/{meta['version']}")
    draft = f"{store}/.{meta['version']}.draft"
    files, target = _file(spark, draft)
    out = files.create(target, True)
    out.write(bytearray(json.dumps(meta).encode()))
    out.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(target, _file(spark, f"{store}/CURRENT")[1], options)
    return meta


def mismatch(meta: dict, wanted: dict) -> str | None:
    """The first of KEYS in which a saved model isn't what a run asks for; keys that the
    model doesn't tell are taken on trust."""
    return next((f"{k}: model has {meta[k]!r}, run asks for {wanted[k]!r}" for k in KEYS if meta.get(k) is not None and meta[k] != wanted[k]), None)


def get_or_fit(rows: DataFrame, store: str, key: str, vector: str, scope: str | None = None, most_drift: float = 0.0, refit: bool = False, **parameters) -> tuple[DataFrame, dict, str]:
    """The model to use, what it was made with, and why: reused, fitted (there was none),
    refit (asked for) or drifted (the mean distance of rows to the model's sample is over
    most_drift, if that is over 0). A model that was made otherwise is refused, not
    replaced, unless a refit is asked for. densmap models are fitted anew each time and
    never stored."""
    spark = rows.sparkSession
    wanted = {"embedding_model": "given", "n_components": 5, "n_neighbors": 15, "min_dist": 0.0, "densmap": False} | {k: v for k, v in parameters.items() if k in KEYS}
    if wanted["densmap"]:
        return *fit(rows, key, vector, scope, **parameters), "fitted"
    found = None if refit else current(spark, store)
    why = "refit" if refit else "fitted"
    if found:
        model, meta = found
        sizes = rows.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).limit(1).collect()
        wanted |= {"input_dimension": sizes[0]["n"] if sizes else meta["input_dimension"], "scope": scope or "global"}
        wrong = mismatch(meta, wanted)
        if wrong:
            raise ValueError(wrong)
        measured = None
        if most_drift > 0 and sizes:
            probes = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"))
            measured = drift(probes, model.select("_k", "_v"), "_k", "_v").first()["drift"]
        if measured is None or measured <= most_drift:
            return model, meta, "reused"
        why, parameters = "drifted", parameters
    model, meta = fit(rows, key, vector, scope, **parameters)
    if why == "drifted":
        meta["refit_trigger"] = {"measured": round(measured, 5), "threshold": most_drift}
    meta = save(model, meta, store)
    return spark.read.parquet(f"{store}/{meta['version']}"), meta, why


def choose_manifold(rows: DataFrame, key: str, vector: str, grid: list[tuple[int, int, int, int]], most_share: float = 0.5, noise_weight: float = 0.35) -> DataFrame:
    """n_components, n_neighbors, least, samples, clusters, noise, objective of each choice
    of the grid, the best first: density clusters of the placed rows, judged like
    clustering.choose_parameters() by the silhouette in the full space. A choice with fewer
    than two clusters, or one of over most_share, comes last, without a value. Tried on
    about clustering.TRIAL_ROWS rows, drawn by a hash of the key."""
    from trendloom.operators import clustering

    n = F.broadcast(rows.agg(F.count("*").alias("_n")))  # one row
    drawn = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) < F.lit(float(clustering.TRIAL_ROWS << 30)) / F.col("_n")
    some = stored(rows.crossJoin(n).where(drawn).select(F.lit(GLOBAL).alias("_pool"), key, vector))
    placed: dict[tuple[int, int], DataFrame] = {}
    tried = []
    for width, near, least, samples in grid:
        if (width, near) not in placed:
            model, meta = fit(some, key, vector, n_components=width, n_neighbors=near)
            placed[(width, near)] = stored(transform(some, model, meta, key, vector).join(some, key))
        labelled = clustering.cluster_pools(placed[(width, near)], "_pool", key, "place", least, samples).join(some.select(key, vector), key)
        q = clustering.pool_quality(labelled, "_pool", key, vector, "label").first()
        good = q is not None and q["clusters"] >= 2 and q["share"] <= most_share and q["silhouette"] is not None
        value = float(q["silhouette"] + 0.1 * np.log1p(q["clusters"]) - noise_weight * q["noise"]) if good else None
        tried.append((width, near, least, samples, q["clusters"] if q else 0, q["noise"] if q else 1.0, value))
    schema = "n_components int, n_neighbors int, least int, samples int, clusters long, noise double, objective double"
    return rows.sparkSession.createDataFrame(sorted(tried, key=lambda t: (t[6] is None, -(t[6] or 0.0), t[:4])), schema)
