"""Similarity joins between segments and topics, and between topics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.vectors import dot
from trendloom.sources.stored import stored


#: Topics, and bytes of centroids, that are sent to every task; more are dealt in blocks of so
#: many bytes, each of which meets the segments in pieces of so many rows.
SENT_TOPICS, SENT_BYTES, PIECE_ROWS = 8192, 32 << 20, 16_384


def resolve_scope(segments: DataFrame, topics: DataFrame, scope: str, pools: tuple[str, ...]) -> DataFrame:
    """Adds scope_key: the own scope if it has topics, else the first of pools if any of
    them has, else null."""
    own = topics.select(F.col(scope).alias("_s")).distinct()
    pooled = topics.where(F.col(scope).isin(*pools)).limit(1).select(F.lit(pools[0]).alias("_p"))
    rows = segments.join(own, segments[scope] == F.col("_s"), "left").join(F.broadcast(pooled), F.lit(True), "left")
    return rows.withColumn("scope_key", F.coalesce("_s", "_p")).drop("_s", "_p")


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of unit length, and which of them are there at all."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    there = vectors.is_valid().to_numpy(zero_copy_only=False)
    flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(vectors), len(flat) // max(there.sum(), 1)))
    out[there] = flat.reshape(out[there].shape)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12), there


def _best(similarities: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the k best of each row, ties to the lesser column."""
    k = min(k, similarities.shape[1])
    if k > 16:
        at = np.argsort(-similarities, axis=1, kind="stable")[:, :k]
        return at, np.take_along_axis(similarities, at, axis=1)
    left, rows, found = similarities.copy(), np.arange(len(similarities)), []
    for _ in range(k):
        at = left.argmax(axis=1)
        found.append(at)
        left[rows, at] = -np.inf
    at = np.stack(found, axis=1)
    return at, np.take_along_axis(similarities, at, axis=1)


def _accepted(values: np.ndarray, threshold: float, margin: float) -> np.ndarray:
    """Which of the descending values count: the best from threshold on, and others that
    do too and are within margin of it."""
    return (values >= threshold) & (values >= values[:, :1] - margin)


def _by_scope(own: list | None, columns: dict, pooled: np.ndarray, n: int):
    """(rows, columns) of each scope: the columns of the topics that these rows see."""
    if own is None:
        yield np.arange(n), columns[None] if columns else np.zeros(0, int)
        return
    groups: dict = {}
    for i, name in enumerate(own):
        groups.setdefault(name if name in columns else None, []).append(i)
    for name, rows in groups.items():
        yield np.array(rows), columns[name] if name in columns else pooled


def _assign_sent(rows: DataFrame, names: pa.Array, scopes: list, matrix: np.ndarray, scope: str | None, pools: tuple[str, ...], k: int, threshold: float, margin: float, schema: str) -> DataFrame:
    """All topics in every task: one product of matrices for each batch and scope, settled
    in the batch."""
    by: dict = {}
    for column, name in enumerate(scopes):
        by.setdefault(name, []).append(column)
    columns = {name: np.array(c) for name, c in by.items()}
    pooled = np.array(sorted(c for p in pools for c in by.get(p, [])), int)

    def run(batches):
        for batch in batches:
            v, there = _matrix(batch.column("_v"))
            at, topic, value, rank = [], [], [], []
            for rows_of, seen in _by_scope(batch.column("_s").to_pylist() if scope else None, columns, pooled, len(v)):
                can = there[rows_of] if len(seen) else np.zeros(len(rows_of), bool)
                best = np.full(len(rows_of), -1.0)
                none = ~can
                if can.any():
                    found, values = _best(v[rows_of[can]] @ matrix[seen].T, k)
                    keep = _accepted(values, threshold, margin)
                    best[can] = values[:, 0]
                    none[can] = ~keep[:, 0]
                    i, r = np.nonzero(keep)
                    at.append(rows_of[can][i]), topic.append(seen[found[i, r]]), value.append(values[i, r]), rank.append(r + 1)
                at.append(rows_of[none]), topic.append(np.full(none.sum(), -1)), value.append(best[none]), rank.append(np.ones(none.sum(), int))
            at, topic, value, rank = (np.concatenate(x) if x else np.zeros(0, int) for x in (at, topic, value, rank))
            picked = pa.array(topic, pa.int64(), mask=topic < 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(pa.array(at, pa.int64())), names.take(picked), pa.array(value, pa.float64()), pa.array(rank, pa.int32())],
                names=["_id", "topic_id", "similarity", "rank"],
            )

    return rows.mapInArrow(run, schema)


def _assign_dealt(rows: DataFrame, topics: DataFrame, total_bytes: int, scope: str | None, pools: tuple[str, ...], k: int, threshold: float, margin: float) -> DataFrame:
    """Topics beyond SENT_BYTES: blocks of a scope's topics meet pieces of its segments.
    Each meeting gives the best k of its block; those of all blocks are merged."""
    blocks = total_bytes // SENT_BYTES + 1
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()))  # rows are told apart by it from here on
    if scope:
        topics = topics.withColumn("_s", F.when(F.col("_s").isin(*pools), pools[0]).otherwise(F.col("_s")))
        own, seen = rows.withColumnRenamed("_s", "_of"), topics.withColumnRenamed("_s", "_of")
        placed = resolve_scope(own, seen, "_of", pools).withColumnRenamed("scope_key", "_s").drop("_of")
    else:
        topics, placed = topics.withColumn("_s", F.lit("")), rows.withColumn("_s", F.lit(""))
    topics = topics.withColumn("_b", F.pmod(F.xxhash64("topic_id"), F.lit(blocks)))
    pieces = rows.agg(F.count("*")).first()[0] // PIECE_ROWS + 1
    placed = placed.withColumn("_p", F.pmod(F.xxhash64("_row"), F.lit(pieces)))
    there = topics.groupBy("_s", "_b").agg(F.count("*").alias("_n")).drop("_n")
    left = placed.where("_v is not null").select("_row", "_s", "_p", "_v").join(F.broadcast(there), "_s")  # a row for each block
    right = topics.join(placed.select("_s", "_p").distinct(), "_s").select("_s", "_b", "_p", "topic_id", "centroid")

    def meet(part: pa.Table, block: pa.Table) -> pa.Table:
        names = pa.array([], pa.int64())
        if part.num_rows and block.num_rows:
            block = block.sort_by("topic_id")
            v, _ = _matrix(part["_v"])
            matrix = np.array(block["centroid"].to_pylist(), float)
            found, values = _best(v @ matrix.T, k)
            i = np.repeat(np.arange(len(v)), found.shape[1])
            return pa.table({"_row": part["_row"].take(pa.array(i)), "topic_id": block["topic_id"].take(pa.array(found.ravel())), "similarity": pa.array(values.ravel())})
        return pa.table({"_row": names, "topic_id": block["topic_id"].slice(0, 0), "similarity": pa.array([], pa.float64())})

    kind = topics.schema["topic_id"].dataType.simpleString()
    keys = ["_s", "_b", "_p"]
    left, right = (t.select(*[F.col(c).alias(c) for c in t.columns]) for t in (left, right))  # columns of their own
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"_row long, topic_id {kind}, similarity double")
    order = Window.partitionBy("_row").orderBy(F.desc("similarity"), "topic_id")  # blocks times k rows
    ranked = met.withColumns({"rank": F.row_number().over(order), "_best": F.max("similarity").over(Window.partitionBy("_row"))}).where(F.col("rank") <= k)
    fits = (F.col("similarity") >= threshold) & (F.col("similarity") >= F.col("_best") - margin)
    kept = ranked.where(fits | (F.col("rank") == 1)).withColumn("topic_id", F.when(fits, F.col("topic_id"))).drop("_best")
    out = rows.select(F.col("_row").alias("_row"), "_id").join(kept, "_row", "left")
    return out.select("_id", "topic_id", F.coalesce("similarity", F.lit(-1.0)).alias("similarity"), F.coalesce("rank", F.lit(1)).cast("int").alias("rank"))


def assign_topics(
    segments: DataFrame, topics: DataFrame, segment_id: str, vector: str, threshold: float, k: int = 2, margin: float = 0.05, scope: str | None = None,
    pools: tuple[str, ...] = ("__POOL__",),
) -> DataFrame:
    """segment_id, topic_id, similarity, rank, assignment_type of every row: the best
    topic if it reaches threshold and up to k - 1 more, as long as each does and is within
    margin of the best (EXISTING); else one row without a topic, with the best similarity
    (UNASSIGNED). topics has topic_id and centroid (of unit length), and the scope if
    named: a segment sees the topics of its scope, those of the pools if that has none,
    and none (similarity -1) if they have none either. A null vector sees none. Ties go to
    the lesser topic_id. Rows that repeat a segment_id are assigned each for itself.

    Up to SENT_TOPICS centroids of up to SENT_BYTES are sent to the tasks; more are dealt in
    blocks, under the same rule."""
    text = lambda c: F.col(c).cast("string").alias("_s")
    rows = segments.select(F.col(segment_id).alias("_id"), F.col(vector).alias("_v"), *([text(scope)] if scope else []))
    topics = topics.select("topic_id", "centroid", *([text(scope)] if scope else []))
    few = topics.limit(SENT_TOPICS + 1).toArrow()
    if few.num_rows > SENT_TOPICS or few.nbytes > SENT_BYTES:
        topics = stored(topics)
        size = topics.agg(F.sum(F.size("centroid").cast("long") * 8 + 64)).first()[0]
        out = _assign_dealt(rows, topics, size, scope, pools, k, threshold, margin)
    else:
        few = few.sort_by("topic_id")
        matrix = np.array(few["centroid"].to_pylist(), float)
        kinds = (segments.schema[segment_id].dataType.simpleString(), topics.schema["topic_id"].dataType.simpleString())
        schema = f"_id {kinds[0]}, topic_id {kinds[1]}, similarity double, rank int"
        scopes = few["_s"].to_pylist() if scope else [None] * few.num_rows
        out = _assign_sent(rows, few["topic_id"].combine_chunks(), scopes, matrix, "_s" if scope else None, pools, k, threshold, margin, schema)
    kind = F.when(F.col("topic_id").isNull(), "UNASSIGNED").otherwise("EXISTING")
    return out.select(F.col("_id").alias(segment_id), "topic_id", "similarity", "rank", kind.alias("assignment_type"))


def topic_pairs(topics: DataFrame, least: float, scope: str | None = None) -> DataFrame:
    """a, b, similarity of topics of one scope (a < b) at or over least."""
    one = topics.select(F.col("topic_id").alias("a"), F.col("centroid").alias("_ca"), *([F.col(scope).alias("_s")] if scope else []))
    two = topics.select(F.col("topic_id").alias("b"), F.col("centroid").alias("_cb"), *([F.col(scope).alias("_t")] if scope else []))
    pairs = one.join(two, (F.col("a") < F.col("b")) & ((F.col("_s") == F.col("_t")) if scope else F.lit(True)))
    return pairs.select("a", "b", dot(F.col("_ca"), F.col("_cb")).alias("similarity")).where(F.col("similarity") >= least)


def containment(members: DataFrame, topic: str, record: str) -> DataFrame:
    """a, b, common, containment: shared distinct records over the lesser topic's."""
    rows = members.select(F.col(topic).alias("t"), F.col(record).alias("r")).distinct()
    sizes = rows.groupBy("t").agg(F.count("*").alias("n"))
    shared = rows.withColumnRenamed("t", "a").join(rows.withColumnRenamed("t", "b"), "r").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    shared = shared.join(sizes.withColumnsRenamed({"t": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"t": "b", "n": "nb"}), "b")
    return shared.select("a", "b", "common", (F.col("common") / F.least("na", "nb")).alias("containment"))


def similarity_bands(pairs: DataFrame) -> DataFrame:
    """One row: pairs of one scope in the bands [.80, .85), [.85, .92) and from .92."""
    s = F.col("similarity")
    return pairs.agg(
        F.count_if((s >= 0.8) & (s < 0.85)).alias("weak"), F.count_if((s >= 0.85) & (s < 0.92)).alias("middle"), F.count_if(s >= 0.92).alias("strong"),
    )


def adjusted_information(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ami, the adjusted mutual information of two labellings (mean of the
    entropies as the norm). What chance gives depends on clusters' sizes only, so each two
    sizes that occur are reckoned once, in tasks."""
    cells = stored(pairs.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n")))
    sides = [stored(cells.groupBy(c).agg(F.sum("n").alias("s"))) for c in ("x", "y")]
    total = F.broadcast(cells.agg(F.sum("n").alias("t")))  # one row
    rows = cells.join(sides[0].withColumnRenamed("s", "sx"), "x").join(sides[1].withColumnRenamed("s", "sy"), "y").crossJoin(total)
    shared = rows.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("sx").cast("double") * F.col("sy")))).alias("shared"))
    share = F.col("s") / F.col("t")
    entropy = [s.crossJoin(total).agg((-F.sum(share * F.log(share))).alias(name)) for s, name in zip(sides, ("hx", "hy"))]
    sizes = [s.groupBy("s").agg(F.count("*").alias("c")).select(F.col("s").alias(f"s{n}"), F.col("c").alias(f"c{n}")) for s, n in zip(sides, "xy")]
    by_size = sizes[0].crossJoin(F.broadcast(sizes[1])).crossJoin(total).repartition("sx", "sy")  # sizes: about sqrt(2 t) differ at most

    def chance(batches):
        from math import lgamma

        for batch in batches:
            out = []
            for x, y, t, times in zip(*(batch.column(c).to_pylist() for c in ("sx", "sy", "t", "times"))):
                k = np.arange(max(1, x + y - t), min(x, y) + 1)
                log = np.vectorize(lambda v: lgamma(v + 1), otypes=[float])
                p = lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - log(k) - log(x - k) - log(y - k) - log(t - x - y + k)
                out.append(times * float((k / t * (np.log(t) + np.log(k) - np.log(x) - np.log(y)) * np.exp(p)).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["e"])

    expected = by_size.select("sx", "sy", "t", (F.col("cx") * F.col("cy")).alias("times")).mapInArrow(chance, "e double").agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("e"))
    one = shared.crossJoin(entropy[0]).crossJoin(entropy[1]).crossJoin(expected)  # one row each
    norm = (F.col("hx") + F.col("hy")) / 2 - F.col("e")
    return one.select(F.when(F.abs(norm) > 1e-15, (F.col("shared") - F.col("e")) / norm).otherwise(1.0).alias("ami"))


def rand_index(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n and the adjusted Rand index of two labellings, from the contingency
    table."""
    two = lambda n: n * (n - 1) / 2
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    by_a = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"))
    by_b = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    both = cells.agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("sc"))
    all3 = both.crossJoin(by_a).crossJoin(by_b)  # one row each
    expected = F.col("sa") * F.col("sb") / two(F.col("n"))
    return all3.select("n", ((F.col("sc") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)).alias("ari"))
