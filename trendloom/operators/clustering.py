"""Topics from vectors, pool by pool: density clusters, merges by distance, splits,
micro-clusters, groups, quality and the choice of parameters.

Vectors stay in Spark: neighbours, reachability and the spanning forest come from joins and
leaves of bounded size (graph.py), so every row of a pool of any size gets a label. What
one task settles are summaries: a pool's spanning forest as numbers (three a row), the
centres of its clusters, and at most about ``MARKS`` landmarks of a group, each of which
stands for the rows nearest to it (in a group of up to MARKS, every row is its own).
Micro-clusters know no landmarks: their average linkage is that of all pairs of rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.vectors import dot, unit
from trendloom.operators import graph
from trendloom.operators.graph import distances, matrix
from trendloom.sources.stored import stored

#: Landmarks of a group; rows that meet them at once; points of a silhouette; rows of a pool
#: that a choice of parameters is made on; neighbours of a row in the graph at least.
MARKS, PIECE_ROWS, SILHOUETTE_POINTS, TRIAL_ROWS, NEAR = 1500, 16_384, 5000, 20_000, 15
#: Of an average linkage: clusters and rows that one task finishes at most, clusters and rows of
#: a block of all pairs, blocks at least, and distances that a task holds at once.
GROUP_CLUSTERS, GROUP_ROWS, BLOCK_CLUSTERS, BLOCK_ROWS, BLOCKS, STEP_CELLS = 4000, 32_768, 3000, 32_768, 4, 1 << 19


def condensed_labels(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, least: int, most: int = 0) -> np.ndarray:
    """Hierarchical density clusters of n points from the edges of their spanning forest,
    lightest first: of the tree of clusters of ``least`` points or more, those of the
    greatest excess of mass that are no larger than ``most`` (0: any). The tree's root is
    no cluster; -1 is noise. Parts without an edge between them part at the root."""
    labels = np.full(n, -1)
    if n < max(2, least):
        return labels
    # The dendrogram: node i < n is a point, n + j the j-th merge.
    top, children, height, size = list(range(n)), {}, {}, [1] * n

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    def meet(i: int, j: int, at: float) -> None:
        node = len(size)
        children[node], height[node] = (i, j), at
        size.append(size[i] + size[j])
        top.append(node)
        top[i] = top[j] = node

    for i, j, at in zip(a.tolist(), b.tolist(), w.tolist()):
        meet(find(i), find(j), at)
    roots = sorted({find(i) for i in range(n)})
    for r in roots[1:]:
        meet(find(roots[0]), r, np.inf)
    # Condensed: a cluster lives until both sides of a split are large enough.
    parent, born, mass, members = [-1], [0.0], [0.0], [size[-1]]
    fell = np.zeros(n, int)  # the cluster that each point left
    stack = [(len(size) - 1, 0)]
    while stack:
        node, cluster = stack.pop()
        if node < n:
            fell[node] = cluster
            continue
        rate = 1 / height[node] if height[node] > 0 else 1e12
        large = [c for c in children[node] if size[c] >= least]
        for c in children[node]:
            if len(large) == 2:
                mass[cluster] += size[c] * (rate - born[cluster])
                stack.append((c, len(parent)))
                parent.append(cluster)
                born.append(rate)
                mass.append(0.0)
                members.append(size[c])
            elif c in large:
                stack.append((c, cluster))
            else:
                mass[cluster] += size[c] * (rate - born[cluster])
                below = [c]
                while below:
                    p = below.pop()
                    if p < n:
                        fell[p] = cluster
                    else:
                        below += children[p]
    below = [0.0] * len(parent)
    chosen = [False] * len(parent)
    for c in range(len(parent) - 1, 0, -1):
        chosen[c] = mass[c] >= below[c] and not (most and members[c] > most)
        below[parent[c]] += mass[c] if chosen[c] else below[c]
    owner = [-1] * len(parent)
    for c in range(1, len(parent)):
        owner[c] = owner[parent[c]] if owner[parent[c]] >= 0 else c if chosen[c] else -1
    owned = np.array(owner)[fell]
    for new, c in enumerate(sorted({*owned[owned >= 0]})):
        labels[owned == c] = new
    return labels


def agglomerate(d: np.ndarray, kind: str, weights: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """(height, i, j) of all merges, lowest first, by chains of nearest neighbours; kind
    is average, complete or ward (squared distances in, squared heights out). i and j
    are the least points of the two clusters. With weights, a point stands for so many
    (for ward, d has their factor 2 u v / (u + v) already)."""
    d = d.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n) if weights is None else weights.astype(float).copy(), np.ones(n, bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            i = chain[-1]
            j = int(np.where(alive, d[i], np.inf).argmin())
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        del chain[-2:]
        lo, hi = min(i, j), max(i, j)
        height = d[i, j]
        merges.append((float(height), lo, hi))
        if kind == "complete":
            row = np.maximum(d[i], d[j])
        elif kind == "average":
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        else:
            row = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * height) / (size[i] + size[j] + size)
        d[lo], d[:, lo] = row, row
        d[lo, lo] = np.inf
        alive[hi] = False
        d[hi], d[:, hi] = np.inf, np.inf
        size[lo] += size[hi]
    return sorted(merges)


def cut(merges: list[tuple[float, int, int]], n: int, clusters: int = 1, under: float = np.inf) -> np.ndarray:
    """Labels after the lowest merges, down to so many clusters, of heights under a bound."""
    top = list(range(n))

    def find(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    for h, i, j in merges[: n - clusters]:
        if h < under:
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def _mean(vector: str):
    return vector_to_array(Summarizer.mean(array_to_vector(vector)))


def _reduced(rows: DataFrame, width: int) -> DataFrame:
    """_s, _k, _x: coordinates along the first ``width`` axes of each scope's greatest
    variance, each axis with its largest part positive; the vector itself where it has too
    few places or the scope too few rows. Scopes are summed up in tasks: rows never meet."""
    if width <= 0:
        return rows.select("_s", "_k", F.col("_v").alias("_x"))

    def sums(batches):
        for batch in batches:
            x, by = matrix(batch.column("_v")), pd.Series(range(batch.num_rows)).groupby(batch.column("_s").to_pandas())
            parts = [(name, len(at), x[at].sum(axis=0), (x[at].T @ x[at]).ravel()) for name, at in ((k, v.to_numpy()) for k, v in by)]
            yield pa.RecordBatch.from_pylist([{"_s": s, "n": n, "one": one.tolist(), "two": two.tolist()} for s, n, one, two in parts], pa.schema([("_s", pa.string()), ("n", pa.int64()), ("one", pa.list_(pa.float64())), ("two", pa.list_(pa.float64()))]))

    def axes(part: pd.DataFrame) -> pd.DataFrame:
        n, mean = part["n"].sum(), np.stack(part["one"]).sum(axis=0) / part["n"].sum()
        if width >= min(n, len(mean)):
            return pd.DataFrame({"_s": part["_s"].iloc[:1], "mean": [mean.tolist()], "axes": [None]})
        spread = np.stack(part["two"]).sum(axis=0).reshape(len(mean), -1) / n - np.outer(mean, mean)
        found = np.linalg.eigh(spread)[1][:, ::-1][:, :width].T
        found = found * np.sign(found[np.arange(width), np.abs(found).argmax(axis=1)])[:, None]
        return pd.DataFrame({"_s": part["_s"].iloc[:1], "mean": [mean.tolist()], "axes": [found.tolist()]})

    sums_of = rows.select("_s", "_v").mapInArrow(sums, "_s string, n long, one array<double>, two array<double>")
    found = sums_of.groupBy("_s").applyInPandas(axes, "_s string, mean array<double>, axes array<array<double>>")  # a row for each batch
    centred = F.zip_with("_v", "mean", lambda x, m: x - m)
    return rows.join(stored(found), "_s").select("_s", "_k", F.when(F.col("axes").isNull(), F.col("_v")).otherwise(F.transform("axes", lambda a: dot(a, centred))).alias("_x"))


def _named(rows: DataFrame, scope: str, key: str, vector: str) -> DataFrame:
    return rows.where(F.col(vector).isNotNull()).select(F.col(scope).cast("string").alias("_s"), F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"))


def density_clusters(rows: DataFrame, least: int, samples: int, most: int = 0) -> DataFrame:
    """_s, _k, label of all rows of _s, _k, _x."""
    table = graph.leaves(rows, "_k", "_x", "_s")
    near = graph.neighbours(table, max(samples, NEAR))
    forest = graph.spanning_forest(graph.reachability_edges(table, near, samples))

    def settle(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        nodes, edges = nodes.sort_by("_k"), edges.sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")])
        place = pd.Index(nodes["_k"].to_pandas())
        ends = [place.get_indexer(edges[c].to_pandas()) for c in ("a", "b")]
        labels = condensed_labels(*ends, edges["w"].to_numpy(), nodes.num_rows, least, most)
        return nodes.select(["_s", "_k"]).append_column("label", pa.array(labels, pa.int64()))

    kind = rows.schema["_k"].dataType.simpleString()
    return stored(rows.select("_s", "_k").groupBy("_s").cogroup(forest.groupBy("_s")).applyInArrow(settle, f"_s string, _k {kind}, label long"))


def close_centres(centres: np.ndarray, epsilon: float) -> np.ndarray:
    """For each centre, the least one that it becomes one with: those nearer than epsilon
    times the median distance between centres, along chains too."""
    into = np.arange(len(centres))
    if epsilon <= 0 or len(centres) < 2:
        return into
    d = distances(centres, centres)
    i, j = np.triu_indices(len(centres), 1)
    scale = np.median(d[i, j])
    for x, y in zip(i, j):
        if scale > 0 and d[x, y] < epsilon * scale:
            into = np.where((into == into[x]) | (into == into[y]), min(into[x], into[y]), into)
    return into


def merge_close(rows: DataFrame, epsilon: float) -> DataFrame:
    """_s, label, into of the clusters of _s, _x, label (-1 is none)."""
    centres = rows.where("label >= 0").groupBy("_s", "label").agg(_mean("_x").alias("c"))

    def settle(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("label")
        into = close_centres(np.stack(table["c"]), epsilon)
        return pd.DataFrame({"_s": table["_s"], "label": table["label"], "into": table["label"].to_numpy()[into]})

    return centres.groupBy("_s").applyInPandas(settle, "_s string, label long, into long")


def landmarks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of groups (_g, _k, _x): _g, _k, mark of all rows, and _g, mark, c, n of the marks,
    about MARKS of a group at most: drawn by a hash of the key, each with the mean and the
    number of the rows nearest to it."""
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_n"))
    drawn = F.pmod(F.xxhash64("_k", F.lit(29)), F.lit(1 << 30)) < F.lit(float(MARKS << 30)) / F.col("_n")
    placed = stored(rows.join(sizes, "_g").withColumns({"_m": drawn, "_p": F.pmod(F.xxhash64("_k"), F.ceil(F.col("_n") / PIECE_ROWS))}))
    pieces = placed.select("_g", "_p").distinct()
    marks = placed.where("_m").select("_g", F.col("_k").alias("mark"), F.col("_x").alias("c")).join(pieces, "_g")
    kind = rows.schema["_k"].dataType.simpleString()

    def near(part: pa.Table, some: pa.Table) -> pa.Table:
        some = some.sort_by("mark")
        at = np.concatenate([distances(matrix(part["_x"].slice(lo, 4096)), matrix(some["c"])).argmin(axis=1) for lo in range(0, part.num_rows, 4096)] or [np.zeros(0, int)])
        return pa.table({"_g": part["_g"], "_k": part["_k"], "mark": some["mark"].take(pa.array(at))})

    mine = placed.where("_m").select("_g", "_k", F.col("_k").alias("mark"))
    marks = marks.select(*[F.col(c).alias(c) for c in marks.columns])  # columns of their own
    others = placed.where("not _m").groupBy("_g", "_p").cogroup(marks.groupBy("_g", "_p")).applyInArrow(lambda a, b: near(a, b) if a.num_rows else near(a, b.slice(0, 0)), f"_g string, _k {kind}, mark {kind}")
    owned = stored(mine.unionByName(others))
    means = placed.select("_g", "_k", "_x").join(owned, ["_g", "_k"]).groupBy("_g", "mark").agg(_mean("_x").alias("c"), F.count("*").alias("n"))
    return owned, means


def linked(rows: DataFrame, kind: str, under: float = np.inf, children=None) -> DataFrame:
    """_g, _k, child of groups (_g, _k, _x): the linkage of their landmarks, cut at heights
    under a bound or into children(size) parts."""
    owned, means = landmarks(rows)

    def settle(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("mark")
        x, n = np.stack(table["c"]), table["n"].to_numpy(float)
        d = distances(x, x)
        if kind == "ward":
            d = d**2 * 2 * np.outer(n, n) / (n[:, None] + n[None, :])
        labels = cut(agglomerate(d, kind, n), len(x), children(int(n.sum())) if children else 1, under) if len(x) > 1 else np.zeros(len(x), int)
        return pd.DataFrame({"_g": table["_g"], "mark": table["mark"], "child": labels})

    key = rows.schema["_k"].dataType.simpleString()
    parts = means.groupBy("_g").applyInPandas(settle, f"_g string, mark {key}, child long")
    return owned.join(parts, ["_g", "mark"]).select("_g", "_k", "child")


def split_large(rows: DataFrame, most: int, alike: float = 0.0, least_children: int = 2) -> DataFrame:
    """_s, _k, label, child of rows _s, _k, _v, _x, label: clusters over most points become
    about size / most children of ten or more points on the average, by Ward's criterion; not
    where two children's centres of vectors are alike. Others are one child, 0."""
    number = lambda n: min(max(least_children, round(n / most)), n // 10)
    sizes = rows.where("label >= 0").groupBy("_s", "label").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    large = stored(sizes.where(F.least(F.greatest(F.lit(least_children), F.rint(F.col("_n") / most)), F.floor(F.col("_n") / 10)) >= least_children).select("_s", "label", F.to_json(F.struct("_s", "label")).alias("_g")))
    inside = stored(rows.join(large, ["_s", "label"]))
    parts = stored(linked(inside.select("_g", "_k", "_x"), "ward", children=number))
    if alike > 0:
        centres = inside.join(parts, ["_g", "_k"]).groupBy("_g", "child").agg(_mean("_v").alias("c")).select("_g", "child", unit(F.col("c")).alias("c"))
        other = centres.select("_g", F.col("child").alias("_o"), F.col("c").alias("_c"))
        same = centres.join(other, "_g").where("child < _o").where(dot(F.col("c"), F.col("_c")) >= alike).select("_g").distinct()
        parts = parts.join(same, "_g", "left_anti")
    found = parts.join(large, "_g").select("_s", "_k", F.col("child").cast("long").alias("child"))
    return rows.join(found, ["_s", "_k"], "left").select("_s", "_k", "label", F.coalesce("child", F.lit(0).cast("long")).alias("child"))


def cluster_pools(
    rows: DataFrame, pool: str, key: str, vector: str, least: int, samples: int, width: int = 0, epsilon: float = 0.0, most: int = 0, alike: float = 0.92
) -> DataFrame:
    """pool, key, label of every row: axes of greatest variance, density clusters, then
    close ones merged and large ones split. Labels of a pool go from 0; -1 is noise, and
    rows without a vector. Keys are unique. An empty table gives no rows."""
    named = stored(_named(rows, pool, key, vector))
    x = _reduced(named, width)
    x = stored(x) if width > 0 else x
    labels = density_clusters(x, least, samples)
    if epsilon > 0:
        into = merge_close(x.join(labels, ["_s", "_k"]), epsilon)
        labels = labels.join(into, ["_s", "label"], "left").select("_s", "_k", F.coalesce("into", "label").alias("label"))
    labels = labels.withColumn("child", F.lit(0).cast("long"))
    if most > 0:
        labels = split_large(stored(named.join(x, ["_s", "_k"]).join(labels.drop("child"), ["_s", "_k"])), most, alike)
    labels = stored(labels)
    order = Window.partitionBy("_s").orderBy("label", "child")  # a row for each cluster
    numbers = labels.where("label >= 0").select("_s", "label", "child").distinct().withColumn("_l", F.row_number().over(order) - 1)
    labels = labels.join(numbers, ["_s", "label", "child"], "left").select("_s", F.col("_k").alias(key), "_l")
    out = rows.select(pool, key).withColumn("_s", F.col(pool).cast("string")).join(labels, ["_s", key], "left")
    return out.select(pool, key, F.coalesce("_l", F.lit(-1)).cast("long").alias("label"))


def choose_parameters(rows: DataFrame, pool: str, key: str, vector: str, grid: list[tuple[int, int, int]], most_share: float = 0.5, noise_weight: float = 0.35) -> DataFrame:
    """pool, width, least, samples, objective: for each pool the best of the grid, by
    silhouette in the full space + 0.1 ln(1 + clusters) - noise_weight * noise; not
    where one cluster holds more than most_share. Tried on about TRIAL_ROWS rows of a pool,
    drawn by a hash of the key: that many settle which parameters suit it."""
    sizes = rows.groupBy(pool).agg(F.count("*").alias("_n"))
    drawn = F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) < F.lit(float(TRIAL_ROWS << 30)) / F.col("_n")
    some = stored(rows.select(pool, key, vector).join(sizes, pool).where(drawn).drop("_n"))
    tried = None
    for width, least, samples in grid:
        labelled = cluster_pools(some, pool, key, vector, least, samples, width).join(some.select(key, vector), key)
        q = pool_quality(labelled, pool, key, vector, "label")
        good = (F.col("clusters") >= 2) & (F.col("share") <= most_share)
        value = F.when(good, F.col("silhouette") + 0.1 * F.log1p("clusters") - noise_weight * F.col("noise")).otherwise(float("-inf"))
        one = stored(q.select(pool, *[F.lit(v).alias(n) for v, n in ((width, "width"), (least, "least"), (samples, "samples"))], value.alias("objective")))
        tried = one if tried is None else tried.unionByName(one)
    best = F.max_by(F.struct("width", "least", "samples", "objective"), F.struct("objective", -F.col("width"), -F.col("least"), -F.col("samples"))).alias("b")
    return tried.groupBy(pool).agg(best).select(pool, "b.*")


def mean_distances(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, own: bool = False) -> np.ndarray:
    """Between clusters, the means of their rows' distances: x and y are in the order of
    their clusters' numbers of_x and of_y, which go from 0, and stand for n_x and n_y rows.
    Where y is x (own), each pair of clusters is looked at once."""
    starts, step = np.searchsorted(of_x, np.arange(of_x[-1] + 1)), max(16, STEP_CELLS // len(x))
    squares, sums = (x * x).sum(axis=1)[:, None], np.zeros((len(starts), of_y[-1] + 1))
    for lo in range(0, len(y), step):
        some, of = y[lo : lo + step], of_y[lo : lo + step]
        c = of[0] if own else 0
        at = starts[c]
        d = x[at:] @ (-2 * some).T
        d += squares[at:]
        d += (some * some).sum(axis=1)
        np.sqrt(np.maximum(d, 0.0, out=d), out=d)
        d *= n_x[at:, None]
        d = np.add.reduceat(d, starts[c:] - at, axis=0) if len(starts) < len(x) else d
        d *= n_y[lo : lo + step]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        sums[c:, of[0] : of[-1] + 1] += np.add.reduceat(d, first, axis=1) if len(first) < len(of) else d
    sums /= np.bincount(of_x, n_x)[:, None]
    sums /= np.bincount(of_y, n_y)
    return np.tril(sums) + np.tril(sums, -1).T if own else sums


def light_forest(d: np.ndarray, own: bool, under: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, weight of the least spanning forest of edges under a bound, between rows and
    columns (numbered after the rows), or where rows and columns are the same (own)."""
    n = len(d) if own else sum(d.shape)
    turned = d if own else np.ascontiguousarray(d.T)
    left, reach, source, at, edges = np.ones(n, bool), np.full(n, np.inf), np.zeros(n, int), 0, []
    for _ in range(n - 1):
        left[at] = False
        lo, row = (0, d[at]) if own else (len(d), d[at]) if at < len(d) else (0, turned[at - len(d)])
        closer = np.flatnonzero(row < reach[lo : lo + len(row)])
        reach[lo + closer], source[lo + closer] = row[closer], at
        at = int(np.where(left, reach, np.inf).argmin())
        if not left[at]:  # nothing leads on: a tree of its own
            at = int(left.argmax())
        elif reach[at] < under:
            edges.append((int(source[at]), at, float(reach[at])))
    i, j, w = zip(*edges) if edges else ((), (), ())
    return np.array(i, int), np.array(j, int), np.array(w, float)


def apart(a: np.ndarray, b: np.ndarray, w: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each cluster (its least one) and how far all others are from it at
    least, from the edges of the least spanning forest, lightest first: the largest
    subtrees that a task can take, and any two that are each other's nearest. Nothing but
    inf is around a whole tree."""
    n = len(rows)
    top, inside, many, held, whole, limit = list(range(n)), list(range(n)), [1] * n, rows.tolist(), [True] * n, np.full(n, np.inf)

    def find(tops: list[int], i: int) -> int:
        while tops[i] != i:
            tops[i] = tops[tops[i]]
            i = tops[i]
        return i

    for i, j, at in zip(a.tolist(), b.tolist(), w.tolist()):
        i, j = sorted((find(top, i), find(top, j)))
        fits = many[i] + many[j] <= GROUP_CLUSTERS and held[i] + held[j] <= GROUP_ROWS or many[i] == many[j] == 1
        if whole[i] and whole[j] and fits:
            inside[j] = i
        else:
            for r in (i, j):
                if whole[r]:
                    whole[r], limit[r] = False, at
        top[j] = i
        many[i], held[i] = many[i] + many[j], held[i] + held[j]
    group = np.array([find(inside, i) for i in range(n)], int)
    return group, limit[group]


def average_linkage(rows: DataFrame, distance: float) -> DataFrame:
    """_k, c (the least key) of rows _s, _k, _x: clusters of each scope by average linkage of
    all its rows, merged at heights under distance. Copies of a vector are one weighted row.

    Merging never brings clusters nearer to a third one. So clusters that all others are at
    a height or more from may be merged under it by themselves: a round takes the least
    spanning forest of the clusters' mean distances, block by block of all pairs, and a task
    finishes each of its subtrees up to the height at which the next edge leads on. A tree
    that a task holds whole is done. The work of a round is quadratic."""
    kind = rows.schema["_k"].dataType.simpleString()
    if distance <= 0:
        return rows.select("_k", F.col("_k").alias("c"))
    alike = Window.partitionBy("_s", "_x")
    named = stored(rows.select(F.to_json(F.struct("_s")).alias("_s"), "_k", "_x", F.min("_k").over(alike).alias("_one"), F.count("*").over(alike).cast("double").alias("n")))
    live, done = named.where("_k = _one").select("_s", "_k", "_x", "n", F.col("_k").alias("c")), []

    def parts(table: pa.Table):
        table = table.sort_by([("c", "ascending"), ("_k", "ascending")])
        names = table["c"].combine_chunks().dictionary_encode()
        return names.dictionary, matrix(table["_x"]), names.indices.to_numpy().astype(int), table["n"].to_numpy()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:  # met nothing
            return pa.schema([]).empty_table()
        own = left["_p"][0].as_py() == left["_b"][0].as_py()
        (names, x, of_x, n_x), (others, y, of_y, n_y) = parts(left), parts(right)
        d = mean_distances(x, y, of_x, of_y, n_x, n_y, own)
        if own:
            np.fill_diagonal(d, np.inf)
        i, j, w = light_forest(d, own, distance)
        names = names if own else pa.concat_arrays([names, others])
        return pa.table({"_s": left["_s"].take(pa.array(np.zeros(len(i), int))), "a": names.take(pa.array(i)), "b": names.take(pa.array(j)), "w": pa.array(w)})

    def settle(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        nodes, edges = nodes.sort_by("c"), edges.sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")])
        place, rows_of = pd.Index(nodes["c"].to_pandas()), nodes["rows"].to_numpy()
        group, limit = apart(*(place.get_indexer(edges[c].to_pandas()) for c in ("a", "b")), edges["w"].to_numpy(), rows_of)
        many, held = np.bincount(group), np.bincount(group, rows_of).astype(int)
        return pa.table({"c": nodes["c"], "g": nodes["c"].take(pa.array(group)), "limit": pa.array(limit), "many": pa.array(many[group], pa.int64()), "rows": pa.array(held[group], pa.int64())})

    def merge(table: pa.Table) -> pa.Table:
        names, x, of, n = parts(table)
        limit = table["limit"][0].as_py()
        merges = agglomerate(mean_distances(x, x, of, of, n, n, True), "average", np.bincount(of, n))
        # Of those that others are as near to, the first two are each other's nearest.
        under = distance if limit == np.inf else max(limit, np.nextafter(merges[0][0], np.inf))
        labels = cut(merges, len(names), under=under)
        return pa.table({"c": names, "new": names.take(pa.array(np.unique(labels, return_index=True)[1][labels]))})

    while True:
        clusters = stored(live.groupBy("_s", "c").agg(F.count("*").alias("rows")))
        scopes = stored(clusters.groupBy("_s").agg(F.count("*").alias("many"), F.sum("rows").alias("rows"), F.min("c").alias("g")))
        fits = (F.col("many") <= GROUP_CLUSTERS) & (F.col("rows") <= GROUP_ROWS)
        plan = clusters.select("_s", "c").join(scopes.where(fits), "_s").select("c", "g", F.lit(np.inf).alias("limit"), "many", "rows")
        if scopes.where(~fits).limit(1).count():
            blocks = F.greatest(F.lit(BLOCKS), F.ceil(F.col("many") / BLOCK_CLUSTERS), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("long")
            placed = stored(live.join(scopes.where(~fits).select("_s", blocks.alias("_of")), "_s").withColumn("_at", F.pmod(F.xxhash64("c"), F.col("_of"))))
            base = [F.col(c).alias(c) for c in ("_s", "_k", "_x", "n", "c")]
            left = placed.select(*base, F.col("_at").alias("_p"), F.explode(F.expr("sequence(_at, _of - 1)")).alias("_b"))
            right = placed.select(*base, F.explode(F.expr("sequence(0L, _at)")).alias("_p"), F.col("_at").alias("_b"))
            edges = left.groupBy("_s", "_p", "_b").cogroup(right.groupBy("_s", "_p", "_b")).applyInArrow(meet, f"_s string, a {kind}, b {kind}, w double")
            forest = graph.spanning_forest(stored(edges.select("_s", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")))
            large = clusters.join(scopes.where(~fits).select("_s"), "_s", "left_semi")
            plan = plan.unionByName(large.groupBy("_s").cogroup(forest.groupBy("_s")).applyInArrow(settle, f"c {kind}, g {kind}, limit double, many long, rows long"))
        plan = stored(plan)
        two = (F.col("many") == 2) & (F.col("rows") > GROUP_ROWS)  # their height is known
        inside = live.join(plan.where((F.col("many") > 1) & ~two).select("c", "g", "limit"), "c")
        new = inside.groupBy("g").applyInArrow(merge, f"c {kind}, new {kind}").unionByName(plan.where(two).select("c", F.col("g").alias("new")))
        over = plan.select("c", (F.col("limit") == np.inf).alias("over"))
        moved = stored(live.join(over, "c").join(new, "c", "left").select("_s", "_k", "_x", "n", F.coalesce("new", "c").alias("c"), "over"))
        done.append(moved.where("over").select(F.col("_k").alias("_one"), "c"))
        live = moved.where("not over").drop("over")
        if not live.limit(1).count():
            break
    return named.select("_k", "_one").join(reduce(DataFrame.unionByName, done), "_one").select("_k", "c")


def micro_clusters(rows: DataFrame, scope: str, key: str, vector: str, author: str, distance: float, least: int, authors: int) -> DataFrame:
    """scope, key, cluster (its least key) of small tight groups of leftovers: average
    linkage of all rows of a scope under distance, with at least so many members and
    distinct authors."""
    inside = rows.where(F.col(vector).isNotNull()).select(F.col(scope).cast("string").alias("_s"), F.col(key).alias("_k"), F.col(vector).alias("_x"))
    people = rows.select(F.col(key).alias("_k"), F.col(author).alias("_a"))
    found = stored(average_linkage(inside, distance).join(people, "_k"))
    good = found.groupBy("c").agg(F.count("*").alias("_n"), F.countDistinct("_a").alias("_d"))
    kept = found.join(good.where((F.col("_n") >= least) & (F.col("_d") >= authors)), "c").select(F.col("_k").alias(key), F.col("c").alias("cluster"))
    return rows.select(scope, key).join(kept, key).select(scope, key, "cluster")


def topic_groups(topics: DataFrame, scope: str, similarity: float) -> DataFrame:
    """scope, topic_id, group_id, group_size: topics of one scope (with topic_id, centroid
    and size > 0) all pairs of which are similar enough, in groups of two or more, named
    after the largest. Topics are summaries: a scope's are settled in one task."""

    def settle(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["size", "topic_id"], ascending=[False, True])
        x = np.stack([np.asarray(v, float) for v in table["centroid"]])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        labels = cut(agglomerate(1 - x @ x.T, "complete"), len(x), under=1 - similarity) if len(x) > 1 else np.zeros(len(x), int)
        table = table.assign(_g=labels)
        table = table[table.groupby("_g")["_g"].transform("size") > 1]
        by = table.groupby("_g")
        table = table.assign(group_id=["G_" + str(v) for v in by["topic_id"].transform("first")], group_size=by["_g"].transform("size"))
        table = table[[scope, "topic_id", "group_id", "group_size"]]
        return table if len(table) else table.astype(object)  # an empty column of texts can't be sent as pandas has it

    some = topics.where("size > 0").select(scope, "topic_id", "centroid", "size")
    return some.groupBy(scope).applyInPandas(settle, some.select(scope, "topic_id", F.lit("").alias("group_id"), F.lit(0).cast("long").alias("group_size")).schema)


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """The mean silhouette of labelled points; nan with fewer than two clusters."""
    names, y = np.unique(labels, return_inverse=True)
    if len(names) < 2 or len(x) < 3:
        return float("nan")
    sums = np.stack([distances(x, x[y == c]).sum(axis=1) for c in range(len(names))], axis=1)
    counts, rows = np.bincount(y), np.arange(len(x))
    own = sums[rows, y] / np.maximum(counts[y] - 1, 1)
    means = sums / counts
    means[rows, y] = np.inf
    other = means.min(axis=1)
    return float(np.where(counts[y] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0).mean())


def pool_quality(rows: DataFrame, pool: str, key: str, vector: str, label: str) -> DataFrame:
    """pool, noise, clusters, share (of the largest cluster) of labelled rows (-1: noise),
    over all rows, and the mean silhouette of about SILHOUETTE_POINTS of a pool's clustered
    rows, drawn by a hash of the key (null with fewer than two clusters): a bounded sample
    is the measure's own."""
    sizes = rows.groupBy(pool, label).agg(F.count("*").alias("_c"))
    inside = F.when(F.col(label) >= 0, F.col("_c"))
    whole = sizes.groupBy(pool).agg(
        (1 - F.coalesce(F.sum(inside), F.lit(0)) / F.sum("_c")).alias("noise"), F.count(inside).alias("clusters"), F.coalesce(F.max(inside) / F.sum("_c"), F.lit(0.0)).alias("share"),
        F.coalesce(F.sum(inside), F.lit(0)).alias("_n"),
    )
    drawn = F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1 << 30)) < F.lit(float(SILHOUETTE_POINTS << 30)) / F.col("_n")
    some = rows.where(F.col(label) >= 0).select(pool, key, vector, label).join(whole.select(pool, "_n"), pool).where(drawn)

    def settle(table: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{pool: table[pool].iat[0], "silhouette": silhouette(np.stack([np.asarray(v, float) for v in table[vector]]), table[label].to_numpy())}])

    found = some.groupBy(pool).applyInPandas(settle, f"{pool} {rows.schema[pool].dataType.simpleString()}, silhouette double")
    return whole.drop("_n").join(found, pool, "left").withColumn("silhouette", F.nanvl("silhouette", F.lit(None).cast("double")))
