"""A manifest of Merkle trees: one for each group of rows, and one over the groups' roots.

Rows become leaves by SHA-256 in Spark's own functions. The leaves, as an RDD, are range
sorted by group and order. Each partition reports how many rows of its first and last
group it has; from these few numbers (a row for each partition) every partition knows
where in their trees its rows stand. It builds all subtrees that lie in it whole. Nodes
whose parent is cut by a partition's border, a few at each level, are shuffled by the
coordinate of an ancestor some levels up, which finishes those levels, until the roots
are there. The paths above a partition's nodes come back to it by the same partitioner,
without a second shuffle of the leaves.
"""

from __future__ import annotations

import hashlib
import math
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.shared import counted

#: Leaves of a partition, about; levels that a shuffle of border nodes finishes at least, and
#: border nodes of one key that it is meant to meet (or arity ** STEP, if that is more).
ROWS, STEP, NODES = 10_000, 7, 4000


def node(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(n: int, arity: int) -> int:
    k = 0
    while n > 1:
        n, k = -(-n // arity), k + 1
    return k


def line(children: list[str], place: int) -> str:
    """One level of a proof: the siblings in order, ``*`` for the node itself."""
    return ",".join([*children[:place], "*", *children[place + 1 :]])


def local_levels(digests: list[str], start: int, total: int, arity: int) -> list[tuple[int, list[str], int]]:
    """(first index, digests, number of all nodes) of each level, of the nodes whose
    leaves all are among the given ones; these are leaves start, start + 1, ... of total."""
    out = [(start, digests, total)]
    while total > 1:
        end, above = start + len(digests), -(-total // arity)
        first, last = -(-start // arity), above if end == total else end // arity
        digests = [node(digests[m * arity - start : (m + 1) * arity - start]) for m in range(first, last)]
        if not digests:
            break
        start, total = first, above
        out.append((start, digests, total))
    return out


def border(tree: list[tuple[int, list[str], int]], arity: int):
    """(level, index, digest) of a partition's nodes that have no parent in it."""
    for k, (start, digests, total) in enumerate(tree):
        lo, hi = (tree[k + 1][0], tree[k + 1][0] + len(tree[k + 1][1])) if k + 1 < len(tree) else (0, 0)
        for i, d in enumerate(digests, start):
            if total == 1 or not lo <= i // arity < hi:
                yield k, i, d


def finish_step(nodes: list[tuple[int, int, str]], low: int, high: int, leaves: int, arity: int):
    """All paths of (level, index, digest) nodes of levels low to high - 1 up to their
    common ancestor at level high: [((level, index), lines)], and the ancestor."""
    known: dict[int, dict[int, str]] = {k: {} for k in range(low, high + 1)}
    for k, i, d in nodes:
        known[k][i] = d
    count = leaves
    for _ in range(low):
        count = -(-count // arity)
    lines: dict[tuple[int, int], str] = {}
    for k in range(low, high):
        for m in {i // arity for i in known[k]}:
            span = range(m * arity, min((m + 1) * arity, count))
            children = [known[k][i] for i in span]
            known[k + 1][m] = node(children)
            lines.update({(k, i): line(children, i - m * arity) for i in span})
        count = -(-count // arity)
    paths = []
    for k, i, _ in nodes:
        path, at = [], i
        for up in range(k, high):
            path.append(lines[(up, at)])
            at //= arity
        paths.append(((k, i), path))
    return paths, known[high]


class Forest:
    """Trees over an RDD of ((group, ...), (digest, ...)), sorted by its keys."""

    def __init__(self, rows, n: int, arity: int):
        self.arity = arity
        self.rows = rows.sortByKey(numPartitions=max(2, -(-n // ROWS)))
        self.parts = self.rows.getNumPartitions()
        seen = self.rows.mapPartitionsWithIndex(_ends).collect()  # a row for each partition
        self.offsets, most, self.groups = _offsets(seen)
        offsets = self.offsets

        def emit(p, rows):
            for group, leaves, start, total in _runs(p, rows, offsets):
                for k, i, d in border(local_levels([v[0] for _, v in leaves], start, total, arity), arity):
                    yield (group, k, i), (d, total, p)

        # A few nodes for each level and partition: kept, and read in few tasks from here on.
        at_borders = self.rows.mapPartitionsWithIndex(emit).persist().coalesce(self.few())
        nodes = at_borders
        self.roots, self.steps = nodes.filter(_is_root(arity)), []
        deep, low = levels(most, arity), 0
        # Under an ancestor stand the border nodes of as many partitions as it has leaves for.
        rise = max(STEP, int(math.log(max(NODES * n / self.parts / (2 * arity * max(deep, 1)), 1), arity)))
        while low < deep:
            step = nodes.flatMap(_under(low, low + rise, arity)).groupByKey(self.few()).map(_finish(low, arity))
            self.steps.append(step)
            nodes = step.map(lambda kv: (kv[0], (kv[1][0], kv[1][1], -1)))
            self.roots = self.roots.union(nodes.filter(_is_root(arity)))
            # Border nodes of higher levels come in with the ancestors.
            nodes = nodes.union(at_borders)
            low, rise = low + rise, STEP

    def few(self) -> int:
        return max(1, self.parts // 8)

    def subroots(self):
        return self.roots.map(lambda r: (r[0][0], r[1][0]))

    def proofs(self, above):
        """RDD of (key, value, lines, above's value) of every row, where above is an RDD of
        (group, (lines, value)) with a row for each group."""
        arity, offsets = self.arity, self.offsets
        first = {p: o[0] for p, o in offsets.items()}
        known = self.roots.map(lambda r: (r[0][0], r)).join(above, self.few()).map(lambda r: (r[1][0][0], (r[1][0][1][2], *r[1][1])))
        up = roots = known
        for step in reversed(self.steps):
            below = step.join(known, self.few()).flatMap(lambda r: [((r[0][0], k, i), (p, path + r[1][1][1], r[1][1][2])) for (k, i), p, path in r[1][0][2]])
            up, known = up.union(below), roots.union(below)
        # Back to the partition that the border node came from: by its first key.
        up = up.filter(lambda r: r[1][0] >= 0).map(lambda r: (first[r[1][0]], (r[0], r[1][1:])))
        up = up.partitionBy(self.parts, self.rows.partitioner.partitionFunc).mapPartitions(lambda it: ((None, v) for _, v in it), True)
        both = up.union(self.rows)
        if both.getNumPartitions() != self.parts:
            raise RuntimeError("paths and rows do not share their partitions")

        def finish(p, rows):
            paths, rows = {}, iter(rows)
            ahead = []
            for key, value in rows:
                if key is not None:
                    ahead.append((key, value))
                    break
                paths[value[0]] = value[1]
            for group, leaves, start, total in _runs(p, _chain(ahead, rows), offsets):
                tree = local_levels([v[0] for _, v in leaves], start, total, arity)
                tops: dict = {}
                for j, (key, value) in enumerate(leaves):
                    lines, at = [], start + j
                    for k in range(len(tree)):
                        if k + 1 == len(tree) or not tree[k + 1][0] <= at // arity < tree[k + 1][0] + len(tree[k + 1][1]):
                            break
                        m, (lo, digests, _) = at // arity, tree[k]
                        if (k, m) not in tops:
                            tops[(k, m)] = digests[m * arity - lo : (m + 1) * arity - lo]
                        lines.append(line(tops[(k, m)], at - m * arity))
                        at = m
                    path, result = paths[(group, k, at)]
                    yield key, value, lines + path, result

        return both.mapPartitionsWithIndex(finish)


def _is_root(arity):
    return lambda r: r[0][1] == levels(r[1][1], arity)


def _under(low, high, arity):
    """The nodes of levels low to high - 1, by their ancestor at high or the root."""

    def pick(r):
        (group, k, i), (d, total, p) = r
        top = min(high, levels(total, arity))
        return [((group, top, i // arity ** (top - k)), (k, i, d, total, p))] if low <= k < top else []

    return pick


def _finish(low, arity):
    def run(kv):
        (group, top, at), found = kv[0], list(kv[1])
        paths, above = finish_step([f[:3] for f in found], low, top, found[0][3], arity)
        return (group, top, at), (above[at], found[0][3], [(place, f[4], path) for f, (place, path) in zip(found, paths)])

    return run


def _crown(groups, n: int, arity: int):
    """RDD of (group, (lines, (subroot, root))) of an RDD of (group, subroot): up to ROWS of
    them are one task's, more are a forest of one tree."""
    if n > ROWS:
        crown = Forest(groups.map(lambda r: ((0, r[0]), (r[1],))), n, arity)
        roots = crown.subroots().map(lambda r: (r[0], ([], r[1])))
        return crown.proofs(roots).map(lambda r: (r[0][1], (r[2], (r[1][0], r[3]))))

    def tree(kv):
        rows = sorted(kv[1])
        paths, above = finish_step([(0, i, d) for i, (_, d) in enumerate(rows)], 0, levels(n, arity), n, arity)
        return [(group, (path, (d, above[0]))) for (group, d), (_, path) in zip(rows, paths)]

    return groups.map(lambda r: (0, r)).groupByKey(1).flatMap(tree)


def _chain(ahead, rows):
    yield from ahead
    yield from rows


def _ends(p, rows):
    first_key = first = last = None
    counts, groups = [0, 0], 0
    for key, _ in rows:
        if first_key is None:
            first_key, first = key, key[0]
        if key[0] == first:
            counts[0] += 1
        if key[0] != last:
            last, counts[1], groups = key[0], 0, groups + 1
        counts[1] += 1
    if first_key is not None:
        yield p, first_key, first, last, counts, groups


def _offsets(seen: list) -> tuple[dict, int, int]:
    """{partition: (its first key, offset of its first group, totals of its first and last
    group)}, the largest of these totals, and the number of groups."""
    totals: dict = {}
    starts, number, before = {}, 0, None
    for p, _, first, last, counts, groups in sorted(seen):
        starts[p] = totals.get(first, 0)
        totals[first] = totals.get(first, 0) + counts[0]
        number += groups - (before is not None and first == before)
        before = last
        if last != first:
            totals[last] = counts[1]
    out = {p: (key, starts[p], totals[first], totals[last]) for p, key, first, last, _, _ in seen}
    return out, max([*totals.values(), 1]), number


def _runs(p, rows, offsets):
    """(group, [(key, value)], offset, total) of each group in a partition."""
    runs = groupby(rows, key=lambda r: r[0][0])
    ahead = next(runs, None)
    begun = True
    while ahead is not None:
        group, leaves = ahead[0], list(ahead[1])
        ahead = next(runs, None)
        _, start, total_first, total_last = offsets[p]
        if begun:
            yield group, leaves, start, total_first
        elif ahead is None:
            yield group, leaves, 0, total_last
        else:
            yield group, leaves, 0, len(leaves)
        begun = False


def field(value: Column) -> Column:
    """A value as a leaf has it: ``-`` if null, else its length in bytes, a colon, itself."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", arity: int = 3, *more: Column) -> DataFrame:
    """order, group, leaf, proof, subroot, root and the columns ``more`` of every row: the
    hash of its fields, the proof from it to the root (a line for each level: the siblings'
    hashes by commas, ``*`` in its own place), the root of its group and that of all.

    Groups come in order, null first; a group's rows by ``order``, null first, and those
    that share it by their leaf. Null fields are told from empty ones. Repeated rows are
    leaves of their own. An empty table gives no rows; columns that aren't named aren't
    read. ``order`` is an integer or a text, and so is ``group``."""
    kinds = [docs.schema[c].dataType.simpleString() for c in (order, group)]
    own = leaf(*[F.col(c) for c in fields])
    rows = docs.select(F.col(order).alias("_o"), F.col(group).alias("_g"), own.alias("_leaf"), F.monotonically_increasing_id().alias("_tie"), *more)
    names = rows.columns[4:]
    rows, n = counted(rows)
    schema = f"{order} {kinds[0]}, {group} {kinds[1]}, leaf string, proof array<string>, subroot string, root string"
    schema += "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in names)
    spark = docs.sparkSession
    if not n:
        return spark.createDataFrame([], schema)
    known = lambda v: (v is not None, 0 if v is None else v)
    keyed = rows.rdd.map(lambda r: ((known(r[1]), known(r[0]), r[2], r[3]), (r[2], *r[4:])))
    trees = Forest(keyed, n, arity)
    above = _crown(trees.subroots(), trees.groups, arity)
    value = lambda k: k[1] if k[0] else None
    out = trees.proofs(above).map(lambda r: (value(r[0][1]), value(r[0][0]), r[1][0], r[2], r[3][0], r[3][1], *r[1][1:]))
    return spark.createDataFrame(out, schema, verifySchema=False)


def proof_digest(proof: Column) -> Column:
    """The hash of all siblings of a proof, from the leaf up, left to right."""
    return F.sha2(F.translate(F.array_join(proof, ""), ",*", ""), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, start, lambda acc, level: F.sha2(F.replace(F.translate(level, ",", ""), F.lit("*"), acc), 256))


def audit(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row. To
    try the proofs, rows with an even crc32 of their doc_id are folded from a text without
    line breaks; those whose text had any don't verify. A row with a null id, null text or
    empty text stays as it is."""
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    cut = F.when(odd & F.contains("text", F.lit("\n")), F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.when(cut.isNotNull(), leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), cut)).alias("_tampered")
    rows = manifest(docs, ("doc_id", "source", "lang", "n_chars", "text"), "source", "doc_id", 3, tampered)
    root = folded(F.coalesce("_tampered", "leaf"), F.col("proof"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
