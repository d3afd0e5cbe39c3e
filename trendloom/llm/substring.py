"""Exact repeats of ``window`` words or more, across documents and within one.

1. Every text is cut into non-overlapping reference blocks of b = (window + 1) // 2 words.
   Any window holds one whole block of its own text's grid, and wherever the window is
   repeated, that block's words stand too, at whatever offset. So blocks are the index,
   and every rolling window of b words is a probe of it.
2. A block that another place holds too is a hit. It is extended to all windows around
   it, which are told apart by 128 bits; windows that start in two places or more are the
   repeats, and what they cover together are the maximal exact repeats.

Tasks send hashes to the parts of the hash space, packed in arrays. What a task has seen
twice it settles itself and sends once: a passage that a third of all documents share
costs one entry for each chunk of words. Texts are told apart by 128 bits of hash, and
copies of one text share its result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.shared import counted, materialise, observed

#: Words that a task takes at once, and bytes of text for each part of the hash space.
CHUNK, PART_BYTES = 1 << 19, 24 << 20
#: A text with over one row in so many, and over HOT_LEAST rows, is dealt to several tasks.
HOT_SHARE, HOT_LEAST = 1000, 200

MESSAGE = "q int, kind int, x binary, y binary, k1 binary, k2 binary, at binary"
#: Kinds of messages: hashes seen once, seen more often, seen once with a place that wants
#: an answer, and places that are settled.
PROBE, SEVERAL, ASK, DONE = range(4)
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def rolled(h: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """The hash of each run of width values, by Horner's rule on all places at once."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, width):
        out *= base
        out += h[j : j + n]
    return out


def _same(x: np.ndarray, y: np.ndarray | None, weight: np.ndarray) -> np.ndarray:
    """For each entry, the weight of all entries with its hash."""
    if not len(x):
        return np.zeros(0, np.int64)
    order = np.argsort(x, kind="stable") if y is None else np.lexsort((y, x))
    new = np.zeros(len(x), bool)
    new[0] = True
    for v in (x,) if y is None else (x, y):
        sorted_ = v[order]
        new[1:] |= sorted_[1:] != sorted_[:-1]
    starts = np.flatnonzero(new)
    total = np.add.reduceat(weight[order], starts, dtype=np.int64)
    out = np.empty(len(x), np.int32)
    out[order] = np.repeat(total, np.diff(np.append(starts, len(x))))
    return out


def _first_of_each(x: np.ndarray, y: np.ndarray | None) -> np.ndarray:
    if y is None:
        return np.unique(x, return_index=True)[1]
    return np.unique(np.stack([x, y], axis=1), axis=0, return_index=True)[1]


def _messages(x, y, weight, asks, key, owner, at, parts: int, chunk: int):
    """What a chunk has to send: hashes x (and y) with their weights, of which those in
    asks want an answer for the place (the owner's key, at)."""
    total = _same(x, y, weight)
    several, single = total >= 2, total < 2
    part = lambda v: ((v >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
    placed_at = lambda i: [v.tobytes() for v in (key[owner[i], 0], key[owner[i], 1], at[i])]
    rows = []

    def send(kind: int, mask: np.ndarray, placed: bool) -> None:
        where = np.flatnonzero(mask)
        if kind == SEVERAL and len(where):
            where = where[_first_of_each(x[where], None if y is None else y[where])]
        q = part(x[where])
        order = np.argsort(q, kind="stable")
        where, bounds = where[order], np.searchsorted(q[order], np.arange(parts + 1))
        for i in range(parts):
            some = where[bounds[i] : bounds[i + 1]]
            if len(some):
                rows.append((i, kind, x[some].tobytes(), y[some].tobytes() if y is not None else None, *(placed_at(some) if placed else [None] * 3)))

    send(PROBE, single & ~asks, False)
    send(SEVERAL, several, False)
    send(ASK, single & asks, True)
    done = np.flatnonzero(several & asks)
    if len(done):
        rows.append((chunk % parts, DONE, None, None, *placed_at(done)))
    columns = list(zip(*rows)) if rows else [()] * 7
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
    names = ["q", "kind", "x", "y", "k1", "k2", "at"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _settled(table: pa.Table) -> pa.Table:
    """k1, k2, place of one part: those that ask and whose hash is somewhere else too."""
    kind = table["kind"].to_numpy()
    get = lambda name, which, kind_of: np.frombuffer(b"".join(v.as_py() or b"" for v, k in zip(table[name], kind) if k in which), kind_of)
    x = [get("x", {k}, np.uint64) for k in (PROBE, SEVERAL, ASK)]
    y = [get("y", {k}, np.uint64) for k in (PROBE, SEVERAL, ASK)]
    weight = np.concatenate([np.full(len(v), w, np.int8) for v, w in zip(x, (1, 2, 1))])
    wide = any(len(v) for v in y)
    total = _same(np.concatenate(x), np.concatenate(y) if wide else None, weight)
    found = total[len(x[0]) + len(x[1]) :] >= 2
    place = [np.concatenate([get(c, {ASK}, t)[found], get(c, {DONE}, t)]) for c, t in (("k1", np.int64), ("k2", np.int64), ("at", np.int32))]
    return pa.table([pa.array(v) for v in place], names=["k1", "k2", "place"])


def _chunks(batches, names: tuple[str, ...]):
    """Columns of rows with about CHUNK words at once, one row for each text, with the
    number of rows that have it."""
    held, words = {}, 0
    for batch in batches:
        lists = batch.column("h")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        others = [batch.column(c).to_pylist() for c in names]
        for i, row in enumerate(zip(*others)):
            key = row[:2]
            if key in held:
                held[key][0] += 1
                continue
            h = values[offsets[i] : offsets[i + 1]].copy()
            held[key] = [1, h, *row[2:]]
            words += len(h)
            if words >= CHUNK:
                yield held
                held, words = {}, 0
    if held:
        yield held


def _laid_out(held: dict):
    lengths = np.array([len(v[1]) for v in held.values()], np.int64)
    starts = np.cumsum(lengths) - lengths
    h = np.concatenate([v[1] for v in held.values()]) if held else np.zeros(0, np.uint64)
    key = np.array(list(held), np.int64).reshape(-1, 2)
    weight = np.array([min(v[0], 2) for v in held.values()], np.int8)
    return h, lengths, starts, key, weight


def _probe_blocks(block: int, parts: int):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        for held in _chunks(batches, ("k1", "k2")):
            h, lengths, starts, key, weight = _laid_out(held)
            windows = np.maximum(lengths - block + 1, 0)
            owner = np.repeat(np.arange(len(lengths), dtype=np.int32), windows)
            at = (np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
            x = rolled(h, block, BASES[0])[starts[owner] + at] if len(owner) else np.zeros(0, np.uint64)
            yield _messages(x, None, weight[owner], at % block == 0, key, owner, at // block, parts, number)
            number += 7919

    return run


def _extend_hits(block: int, window: int, parts: int):
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        for held in _chunks(batches, ("k1", "k2", "places")):
            h, lengths, starts, key, weight = _laid_out(held)
            owner, at = [], []
            for i, v in enumerate(held.values()):
                found = np.unique(np.asarray(v[2], np.int64))
                # The windows that hold a block: each holds one whole block of its grid or, for an odd width, two at most.
                first = (found[:, None] * block - np.arange(window - block + 1)[None, :]).ravel()
                first = np.unique(first[(first >= 0) & (first <= lengths[i] - window)])
                owner.append(np.full(len(first), i, np.int32))
                at.append(first)
            owner, at = np.concatenate(owner), np.concatenate(at)
            x, y = ((rolled(h, window, b)[starts[owner] + at] if len(owner) else np.zeros(0, np.uint64)) for b in BASES)
            yield _messages(x, y, weight[owner], np.ones(len(at), bool), key, owner, at.astype(np.int32), parts, number)
            number += 7919

    return run


def _answers(messages: DataFrame, parts: int) -> DataFrame:
    """k1, k2, places: a row for each text with any. Every part is a partition."""
    places = messages.repartition(parts, "q").groupBy("q").applyInArrow(lambda table: _settled(table), "k1 long, k2 long, place int")
    return materialise(places.groupBy("k1", "k2").agg(F.collect_list("place").alias("places")))


def _joined(docs: DataFrame, found: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """docs with the places of their texts; texts of very many rows are dealt by salts."""
    few = F.broadcast(hot)  # HOT_SHARE rows at most
    left = docs.join(few, ["k1", "k2"], "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1)))).drop("salts")
    right = found.join(few, ["k1", "k2"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, ["k1", "k2", "salt"], how)


def _cut(window: int):
    def run(batches):
        for batch in batches:
            out = {"id": [], "kept": [], "n_words": [], "spans": []}
            for text, places in zip(batch.column("text"), batch.column("places")):
                words = (text.as_py() or "").encode().split()
                places, spans = places.as_py(), []
                for p in sorted(places or ()):
                    if spans and p <= spans[-1]["until"]:
                        spans[-1]["until"] = p + window
                    else:
                        spans.append({"start": p, "until": p + window})
                kept, at = [], 0
                for s in spans:
                    kept += words[at : s["start"]]
                    at = s["until"]
                out["kept"].append(b" ".join(kept + words[at:] if spans else words).decode())
                out["n_words"].append(len(words))
                out["spans"].append(spans)
            spans = pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("until", pa.int32())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(out["kept"], pa.string()), pa.array(out["n_words"], pa.int64()), spans], names=["id", "kept", "n_words", "spans"]
            )

    return run


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, kept, n_words, n_removed, spans (start, until in words) of every row: its
    words, joined by one space, without those that a window covers which starts anywhere
    else too, in this text or another. Words are what spaces, tabs and line breaks of
    ASCII part.

    A null or empty text has no words, a text of under ``window`` words no window. All
    rows of a repeated text or row lose all their windows. Null and repeated ids are as
    any other. An empty table gives no rows; other columns aren't read. window is 2 or
    more."""
    if window < 2:
        raise ValueError("window must be 2 or more")
    block = (window + 1) // 2
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))
    counts, seen = observed(rows.select("k1", "k2", F.octet_length("text").alias("b")), F.sum("b").alias("bytes"), F.count("*").alias("rows"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (seen["bytes"] or 0) // PART_BYTES + 1)
    most = max(seen["rows"] // HOT_SHARE, HOT_LEAST)
    hot, _ = counted(counts.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") > most).select("k1", "k2", F.ceil(F.col("n") / most).alias("salts")))
    hashed = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("h")

    blocks = _answers(rows.select("k1", "k2", hashed).mapInArrow(_probe_blocks(block, parts), MESSAGE), parts)
    near = _joined(rows.select("k1", "k2", "text"), blocks, hot, "inner")
    repeats = _answers(near.select("k1", "k2", "places", hashed).mapInArrow(_extend_hits(block, window, parts), MESSAGE), parts)

    every = _joined(rows, repeats, hot, "left").select("id", "text", "places")
    kind = docs.schema[id_col].dataType.simpleString()
    out = every.mapInArrow(_cut(window), f"id {kind}, kept string, n_words long, spans array<struct<start:int,until:int>>")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["until"] - s["start"])
    return out.select(F.col("id").alias(id_col), "kept", "n_words", removed.alias("n_removed"), "spans")
