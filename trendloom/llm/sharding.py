"""Sharding by sampled splitters, with DataFrame operations only.

1. A size-weighted sample of keys is drawn: a row is taken with a probability in
   proportion to its bytes, so that the sample's quantiles are quantiles of bytes.
2. Its quantiles cut the key space (a hash of the text) into ranges.
3. Every row is counted. Ranges over their fair share, by bytes or by rows, are
   subdivided evenly by the hash of the id into cells. A group of equal texts of any
   size is so divided.
4. Exact byte totals of the cells and a running sum inside each cell give each
   row's place in one order of all bytes; shard i takes the rows whose middle byte
   is in the i-th of ``shards`` equal stretches. Shards differ by the size of their
   first and last rows at most.

The driver sees the sample (``SAMPLE`` rows expected) and a row for each range.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.shared import hash_share, materialise

#: Expected size of the splitter sample.
SAMPLE = 4096
#: First cut of the key space.
RANGES = 256
#: No cell is meant to hold more rows than this.
CELL_ROWS = 200_000


def _range_of(key: Column, splitters: list[int]) -> Column:
    """The number of splitters at or below key: a count over every 16th, then one over
    the 16 from there."""
    if not splitters:
        return F.lit(0)
    at_or_below = lambda numbers: F.size(F.filter(numbers, lambda s: s <= key))
    every = F.array(*[F.lit(s) for s in splitters])
    coarse = F.array(*[F.lit(s) for s in splitters[15::16]]) if len(splitters) > 15 else F.array().cast("array<long>")
    skipped = at_or_below(coarse) * 16
    return skipped + at_or_below(F.slice(every, skipped + 1, F.lit(16)))


def _quantiles(sample: list, total: float, ranges: int) -> list[int]:
    """Boundaries between equal weights of the sample, without repeats."""
    if not sample:
        return []
    rows = sorted((r["h"], max(float(r["size"]), total / SAMPLE)) for r in sample)
    running, acc = [], 0.0
    for _, weight in rows:
        acc += weight
        running.append(acc)
    cuts = {rows[min(bisect_left(running, acc * i / ranges), len(rows) - 1)][0] for i in range(1, ranges)}
    return sorted(cuts)


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES) -> DataFrame:
    """Puts every row into one of ``shards`` shards of near-equal bytes.

    Returns id_col, size (UTF-8 bytes of the text plus 1; a null text has none),
    text_crc32, law (``bytes``), shard, slot (0, 1, ... within the shard),
    grown_shard (null for this law).

    Null ids are placed like any other row. Repeated rows are kept, each with a slot
    of its own; which of two identical rows gets which slot has no meaning. An empty
    table gives no rows. Columns other than the two named are not read.
    """
    text = F.col(text_col)
    narrow = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("h"),
            F.xxhash64(F.col(id_col), F.lit(17)).alias("t"),
        )
    )
    total = narrow.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total_bytes, total_rows = total["bytes"] or 0, total["rows"]
    take = hash_share(F.col("t"), 1) * F.lit(float(max(total_bytes, 1))) < F.col("size") * F.lit(float(SAMPLE))
    sample = narrow.where(take).select("h", "size").collect()
    placed = narrow.withColumn("range", _range_of(F.coalesce("h", F.lit(0)), _quantiles(sample, total_bytes, ranges)))

    # Overfull ranges are split into equal cells by a hash that copies of a text don't share.
    per_range = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    fair_bytes, fair_rows = max(total_bytes / ranges, 1), max(min(total_rows / ranges, CELL_ROWS), 1)
    pieces = {r["range"]: max(1, round(r["bytes"] / fair_bytes), round(r["rows"] / fair_rows)) for r in per_range}
    cut = F.lit(1)
    if any(n > 1 for n in pieces.values()):
        numbers = F.array(*[F.lit(pieces.get(i, 1)) for i in range(max(pieces) + 1)])
        cut = F.element_at(numbers, F.col("range") + 1)
    placed = placed.withColumn("cell", F.col("range").cast("long") * (1 << 20) + F.pmod(F.xxhash64("t", F.lit(5)), cut))

    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("cell")
        .agg(F.sum("size").alias("bytes"))
        .select("cell", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    )
    inside = Window.partitionBy("cell").orderBy("h", "t", "doc_id", "text_crc32", "size")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.join(starts, "cell").withColumn("offset", F.col("start") + F.sum("size").over(upto) - F.col("size"))
    shard = F.least(F.lit(shards - 1), F.floor((F.col("offset") + F.col("size") / 2) * F.lit(shards) / F.lit(max(total_bytes, 1)))).cast("int")
    ranked = materialise(
        placed.withColumn("shard", shard).select("doc_id", "size", "text_crc32", "cell", "shard", F.row_number().over(inside).alias("n"))
    )
    # Where each (shard, cell) starts within its shard: one row for each cell and boundary.
    parts = ranked.groupBy("shard", "cell").agg(F.min("n").alias("first"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("shard", "cell", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"))
    return ranked.join(parts, ["shard", "cell"]).select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("n") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
