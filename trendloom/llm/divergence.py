"""How the sources of a language differ in their terms, shard by shard in DuckDB.

1. Each task counts the terms of its documents with SQL, slice by slice, and sends partial
   counts to shards by a hash of language and term.
2. A shard adds them up, keeps the terms of enough documents, and stores their counts.
   Spark sums up the totals and vocabulary sizes that all shards have in common.
3. Each shard then has all sources' smoothed shares of its terms: it sums the divergences
   of all pairs of sources over its terms and ranks its most over-used ones. Spark merges
   the sums and ranks them.

A shard holds the counts of its terms, of which each (language, term) has one for each
source: the number of shards grows with the bytes of text, so that a shard doesn't.
All arithmetic is in whole numbers (128 bits where products need them).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.shared import materialise, observed

#: Bytes of text for a shard; of a slice that is counted at once; partial counts that a
#: task holds before it sends them.
SHARD_BYTES, SLICE_BYTES, HELD = 8 << 20, 8 << 20, 1_000_000
UNIT = 1_000_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

COUNT = f"""
INSERT INTO part
SELECT lang, source, term, sum(n)::BIGINT, count(*) FROM (
  SELECT r, lang, source, term, count(*) AS n FROM (
    SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{TERM}')) AS term
    FROM (SELECT row_number() OVER () AS r, * FROM docs))
  GROUP BY ALL)
GROUP BY ALL"""

MERGED = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM part GROUP BY ALL"

KEPT = """
SELECT lang, source, term, sum(n)::BIGINT AS n FROM part
SEMI JOIN (SELECT lang, term FROM part GROUP BY ALL HAVING sum(docs) >= $least) AS k USING (lang, term)
GROUP BY ALL"""

SHARES = f"""
CREATE TABLE shares AS
WITH terms AS (SELECT lang, term, sum(n) AS of_lang FROM kept GROUP BY ALL)
SELECT g.lang, g.source, t.term, coalesce(k.n, 0) AS n,
  (1 + {UNIT}::HUGEINT * (coalesce(k.n, 0) + 2) // (g.total + 2 * g.v))::BIGINT AS p,
  (1 + {UNIT}::HUGEINT * (t.of_lang + 2) // (g.lang_total + 2 * g.v))::BIGINT AS q
FROM groups AS g JOIN terms AS t USING (lang) LEFT JOIN kept AS k ON k.lang = g.lang AND k.source = g.source AND k.term = t.term"""

FOUND = """
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
FROM shares AS a JOIN shares AS b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
UNION ALL
SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) AS f FROM shares WHERE n > 0 AND p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, term) <= $top"""


def _session():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "900MB", "temp_directory": "", "preserve_insertion_order": False})


def _counts(batches):
    """Partial counts of a task's documents."""
    con = _session()
    con.execute("CREATE TABLE part (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")

    def sent():
        yield from con.sql(MERGED).to_arrow_reader(100_000)
        con.execute("TRUNCATE part")

    held = 0
    for batch in batches:
        rows = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
        for lo in range(0, batch.num_rows, rows):
            con.register("docs", pa.Table.from_batches([batch.slice(lo, rows)]))
            con.execute(COUNT)
            con.unregister("docs")
            held = con.execute("SELECT count(*) FROM part").fetchall()[0][0]
            if held > HELD:
                yield from sent()
                held = 0
    if held:
        yield from sent()


def _kept(least: int):
    def run(batches):
        con = _session()
        con.execute("CREATE TABLE part (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        for batch in batches:
            con.register("more", pa.Table.from_batches([batch]))
            con.execute("INSERT INTO part SELECT lang, source, term, n, docs FROM more")
            con.unregister("more")
        yield from con.sql(KEPT, params={"least": least}).to_arrow_reader(100_000)

    return run


def _sums(top: int):
    def run(kept: pa.Table, groups: pa.Table) -> pa.Table:
        con = _session()
        con.register("kept", kept)
        con.register("groups", groups)
        con.execute(SHARES)
        names = {"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.int64()}
        batches = [b.cast(pa.schema(list(names.items()))) for b in con.sql(FOUND, params={"top": top}).to_arrow_reader(100_000)]
        return pa.Table.from_batches(batches, pa.schema(list(names.items())))

    return run


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: for each source of a language
    each other one, by how much their shares of the language's terms differ, all ranks.
    Part ``term``: the ``top`` terms that a source uses more than its language does.

    A null text, lang or source is as an empty one: documents without terms count as a
    group all the same, with even shares. Repeated rows count as often as they come.
    Equal values are ranked by item, in the order of its bytes. A language without terms
    in ``least_docs`` documents has pairs of value 0; a lone source has none. An empty
    table gives no rows; other columns aren't read."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for n, c in (("text", text), ("lang", lang), ("source", source))])
    groups, seen = observed(rows.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("b")), F.sum("b").alias("bytes"))
    shards = (seen["bytes"] or 0) // SHARD_BYTES + 1
    kind = "lang string, source string, term string, n long"
    counts = rows.mapInArrow(_counts, f"{kind}, docs long").repartition(shards, "lang", "term")
    kept = materialise(counts.mapInArrow(_kept(least_docs), kind))

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = groups.select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", zero("total"), zero("v"), zero("lang_total"))
    groups = materialise(groups)

    # Every shard gets the groups: as many rows as its sums have sources.
    parts = kept.withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")).groupBy("shard")
    dealt = groups.where("v > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("shard")
    found = parts.cogroup(dealt).applyInArrow(_sums(top), "lang string, source string, part string, item string, value long")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    empty = groups.where("v = 0").select("lang", "source")
    none = empty.join(empty.withColumnRenamed("source", "item"), "lang").where("source != item").withColumn("value", F.lit(0).cast("long"))
    both = both.unionByName(none.select(both.columns)).withColumn("part", F.lit("pair"))
    every = both.unionByName(found.where("part = 'term'").select(both.columns))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return every.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank")).where((F.col("part") == "pair") | (F.col("rank") <= top))
