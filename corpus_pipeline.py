"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of docs. Near-duplicates are those with a similarity of 0.8 or more on sets
of five-word shingles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import bpe, decontam, language, neardup, pii
from trendloom.llm.shared import materialise, short_batches, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with some confidence stay. Null, empty and
    letterless texts go; repeated rows are judged alike; an empty table gives no rows."""
    short_batches(spark)
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group stays, on one row: of rows that
    repeat its id, the one with the least text. Rows with a null id, and those without
    words (null and empty texts), all stay. An empty table gives no rows."""
    short_batches(spark)
    found = neardup.near_duplicates(docs, width=5, percent=80)
    gone = materialise(found.where(~F.col("kept")).select("doc_id").distinct())
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = materialise(kept.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if again.isEmpty():
        return kept
    several = kept.join(again, "doc_id").select(docs.columns)
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*+$")
    one = several.where(~blank).groupBy("doc_id").agg(F.min(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("r"))
    one = one.select("doc_id", "r.*").select(docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(one).unionByName(several.where(blank))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item stay, and rows with a null id or text; all rows
    of an id go if one of its texts has an item. An empty table gives no rows."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, with pseudonyms in their texts, made with the key that the
    session names in ``trendloom.pii.key``, else with the demonstration key. Null and
    empty texts stay as they are; repeated rows get the same text; an empty table gives
    no rows."""
    return pii.pseudonymised_rows(docs, spark.conf.get("trendloom.pii.key", pii.DEMO_KEY))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of every row; a null or empty text has no ids. An empty
    table gives no rows."""
    import public_tokenizers

    short_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII pseudonyms", replace_pii),
    ("BPE encoding", encode_tokens),
]

#: SQL can't express the language model, the similarity groups or BPE merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
