"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.shared import table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendloom.llm.bpe import digest

    return digest(table(spark, sf_dir, "documents"), _tokenizer())


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendloom.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendloom.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendloom.llm.quality import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendloom.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendloom.llm.pii import DEMO_KEY, pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendloom.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendloom.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendloom.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendloom.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendloom.llm.substring import remove_repeats

    rows = remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendloom.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trendloom.llm.merkle import audit

    return audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_sharding": op2_sharding,
        "op3_toxicity": op3_toxicity,
        "op4_quality": op4_quality,
        "op5_html_text": op5_html_text,
        "op6_pii": op6_pii,
        "op7_secrets": op7_secrets,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_language": op9_language,
        "op10_decontamination": op10_decontamination,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_divergence": op12_divergence,
        "op13_merkle": op13_merkle,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from trendloom.llm.oracles import SQL

    return SQL
