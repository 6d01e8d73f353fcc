"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catsim.llm import chat, langid, media, mixing, neardup, packing, periods, pii, quality, sharding, spelling, substring, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(_documents(spark, sf_dir), labels).select("doc_id", "held_out", "score", "predicted", "spans")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer_path())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.media_columns(_documents(spark, sf_dir)))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_hostile(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.conversation_digests(chat.format_conversations(turns))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digests(_documents(spark, sf_dir))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_classes(_documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(_documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_report(_documents(spark, sf_dir))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(_documents(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(_documents(spark, sf_dir))


def queries() -> dict[str, Query]:
    found = (
        op1_toxicity,
        op2_packing,
        op3_quality_rules,
        op4_language_id,
        op5_media,
        op6_chat_format,
        op7_substring_dedup,
        op8_near_duplicates,
        op9_mixing,
        op10_pii,
        op11_spelling_variants,
        op12_sharding,
        op13_periodic_runs,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality.ORACLE_SQL,
        "op6_chat_format": chat.ORACLE_SQL,
        "op7_substring_dedup": substring.ORACLE_SQL,
        "op9_mixing": mixing.ORACLE_SQL,
        "op11_spelling_variants": spelling.ORACLE_SQL,
        "op12_sharding": sharding.ORACLE_SQL,
        "op13_periodic_runs": periods.ORACLE_SQL,
    }
