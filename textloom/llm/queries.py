"""The registered queries of the training-data operators, one opN_<name> each, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import chat_format, decontaminate, language_id, mixing, near_dedup, oracles, quality_classifier, quality_rules, token_count, token_output, url_filter
from textloom.llm._common import table

#: The rules of the URL query.
ALLOW, BLOCK = ["example.net/en/", "org/fr/"], ["net/", "example.com/de/"]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    schema = "conv_id long, turn long, role string, text string"
    hard = spark.createDataFrame([(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], schema)
    turns = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    return chat_format.read_back(chat_format.chat_format(turns.unionByName(hard)))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids written as ORC and read back."""
    return token_output.token_output(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items found in documents, within their error budgets."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return url_filter.url_filter(table(spark, sf_dir, "pages"), ALLOW, BLOCK).withColumn("score", F.round("score", 6))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distances and verdict of the quality rules for every document."""
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "common_distance")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_token_orc, op3_token_counts, op4_decontaminate, op5_minhash_near_dedup, op6_quality_qda, op7_url_filter, op8_language_id, op9_source_mix, op10_quality_rules)
}

ORACLES: dict[str, str] = {"op1_chat_format": oracles.CHAT_FORMAT, "op5_minhash_near_dedup": oracles.NEAR_DEDUP, "op7_url_filter": oracles.url_filter(ALLOW, BLOCK), "op10_quality_rules": oracles.QUALITY_RULES}
