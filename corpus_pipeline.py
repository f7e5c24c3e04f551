"""The corpus pipeline: quality classifier, near-dedup, decontamination, mixing, token output.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the stage before kept; its result is written
as Parquet and read again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, mixing, near_dedup, quality_classifier, token_output
from textloom.llm._common import materialise, release, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, trained on their labels, accepts."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id. Rows with a null id stay; of rows that
    repeat an id one stays."""
    groups = materialise(near_dedup.near_duplicates(docs), "pipeline-groups")
    out = docs.join(groups.where("not kept").select("doc_id").distinct().hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    twice = materialise(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeats")
    if not twice.isEmpty():
        once = out.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
        out = out.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
    return out


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item within its error budget."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them."""
    return mixing.mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all rows, written as ORC and read back: doc_id, start, n_tokens, ids_crc32."""
    return token_output.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [("quality_classifier", quality), ("near_dedup", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("token_output", tokens)]

#: Not for SQL: classifier, sketches and tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)  # only tables of this run's own folder
    return STAGES[-1][1](spark, docs, sf_dir)
