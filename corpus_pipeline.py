"""The corpus pipeline: documents through five stages, each written as Parquet by the caller and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, decontaminate, langid, near_dedup, pii
from tidewatch.llm.common import free_name, session, table
from tidewatch.session import cut_lineage

#: the JVM beside the workers has grown in the stages before, so they remember fewer pieces than op10's
PIECES_MOST = 100_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with enough confidence."""
    session(spark)
    return langid.keep_recognised(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    session(spark)
    return near_dedup.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, up to its error budget."""
    session(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text replaced by its kind."""
    session(spark)
    return pii.redacted(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, number of tokens, their ids, and whether decoding them gives the text back."""
    session(spark)
    text, ids = free_name(docs, "whole_text"), free_name(docs, "ids")
    encode, decode = bpe.codec(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, PIECES_MOST)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text))
    rows = rows.withColumn(ids, encode(F.col(text)))
    return rows.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.col(ids).alias("ids"),
                       (decode(F.col(ids)) == F.col(text).cast("binary")).alias("exact"))


STAGES = [
    ("language", language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal_data", redacted),
    ("tokens", token_ids),
]

#: language models, boosted trees and BPE are beyond SQL; the stages are tested against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is checkpointed, since the next stage reads it more than once."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut_lineage(docs), sf_dir)
    return docs
