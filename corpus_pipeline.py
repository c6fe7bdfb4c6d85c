"""The corpus pipeline: four stages over `documents`, each written as Parquet and read again as the next one's input.

Every stage works on all that its predecessor kept. All but the last return the columns of `documents`."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytosift.llm import common, exact_dedup, langid, near_dup, packing, tokens


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that have no language: no text, no letter, or letters enough to judge and a low score."""
    labelled = docs.select("text", "lang")
    found = langid.identify(docs, langid.fit(labelled), prediction="_lang_pred", score="_score", letters="_letters")
    return found.where(langid.accepted(F.col("_lang_pred"), F.col("_score"), F.col("_letters"))).drop("_lang_pred", "_score", "_letters")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case), the document with the largest doc_id stays."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a similarity of 0.8 or more on five-word shingles, one stays."""
    return near_dup.near_dedup(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end=2, added=tokens.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]

#: A trained classifier and a tokenizer are no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
