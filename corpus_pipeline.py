"""A training corpus from ``documents``: five stages, each of them one corpus operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wirefold.llm.common import store, table
from wirefold.llm.decontaminate import decontaminate
from wirefold.llm.line_rules import clean
from wirefold.llm.mixing import take_words
from wirefold.llm.ngram_join import keep_one
from wirefold.llm.rans import read_shards, write_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, the one with the smallest doc_id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row per time, the last one cut where a block border falls inside."""
    return take_words(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document row of the encoded corpus, read back from its shards: ``doc_id, start,
    n_tokens, ids_crc32``."""
    return read_shards(write_shards(docs))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixture", mixture), ("encoding", encoding)]

#: Tokens and their checksums are not SQL's to say; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir))
    return docs
