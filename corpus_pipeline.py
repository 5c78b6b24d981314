"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

All stages but the last return the columns of their input, whatever their names; extra columns are carried along. An empty table
stays empty. A null lang or source is a value of its own, a null doc_id comes before all others, and very long texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reviewtrust.llm import byte_bpe, line_dedup, mixing, rules, simhash
from reviewtrust.llm.common import read, workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the outlier test rejects go: null and empty texts among them. Repeated rows are judged alike."""
    return rules.keep_good(docs)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that five or more documents share stay in the one with the largest doc_id; every row stays, null texts as null."""
    return line_dedup.drop_shared_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest doc_id; repeated rows, and all null and empty texts, are one group."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, identical rows share one number of copies; texts without words are not taken."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and byte-level BPE ids of every row; null and empty texts have none."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode(docs, byte_bpe.sentencepiece_model(ranks), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", shared_lines),
    ("simhash_near_dedup", near_duplicates),
    ("mix_sources", mix_sources),
    ("byte_bpe", token_ids),
]

#: The estimates and fingerprints of stages 1, 3, 4 and 5 can't be expressed in SQL: tests/llm compares them with
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir)
    space = workspace(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = space.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
