"""From raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from intervalia.llm import bpe, mixing, ngram_join, quality_rules, suffix_dedup
from intervalia.llm.common import stash, table
from intervalia.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules: quality_rules.filter_documents, with its defined cases."""
    ship(spark)
    return quality_rules.filter_documents(spark, docs, sf_dir)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, the one of least doc_id: ngram_join.keep_one_of_each."""
    ship(spark)
    return ngram_join.keep_one_of_each(spark, docs, sf_dir)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat: suffix_dedup.cut_documents."""
    ship(spark)
    return suffix_dedup.cut_documents(spark, docs, sf_dir)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time that the mix takes a document, a partition a shard: mixing.mix_documents."""
    ship(spark)
    return mixing.mix_documents(spark, docs, sf_dir)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes decoded from them: bpe.encode_documents."""
    ship(spark)
    return bpe.encode_documents(spark, docs, sf_dir)


STAGES = [("quality_rules", quality), ("ngram_join", near_copies), ("suffix_dedup", repeats), ("mixing", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder, where lineage ends. An empty table gives
    an empty result; nulls, repeated rows and other columns are as each stage defines."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Byte-pair encoding and the removal of repeated bytes have no DuckDB form; tests/llm holds run() against a plain version.
ORACLE_SQL = None
