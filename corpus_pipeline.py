"""Corpus pipeline: stages over documents, each written and read again by the next.

Each function takes (spark, docs, sf_dir). All but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aridscape.llm import mixing, packing, quality, simhash, substring
from aridscape.llm.common import written
from aridscape.llm.queries import tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed limits and the outlier test keep."""
    return quality.filtered(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicated(docs)


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds."""
    return substring.cleaned(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return packing.packed(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("near copies", near_copies_stage),
    ("repeated passages", passages_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Iterated estimates and components cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
