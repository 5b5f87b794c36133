"""A corpus from documents to training sequences: quality rules, exact dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all the stage before it kept, and returns documents; the last returns the pieces of the
packed sequences. Stages are written to the shared folder in between; a stage's own tables and its input go once its output is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strucreg.llm import exact_dedup, mixing, ngram_join, packing, quality
from strucreg.llm.common import Tables
from strucreg.llm.queries import documents, tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality rules", good_documents),
    ("exact dedup", different_documents),
    ("n-gram Jaccard join", dissimilar_documents),
    ("mixing sources to target weights", mixed_documents),
    ("best-fit packing", packed_sequences),
]

# The language references, the mixing rates and the packing are fitted; SQL cannot say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "pipeline")
    docs, last = documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs = tables.settle(lambda: stage(spark, docs, sf_dir))  # noqa: B023  called at once
        if last is not None:
            tables.forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
