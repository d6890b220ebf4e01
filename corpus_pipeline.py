"""The corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; run() writes what a stage returns
as Parquet in the shared folder and reads it for the next, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, ngram_join, packing, quality
from tessera.llm.labelled import fold
from tessera.llm.queries import tokenizer_path
from tessera.llm.shared import stored

#: SQL can't express the classifier's or the packing's rows; tests compare stages with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject (label 0 likelier than 0.3); repeated ids keep their own verdict."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels, lambda i: fold(i, 4) != 2, threshold=0.7)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the smallest id."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return ngram_join.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in order of their positions."""
    return mixing.mixed(docs, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0, curves=mixing.CURVES)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path(), most=1024, end_id=2)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("mixing", mix_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs.select(*(F.col(c) for c in docs.columns))
