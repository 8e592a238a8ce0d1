"""A training corpus from raw documents: quality, toxicity, near duplicates, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and
read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import mixing, near_duplicates, packing, quality, toxicity
from strandline.llm._shared import ship, table, written
from strandline.llm.queries import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    ship(spark)
    return near_duplicates.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    ship(spark)
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_civil),
    ("n-gram Jaccard join", keep_distinct),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: SQL can't express the trained stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs, f"stage-{at}-{name.replace(' ', '-')}")
    return docs
