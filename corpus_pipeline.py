"""From raw documents to packed training rows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All stages but the last return the columns of ``documents``.

1. quality       adaptive quality rules; documents that they reject go
2. near_copies   n-gram Jaccard join; one document of each group of near copies stays
3. decontaminate documents that hold a benchmark passage go
4. mix           sources to target weights; a document occurs as often as the mix takes it
5. pack          token ids in fixed rows
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.lineage import scratch
from graphloom.llm import decontam, jaccard, mixing, packing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_documents(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

#: SQL can't express the sketches, the latent search or the packing; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
