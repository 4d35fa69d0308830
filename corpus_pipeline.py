"""From raw documents to packed training sequences, in five stages.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``.  All but
the last return the columns of ``documents``.  Each has the executors shrink their heaps first.

1. toxicity: documents with a toxicity score of 0.5 or more go.
2. exact_dedup: of equal texts (A-Z lower-cased) the row with the largest id stays.
3. near_dedup: of each group linked by a similarity of 0.8 on five-word shingles, the row
   with the least id stays.
4. mixing: sources are taken to their target weights; a document appears as often as the mix
   takes it, the last one of a source perhaps cut to its first words.
5. packing: all pieces of all documents with their place in sequences of 2048 tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from lodestone.llm.shared import shared_folder, shrink, spread


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink(spark)
    return toxicity.drop_toxic(docs, toxicity.learn(spark, docs, sf_dir))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink(spark)
    return exact_dedup.drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink(spark)
    return near_dedup.drop_near_copies(docs, size=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink(spark)
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the trained and the random stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all of ``documents``; what each returns is written to the shared checkpoint folder."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus_pipeline-{uuid.uuid4().hex}"
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
