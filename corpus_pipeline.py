"""The corpus pipeline: every stage works on all rows that the one before kept.

1. quality: the weak-label classifier; rejected documents go (operator 10)
2. exact_dedup: chunk recipes; the row of the largest doc_id stays (operator 3)
3. near_dedup: SetSketch, five words, similarity 0.8 or more; the row of the
   least doc_id of each component stays (operator 4)
4. mix: sources to target weights, with repeats and a cut (operator 6)
5. pack: windows of 2048 ids, each piece with its token ids (operator 1)

Stages 1 to 4 return the columns of documents; each stage's rows are written
as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bagwise.llm import exact_dedup, mixing, near_dedup, packing, quality_model, queries
from bagwise.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.vocabulary())


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", pack)]

#: Tokenisation, weak labels and packing are not SQL; tests/llm holds the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
