"""A training-data pipeline: five stages over `documents`, each written as Parquet and read again.

Language ID leaves out documents without an identifiable language and fills in the language where it is null; exact and near deduplication
leave one document of each group (the largest and the smallest doc_id); mixing repeats or leaves out
documents so that sources meet their target weights; packing lays what is left
into sequences of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quaerix.llm import exact_dedup, langid, mixing, near_dedup, packing
from quaerix.llm.common import materialize, table
from quaerix.llm.queries import VOCABULARY
from quaerix.session import ship


#: Documents that every language's classifier rejects by more than half of what separates two languages go. Short clean texts score lower than long ones.
LEAST_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.keep_identified(docs, langid.fit(docs), least=LEAST_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.drop_near_duplicates(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    # Few remembered words: the stages share an executor's memory.
    return packing.pack(docs, VOCABULARY, words=1 << 15)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]

#: Language ID, near deduplication and tokens cannot be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
