"""A corpus pipeline of five stages over ``documents``.

Each stage works on what the one before it kept, and is written as Parquet and read again before the
next one; what a stage staged for itself is removed then.  All but the last return the columns of ``documents``.

Defined cases: a null text is empty (its language isn't told, so it goes in the first stage); rows with a null
id are documents like others; of rows with equal texts one stays, so rows that repeat do too; two texts under one
id are judged apart; an empty table gives no sequences; further columns are kept until the last stage, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import exact_dedup, jaccard_join, language_id, packing, pii
from recollect.llm.common import forget, mark, staged
from recollect.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't told go."""
    ship(spark)
    return language_id.keep_known(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at five words and a similarity of 0.8, that with the smallest id stays."""
    ship(spark)
    return jaccard_join.keep_one_of_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows."""
    ship(spark)
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("jaccard_join", near), ("pii", private), ("packing", pack)]

#: SQL expresses neither the language model nor the span classifier; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = mark()
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        forget(spark, start)
    return STAGES[-1][1](spark, docs, sf_dir)
