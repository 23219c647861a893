"""How the given tables stand for frames, vectors, queries and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.dates import millis


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as frames; metadata are language and source."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("frame_id"), F.col("text").alias("content"), F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"), "lang", "source")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), "embedding", "label")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a timeline: errors are deleted; an event is superseded by the next one of its user and type."""
    from pyspark.sql import Window

    events = table(spark, sf_dir, "events")
    nxt = F.lead("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return events.select(F.col("event_id").alias("frame_id"), millis(F.col("ts")).alias("ts_ms"), F.col("event_type").alias("kind"), "user_id", "value", F.col("props").alias("content"), F.when(F.col("event_type") == "error", "deleted").otherwise("active").alias("status"), nxt.alias("superseded_by"))


#: The same in SQL.
EVENT_FRAMES = """event_frames AS (SELECT event_id AS frame_id, epoch_us(ts) // 1000 AS ts_ms, event_type AS kind, user_id, value, props AS content,
  CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'active' END AS status,
  lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS superseded_by FROM events)"""


def memory_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as frames of a memory: with times, sessions, deleted and superseded ones, and surrogates."""
    n = F.col("doc_id")
    session = F.create_map(F.lit("session_id"), F.pmod(n, F.lit(5)).cast("string"))
    return table(spark, sf_dir, "documents").select(n.alias("frame_id"), F.col("text").alias("content"), (F.pmod(n * 7919, F.lit(100_003)) * 1000).alias("ts_ms"), F.when(n % 17 == 3, "deleted").otherwise("active").alias("status"), F.when(n % 13 == 5, n + 1).alias("superseded_by"), F.when(n % 19 == 7, "surrogate").otherwise("chunk").alias("kind"), session.alias("metadata"))


#: The same in SQL.
MEMORY_FRAMES = """memory_frames AS (SELECT doc_id AS frame_id, doc_id * 7919 % 100003 * 1000 AS ts_ms, CASE WHEN doc_id % 17 = 3 THEN 'deleted' ELSE 'active' END AS status,
  CASE WHEN doc_id % 13 = 5 THEN doc_id + 1 END AS superseded_by, CASE WHEN doc_id % 19 = 7 THEN 'surrogate' ELSE 'chunk' END AS kind, doc_id % 5 AS session FROM documents)"""
