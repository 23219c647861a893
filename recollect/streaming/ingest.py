"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recollect.operators.context import OVERLAP_TOKENS, TARGET_TOKENS, chunks
from recollect.session import staged
from recollect.sources.frames import Store
from recollect.sources.index import TextIndex, VectorIndex


def chunk_stream(texts: DataFrame, *, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Chunks of a stream of texts (doc_id, content): the same as of the whole batch, without state."""
    return chunks(texts, target=target, overlap=overlap)


def newest_per_key(batch: DataFrame) -> DataFrame:
    """The last operation on each key of a micro-batch (key, seq, op, value)."""
    return batch.groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("x")).select("key", "x.*")


def upsert_stream(operations: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, **options: str) -> StreamingQuery:
    """Apply the last operation per key of every micro-batch; the batch id makes a retry recognisable."""
    return operations.writeStream.options(**options).option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: apply(newest_per_key(df), i)).trigger(availableNow=True).start()


def index_stream(changes: DataFrame, index: TextIndex | VectorIndex, checkpoint: str, *, name: str, compact_after: int = 16, **options: str) -> StreamingQuery:
    """Keep an index of a stream of changes (frame_id, content or embedding, seq), each micro-batch once.

    A micro-batch is a segment under the stream's name and its number: one that is tried again after its segment was committed, but before
    the stream knew, changes nothing.  The last change of a frame counts, within a batch too.  After so many segments they are
    made one, between two batches.
    """
    value = "content" if isinstance(index, TextIndex) else "embedding"

    def apply(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("frame_id").agg(F.max_by(F.struct(value), "seq").alias("at"), F.max("seq").alias("seq")).select("frame_id", F.col("at")[value].alias(value), "seq")
        held = staged(newest)
        if held.limit(1).count():
            ends = held.agg(F.min("seq").alias("first"), F.max("seq").alias("last")).first()
            index.add(held.select("frame_id", value), seq=(ends.first, ends.last), batch=(name, number))
        if len(index.segments()) > compact_after:
            index.compact()

    return changes.writeStream.options(**options).option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()


def commit_stream(mutations: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Commit every micro-batch of mutations as a generation; batches that were committed before change nothing."""
    return mutations.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: store.commit(df)).trigger(availableNow=True).start()


def mutation_files(spark: SparkSession, path: str, schema: str, max_files: int = 16) -> DataFrame:
    """New mutation files as a stream; the number of files bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def access_counts(accesses: DataFrame) -> DataFrame:
    """Running access statistics of a stream (frame_id, ts_ms), for update mode."""
    return accesses.groupBy("frame_id").agg(F.count(F.lit(1)).alias("uses"), F.max("ts_ms").alias("last_ms"), F.min("ts_ms").alias("first_ms"))


def should_commit(used: int, size: int, pending: int, *, share: float = 0.8, least: int = 128 * 1024, largest: int = 4 << 20) -> bool:
    """Whether pressure on a small log calls for an early commit."""
    return 0 < size <= largest and pending >= least and used >= share * size
