"""The frame log: scans, lookups, folding of mutations, snapshots, checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.operators.fusion import live
from recollect.session import staged


class StoreError(ValueError):
    """A store's rule is broken: unknown ids, wrong dimensions, cycles, nothing committed."""


def lookup(frames: DataFrame, ids: DataFrame) -> DataFrame:
    """Frames of the ids (frame_id); unknown ids are skipped."""
    return frames.join(ids.select("frame_id").distinct(), "frame_id", "left_semi")


def fold(committed: DataFrame, mutations: DataFrame) -> DataFrame:
    """frame_id, content, ts_ms, status, supersedes, superseded_by after the mutations (seq, op, frame_id, other_id, content, ts_ms).

    A put gives a frame its content (the last one counts), a delete its status.  A supersede of frame_id by
    other_id counts if both exist and differ, neither has such a link yet, and it is the first for either.
    """
    puts = mutations.filter("op = 'put'").groupBy("frame_id").agg(F.max_by(F.struct("content", "ts_ms"), "seq").alias("new"))
    gone = mutations.filter("op = 'delete'").select("frame_id").distinct().withColumn("gone", F.lit(True))
    base = committed.select("frame_id", "content", "ts_ms", "status", "supersedes", "superseded_by").join(puts, "frame_id", "full_outer").join(gone, "frame_id", "left")
    known = base.select("frame_id", F.coalesce("new.content", "content").alias("content"), F.coalesce("new.ts_ms", "ts_ms").alias("ts_ms"), F.when(F.col("gone"), "deleted").otherwise(F.coalesce("status", F.lit("active"))).alias("status"), "supersedes", "superseded_by")
    links = valid_links(known, mutations)
    out = known.join(links.select("frame_id", F.col("other_id").alias("by")), "frame_id", "left").join(links.select(F.col("other_id").alias("frame_id"), F.col("frame_id").alias("of")), "frame_id", "left")
    return out.select("frame_id", "content", "ts_ms", "status", F.coalesce("supersedes", "of").alias("supersedes"), F.coalesce("superseded_by", "by").alias("superseded_by"))


def valid_links(frames: DataFrame, mutations: DataFrame) -> DataFrame:
    """frame_id, other_id of the supersede mutations that count."""
    asked = mutations.filter("op = 'supersede' AND frame_id <> other_id")
    first = asked.withColumn("a", F.row_number().over(Window.partitionBy("frame_id").orderBy("seq"))).withColumn("b", F.row_number().over(Window.partitionBy("other_id").orderBy("seq"))).filter("a = 1 AND b = 1")
    free = first.join(frames.filter("superseded_by IS NULL").select("frame_id"), "frame_id", "left_semi").join(frames.filter("supersedes IS NULL").select(F.col("frame_id").alias("other_id")), "other_id", "left_semi")
    reverse = free.select(F.col("frame_id").alias("other_id"), F.col("other_id").alias("frame_id"), F.col("seq").alias("earlier"))
    return free.join(reverse, ["frame_id", "other_id"], "left").filter("earlier IS NULL OR earlier > seq").select("frame_id", "other_id")


def violations(mutations: DataFrame) -> DataFrame:
    """Supersede mutations that break a rule, with the first rule broken."""
    asked = mutations.filter("op = 'supersede'")
    a = F.row_number().over(Window.partitionBy("frame_id").orderBy("seq"))
    b = F.row_number().over(Window.partitionBy("other_id").orderBy("seq"))
    back = asked.select(F.col("frame_id").alias("other_id"), F.col("other_id").alias("frame_id"), F.col("seq").alias("earlier")).groupBy("frame_id", "other_id").agg(F.min("earlier").alias("earlier"))
    seen = asked.withColumn("a", a).withColumn("b", b).join(back, ["frame_id", "other_id"], "left")
    rule = F.when(F.col("frame_id") == F.col("other_id"), "self").when(F.col("earlier") < F.col("seq"), "reverse").when(F.col("a") > 1, "second_successor").when(F.col("b") > 1, "second_predecessor")
    return seen.withColumn("rule", rule).filter("rule IS NOT NULL").select("seq", "frame_id", "other_id", "rule")


def stats(frames: DataFrame) -> DataFrame:
    """One row: frames, active, deleted, superseded, generation."""
    return frames.agg(F.count(F.lit(1)).alias("frames"), F.count_if(live()).alias("live"), F.count_if(F.col("status") == "deleted").alias("deleted"), F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"), F.max("generation").alias("generation"))


def checksum(content: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(content, F.lit("")), "UTF-8"), 256)


def verify(frames: DataFrame, expected: DataFrame) -> DataFrame:
    """Frames whose content doesn't match the checksum written for them (frame_id, checksum), or that lack one."""
    seen = frames.select("frame_id", checksum(F.col("content")).alias("found"))
    return seen.join(expected.select("frame_id", "checksum"), "frame_id", "full_outer").filter(~F.col("found").eqNullSafe(F.col("checksum")))


def surrogates(frames: DataFrame) -> DataFrame:
    """frame_id (of the source), surrogate_id: live surrogates of live sources that are none themselves; the last one wins."""
    source = F.expr("try_cast(metadata['source_frame_id'] AS bigint)")
    made = frames.filter(live() & (F.col("kind") == "surrogate")).select(source.alias("frame_id"), F.col("frame_id").alias("surrogate_id"))
    real = frames.filter(live() & (F.coalesce(F.col("kind"), F.lit("")) != "surrogate")).select("frame_id")
    return made.join(real, "frame_id", "left_semi").groupBy("frame_id").agg(F.max("surrogate_id").alias("surrogate_id"))


def numbered(rows: DataFrame, base: int, *order: str) -> DataFrame:
    """Dense frame ids from ``base`` on, in the given order.

    A range sort gives each partition a run of the order, which is written before it is counted, so that both
    passes see the same runs; only the partitions' sizes go to the driver, and no single task sees all rows.
    """
    return placed(rows.orderBy(*order), base)


def in_runs(rows: DataFrame, *order: str) -> DataFrame:
    """Rows in order, each partition a run.  The ranges are found by a pass over ``rows`` of its own, so sort what is cheap to make, and derive the rest after it."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order)


def placed(ordered: DataFrame, base: int) -> DataFrame:
    """Dense frame ids from ``base`` on for rows whose partitions are runs of the order."""
    spark = ordered.sparkSession
    run = staged(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = sorted((r["_part"], r["count"]) for r in run.groupBy("_part").count().collect())
    starts, at = [], base
    for part, n in sizes:
        starts.append((part, at))
        at += n
    table = spark.createDataFrame(starts or [(0, base)], "_part int, _start long")
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)  # the place in the partition
    return run.join(F.broadcast(table), "_part").withColumn("frame_id", F.col("_start") + inside).drop("_part", "_at", "_start")


def check_dimensions(vectors: DataFrame) -> int:
    """The one dimension of all vectors."""
    seen = vectors.groupBy(F.size("embedding").alias("n")).count().limit(2).collect()
    if len(seen) != 1 or seen[0].n < 1:
        raise StoreError("vectors must not be empty and must have one dimension")
    return seen[0].n


def rewrite_live(frames: DataFrame) -> DataFrame:
    """All frames with their ids, without the content of those that aren't live."""
    return frames.withColumn("content", F.when(live(), F.col("content")))


class Store:
    """A folder of snapshots: ``frames/g=<n>`` and a manifest row for each generation that is complete.

    A commit writes a new snapshot, then its manifest; readers take the newest generation that has one, so a
    commit that was cut short is never seen.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _manifests(self) -> DataFrame | None:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return None
        return self.spark.read.schema("generation long, snapshot string, last_seq long").parquet(f"{self.path}/manifest")

    def head(self):
        rows = self._manifests()
        return rows.orderBy(F.desc("generation")).first() if rows is not None else None

    def frames(self) -> DataFrame:
        at = self.head()
        if at is None:
            raise StoreError("nothing has been committed")
        return self.spark.read.parquet(at.snapshot)

    def commit(self, mutations: DataFrame) -> int:
        """Fold the mutations after the last committed sequence number into a new generation."""
        at = self.head()
        pending = mutations.filter(F.col("seq") > (at.last_seq if at else -1))
        last = pending.agg(F.max("seq")).first()[0]
        if last is None:
            return at.generation if at else 0
        empty = self.spark.createDataFrame([], "frame_id long, content string, ts_ms long, status string, supersedes long, superseded_by long")
        generation = (at.generation if at else 0) + 1
        snapshot = f"{self.path}/frames/g={generation}-{uuid.uuid4().hex}"
        fold(self.frames() if at else empty, pending).withColumn("written", F.lit(generation)).write.parquet(snapshot)
        self.spark.createDataFrame([(generation, snapshot, last)], "generation long, snapshot string, last_seq long").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return generation


def replay(committed_seq: int, entries: DataFrame) -> DataFrame:
    """Entries (seq, valid, ...) that recovery applies: after the committed one and before the first that can't be read."""
    after = entries.filter(F.col("seq") > committed_seq)
    bad = after.filter("NOT valid").agg(F.min("seq").alias("bad"))
    return after.join(F.broadcast(bad)).filter("bad IS NULL OR seq < bad").drop("bad")
