"""Maintenance decisions, access statistics, embeddings cache, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import words
from recollect.operators.fusion import live


def dead_payload(frames: DataFrame) -> DataFrame:
    """One row: bytes of all and of dead content, and the dead share."""
    size = F.octet_length(F.coalesce("content", F.lit("")))
    out = frames.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum(F.when(live(), 0).otherwise(size)), F.lit(0)).alias("dead_bytes"), F.count_if(live()).alias("live"), F.count_if(F.col("status") == "deleted").alias("deleted"), F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"))
    return out.withColumn("dead_share", F.when(F.col("total_bytes") > 0, F.round(F.col("dead_bytes") / F.col("total_bytes"), 9)).otherwise(0.0))


def rewrite_decision(state: DataFrame, *, every: int = 4, cooldown_ms: int = 3_600_000, idle_ms: int = 15_000, least_bytes: int = 1 << 20, least_share: float = 0.25, least_gain: int = 64 * 1024) -> DataFrame:
    """The outcome of each row (enabled, flushes, now_ms, last_run_ms, last_write_ms, total_bytes, dead_bytes): the first gate that stops it, else ``run``."""
    share = F.when(F.col("total_bytes") > 0, F.col("dead_bytes") / F.col("total_bytes")).otherwise(0.0)
    bar = min(max(least_share, 0.0), 1.0)
    return state.withColumn(
        "outcome",
        F.when(~F.col("enabled"), "disabled")
        .when(F.pmod(F.col("flushes"), F.lit(max(1, every))) != 0, "cadence")
        .when(F.col("last_run_ms").isNotNull() & (F.col("now_ms") - F.col("last_run_ms") < cooldown_ms), "cooldown")
        .when(F.col("now_ms") - F.col("last_write_ms") < idle_ms, "busy")
        .when((F.col("dead_bytes") < least_bytes) & (share < bar), "below_thresholds")
        .when(F.col("dead_bytes") < least_gain, "small_gain")
        .otherwise("run"),
    )


def validated_rewrite(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: whether a rewrite kept every frame id and all live content, else ``rollback``."""
    left = before.select("frame_id", F.when(live(), F.sha2(F.coalesce("content", F.lit("")), 256)).alias("a"))
    right = after.select("frame_id", F.when(live(), F.sha2(F.coalesce("content", F.lit("")), 256)).alias("b"), F.lit(True).alias("there"))
    both = left.join(right, "frame_id", "full_outer")
    bad = both.filter(F.col("there").isNull() | ~F.col("a").eqNullSafe(F.col("b"))).agg(F.count(F.lit(1)).alias("differences"))
    return bad.select("differences", F.when(F.col("differences") == 0, "kept").otherwise("rollback").alias("outcome"))


def kept_rewrites(candidates: DataFrame, keep: int = 2) -> DataFrame:
    """Rewritten stores (store, path, mtime_ms) that stay: the newest of each store."""
    order = Window.partitionBy("store").orderBy(F.desc("mtime_ms"), "path")
    return candidates.withColumn("place", F.row_number().over(order)).withColumn("keep", F.col("place") <= keep)


def access_stats(accesses: DataFrame) -> DataFrame:
    """frame_id, uses, last_ms, first_ms of accesses (frame_id, ts_ms)."""
    return accesses.groupBy("frame_id").agg(F.count(F.lit(1)).alias("uses"), F.max("ts_ms").alias("last_ms"), F.min("ts_ms").alias("first_ms"))


def pruned(stats: DataFrame, active: DataFrame) -> DataFrame:
    return stats.join(active.select("frame_id").distinct(), "frame_id", "left_semi")


def session_stats(turns: DataFrame) -> DataFrame:
    """session_id, frames, words of live rows (session_id, content)."""
    return turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.size(words(F.coalesce("content", F.lit(""))))).cast("long").alias("words"))


def missing_embeddings(texts: DataFrame, cached: DataFrame) -> DataFrame:
    """text_hash, content of the distinct texts that have no vector yet; each is embedded once."""
    each = texts.select(F.sha2(F.coalesce("content", F.lit("")), 256).alias("text_hash"), "content")
    return each.groupBy("text_hash").agg(F.first("content").alias("content"), F.count(F.lit(1)).alias("uses")).join(cached.select("text_hash"), "text_hash", "left_anti")


def source_changed(before: Column, after: Column) -> Column:
    """Whether a derived table must be made again."""
    return ~before.eqNullSafe(after)


# -------------------------------------------------------------- evaluation
def retrieval_quality(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row: mean recall at k and reciprocal rank of results (query_id, item, rank) against relevant (query_id, item)."""
    wanted = relevant.select("query_id", "item").distinct()
    hits = results.filter(F.col("rank") <= k).join(wanted, ["query_id", "item"])
    each = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(hits.groupBy("query_id").agg(F.countDistinct("item").alias("found"), F.min("rank").alias("first")), "query_id", "left")
    return each.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.coalesce("found", F.lit(0)) / F.col("n")), 6).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count_if(F.col("found").isNull()).alias("failures"))


def token_f1(answer: Column, expected: Column) -> Column:
    """F1 of the words of an answer."""
    a, b = words(answer), words(expected)
    common = F.size(F.array_intersect(a, b))
    p, r = common / F.greatest(F.size(F.array_distinct(a)), F.lit(1)), common / F.greatest(F.size(F.array_distinct(b)), F.lit(1))
    return F.when(common > 0, 2 * p * r / (p + r)).otherwise(0.0)


def latency_summary(samples: DataFrame, by: list[str]) -> DataFrame:
    """Mean and quantiles of value."""
    return samples.groupBy(*by).agg(F.round(F.avg("value"), 6).alias("mean"), *[F.round(F.percentile("value", F.lit(q)), 6).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)])


def drift(first: Column, last: Column) -> Column:
    """Change in percent; nothing to compare with is none."""
    return F.when(first > 0, (last - first) / first * 100.0).otherwise(0.0)
