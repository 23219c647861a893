"""Photo- and video-shaped operators: segments, overlaps, roll-ups, places, summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The least overlap of a transcript piece with a segment, cells a degree, metres a degree.
LEAST_OVERLAP_MS = 250
# Fixed value: scores that differ by no more are a tie.
TIE = 1e-3
CELLS_PER_DEGREE, METRES_PER_DEGREE, MOST_CELLS = 100, 111_000.0, 100_000


def segment_windows(duration: Column, length: int, overlap: int, most: int) -> Column:
    """array<struct<index, start_ms, end_ms, mid_ms>> of windows over a duration; the last is cut short."""
    stride = max(1, length - overlap)
    count = F.when(duration <= 0, 0).otherwise(F.least(F.ceil(duration / F.lit(stride)).cast("long"), F.lit(most).cast("long")))
    starts = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count - 1, F.lit(0).cast("long"))), lambda i: i * stride)

    def window(start: Column, i: Column) -> Column:
        end = F.least(start + length, duration)
        return F.struct(i.cast("long").alias("index"), start.alias("start_ms"), end.alias("end_ms"), F.floor((start + end) / 2).cast("long").alias("mid_ms"))

    return F.when(count > 0, F.transform(starts, window)).otherwise(F.array().cast("array<struct<index:bigint,start_ms:bigint,end_ms:bigint,mid_ms:bigint>>"))


def overlap_join(segments: DataFrame, pieces: DataFrame, *, least_ms: int = LEAST_OVERLAP_MS, cell_ms: int = 60_000) -> DataFrame:
    """video_id, index, transcript: texts of pieces that overlap a segment by ``least_ms``, in order of (start, end, text).

    Both sides are dealt into time cells, so that the range condition becomes an equality join; a pair counts in
    the cell where its overlap starts.
    """
    def cells(df: DataFrame, start: str, end: str) -> DataFrame:
        return df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(start) / cell_ms), F.floor(F.greatest(F.col(start), F.col(end) - 1) / cell_ms))))

    left, right = cells(segments, "start_ms", "end_ms"), cells(pieces, "from_ms", "to_ms")
    both = left.join(right, ["video_id", "cell"])
    begin, end = F.greatest("start_ms", "from_ms"), F.least("end_ms", "to_ms")
    hit = both.filter((end - begin >= least_ms) & (F.floor(begin / cell_ms) == F.col("cell")))
    listed = F.array_sort(F.collect_list(F.struct("from_ms", "to_ms", "text")))
    return hit.groupBy("video_id", "index").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("transcript"), F.count(F.lit(1)).alias("n_pieces"))


def root_rollup(hits: DataFrame, frames: DataFrame, root_kind: str) -> DataFrame:
    """query_id, root_id, score, evidence, snippet: hits (query_id, frame_id, score, position, kind, preview) on live roots of a kind."""
    parents = frames.select("frame_id", F.coalesce("parent_id", "frame_id").alias("root_id"))
    roots = frames.filter((F.col("kind") == root_kind) & (F.col("status") == "active") & F.col("superseded_by").isNull()).select(F.col("frame_id").alias("root_id"))
    placed = hits.join(parents, "frame_id").join(roots, "root_id", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("position", "kind")))
    return placed.groupBy("query_id", "root_id").agg(F.max("score").alias("score"), F.array_distinct(F.transform(listed, lambda x: x["kind"])).alias("evidence"), F.min_by("preview", F.when(F.coalesce("preview", F.lit("")) != "", F.col("position"))).alias("snippet"))


def best_segments(hits: DataFrame, most: int = 3) -> DataFrame:
    """The best hit of each (query_id, root_id, index), and the first ``most`` of a root.

    Hits are taken from the highest score on; one takes the place of the best so far if its score is higher by more
    than ``TIE``, or within that and its frame is older.  A query's hits are at most what search returns for it.
    """
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("back"), "frame_id")))

    def better(acc: Column, x: Column) -> Column:
        gain = acc["back"] - x["back"]
        return F.when((gain > TIE) | ((F.abs(gain) <= TIE) & (x["frame_id"] < acc["frame_id"])), x).otherwise(acc)

    best = hits.groupBy("query_id", "root_id", "index").agg(listed.alias("hits")).select("query_id", "root_id", "index", F.aggregate("hits", F.get("hits", F.lit(0)), better).alias("best"))
    best = best.select("query_id", "root_id", "index", "best.frame_id", (-F.col("best.back")).alias("score"))
    few = Window.partitionBy("query_id", "root_id").orderBy(F.desc(F.round("score", 3)), "index")
    return best.withColumn("place", F.row_number().over(few)).filter(F.col("place") <= most)


def cell(degrees: Column) -> Column:
    return F.floor(degrees * CELLS_PER_DEGREE).cast("long")


def near(places: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """Places (lat, lon) in the cells around a point; a radius of nothing, or too many cells, filters nothing."""
    if radius_m <= 0:
        return places
    d_lat = radius_m / METRES_PER_DEGREE
    cos = abs(math.cos(math.radians(lat)))
    d_lon = min(180.0, radius_m / (METRES_PER_DEGREE * cos)) if cos > 1e-12 else 180.0
    lo_lat, hi_lat, lo_lon, hi_lon = (math.floor(x * CELLS_PER_DEGREE) for x in (lat - d_lat, lat + d_lat, lon - d_lon, lon + d_lon))
    if (hi_lat - lo_lat + 1) * (hi_lon - lo_lon + 1) >= MOST_CELLS:
        return places
    return places.filter(cell(F.col("lat")).between(lo_lat, hi_lat) & cell(F.col("lon")).between(lo_lon, hi_lon))


def current_roots(frames: DataFrame, kind: str) -> DataFrame:
    """asset_id, frame_id of the newest live root of each asset."""
    live = frames.filter((F.col("kind") == kind) & (F.col("status") == "active") & F.col("superseded_by").isNull())
    return live.groupBy(F.col("metadata")["asset_id"].alias("asset_id")).agg(F.max_by("frame_id", F.struct("ts_ms", "frame_id")).alias("frame_id"))


def with_children(frames: DataFrame, roots: DataFrame) -> DataFrame:
    """frame_id of roots and of frames below them: what a cascading delete removes.

    Roots grow with the input, so they aren't broadcast; a task hashes its share of them, and frames pass by without a sort.
    """
    named = roots.select(F.col("frame_id").alias("root_id")).hint("shuffle_hash")
    return frames.select("frame_id", F.coalesce("parent_id", "frame_id").alias("root_id")).join(named, "root_id", "left_semi").select("frame_id")


def recognized_lines(blocks: Column, most: int = 32) -> Column:
    """Lines of recognised text (array<struct<confidence, text>>): by confidence, longer ones first, without repeats."""
    order = F.array_sort(F.transform(blocks, lambda b: F.struct((-b["confidence"]).alias("c"), (-F.length(b["text"])).alias("n"), b["text"].alias("text"))))
    return F.slice(F.array_distinct(F.filter(F.transform(order, lambda x: F.trim(x["text"])), lambda t: t != "")), 1, most)


def region_proposals(boxes: Column, most: int = 4) -> Column:
    """The boxes (x, y, w, h, confidence) of highest confidence, or a two by two grid."""
    box = F.transform(F.slice(F.sort_array(F.transform(boxes, lambda b: F.struct((-b["confidence"]).alias("c"), b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h")))), 1, most), lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h")))
    grid = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.5).alias("w"), F.lit(0.5).alias("h")) for x in (0.0, 0.5) for y in (0.0, 0.5)])
    return F.when(F.coalesce(F.size(boxes), F.lit(0)) > 0, box).otherwise(grid)


def described(labels: Column, text: Column, least: float = 0.3, most: int = 5) -> Column:
    """An image as text: its labels (array<struct<label, confidence>>) and the text in it."""
    good = F.slice(F.array_sort(F.transform(F.filter(labels, lambda x: x["confidence"] > least), lambda x: F.struct((-x["confidence"]).alias("c"), x["label"].alias("label")))), 1, most)
    seen = F.array_join(F.transform(good, lambda x: x["label"]), ", ")
    return F.concat_ws("; ", F.when(seen != "", F.concat(F.lit("Image of "), seen)), F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit("Text: "), text)))


def degraded(frames: DataFrame, kind: str) -> DataFrame:
    """How many roots of a kind aren't on this device."""
    return frames.filter(F.col("kind") == kind).agg(F.count_if(F.coalesce(F.col("metadata")["is_local"], F.lit("true")) != "true").alias("degraded"), F.count(F.lit(1)).alias("roots"))


def clock(ms: Column) -> Column:
    """MM:SS of milliseconds."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), F.pmod(s, F.lit(60)))
