"""Photo and video recall for a batch of questions: lanes by what a question has, constraints, roots, parts, budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import query_type, search_tokens
from recollect.operators import fusion, geo, lanes
from recollect.operators.context import prefix_budget
from recollect.session import staged
from recollect.sources.frames import numbered

LATEST = 9223372036854775807


def newest_in_range(rows: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """query_id, frame_id, rank: the newest rows (frame_id, ts_ms; ties: the smaller id) of each range (query_id, after_ms, before_ms; null: open), half open.

    Rows are numbered in order of time, and so are rows and ends of ranges together; what a range may hold are the ``limit``
    numbers below its end, which are joined by number.  No range meets more rows than that.
    """
    mine = rows.filter("ts_ms IS NOT NULL").select("ts_ms", F.lit(1).alias("kind"), (-F.col("frame_id")).alias("back"))
    ends = asked.select(F.coalesce("before_ms", F.lit(LATEST)).alias("ts_ms"), F.lit(0).alias("kind"), F.col("query_id").alias("back"), F.col("after_ms"))
    order = ("ts_ms", "kind", "back")
    place = numbered(mine, 0, *order).select(F.col("frame_id").alias("n"), (-F.col("back")).alias("frame_id"), "ts_ms")
    both = numbered(mine.unionByName(ends.drop("after_ms")), 0, *order).filter("kind = 0").select(F.col("back").alias("query_id"), F.col("frame_id").alias("above"))
    alone = numbered(ends, 0, *order).select(F.col("back").alias("query_id"), "after_ms", F.col("frame_id").alias("m"))
    upto = both.join(alone, "query_id").select("query_id", "after_ms", (F.col("above") - F.col("m")).alias("end")).filter("end > 0")
    each = upto.select("query_id", "after_ms", "end", F.explode(F.sequence(F.greatest(F.col("end") - limit, F.lit(0).cast("long")), F.col("end") - 1)).alias("n"))
    return each.join(place, "n").filter("after_ms IS NULL OR ts_ms >= after_ms").select("query_id", "frame_id", (F.col("end") - F.col("n")).cast("int").alias("rank"))


def _ranked(frames: DataFrame, vectors: DataFrame, asked: DataFrame, most: int, alpha: float) -> DataFrame:
    """query_id, frame_id, place, score, sources: both lanes fused where a question has text and vector, else its only lane as it is."""
    text, vector = asked.filter("has_text"), asked.filter("embedding IS NOT NULL")
    found = {
        "text": staged(lanes.text_lane(frames, text.select("query_id", search_tokens(F.col("query"), marks=False).alias("terms")), most)),
        "vector": staged(lanes.knn(vectors, vector.select("query_id", "embedding"), most)),
    }
    both = text.filter("embedding IS NOT NULL").select("query_id", *[fusion.lane_weight(query_type(F.col("query")), i, alpha).alias(n) for i, n in enumerate(found)])
    out = fusion.fuse(found, both).filter(F.col("position") <= most).select("query_id", "frame_id", F.col("position").alias("place"), "score", "sources")
    for name, lane in found.items():
        alone = lane.join(both.select("query_id"), "query_id", "left_anti")
        out = out.unionByName(alone.select("query_id", F.col("frame_id").cast("long").alias("frame_id"), F.col("rank").cast("int").alias("place"), "score", F.array(F.lit(name)).alias("sources")))
    return out


def library_recall(frames: DataFrame, vectors: DataFrame, questions: DataFrame, *, root_kind: str, places: DataFrame | None = None, limit: int = 12, parts: int = 3, top_k: int = 200, tokens: int = 1200, alpha: float = 0.5) -> DataFrame:
    """query_id, root_id, position, score, evidence, parts, summary, tokens, used: photos or videos for questions.

    ``frames`` has frame_id, parent_id, kind, status, superseded_by, ts_ms and content, ``vectors`` frame_id and embedding, ``places``
    frame_id of roots with lat and lon; ``questions`` query_id (a number, once each), query, embedding, after_ms, before_ms, lat, lon and
    radius_m, each of which may be null.

    * A question with text and vector searches by both, one with either by that lane, one with neither but a range of time or a radius
      gets the newest roots within it, and one with nothing gets nothing.  Constraints hold for results of lanes as well, after ranking.
    * Results count for their root (themselves without a parent), which must be a live one of ``root_kind``: its best score, then the smaller id.
      ``evidence`` are the lanes that found it, ``parts`` its best ``parts`` parts.
    * ``summary`` are the words of those parts, cut to an equal share of ``tokens`` for each root; roots count up to the first that overflows.
    """
    has_text = F.trim(F.coalesce("query", F.lit(""))) != ""
    asked = staged(questions.select("query_id", "query", has_text.alias("has_text"), "embedding", "after_ms", "before_ms", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col("radius_m").cast("double").alias("radius_m")))
    most = fusion.candidate_limit(max(top_k, limit))
    live = frames.filter(fusion.live())
    roots = live.filter(F.col("kind") == root_kind).select(F.col("frame_id").alias("root_id"), "ts_ms")
    near = None
    if places is not None:
        near = geo.radius_join(places.select(F.col("frame_id").alias("root_id"), "lat", "lon"), asked.filter("radius_m IS NOT NULL").select("query_id", "lat", "lon", "radius_m")).select("query_id", "root_id").distinct()
    ranked = staged(_ranked(frames, vectors, asked, most, alpha))  # at most ``most`` rows for each question
    constraints = asked.select("query_id", "after_ms", "before_ms", F.col("radius_m").isNotNull().alias("around"))
    in_time = (F.col("after_ms").isNull() | (F.col("ts_ms") >= F.col("after_ms"))) & (F.col("before_ms").isNull() | (F.col("ts_ms") < F.col("before_ms")))
    hits = ranked.join(live.select("frame_id", F.coalesce("parent_id", "frame_id").alias("root_id"), "ts_ms"), "frame_id").join(constraints, "query_id").filter(in_time)
    if near is not None:
        hits = hits.join(near.withColumn("found", F.lit(True)), ["query_id", "root_id"], "left").filter("NOT around OR found")
    hits = hits.join(roots.select("root_id"), "root_id", "left_semi").select("query_id", "root_id", "frame_id", "score", "sources")
    bare = asked.filter("NOT has_text AND embedding IS NULL")
    timed = newest_in_range(roots.withColumnRenamed("root_id", "frame_id"), bare.filter("radius_m IS NULL AND (after_ms IS NOT NULL OR before_ms IS NOT NULL)"), most).withColumnRenamed("frame_id", "root_id")
    if near is not None:
        around = bare.filter("radius_m IS NOT NULL").select("query_id", "after_ms", "before_ms").join(near, "query_id").join(roots, "root_id").filter(in_time)
        newest = around.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ts_ms"), "root_id"))).filter(F.col("rank") <= most)
        timed = timed.unionByName(newest.select("query_id", "root_id", "rank"))
    hits = hits.unionByName(timed.select("query_id", "root_id", F.col("root_id").alias("frame_id"), F.round(1.0 / (F.lit(fusion.RRF_K) + F.col("rank")), 9).alias("score"), F.array(F.lit("timeline")).alias("sources")))
    hits = staged(hits)  # and so many of roots
    best = hits.groupBy("query_id", "root_id").agg(F.max("score").alias("score"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("evidence"))
    picked = best.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "root_id"))).filter(F.col("position") <= limit)
    picked = staged(picked)
    of_root = Window.partitionBy("query_id", "root_id").orderBy(F.desc("score"), "frame_id")
    few = hits.join(picked.select("query_id", "root_id"), ["query_id", "root_id"], "left_semi").filter("frame_id <> root_id").withColumn("place", F.row_number().over(of_root)).filter(F.col("place") <= parts)
    few = staged(few.select("query_id", "root_id", "frame_id", "place"))  # its size is known then: texts are moved only if it is too large to be sent to them
    listed = few.join(frames.select("frame_id", "content"), "frame_id").groupBy("query_id", "root_id").agg(F.array_sort(F.collect_list(F.struct("place", "frame_id", "content"))).alias("p"))
    items = picked.join(listed, ["query_id", "root_id"], "left").withColumn("share", F.greatest(F.lit(1), F.floor(F.lit(tokens) / F.count(F.lit(1)).over(Window.partitionBy("query_id")))).cast("int"))
    words = F.filter(F.split(F.array_join(F.transform("p", lambda x: F.coalesce(x["content"], F.lit(""))), "\n"), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    items = items.withColumn("w", F.slice(F.coalesce(words, F.array().cast("array<string>")), 1, F.col("share"))).withColumn("tokens", F.size("w").cast("long"))
    cut = prefix_budget(items, tokens)
    return cut.select("query_id", "root_id", "position", "score", "evidence", F.coalesce(F.transform("p", lambda x: x["frame_id"]), F.array().cast("array<bigint>")).alias("parts"), F.array_join("w", " ").alias("summary"), "tokens", "used")
