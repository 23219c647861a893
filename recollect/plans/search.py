"""Unified search: lanes, fusion, filters, reranking, context.  One lazy plan for a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import query_type, search_tokens
from recollect.operators import fusion, lanes
from recollect.operators.context import assemble
from recollect.session import staged

MODES = ("text", "vector", "hybrid")


@dataclass
class SearchRequest:
    """Settings of a batch.  ``keep`` filters frames after ranking; ``alpha`` is the share of text in hybrid mode."""

    mode: str = "hybrid"
    top_k: int = 10
    alpha: float | None = 0.5
    rrf_k: int = fusion.RRF_K
    metric: str = "cosine"
    min_score: float | None = None
    keep: Column | None = None
    rerank: bool = True
    extra_lanes: dict[str, DataFrame] = field(default_factory=dict)
    #: Newest frames for questions that nothing survives for, in :func:`unified`.
    fallback: int = 0


def search(frames: DataFrame, vectors: DataFrame | None, questions: DataFrame, request: SearchRequest | None = None) -> DataFrame:
    """query_id, frame_id, position, score, best_rank, sources, contributions, preview.

    ``frames`` has frame_id and content (and what ``keep`` uses); ``questions`` query_id, query and, for
    vectors, embedding.  A query without an embedding has no vector lane in hybrid mode.  Lanes that the request
    brings under the name ``text`` or ``vector`` aren't computed: several searches can share them.
    """
    r = request or SearchRequest()
    if r.mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    asked = questions.filter(F.trim(F.coalesce("query", F.lit(""))) != "") if r.mode != "vector" else questions
    if r.mode == "vector" and (vectors is None or "embedding" not in questions.columns):
        raise ValueError("vector mode needs embeddings")
    if r.top_k <= 0:
        asked = asked.limit(0)
    most = fusion.candidate_limit(max(r.top_k, 1))
    found: dict[str, DataFrame] = dict(r.extra_lanes)
    if r.mode != "vector" and "text" not in found:
        found["text"] = lanes.bm25(frames, _terms(asked), most)
    if r.mode != "text" and "vector" not in found and vectors is not None and "embedding" in questions.columns:
        found["vector"] = lanes.knn(vectors, asked.filter("embedding IS NOT NULL").select("query_id", "embedding"), most, metric=r.metric)
    kind = query_type(F.col("query"))
    share = {"text": 1.0, "vector": 0.0}.get(r.mode, r.alpha)
    weights = asked.select("query_id", *[F.lit(1.0).alias(n) if r.mode != "hybrid" and n == r.mode else fusion.lane_weight(kind, i, share).alias(n) for i, n in enumerate(("text", "vector", "timeline"))], F.lit(0.5).alias("structured"))
    fused = fusion.fuse(found, weights, k=r.rrf_k).filter(F.col("position") <= most)
    keep = F.lit(True) if r.min_score is None else F.col("score") >= r.min_score
    if r.keep is not None:
        keep = keep & r.keep
    held = fused.join(frames.drop("score", "position"), "frame_id").filter(keep)
    order = Window.partitionBy("query_id").orderBy("position")
    cut = held.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= r.top_k)
    cut = cut.join(asked.select("query_id", "query"), "query_id")
    cut = cut.withColumn("preview", F.when(F.array_contains("sources", "text"), lanes.snippets(F.col("content"), search_tokens(F.col("query")))).otherwise(F.substring("content", 1, 512)))
    if r.rerank:
        composite = F.when(fusion.rerank_applies(), fusion.search_score(F.col("score"), F.array_contains("sources", "vector"))).otherwise(F.col("score"))
        cut = fusion.reranked(fusion.with_features(cut), composite, fusion.rerank_window(r.top_k)).withColumn("position", F.col("new_position"))
    return cut.select("query_id", "query", "frame_id", "position", "score", "best_rank", "sources", "contributions", "preview")


def _terms(asked: DataFrame) -> DataFrame:
    return asked.select("query_id", search_tokens(F.col("query"), marks=False).alias("terms"))


def unified(frames: DataFrame, vectors: DataFrame | None, questions: DataFrame, request: SearchRequest | None = None, *, index: lanes.TextIndex | None = None, structured: DataFrame | None = None) -> DataFrame:
    """query_id, frame_id, position, score, sources: search composed of all its lanes.

    ``frames`` has frame_id, content, ts_ms, status, superseded_by, kind and metadata; an ``index`` of their texts
    spares reading them; ``structured`` (query_id, frame_id, rank) is the lane of facts.

    * Text: frames with all terms first, then with any.
    * One lane alone (text or vector mode) keeps its own order and scores, but for questions with structured hits.
    * The timeline is a lane of hybrid mode, for questions of a time: the newest live frames that are no surrogates.
    * In hybrid mode a question without a vector simply has no vector lane; vector mode needs them.
    * What is left after the filters (by default: live frames that are no surrogates) is cut to ``top_k``; a question
      with nothing left gets the ``fallback`` newest frames.
    """
    r = request or SearchRequest()
    if r.mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    by_vector = vectors is not None and "embedding" in questions.columns
    if r.mode == "vector" and not by_vector:
        raise ValueError("vector mode needs embeddings")
    asked = questions if r.mode == "vector" else questions.filter(F.trim(F.coalesce("query", F.lit(""))) != "")
    if r.top_k <= 0:
        asked = asked.limit(0)
    most = fusion.candidate_limit(max(r.top_k, 1))
    kind = query_type(F.col("query"))
    found: dict[str, DataFrame] = dict(r.extra_lanes)
    if r.mode != "vector":
        found["text"] = lanes.text_lane(frames if index is None else index, _terms(asked), most)
    if r.mode != "text" and by_vector:
        found["vector"] = lanes.knn(vectors, asked.filter("embedding IS NOT NULL").select("query_id", "embedding"), most, metric=r.metric)
    keep = (fusion.frame_filter() if r.keep is None else r.keep) & (F.lit(True) if r.min_score is None else F.col("score") >= r.min_score)
    newest = frames.filter(fusion.frame_filter()).orderBy(F.desc("ts_ms"), "frame_id").limit(max(most, r.fallback)).withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("ts_ms"), "frame_id"))).select("frame_id", "rank")  # a bounded list
    if r.mode == "hybrid":
        found["timeline"] = asked.filter(kind == "temporal").select("query_id").join(F.broadcast(newest))
    if structured is not None:
        found["structured"] = structured
    share = {"text": 1.0, "vector": 0.0}.get(r.mode, r.alpha)
    weights = asked.select("query_id", *[fusion.lane_weight(kind, i, share).alias(n) for i, n in enumerate(("text", "vector", "timeline"))], F.lit(0.5).alias("structured"))
    several = asked.select("query_id") if r.mode == "hybrid" else structured.select("query_id").distinct() if structured is not None else None
    columns = ["query_id", "frame_id", "score", "place", "sources"]
    parts = []
    if several is not None:
        mine = {n: lane.join(several, "query_id", "left_semi") for n, lane in found.items()} if r.mode != "hybrid" else found
        fused = fusion.fuse(mine, weights, k=r.rrf_k).filter(F.col("position") <= most)
        parts.append(fused.withColumnRenamed("position", "place").select(*columns))
    if r.mode != "hybrid":
        alone = found[r.mode] if several is None else found[r.mode].join(several, "query_id", "left_anti")
        parts.append(alone.select("query_id", F.col("frame_id").cast("long").alias("frame_id"), "score", F.col("rank").cast("int").alias("place"), F.array(F.lit(r.mode)).alias("sources")))
    ranked = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    held = ranked.join(frames.drop("score", "place", "content"), "frame_id").filter(keep)
    cut = held.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).filter(F.col("position") <= r.top_k).select("query_id", "frame_id", "position", "score", "sources")
    if r.fallback <= 0:
        return cut
    cut = staged(cut)
    late = fusion.timeline_fallback(cut, asked, newest.withColumnRenamed("rank", "place"), k=r.rrf_k, limit=r.fallback)
    return cut.unionByName(late.select("query_id", "frame_id", F.col("place").cast("int").alias("position"), F.col("score").cast("double").alias("score"), F.array(F.lit("timeline")).alias("sources")))


def recall(frames: DataFrame, vectors: DataFrame | None, questions: DataFrame, request: SearchRequest | None = None, **budget) -> DataFrame:
    """Context items for questions: search, rerank for answers, assemble within the token budget."""
    found = search(frames, vectors, questions, request)
    score = fusion.answer_score(F.col("score"), by_vector=vectors is not None)
    ready = fusion.reranked(fusion.with_features(found), score, 12).withColumn("position", F.col("new_position")).drop("new_position")
    ready = staged(fusion.without_features(ready))  # top_k rows for each question, read by each part of the assembly
    return assemble(ready, frames.select("frame_id", "content"), **budget)
