"""Reciprocal-rank fusion, adaptive weights, filters after ranking, and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import scores
from recollect.functions.dates import date_keys, date_literals
from recollect.functions.text import ANSWER_DISTRACTORS, SEARCH_DISTRACTORS, TENTATIVE, collapsed, contains_any, digits_only, entity_terms, intents, letters_only, phrase_key, quoted_phrases, terms, year_terms

RRF_K = 60
# Weights of the lanes by query type (text, vector, timeline).
LANE_WEIGHTS = {"factual": (0.7, 0.3, 0.0), "semantic": (0.3, 0.7, 0.0), "temporal": (0.25, 0.25, 0.5), "exploratory": (0.4, 0.5, 0.1)}
LANES = ("text", "vector", "timeline", "structured")


def lane_weight(kind: Column, lane: int, alpha: float | None = None) -> Column:
    """Weight of a lane for a query type; with alpha, text counts alpha and vectors 1 - alpha of it."""
    out = F.lit(0.0)
    for name, weights in LANE_WEIGHTS.items():
        share = 1.0 if alpha is None or lane > 1 else min(max(alpha, 0.0), 1.0) if lane == 0 else 1.0 - min(max(alpha, 0.0), 1.0)
        out = F.when(kind == name, weights[lane] * share).otherwise(out)
    return out


def candidate_limit(k: int) -> int:
    """How many candidates each lane gives, so that filters after ranking leave enough."""
    return max(k, min(3 * k, 1000))


def fuse(lanes: dict[str, DataFrame], weights: DataFrame, *, k: int = RRF_K) -> DataFrame:
    """query_id, frame_id, score, best_rank, sources, contributions and position.

    ``lanes`` have query_id, frame_id and rank; ``weights`` has query_id and a column for each lane.  Lanes
    whose weight isn't positive are left out.
    """
    parts = []
    for name, lane in lanes.items():
        weighted = lane.join(weights.select("query_id", F.col(name).alias("weight")), "query_id").filter("weight > 0")
        parts.append(weighted.select("query_id", F.col("frame_id").cast("long").alias("frame_id"), F.col("rank").cast("int").alias("rank"), F.lit(name).alias("source"), (F.col("weight") / (F.lit(max(0, k)) + F.col("rank"))).alias("part")))
    each = parts[0]
    for p in parts[1:]:
        each = each.unionByName(p)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("part")).alias("minus"), "source", "rank")))
    out = each.groupBy("query_id", "frame_id").agg(F.round(F.sum("part"), 9).alias("score"), F.min("rank").alias("best_rank"), F.sort_array(F.collect_set("source")).alias("sources"), listed.alias("contributions"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("best_rank"), F.asc("frame_id"))
    return out.withColumn("position", F.row_number().over(order))


def tie_reasons(fused: DataFrame) -> DataFrame:
    """Why each result stands below the one before it."""
    order = Window.partitionBy("query_id").orderBy("position")
    score, rank = F.lag("score").over(order), F.lag("best_rank").over(order)
    reason = F.when(F.col("position") == 1, "top_result").when(score != F.col("score"), "fused_score").when(rank != F.col("best_rank"), "best_lane_rank").otherwise("frame_id")
    return fused.withColumn("tie_reason", reason)


# ---------------------------------------------------------------- filters
def live() -> Column:
    return (F.col("status") == "active") & F.col("superseded_by").isNull()


def in_range(ts: Column, after: int | Column | None, before: int | Column | None) -> Column:
    """Half open: after <= ts < before."""
    out = F.lit(True)
    if after is not None:
        out = out & (ts >= after)
    if before is not None:
        out = out & (ts < before)
    return out


def metadata_matches(entries: dict[str, str] | None = None, tags: list[tuple[str, str]] | None = None, labels: list[str] | None = None) -> Column:
    """All entries equal, all tags and labels present."""
    out = F.lit(True)
    for key, value in (entries or {}).items():
        out = out & F.coalesce(F.col("metadata")[key] == value, F.lit(False))
    for key, value in tags or []:
        out = out & F.array_contains("tags", F.struct(F.lit(key).alias("key"), F.lit(value).alias("value")))
    if labels:
        out = out & (F.size(F.array_except(F.array(*map(F.lit, labels)), F.col("labels"))) == 0)
    return out


def frame_filter(*, min_score: float | None = None, after: int | None = None, before: int | None = None, only: list[int] | None = None, include_deleted: bool = False, include_superseded: bool = False, include_surrogates: bool = False, metadata: dict[str, str] | None = None, tags: list[tuple[str, str]] | None = None, labels: list[str] | None = None) -> Column:
    """What a result must pass: score, time, allowed ids, not deleted, not superseded, no surrogate, metadata."""
    out = in_range(F.col("ts_ms"), after, before)
    if min_score is not None:
        out = out & (F.col("score") >= min_score)
    if only is not None:
        out = out & F.col("frame_id").isin(only)
    if not include_deleted:
        out = out & (F.col("status") == "active")
    if not include_superseded:
        out = out & F.col("superseded_by").isNull()
    if not include_surrogates:
        out = out & (F.coalesce(F.col("kind"), F.lit("")) != "surrogate")
    return out & metadata_matches(metadata, tags, labels)


def after_ranking(ranked: DataFrame, frames: DataFrame, keep: Column, k: int) -> DataFrame:
    """The first k results that pass, out of candidates that were ranked and cut before: fewer than k may be left.

    A candidate without a frame goes.
    """
    passed = ranked.join(frames.drop("score", "position"), "frame_id").filter(keep)
    order = Window.partitionBy("query_id").orderBy("position")
    return passed.withColumn("final", F.row_number().over(order)).filter(F.col("final") <= k)


def timeline_fallback(results: DataFrame, queries: DataFrame, recent: DataFrame, *, k: int = RRF_K, limit: int = 10) -> DataFrame:
    """For queries without any result: recent frames (frame_id, place: 1-based before filtering), scored by place."""
    empty = queries.select("query_id").join(results.select("query_id").distinct(), "query_id", "left_anti")
    scored = recent.withColumn("score", F.round(1.0 / (F.lit(max(0, k)) + F.col("place")), 9))
    few = scored.orderBy("place").limit(limit)  # bounded, so that it may be broadcast to the queries left empty
    return empty.join(F.broadcast(few.select("frame_id", "score", "place")))


# -------------------------------------------------------------- reranking
def _coverage(query: Column, text: Column) -> tuple[Column, Column]:
    hits = F.size(F.array_intersect(query, text))
    return hits, hits / F.greatest(F.size(query), F.lit(1))


def _if(condition: Column, value: Column | float) -> Column:
    return F.when(condition, value).otherwise(0.0)


def rerank_window(k: int) -> int:
    return min(max(2 * k, 10), 32)


def with_features(results: DataFrame) -> DataFrame:
    """Columns ``_..`` that both reranking scores read, computed once for each row from query and preview."""
    query, preview = F.col("query"), F.coalesce("preview", F.lit(""))
    asked = {f"_{k}": c for k, c in intents(query).items()}
    first = results.withColumns({"_text": collapsed(preview), "_quoted": quoted_phrases(query), **asked})
    text = F.col("_text")
    return first.withColumns({
        "_low": F.lower(text), "_q_terms": F.array_distinct(terms(query)), "_p_terms": F.array_distinct(terms(text)), "_q_names": entity_terms(query), "_p_names": entity_terms(text),
        "_q_years": year_terms(query), "_p_years": year_terms(text), "_q_days": date_keys(query), "_p_days": date_keys(text), "_dates": date_literals(text), "_flat": F.array_join(scores.words(text), " "),
        "_raw": F.transform("_quoted", F.lower), "_keys": F.filter(F.transform("_quoted", phrase_key), lambda p: p != ""),
    })


def without_features(results: DataFrame) -> DataFrame:
    return results.drop(*[c for c in results.columns if c.startswith("_")])


def search_score(score: Column, by_vector: Column) -> Column:
    """What intent-aware reranking orders by: names, years, days, phrases and what is asked for."""
    text, low = F.col("_text"), F.col("_low")
    q_terms, p_terms, q_names, p_names = F.col("_q_terms"), F.col("_p_terms"), F.col("_q_names"), F.col("_p_names")
    with_digit, plain = (lambda x: F.filter(x, lambda t: t.rlike(r"\p{N}"))), (lambda x: F.filter(x, letters_only))
    recall, precision = scores.overlap(q_terms, p_terms)
    out = score + _if((F.size(q_terms) > 0) & (F.size(p_terms) > 0), recall * 0.55 + precision * 0.25)

    hits, share = _coverage(q_names, p_names)
    q_numbered, q_plain, p_plain = with_digit(q_names), plain(q_names), plain(p_names)
    numbers = F.size(F.array_intersect(F.filter(q_terms, digits_only), p_terms))
    named = share * 0.30
    named += _if(F.size(q_numbered) > 0, _coverage(q_numbered, p_names)[1] * 1.95) + _if(F.size(q_plain) > 0, _coverage(q_plain, p_plain)[1] * 1.25)
    named -= _if(hits == 0, F.when(F.size(q_numbered) > 0, 0.85).otherwise(0.45) + _if(numbers > 0, 0.75))
    named -= _if((F.size(q_plain) > 0) & (_coverage(q_plain, p_plain)[0] == 0) & (F.size(p_plain) > 0), 0.40)
    out += _if(F.size(q_names) > 0, named)
    for q, p, gain, loss in ((F.col("_q_years"), F.col("_p_years"), 1.25, 1.10), (F.col("_q_days"), F.col("_p_days"), 1.15, 0.95)):
        hits, share = _coverage(q, p)
        out += _if(F.size(q) > 0, share * gain - _if((hits == 0) & (F.size(p) > 0), loss))

    raw = F.col("_raw")
    strict = F.filter(raw, lambda p: p.contains("-") | (F.size(F.split(p, r"\s+")) >= 2))
    exact = F.size(F.filter(raw, lambda p: low.contains(p)))
    exact_strict = F.size(F.filter(strict, lambda p: low.contains(p)))
    has_strict = F.size(strict) > 0
    quoted = F.when(exact > 0, exact * F.when(has_strict, 2.10).otherwise(1.20)).otherwise(F.when(has_strict, -1.40).otherwise(-0.35)) - (F.size(strict) - exact_strict) * 0.85
    out += _if(F.size(raw) > 0, quoted)
    keys, flat = F.col("_keys"), F.col("_flat")
    found = F.size(F.filter(keys, lambda p: flat.contains(p)))
    missed = has_strict & (exact_strict == 0)
    out += _if(F.size(keys) > 0, found / F.greatest(F.size(keys), F.lit(1)) * F.when(missed, 0.20).otherwise(0.75) - _if(missed, 0.55) - _if(found == 0, F.when(missed, 0.45).otherwise(0.20)))

    place = F.when(text.rlike(r"\b[Mm]oved? to [A-Z]"), 1.60).when(contains_any(low, ["moved to", "move to"]), 0.45).when(low.contains("city"), 0.10).otherwise(0.0)
    place -= _if(contains_any(low, ["without a destination", "city move", "retrospective"]), 0.75) + _if(contains_any(low, ["allergic", "health", "peanut"]), 1.10) + _if(low.contains("prefer"), 0.55)
    out += _if(F.col("_asks_location"), place)
    open_date = contains_any(low, TENTATIVE)
    date = F.when(low.contains("public launch is") & ~open_date, 1.70).when(low.contains("public launch") | (F.size("_dates") > 0), 1.20).otherwise(0.0)
    date -= _if(open_date, F.greatest(F.when(by_vector, 2.90).otherwise(2.45), score * F.when(by_vector, 1.60).otherwise(1.40)))
    date -= _if(low.contains("draft memo"), F.when(by_vector, 1.45).otherwise(1.20)) + _if(contains_any(low, [" owns ", "owner", "deployment readiness"]), 0.40)
    out += _if(F.col("_asks_date"), date)
    out += _if(F.col("_asks_ownership"), _if(contains_any(low, [" owns ", "owner", "owns deployment readiness"]), 1.10) - _if(low.contains("public launch") & ~low.contains(" owns "), 0.35))
    out -= _if(contains_any(low, SEARCH_DISTRACTORS), 0.40)
    return F.when(F.coalesce("preview", F.lit("")) == "", score).otherwise(F.round(out, 9))


def rerank_applies() -> Column:
    """Only where a place, date or owner is asked for and the query names something."""
    signal = (F.size("_q_names") > 0) | (F.size("_q_years") > 0) | (F.size("_q_days") > 0) | (F.size("_raw") > 0)
    return (F.col("_asks_location") | F.col("_asks_date") | F.col("_asks_ownership")) & signal


def answer_score(score: Column, by_vector: bool = True, penalty: float = 0.30) -> Column:
    """What reranking for answers orders by."""
    low, ask = F.col("_low"), {k: F.col(f"_{k}") for k in ("asks_location", "asks_date", "asks_ownership")}
    recall, precision = scores.overlap(F.col("_q_terms"), F.col("_p_terms"))
    out = score + _if((F.size("_q_terms") > 0) & (F.size("_p_terms") > 0), recall * 0.80 + precision * 0.40)
    names = F.col("_q_names")
    hits, share = _coverage(names, F.col("_p_names"))
    out += _if(F.size(names) > 0, share * (1.25 if by_vector else 0.90) - _if(hits == 0, 0.65 if by_vector else 0.35))
    for q, p, gain, loss in ((F.col("_q_years"), F.col("_p_years"), 1.35, 1.35 if by_vector else 1.05), (F.col("_q_days"), F.col("_p_days"), 1.15, 1.15 if by_vector else 0.90)):
        hits, share = _coverage(q, p)
        out += _if(F.size(q) > 0, share * gain - _if((hits == 0) & (F.size(p) > 0), loss))
    dated = F.size("_dates") > 0
    out += _if(ask["asks_location"] & low.contains("moved to"), 0.45)
    out += _if(ask["asks_date"] & (contains_any(low, ["public launch", "launch is"]) | dated), 0.45)
    out -= _if(ask["asks_date"] & contains_any(low, TENTATIVE), penalty * (2.8 if by_vector else 1.8))
    out += _if(ask["asks_ownership"] & low.contains(" owns "), 0.45)
    out -= _if(contains_any(low, ANSWER_DISTRACTORS), penalty * (2.2 if by_vector else 1.0) + _if(ask["asks_date"] & ~dated, 0.35 if by_vector else 0.0))
    return F.when(F.coalesce("preview", F.lit("")) == "", score).otherwise(F.round(out, 9))


def reranked(results: DataFrame, composite: Column, window: int) -> DataFrame:
    """New order of the first ``window`` results of each query; the rest and all scores stay."""
    keyed = results.withColumn("composite", F.when(F.col("position") <= window, composite))
    order = Window.partitionBy("query_id").orderBy(F.when(F.col("position") <= window, 0).otherwise(1), F.desc("composite"), F.when(F.col("position") <= window, -F.col("score")), F.when(F.col("position") <= window, F.col("frame_id")), "position")
    return keyed.withColumn("new_position", F.row_number().over(order)).drop("composite")
