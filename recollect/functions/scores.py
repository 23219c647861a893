"""Scores: importance, overlap, salience, tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import age_hours
from .text import words

# Weights and half lives of importance, thresholds of tiers.
AGE_WEIGHT, USE_WEIGHT, IDLE_WEIGHT = 0.3, 0.4, 0.3
AGE_HOURS, IDLE_HOURS, USE_SCALE = 168.0, 24.0, 5.0
FULL_FROM, GIST_FROM, QUERY_BOOST = 0.6, 0.3, 0.15
RECENT_DAYS, OLD_DAYS = 7, 30


def importance(now_ms: Column, at_ms: Column, uses: Column, last_ms: Column, weights: tuple[float, float, float] = (AGE_WEIGHT, USE_WEIGHT, IDLE_WEIGHT)) -> Column:
    """Age, frequency and recency of use in 0..1; only the age counts where the weights sum to nothing."""
    age = F.exp(-age_hours(now_ms, at_ms) / AGE_HOURS)
    use = F.least(F.lit(1.0), F.log(F.coalesce(uses, F.lit(0)) + 1.0) / USE_SCALE)
    idle = F.when(last_ms.isNull(), 0.0).otherwise(F.exp(-age_hours(now_ms, last_ms) / IDLE_HOURS))
    total = sum(weights)
    if total <= 0:
        return age
    return (weights[0] * age + weights[1] * use + weights[2] * idle) / total


def tier_by_importance(score: Column, specificity: Column | None = None) -> Column:
    boosted = F.least(F.lit(1.0), score + QUERY_BOOST * specificity) if specificity is not None else score
    return F.when(boosted >= FULL_FROM, "full").when(boosted >= GIST_FROM, "gist").otherwise("micro")


def tier_by_age(now_ms: Column, at_ms: Column) -> Column:
    days = (now_ms - at_ms) / 86_400_000.0
    return F.when(days < RECENT_DAYS, "full").when(days < OLD_DAYS, "gist").otherwise("micro")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 where one is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / F.size(F.array_union(a, b)))


def overlap(query: Column, text: Column) -> tuple[Column, Column]:
    """Recall and precision of a text's token set against the query's."""
    common = F.size(F.array_intersect(query, text))
    return common / F.greatest(F.size(query), F.lit(1)), common / F.greatest(F.size(F.array_distinct(text)), F.lit(1))


def long_words(text: Column) -> Column:
    return F.filter(words(text), lambda t: F.length(t) > 2)


def salience(sentence: Column, tokens: Column | None = None) -> Column:
    """How much a sentence says: length, digits, colons, bullets, code, variety; ``tokens`` are its long words, if they are at hand."""
    tokens = long_words(sentence) if tokens is None else tokens
    n = F.size(tokens)
    base = F.least(n, F.lit(40)) * F.when(n < 4, 0.25).when(n > 80, 0.7).otherwise(1.0)
    extra = F.when(sentence.rlike(r"\p{Nd}"), 6.0).otherwise(0.0) + F.when(sentence.contains(":"), 4.0).otherwise(0.0)
    extra += F.when(sentence.startswith("-") | sentence.startswith("*"), 2.0).otherwise(0.0) + F.when(sentence.contains("`"), 2.0).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(base + extra + F.size(F.array_distinct(tokens)) / n * 3.0)


def clamp01(x: Column) -> Column:
    """NaN and minus infinity are 0, plus infinity 1."""
    return F.when(F.isnan(x) | (x == F.lit(float("-inf"))), 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))
