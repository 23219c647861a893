"""Deterministic answers from context items: pattern candidates, relevance, a fixed order of what is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import scores
from recollect.functions.dates import MONTHS, date_keys, date_literals
from recollect.functions.text import collapsed, contains_any, entity_terms, intents, once, terms, year_terms
from recollect.operators.context import scored_sentences

# Fixed value: one name of a person.
_NAME = r"(?:[A-Z][A-Za-z]*(?:['’\-][A-Z][A-Za-z]*)?)"
_PERSON = rf"({_NAME}(?:\s+{_NAME}){{0,3}})"
_MONTH = "(?:" + "|".join(m.capitalize() for m in MONTHS) + ")"
# What an answer looks like (pattern, group, bonus), by kind.
PATTERNS = {
    "owner_of_readiness": (rf"\b{_PERSON}\s+owns\s+deployment\s+readiness\b", 1, 0.60),
    "appointment": (rf"\b{_MONTH}\s+\d{{1,2}},\s+\d{{4}}\s+at\s+\d{{1,2}}:\d{{2}}\s*(?:AM|PM)\b", 0, 0.55),
    "city": (r"\b[Mm]oved\s+to\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", 1, 0.45),
    "destination": (r"\b[Ff]light\s+to\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", 1, 0.45),
    "allergy": (r"\ballergic\s+to\s+([A-Za-z]+(?:\s+[A-Za-z]+)?)\b", 1, 0.40),
    "preference": (r"\bprefers\s+([^.]+)", 1, 0.35),
    "pet": (r"\bnamed\s+([A-Z][a-z]+)\b", 1, 0.40),
    "adopted": (rf"\bin\s+({_MONTH}\s+\d{{4}})\b", 1, 0.40),
}
OWNS = rf"\b{_PERSON}\s+owns\s+([^.,;\n]+?)(?=\s+and\s+{_PERSON}\s+owns\b|[.,;\n]|$)"
LAUNCH = r"(?i)\bpublic\s+launch[^.\n]*"


def _share(query: Column, text: Column, gain: float, loss: float, always: bool) -> Column:
    """Gain for the query's terms that a text has, loss for none; the text's are found only if the query has any, and once."""

    def of(q: Column, t: Column, hits: Column) -> Column:
        miss = (hits == 0) if always else (hits == 0) & (F.size(t) > 0)
        return hits / F.size(q) * gain - F.when(miss, loss).otherwise(0.0)

    return once(query, lambda q: F.when(F.size(q) > 0, once(text, lambda t: once(F.size(F.array_intersect(q, t)), lambda hits: of(q, t, hits)))).otherwise(0.0))


def relevance(query: Column, text: Column, base: Column) -> Column:
    """How well an item fits a question."""

    def shared(q: Column, t: Column) -> Column:
        recall, precision = scores.overlap(q, t)
        return F.when((F.size(q) > 0) & (F.size(t) > 0), recall * 0.70 + precision * 0.30).otherwise(0.0)

    out = base + once(F.array_distinct(terms(query)), lambda q: once(F.array_distinct(terms(text)), lambda t: shared(q, t)))
    out += _share(entity_terms(query), entity_terms(text), 0.95, 0.70, True)
    out += _share(year_terms(query), year_terms(text), 1.45, 1.35, False)
    return out + _share(date_keys(query), date_keys(text), 1.25, 1.10, False)


def answers(items: DataFrame) -> DataFrame:
    """query_id, answer from items (query_id, query, frame_id, position, score, content); empty where nothing has text.

    Items of a query meet in one task before anything is computed: rows are small and costly, so the number of tasks is
    fixed rather than left to their size.  Each row then says all it has at once: candidates by kind, sentences, its text.
    """
    spark = items.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = items.filter(F.col("content").isNotNull()).select("query_id", "query", "content", "position", "score").repartition(tasks, "query_id")
    clean = dealt.withColumn("content", collapsed(F.col("content"))).filter("content <> ''")
    known = clean.withColumns({"q_terms": terms(F.col("query")), "days": date_literals(F.col("content"))})
    fit = known.withColumn("fit", relevance(F.col("query"), F.col("content"), F.col("score")))

    def candidate(kind: str, value: Column, score: Column, *, at: Column | None = None) -> Column:
        place = F.lit(None) if at is None else F.col("position")
        return F.struct(F.lit(kind).alias("kind"), value.alias("text"), score.cast("double").alias("score"), place.cast("long").alias("position"), (F.lit(None) if at is None else at).cast("int").alias("at"))

    def rated(bonus: Column | float) -> Column:
        return F.round(F.col("fit") + bonus, 9)

    found = [candidate("owner" if kind == "owner_of_readiness" else kind, F.nullif(F.regexp_extract("content", pattern, group), F.lit("")), rated(bonus)) for kind, (pattern, group, bonus) in PATTERNS.items()]
    clause = F.filter(F.transform(F.regexp_extract_all("content", F.lit(LAUNCH), F.lit(0)), lambda c: F.get(date_literals(c), F.lit(0))), lambda d: d.isNotNull())
    found.append(candidate("launch", F.get(clause, F.lit(0)), rated(0.55)))
    found.append(candidate("date", F.get("days", F.lit(0)), rated(0.20)))
    owners, topics = F.regexp_extract_all("content", F.lit(OWNS), F.lit(1)), F.regexp_extract_all("content", F.lit(OWNS), F.lit(2))

    def owned(owner: Column, topic: Column) -> Column:
        def of(q: Column, t: Column) -> Column:
            recall, precision = scores.overlap(q, t)
            return 0.40 + F.when((F.size(q) > 0) & (F.size(t) > 0), recall * 0.80 + precision * 0.25).otherwise(0.0) + F.when(F.lower(topic).contains("deployment readiness"), 0.20).otherwise(0.0)

        return candidate("owner", owner, rated(once(F.array_distinct("q_terms"), lambda q: once(F.array_distinct(terms(topic)), lambda t: of(q, t)))))

    said = F.transform(scored_sentences(F.col("q_terms"), F.col("content")), lambda s: candidate("_sentence", s["sentence"], s["score"], at=s["at"]))
    whole = candidate("_first", F.col("content"), F.lit(0.0), at=F.lit(0))
    every = fit.select("query_id", "query", F.filter(F.concat(F.array(*found, whole), F.zip_with(owners, topics, owned), said), lambda c: c["text"].isNotNull()).alias("every"))
    # Never empty; explode would have Spark filter by the list's size first, which computes all of it again.
    each = every.select("query_id", "query", F.explode_outer("every").alias("c")).select("query_id", F.when(F.col("c.kind") == "_first", F.col("query")).alias("query"), "c.*")
    # Of the first texts the position counts before all else: their scores are equal, and so must be their lengths here.
    length = F.when(F.col("kind") == "_first", 0).otherwise(F.length("text"))
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), length, "position", "at", "text")
    best = each.withColumn("n", F.row_number().over(order)).filter("n = 1")
    by_kind = best.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "text"))).alias("best"), F.max("query").alias("query"))
    return by_kind.select("query_id", F.coalesce(chosen(F.col("query"), F.col("best")), F.col("best")["_sentence"], F.col("best")["_first"]).alias("answer"))


def chosen(query: Column, best: Column) -> Column:
    """The candidate that the question asks for; the first rule that has its candidates."""
    low, ask = F.lower(query), intents(query)
    travel, allergy = contains_any(low, ["flying", "flight", "travel"]), contains_any(low, ["allergy", "allergic"])
    style, pet, dentist = contains_any(low, ["status update", "written"]), contains_any(low, ["dog", "pet", "adopt"]), contains_any(low, ["dentist", "appointment"])
    launch = F.coalesce(best["launch"], best["date"])
    rules = [
        (pet, F.concat(best["pet"], F.lit(" in "), best["adopted"])),
        (ask["asks_ownership"] & ask["asks_date"], F.concat(best["owner"], F.lit(" and "), launch)),
        (style, best["preference"]),
        (allergy, F.concat(F.lit("allergic to "), best["allergy"])),
        (travel, best["destination"]),
        (ask["asks_location"], best["city"]),
        (ask["asks_date"] & dentist, best["appointment"]),
        (ask["asks_date"], launch),
        (ask["asks_ownership"], best["owner"]),
    ]
    return F.coalesce(*[F.when(condition, value) for condition, value in rules])
