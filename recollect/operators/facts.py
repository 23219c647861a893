"""The bitemporal fact store: entities, aliases, facts, spans, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import compatible, without_marks, words

FOREVER = 9223372036854775807
MOST_CANDIDATES, MOST_FACTS, MOST_FRAMES = 24, 64, 32


def alias_key(alias: Column) -> Column:
    """Comparable form of an alias: compatible forms made one, case and marks folded, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(without_marks(F.lower(compatible(alias))), r"\s+", " "))


def holds(start: Column, end: Column, at: Column | int) -> Column:
    """Half-open span; no end is open."""
    return (start <= at) & (end.isNull() | (end > at))


def as_of(spans: DataFrame, system_ms: Column | int = FOREVER, valid_ms: Column | int = FOREVER) -> DataFrame:
    return spans.filter(holds(F.col("system_from_ms"), F.col("system_to_ms"), system_ms) & holds(F.col("valid_from_ms"), F.col("valid_to_ms"), valid_ms))


def upsert_entities(known: DataFrame, new: DataFrame) -> DataFrame:
    """key, kind: new keys are added, a kind is filled only where it was empty."""
    first = new.groupBy("key").agg(F.max("kind").alias("new_kind"))
    return known.select("key", "kind").join(first, "key", "full_outer").select("key", F.coalesce(F.nullif("kind", F.lit("")), F.col("new_kind"), F.lit("")).alias("kind"))


def resolve(aliases: DataFrame, entities: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, entity_id, key, kind of the entities that an alias (query_id, alias) names."""
    wanted = asked.select("query_id", alias_key(F.col("alias")).alias("alias_norm"))
    return wanted.join(aliases.select("entity_id", "alias_norm").distinct(), "alias_norm").join(entities, "entity_id").select("query_id", "entity_id", "key", "kind").distinct()


def fact_hash(subject: Column, predicate: Column, kind: Column, value: Column) -> Column:
    """Identity of a fact."""
    return F.sha2(F.concat_ws("\u001f", subject, predicate, kind.cast("string"), value), 256)


def assert_facts(known: DataFrame, new: DataFrame) -> DataFrame:
    """Facts (subject, predicate, object_kind, value, fact_hash) that aren't known yet, once each."""
    hashed = new.withColumn("fact_hash", fact_hash(F.col("subject"), F.col("predicate"), F.col("object_kind"), F.col("value")))
    return hashed.dropDuplicates(["fact_hash"]).join(known.select("fact_hash"), "fact_hash", "left_anti")


def retract(spans: DataFrame, retractions: DataFrame) -> DataFrame:
    """Close the open system spans of facts at a time (fact_id, at_ms; the earliest counts).

    Nothing happens where none is open; a time at or before the start is reported by :func:`bad_retractions`.
    """
    first = retractions.groupBy("fact_id").agg(F.min("at_ms").alias("at_ms"))
    open_ = F.col("system_to_ms").isNull() & F.col("at_ms").isNotNull() & (F.col("at_ms") > F.col("system_from_ms"))
    return spans.join(first, "fact_id", "left").withColumn("system_to_ms", F.when(open_, F.col("at_ms")).otherwise(F.col("system_to_ms"))).drop("at_ms")


def bad_retractions(spans: DataFrame, retractions: DataFrame) -> DataFrame:
    return spans.filter("system_to_ms IS NULL").join(retractions, "fact_id").filter("at_ms <= system_from_ms").select("fact_id", "span_id", "at_ms")


def facts_about(facts: DataFrame, spans: DataFrame, entities: DataFrame, predicates: DataFrame, *, system_ms: int = FOREVER, valid_ms: int = FOREVER, subject: str | None = None, predicate: str | None = None) -> DataFrame:
    """Facts that hold, with their subject, predicate and, for entity values, the object's key."""
    held = as_of(spans, system_ms, valid_ms).select("fact_id", "span_id", "valid_from_ms", "valid_to_ms", "system_from_ms")
    named = entities.select(F.col("entity_id").alias("subject_entity_id"), F.col("key").alias("subject"))
    kinds = predicates.select("predicate_id", F.col("key").alias("predicate"))
    if subject is not None:
        named = named.filter(F.col("subject") == subject)
    if predicate is not None:
        kinds = kinds.filter(F.col("predicate") == predicate)
    objects = entities.select(F.col("entity_id").alias("object_entity_id"), F.col("key").alias("object_key"))
    return held.join(facts, "fact_id").join(named, "subject_entity_id").join(kinds, "predicate_id").join(objects, "object_entity_id", "left")


def ordered_facts(hits: DataFrame, limit: int) -> DataFrame:
    """The first facts by predicate, kind, value, start (new first) and id; ``truncated`` when the limit is reached."""
    value = F.coalesce("object_text", F.col("object_int").cast("string"), F.col("object_real").cast("string"), F.col("object_bool").cast("string"), F.hex("object_blob"), F.col("object_time_ms").cast("string"), F.col("object_entity_id").cast("string"))
    cut = hits.withColumn("value", value).orderBy("predicate", "object_kind", "value", F.desc("valid_from_ms"), "fact_id").limit(limit)
    return cut.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) >= limit)  # at most limit rows


def entity_candidates(queries: DataFrame, aliases: DataFrame, entities: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """Entities that a query's text (query_id, query) names: the whole of it, then any word of two letters or more."""
    whole = queries.select("query_id", alias_key(F.col("query")).alias("alias_norm"), F.lit(0).alias("match"))
    parts = queries.select("query_id", F.explode(F.array_distinct(F.filter(words(F.col("query")), lambda t: F.length(t) >= 2))).alias("word")).select("query_id", alias_key(F.col("word")).alias("alias_norm"), F.lit(1).alias("match"))
    named = whole.unionByName(parts).join(aliases.select("entity_id", "alias_norm"), "alias_norm").join(entities.select("entity_id", "key"), "entity_id")
    best = named.groupBy("query_id", "entity_id", "key").agg(F.min("match").alias("match"), F.max(F.length("alias_norm")).alias("long"))
    order = Window.partitionBy("query_id").orderBy("match", F.desc("long"), "key")
    return best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def evidence_frames(candidates: DataFrame, facts: DataFrame, spans: DataFrame, evidence: DataFrame, *, system_ms: int = FOREVER, valid_ms: int = FOREVER, most_facts: int = MOST_FACTS, most_frames: int = MOST_FRAMES) -> DataFrame:
    """query_id, frame_id, rank: frames that support the facts about a query's entities (query_id, entity_id)."""
    held = as_of(spans, system_ms, valid_ms)
    about = candidates.select("query_id", F.col("entity_id").alias("subject_entity_id")).join(facts.select("fact_id", "subject_entity_id"), "subject_entity_id").join(held.select("fact_id").distinct(), "fact_id", "left_semi").select("query_id", "fact_id").distinct()
    first = about.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("fact_id"))).filter(F.col("n") <= most_facts).drop("n")
    backed = evidence.join(spans.select("span_id", F.col("fact_id").alias("of_span"), "valid_from_ms", "valid_to_ms", "system_from_ms", "system_to_ms"), "span_id", "left")
    backed = backed.filter(F.col("of_span").isNull() | (holds(F.col("system_from_ms"), F.col("system_to_ms"), system_ms) & holds(F.col("valid_from_ms"), F.col("valid_to_ms"), valid_ms)))
    backed = backed.select(F.coalesce("fact_id", "of_span").alias("fact_id"), F.col("source_frame_id").alias("frame_id"), "confidence", "asserted_at_ms")
    scored = first.join(backed, "fact_id").groupBy("query_id", "frame_id").agg(F.max(F.coalesce("confidence", F.lit(-1.0))).alias("confidence"), F.max("asserted_at_ms").alias("asserted_at_ms"), F.countDistinct("fact_id").alias("facts"))
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), F.desc("facts"), F.desc("asserted_at_ms"), "frame_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_frames)


def valid_identifier(value: Column) -> Column:
    """``<namespace>:<id>`` of letters, digits and ``._-/``, up to 128 bytes each part."""
    return value.rlike(r"^[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._/-]{1,128}$") & (F.octet_length(value) <= 193)


def typed_value(text: Column) -> dict[str, Column]:
    """A JSON value as object_kind and columns: 1 text, 2 integer, 3 real, 4 boolean, 5 bytes, 6 time, 7 entity.

    Plain scalars are read by their form; ``{"entity": ..}``, ``{"time_ms": ..}`` and ``{"base64": ..}`` are envelopes.
    """
    entity, time, blob = (F.get_json_object(text, f"$.{k}") for k in ("entity", "time_ms", "base64"))
    kind = F.when(entity.isNotNull(), 7).when(time.isNotNull(), 6).when(blob.isNotNull(), 5).when(text.rlike(r"^\s*(true|false)\s*$"), 4).when(text.rlike(r"^\s*-?\d+\s*$"), 2).when(text.rlike(r"^\s*-?\d+(\.\d+)?([eE][+-]?\d+)?\s*$"), 3).otherwise(1)
    real = F.when(kind == 3, text.try_cast("double") + F.lit(0.0))
    return {"object_kind": kind, "object_text": F.when(kind == 1, F.when(text.rlike(r'^\s*".*"\s*$'), F.regexp_extract(text, r'^\s*"(.*)"\s*$', 1)).otherwise(text)), "object_int": F.when(kind == 2, F.trim(text).try_cast("long")), "object_real": real, "object_bool": F.when(kind == 4, F.trim(text).try_cast("boolean")), "object_blob": F.when(kind == 5, F.unbase64(blob)), "object_time_ms": F.when(kind == 6, time.try_cast("long")), "object_entity": entity}


def neighbours(facts: DataFrame, spans: DataFrame, **at) -> DataFrame:
    """One step along entity-valued facts: from_id, to_id, predicate_id."""
    return as_of(spans, **at).select("fact_id").join(facts.filter("object_entity_id IS NOT NULL"), "fact_id").select(F.col("subject_entity_id").alias("from_id"), F.col("object_entity_id").alias("to_id"), "predicate_id").distinct()
