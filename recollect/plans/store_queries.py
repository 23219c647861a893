"""Queries of the frame log, facts, sessions and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import dates, scores
from recollect.operators import context, facts, fusion, maintenance
from recollect.plans.tables import EVENT_FRAMES, event_frames, frames, questions, table
from recollect.plans.text_queries import sql_words
from recollect.sources import files
from recollect.sources import frames as log


# ---------------------------------------------------------------- frame log
def frame_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every frame with its checksum and size."""
    return frames(spark, sf).select("frame_id", "lang", "source", log.checksum(F.col("content")).alias("checksum"), F.octet_length("content").alias("bytes"))


def frame_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Frames that labels name; labels of unknown documents are skipped."""
    return log.lookup(frames(spark, sf), table(spark, sf, "labels").select(F.col("doc_id").alias("frame_id"))).select("frame_id", "source")


def frame_stats(spark: SparkSession, sf: str) -> DataFrame:
    return log.stats(event_frames(spark, sf).withColumn("generation", F.lit(1)))


def _mutations(spark: SparkSession, sf: str) -> DataFrame:
    """Events as mutations of frames numbered by user: purchases and views put, errors delete, signups supersede."""
    e = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "supersede").otherwise("put")
    return e.select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("long").alias("frame_id"), ((F.col("user_id") * 7 + F.col("event_id")) % 97).cast("long").alias("other_id"), F.col("props").alias("content"), dates.millis(F.col("ts")).alias("ts_ms"))


_MUTATIONS = """mutations AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'supersede' ELSE 'put' END AS op, user_id::bigint AS frame_id,
 ((user_id * 7 + event_id) % 97)::bigint AS other_id, props AS content, epoch_us(ts) // 1000 AS ts_ms FROM events)"""


def log_fold_live(spark: SparkSession, sf: str) -> DataFrame:
    """State of every frame after all mutations."""
    empty = spark.createDataFrame([], "frame_id long, content string, ts_ms long, status string, supersedes long, superseded_by long")
    return log.fold(empty, _mutations(spark, sf)).select("frame_id", "content", "ts_ms", "status", "supersedes", "superseded_by")


_FOLD = f"""WITH {_MUTATIONS}, puts AS (SELECT frame_id, arg_max(content, seq) AS content, arg_max(ts_ms, seq) AS ts_ms FROM mutations WHERE op = 'put' GROUP BY 1),
 base AS (SELECT frame_id, content, ts_ms, CASE WHEN frame_id IN (SELECT frame_id FROM mutations WHERE op = 'delete') THEN 'deleted' ELSE 'active' END AS status FROM puts),
 a AS (SELECT * FROM mutations WHERE op = 'supersede' AND frame_id <> other_id),
 f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY seq) = 1 AND row_number() OVER (PARTITION BY other_id ORDER BY seq) = 1),
 g AS (SELECT * FROM f WHERE frame_id IN (SELECT frame_id FROM base) AND other_id IN (SELECT frame_id FROM base)),
 v AS (SELECT g.* FROM g LEFT JOIN g r ON r.frame_id = g.other_id AND r.other_id = g.frame_id WHERE r.seq IS NULL OR r.seq > g.seq)
 SELECT base.*, s.frame_id AS supersedes, b.other_id AS superseded_by FROM base LEFT JOIN v b ON b.frame_id = base.frame_id LEFT JOIN v s ON s.other_id = base.frame_id"""


def log_supersede_violations(spark: SparkSession, sf: str) -> DataFrame:
    return log.violations(_mutations(spark, sf))


_VIOLATIONS = f"""WITH {_MUTATIONS}, a AS (SELECT * FROM mutations WHERE op = 'supersede'), s AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY seq) AS x, row_number() OVER (PARTITION BY other_id ORDER BY seq) AS y,
  (SELECT min(b.seq) FROM a b WHERE b.frame_id = a.other_id AND b.other_id = a.frame_id) AS earlier FROM a),
 r AS (SELECT seq, frame_id, other_id, CASE WHEN frame_id = other_id THEN 'self' WHEN earlier < seq THEN 'reverse' WHEN x > 1 THEN 'second_successor' WHEN y > 1 THEN 'second_predecessor' END AS rule FROM s)
 SELECT * FROM r WHERE rule IS NOT NULL"""


def log_replay(spark: SparkSession, sf: str) -> DataFrame:
    """What recovery applies after sequence 100 when the first bad entry is the 5,000th error or the last event."""
    e = _mutations(spark, sf).withColumn("valid", ~((F.col("op") == "delete") & (F.col("seq") % 977 == 0) & (F.col("seq") > 500)))
    return log.replay(100, e).select("seq", "op", "frame_id")


_REPLAY = f"""WITH {_MUTATIONS}, b AS (SELECT min(seq) AS bad FROM mutations WHERE op = 'delete' AND seq % 977 = 0 AND seq > 500) SELECT seq, op, frame_id FROM mutations, b WHERE seq > 100 AND (bad IS NULL OR seq < bad)"""


def checksum_report(spark: SparkSession, sf: str) -> DataFrame:
    """Frames whose checksum isn't the one noted: every tenth was noted with a changed text."""
    f = frames(spark, sf)
    noted = f.select("frame_id", log.checksum(F.when(F.col("frame_id") % 10 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).alias("checksum"))
    return log.verify(f, noted)


def surrogate_map(spark: SparkSession, sf: str) -> DataFrame:
    """Odd documents stand as surrogates of the one before."""
    f = frames(spark, sf).select("frame_id", F.when(F.col("frame_id") % 2 == 1, "surrogate").otherwise("chunk").alias("kind"), F.when(F.col("frame_id") % 9 == 0, "deleted").otherwise("active").alias("status"), F.lit(None).cast("long").alias("superseded_by"), F.create_map(F.lit("source_frame_id"), (F.col("frame_id") - 1).cast("string")).alias("metadata"))
    return log.surrogates(f)


def dense_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Dense ids in order of time, from 1,000 on."""
    return log.numbered(event_frames(spark, sf).select(F.col("frame_id").alias("event_id"), "ts_ms"), 1000, "ts_ms", "event_id").select("event_id", "frame_id")


def live_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    """Frame ids stay; content of frames that aren't live goes."""
    return log.rewrite_live(event_frames(spark, sf)).select("frame_id", F.coalesce("content", F.lit("")).alias("content"))


def filter_metadata_labels(spark: SparkSession, sf: str) -> DataFrame:
    """English documents of one source with all wanted labels and tags."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("frame_id"), F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 0, "clean"))).alias("labels"))
    f = frames(spark, sf).join(labels, "frame_id").withColumn("tags", F.array(F.struct(F.lit("lang").alias("key"), F.col("lang").alias("value"))))
    return f.filter(fusion.metadata_matches({"source": "src1"}, [("lang", "en")], ["good", "clean"])).select("frame_id")


# -------------------------------------------------------------------- facts
def _facts(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    """Customers as entities; the status of an order is a fact that holds until the customer's next order."""
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    spans = o.select(F.col("o_orderkey").alias("span_id"), F.col("o_orderkey").alias("fact_id"), dates.millis(F.col("o_orderdate")).alias("valid_from_ms"), dates.millis(F.lead("o_orderdate").over(w)).alias("valid_to_ms"), dates.millis(F.col("o_orderdate")).alias("system_from_ms"), F.when(F.col("o_orderpriority") == "5-LOW", dates.millis(F.col("o_orderdate")) + 86_400_000_000).alias("system_to_ms"))
    null = F.lit(None)
    fact = o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("subject_entity_id"), F.lit(1).cast("long").alias("predicate_id"), F.lit(1).alias("object_kind"), F.col("o_orderstatus").alias("object_text"), null.cast("long").alias("object_int"), null.cast("double").alias("object_real"), null.cast("boolean").alias("object_bool"), null.cast("binary").alias("object_blob"), null.cast("long").alias("object_time_ms"), null.cast("long").alias("object_entity_id"))
    entity = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("kind"))
    predicate = spark.createDataFrame([(1, "order_status")], "predicate_id long, key string")
    return fact, spans, entity, predicate


_AT = 820454400000  # 1996-01-01
_SPANS = """sp AS (SELECT o_orderkey AS span_id, o_orderkey AS fact_id, o_custkey, o_orderstatus, epoch_us(o_orderdate) // 1000 AS vf, epoch_us(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) // 1000 AS vt,
 CASE WHEN o_orderpriority = '5-LOW' THEN epoch_us(o_orderdate) // 1000 + 86400000000 END AS st FROM orders)"""


def facts_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """What held on a day, as known then."""
    f, s, e, p = _facts(spark, sf)
    return facts.facts_about(f, s, e, p, system_ms=_AT, valid_ms=_AT).select("fact_id", "subject", "predicate", "object_text", "valid_from_ms", "valid_to_ms")


_ASOF = f"""WITH {_SPANS} SELECT fact_id, 'customer:' || o_custkey AS subject, 'order_status' AS predicate, o_orderstatus AS object_text, vf AS valid_from_ms, vt AS valid_to_ms FROM sp
 WHERE vf <= {_AT} AND (vt IS NULL OR vt > {_AT}) AND (st IS NULL OR st > {_AT}) AND o_custkey IN (SELECT c_custkey FROM customer)"""


def facts_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 facts about one customer's segment, and whether there may be more."""
    f, s, e, p = _facts(spark, sf)
    return facts.ordered_facts(facts.facts_about(f, s, e.filter("kind = 'BUILDING'"), p), 50).select("fact_id", "value", "valid_from_ms", "truncated")


_ORDERED = f"""WITH {_SPANS} SELECT fact_id, o_orderstatus AS value, vf AS valid_from_ms, count(*) OVER () >= 50 AS truncated FROM (SELECT sp.* FROM sp JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'
 AND vt IS NULL AND st IS NULL ORDER BY o_orderstatus, vf DESC, fact_id LIMIT 50)"""


def facts_point_in_time_join(spark: SparkSession, sf: str) -> DataFrame:
    """Each line's ship date against what held for its customer then: an as-of join on the customer."""
    f, s, _, _ = _facts(spark, sf)
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", dates.millis(F.col("l_shipdate")).alias("at"))
    held = s.join(f.select("fact_id", F.col("subject_entity_id").alias("o_custkey"), "object_text"), "fact_id")
    return lines.join(held, "o_custkey").filter(facts.holds(F.col("valid_from_ms"), F.col("valid_to_ms"), F.col("at"))).select("l_orderkey", "l_linenumber", "fact_id", "object_text")


_PIT = f"""WITH {_SPANS}, l AS (SELECT l_orderkey, l_linenumber, o_custkey, epoch_us(l_shipdate) // 1000 AS ship FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
 SELECT l_orderkey, l_linenumber, fact_id, o_orderstatus AS object_text FROM l JOIN sp USING (o_custkey) WHERE vf <= ship AND (vt IS NULL OR vt > ship)"""


def _capitalised(text):
    """The words between blanks that are a capital and small ASCII letters."""
    return F.filter(F.split(text, "[ \t\n\r]+"), lambda w: w.rlike("^[A-Z][a-z]{2,}$"))


def _named_terms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Aliases and entities: every capitalised ASCII word of the documents names a term."""
    word = table(spark, sf, "documents").select(F.explode(F.array_distinct(_capitalised(F.col("text")))).alias("word")).distinct()
    entity = word.select(F.conv(F.substring(F.md5("word"), 1, 15), 16, 10).cast("long").alias("entity_id"), F.concat(F.lit("term:"), F.lower("word")).alias("key"), F.lit("term").alias("kind"), facts.alias_key(F.col("word")).alias("alias_norm"))
    return entity.select("entity_id", "alias_norm"), entity.select("entity_id", "key", "kind")


def entity_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """The terms that the capitalised words of each benchmark item name, however they are written."""
    alias, entity = _named_terms(spark, sf)
    said = questions(spark, sf).select("query_id", F.explode(_capitalised(F.col("query"))).alias("word"))
    return facts.resolve(alias, entity, said.select("query_id", F.concat(F.lit("  "), F.upper("word"), F.lit(" ")).alias("alias")))


_CAPITALISED = r"list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{2,}'))"
_NAMED = f"""e AS (SELECT ('0x' || substr(md5(word), 1, 15))::BIGINT AS entity_id, 'term:' || lower(word) AS key, lower(word) AS alias FROM (SELECT DISTINCT unnest({_CAPITALISED}) AS word FROM documents))"""
_RESOLVE = f"""WITH {_NAMED}, q AS (SELECT DISTINCT item_id AS query_id, lower(word) AS alias FROM (SELECT item_id, unnest({_CAPITALISED}) AS word FROM benchmark))
 SELECT DISTINCT query_id, entity_id, key, 'term' AS kind FROM q JOIN e USING (alias)"""


def entity_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Customers merged with suppliers of the same number; a kind is only filled where it was empty."""
    known = table(spark, sf, "customer").select(F.concat(F.lit("party:"), F.col("c_custkey").cast("string")).alias("key"), F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("kind"))
    new = table(spark, sf, "supplier").select(F.concat(F.lit("party:"), (F.col("s_suppkey") * 17).cast("string")).alias("key"), F.lit("SUPPLIER").alias("kind"))
    return facts.upsert_entities(known, new)


_UPSERT = """WITH k AS (SELECT 'party:' || c_custkey AS key, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS kind FROM customer), n AS (SELECT 'party:' || s_suppkey * 17 AS key, max('SUPPLIER') AS nk FROM supplier GROUP BY 1)
 SELECT key, coalesce(nullif(kind, ''), nk, '') AS kind FROM k FULL JOIN n USING (key)"""


def fact_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """New facts once each, without those known: statuses per customer, known where the order was finished before 1995."""
    o = table(spark, sf, "orders")
    new = o.select(F.col("o_custkey").cast("string").alias("subject"), F.lit("order_status").alias("predicate"), F.lit(1).alias("object_kind"), F.col("o_orderstatus").alias("value"))
    known = o.filter(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz")).select(facts.fact_hash(F.col("o_custkey").cast("string"), F.lit("order_status"), F.lit(1), F.col("o_orderstatus")).alias("fact_hash")).distinct()
    return facts.assert_facts(known, new).select("subject", "value", "fact_hash")


_DEDUPE = """WITH h AS (SELECT o_custkey::varchar AS subject, o_orderstatus AS value, o_orderdate, sha256(concat_ws(chr(31), o_custkey::varchar, 'order_status', '1', o_orderstatus)) AS fact_hash FROM orders)
 SELECT DISTINCT subject, value, fact_hash FROM h WHERE fact_hash NOT IN (SELECT fact_hash FROM h WHERE o_orderdate < TIMESTAMP '1995-01-01')"""


def fact_retract(spark: SparkSession, sf: str) -> DataFrame:
    """Open spans of returned orders close at the first return."""
    _, s, _, _ = _facts(spark, sf)
    back = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("fact_id"), dates.millis(F.col("l_shipdate")).alias("at_ms"))
    return facts.retract(s, back).select("span_id", "system_to_ms")


_RETRACT = f"""WITH {_SPANS}, r AS (SELECT l_orderkey, min(epoch_us(l_shipdate) // 1000) AS back FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
 SELECT span_id, CASE WHEN st IS NULL AND back > vf THEN back ELSE st END AS system_to_ms FROM sp LEFT JOIN r ON l_orderkey = fact_id"""


def evidence_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as sources of evidence for the facts about customers of a segment, one query for each nation."""
    f, s, _, _ = _facts(spark, sf)
    asked = table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("query_id"), F.col("c_custkey").alias("entity_id"))
    e = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")).alias("span_id"), F.col("l_orderkey").alias("fact_id"), F.col("l_partkey").alias("source_frame_id"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("confidence"), dates.millis(F.col("l_shipdate")).alias("asserted_at_ms"))
    return facts.evidence_frames(asked, f, s, e).select("query_id", "frame_id", "confidence", "facts", "rank")


_EVIDENCE = f"""WITH {_SPANS}, held AS (SELECT * FROM sp WHERE vt IS NULL AND st IS NULL), about AS (SELECT DISTINCT c_nationkey::bigint AS query_id, fact_id FROM customer JOIN held ON o_custkey = c_custkey),
 first AS (SELECT * FROM about QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fact_id) <= 64),
 e AS (SELECT l_orderkey AS fact_id, l_partkey AS frame_id, CASE WHEN l_discount > 0 THEN l_discount END AS conf, epoch_us(l_shipdate) // 1000 AS said FROM lineitem WHERE l_linenumber <> 1 OR l_orderkey IN (SELECT span_id FROM held)),
 g AS (SELECT query_id, frame_id, max(coalesce(conf, -1)) AS confidence, max(said) AS said, count(DISTINCT fact_id) AS facts FROM first JOIN e USING (fact_id) GROUP BY 1, 2)
 SELECT query_id, frame_id, confidence, facts, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, facts DESC, said DESC, frame_id) AS rank FROM g QUALIFY rank <= 32"""


def structured_lane(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that benchmark items name, among all that the documents have."""
    alias, entity = _named_terms(spark, sf)
    return facts.entity_candidates(questions(spark, sf), alias, entity).select("query_id", "entity_id", "key", "match", "place")


_STRUCTURED = rf"""WITH {_NAMED}, q AS (SELECT item_id AS query_id, text, list_transform({sql_words('text')}, lambda w: strip_accents(w)) AS w FROM benchmark),
 u AS (SELECT query_id, trim(regexp_replace(strip_accents(lower(text)), '\s+', ' ', 'g')) AS alias, 0 AS match FROM q UNION ALL SELECT query_id, unnest(list_distinct(list_filter(w, lambda x: length(x) >= 2))), 1 FROM q),
 m AS (SELECT query_id, entity_id, key, min(match) AS match, max(length(alias)) AS long FROM u JOIN e USING (alias) GROUP BY ALL)
 SELECT query_id, entity_id, key, match, row_number() OVER (PARTITION BY query_id ORDER BY match, long DESC, key) AS place FROM m QUALIFY place <= 24"""


def identifier_check(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    ident = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", facts.valid_identifier(ident).alias("valid"))


def typed_values(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of values read from text: JSON properties, numbers, words."""
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 4 == 0, F.get_json_object("props", "$.k")).when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"entity":"user:'), F.col("user_id").cast("string"), F.lit('"}'))).when(F.col("event_id") % 4 == 2, F.lit("true")).otherwise(F.col("event_type"))
    v = facts.typed_value(raw)
    return e.select("event_id", v["object_kind"].alias("object_kind"), v["object_int"].alias("object_int"), v["object_text"].alias("object_text"), v["object_entity"].alias("object_entity"))


_TYPED = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 7 WHEN 2 THEN 4 ELSE 1 END AS object_kind, CASE WHEN event_id % 4 = 0 THEN json_extract_string(props, '$.k')::bigint END AS object_int,
 CASE WHEN event_id % 4 = 3 THEN event_type END AS object_text, CASE WHEN event_id % 4 = 1 THEN 'user:' || user_id END AS object_entity FROM events"""


# ----------------------------------------------------- sessions, maintenance
def session_stats(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.session_stats(table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("text").alias("content")))


def latest_handoff(spark: SparkSession, sf: str) -> DataFrame:
    """The last turn of the assistant or the system in every conversation."""
    turns = table(spark, sf, "conversations").filter("role IN ('system', 'assistant')").select("conv_id", "turn", "role", F.md5("text").alias("digest"))
    return context.latest(turns, ["conv_id"], "turn")


def access_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = event_frames(spark, sf).select(F.col("user_id").alias("frame_id"), "ts_ms")
    active = table(spark, sf, "customer").select(F.col("c_custkey").alias("frame_id"))
    return maintenance.pruned(maintenance.access_stats(e), active)


def importance_tier(spark: SparkSession, sf: str) -> DataFrame:
    """Importance and tier of every event at the time of the last one, by its user's accesses."""
    e = event_frames(spark, sf)
    used = maintenance.access_stats(e.select(F.col("user_id").alias("frame_id"), "ts_ms")).withColumnRenamed("frame_id", "user_id")
    now = e.agg(F.max("ts_ms").alias("now_ms"))  # one row
    both = e.join(used, "user_id").join(F.broadcast(now))
    score = scores.importance(F.col("now_ms"), F.col("ts_ms"), F.col("uses"), F.col("last_ms"))
    return both.select("frame_id", F.round(score, 6).alias("importance"), scores.tier_by_importance(F.round(score, 6)).alias("tier"), scores.tier_by_age(F.col("now_ms"), F.col("ts_ms")).alias("tier_by_age"))


_IMPORTANCE = f"""WITH {EVENT_FRAMES}, u AS (SELECT user_id, count(*) AS uses, max(ts_ms) AS last_ms FROM event_frames GROUP BY 1), n AS (SELECT max(ts_ms) AS now FROM event_frames),
 s AS (SELECT frame_id, (now - ts_ms) / 86400000.0 AS days, round(0.3 * exp(-((now - ts_ms) / 3600000.0) / 168.0) + 0.4 * least(1.0, ln(uses + 1.0) / 5.0) + 0.3 * exp(-((now - last_ms) / 3600000.0) / 24.0), 6) AS importance FROM event_frames JOIN u USING (user_id), n)
 SELECT frame_id, importance, CASE WHEN importance >= 0.6 THEN 'full' WHEN importance >= 0.3 THEN 'gist' ELSE 'micro' END AS tier, CASE WHEN days < 7 THEN 'full' WHEN days < 30 THEN 'gist' ELSE 'micro' END AS tier_by_age FROM s"""


def dead_payload_report(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.dead_payload(event_frames(spark, sf))


_DEAD = f"""WITH {EVENT_FRAMES}, s AS (SELECT strlen(coalesce(content, '')) AS b, status = 'active' AND superseded_by IS NULL AS live, status, superseded_by FROM event_frames)
 SELECT sum(b) AS total_bytes, coalesce(sum(b) FILTER (NOT live), 0) AS dead_bytes, count(*) FILTER (live) AS live, count(*) FILTER (status = 'deleted') AS deleted, count(superseded_by) AS superseded, round(coalesce(sum(b) FILTER (NOT live), 0) / sum(b), 9) AS dead_share FROM s"""


def rewrite_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The outcome of scheduled maintenance for states made from orders."""
    o = table(spark, sf, "orders")
    at = dates.millis(F.col("o_orderdate"))
    state = o.select("o_orderkey", (F.col("o_orderkey") % 11 != 0).alias("enabled"), (F.col("o_orderkey") % 8).alias("flushes"), at.alias("now_ms"), F.when(F.col("o_custkey") % 3 == 0, at - F.col("o_custkey") * 10_000).alias("last_run_ms"), (at - F.col("o_orderkey") % 60_000).alias("last_write_ms"), F.lit(4_000_000).cast("long").alias("total_bytes"), (F.col("o_totalprice") * 10).cast("long").alias("dead_bytes"))
    return maintenance.rewrite_decision(state).select("o_orderkey", "outcome")


_GATE = """WITH s AS (SELECT o_orderkey, o_orderkey % 11 <> 0 AS enabled, o_orderkey % 8 AS flushes, CASE WHEN o_custkey % 3 = 0 THEN o_custkey * 10000 END AS since_run, o_orderkey % 60000 AS since_write, trunc(o_totalprice * 10)::bigint AS dead FROM orders)
 SELECT o_orderkey, CASE WHEN NOT enabled THEN 'disabled' WHEN flushes % 4 <> 0 THEN 'cadence' WHEN since_run < 3600000 THEN 'cooldown' WHEN since_write < 15000 THEN 'busy' WHEN dead < 1048576 AND dead / 4000000.0 < 0.25 THEN 'below_thresholds' WHEN dead < 65536 THEN 'small_gain' ELSE 'run' END AS outcome FROM s"""


def embedding_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct texts that still need a vector: those of src0 have theirs."""
    f = frames(spark, sf)
    cached = f.filter("source = 'src0'").select(F.sha2("content", 256).alias("text_hash")).distinct()
    return maintenance.missing_embeddings(f, cached).select("text_hash", "uses")


def surrogate_outdated(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose surrogate is missing or was made from another text."""
    f = frames(spark, sf).withColumn("status", F.lit("active")).withColumn("superseded_by", F.lit(None).cast("long")).withColumn("role", F.lit("chunk")).withColumn("kind", F.lit(""))
    made = f.filter("frame_id % 3 <> 0").select("frame_id", F.when(F.col("frame_id") % 3 == 1, F.sha2("content", 256)).otherwise(F.sha2(F.lit("old"), 256)).alias("source_hash"), F.lit("extractive").alias("algorithm"), F.lit(1).alias("version"))
    return context.outdated(f, made)


def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    return maintenance.latency_summary(table(spark, sf, "events").select("event_type", "value"), ["event_type"])


def file_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files: metadata from the address."""
    p = table(spark, sf, "pages")
    m = files.file_metadata(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1), F.col("url"), F.octet_length("html"))
    return p.filter(F.regexp_replace("html", r"\s+", "") != "").select("page_id", m["source_uri"].alias("uri"), m["source_bytes"].alias("bytes"), m["source_kind"].alias("kind"))


def commit_log(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as a commit log and parsed again."""
    c = table(spark, sf, "conversations")
    one = F.concat(F.lit("COMMIT:"), F.md5(F.concat_ws("-", "conv_id", "turn")), F.lit("|"), F.substring(F.md5(F.concat_ws("-", "conv_id", "turn")), 1, 7), F.lit("|"), F.col("role"), F.lit("|2024-01-01|turn "), F.col("turn").cast("string"), F.lit(" | of talk\nbody of it\ndiff --git a/x b/x\n+line\ndiff --git a/y b/y\n"))
    logs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("t")))), lambda x: x["t"]), "").alias("text"))
    return files.commits(logs.withColumnRenamed("conv_id", "log_id")).select("log_id", F.col("at").cast("long").alias("at"), "hash", "short", "author", "subject", "body", F.col("files_changed").cast("long").alias("files_changed"))


_COMMITS = """SELECT conv_id AS log_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS at, md5(conv_id || '-' || turn) AS hash, md5(conv_id || '-' || turn)[1:7] AS short, role AS author, 'turn ' || turn || ' | of talk' AS subject, 'body of it' || chr(10) AS body, 2::bigint AS files_changed FROM conversations"""

QUERIES = {
    f.__name__: f
    for f in (frame_scan, frame_lookup, frame_stats, log_fold_live, log_supersede_violations, log_replay, checksum_report, surrogate_map, dense_ids, live_rewrite, filter_metadata_labels, facts_as_of, facts_ordered, facts_point_in_time_join, entity_resolve, entity_upsert, fact_dedupe, fact_retract, evidence_rank, structured_lane, identifier_check, typed_values, session_stats, latest_handoff, access_stats, importance_tier, dead_payload_report, rewrite_gate, embedding_dedupe, surrogate_outdated, latency_summary, file_frames, commit_log)
}
ORACLES = {
    "frame_scan": "SELECT doc_id AS frame_id, lang, source, sha256(coalesce(text, '')) AS checksum, strlen(text) AS bytes FROM documents",
    "frame_lookup": "SELECT doc_id AS frame_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "frame_stats": f"WITH {EVENT_FRAMES} SELECT count(*) AS frames, count(*) FILTER (status = 'active' AND superseded_by IS NULL) AS live, count(*) FILTER (status = 'deleted') AS deleted, count(superseded_by) AS superseded, 1 AS generation FROM event_frames",
    "log_fold_live": _FOLD,
    "log_supersede_violations": _VIOLATIONS,
    "log_replay": _REPLAY,
    "checksum_report": "SELECT doc_id AS frame_id, sha256(text) AS found, sha256(text || '!') AS checksum FROM documents WHERE doc_id % 10 = 0",
    "surrogate_map": "SELECT doc_id - 1 AS frame_id, doc_id AS surrogate_id FROM documents WHERE doc_id % 2 = 1 AND doc_id % 9 <> 0 AND (doc_id - 1) % 9 <> 0 AND doc_id - 1 IN (SELECT doc_id FROM documents)",
    "dense_ids": "SELECT event_id, 999 + row_number() OVER (ORDER BY epoch_us(ts) // 1000, event_id) AS frame_id FROM events",
    "live_rewrite": f"WITH {EVENT_FRAMES} SELECT frame_id, CASE WHEN status = 'active' AND superseded_by IS NULL THEN coalesce(content, '') ELSE '' END AS content FROM event_frames",
    "filter_metadata_labels": "SELECT doc_id AS frame_id FROM documents JOIN labels USING (doc_id) WHERE source = 'src1' AND lang = 'en' AND quality = 1 AND toxic = 0",
    "facts_as_of": _ASOF,
    "facts_ordered": _ORDERED,
    "facts_point_in_time_join": _PIT,
    "entity_resolve": _RESOLVE,
    "entity_upsert": _UPSERT,
    "fact_dedupe": _DEDUPE,
    "fact_retract": _RETRACT,
    "evidence_rank": _EVIDENCE,
    "structured_lane": _STRUCTURED,
    "identifier_check": r"SELECT p_partkey, regexp_full_match(CASE WHEN p_partkey % 3 = 0 THEN 'part:' || p_partkey ELSE p_name END, '[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._/-]{1,128}') AS valid FROM part",
    "typed_values": _TYPED,
    "session_stats": f"SELECT conv_id AS session_id, count(*) AS frames, sum(len({sql_words('text')}))::bigint AS words FROM conversations GROUP BY 1",
    "latest_handoff": "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations WHERE role IN ('system', 'assistant') QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "access_stats": "SELECT user_id AS frame_id, count(*) AS uses, max(epoch_us(ts) // 1000) AS last_ms, min(epoch_us(ts) // 1000) AS first_ms FROM events WHERE user_id IN (SELECT c_custkey FROM customer) GROUP BY 1",
    "importance_tier": _IMPORTANCE,
    "dead_payload_report": _DEAD,
    "rewrite_gate": _GATE,
    "embedding_dedupe": "SELECT sha256(text) AS text_hash, count(*) AS uses FROM documents GROUP BY 1 HAVING sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')",
    "surrogate_outdated": "SELECT doc_id AS frame_id, CASE WHEN doc_id % 3 = 0 THEN 'missing' ELSE 'changed' END AS reason FROM documents WHERE doc_id % 3 <> 1 AND regexp_replace(text, '\\s+', '', 'g') <> ''",
    "latency_summary": "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "file_frames": "SELECT page_id, url AS uri, strlen(html)::varchar AS bytes, 'file' AS kind FROM pages WHERE regexp_replace(html, '\\s+', '', 'g') <> ''",
    "commit_log": _COMMITS,
}
