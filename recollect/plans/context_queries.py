"""Queries of chunks, budgets, surrogates, answers and media-shaped operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import dates
from recollect.functions.embed import embed
from recollect.functions.tokens import BytePairs
from recollect.operators import answers, context, geo, library, maintenance, media
from recollect.plans.tables import EVENT_FRAMES, event_frames, frames, table
from recollect.plans.text_queries import sql_terms
from recollect.sources import files

def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))


def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 400 tokens that share 40 (rows only: the piece pattern looks ahead, which the SQL engine's can't)."""
    return context.chunks(_texts(spark, sf)).select("doc_id", "chunk", "tokens", F.md5("content").alias("digest"))


def _vocabulary() -> BytePairs:
    import public_tokenizers

    return BytePairs.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document in a byte-pair vocabulary (rows only: SQL has none; tested against its library)."""
    return _texts(spark, sf).select("doc_id", _vocabulary().count(F.col("content")).alias("tokens"))


def chunk_windows_of_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 400 tokens of the vocabulary that share 40 (rows only)."""
    return context.chunks(_texts(spark, sf), vocabulary=_vocabulary()).select("doc_id", "chunk", "tokens", F.md5("content").alias("digest"))


def window_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Starts of windows over every order's price as a number of tokens, with and without overlap."""
    n = F.col("o_totalprice").cast("int") % 5000
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.array_join(context.window_starts(n, 400, 40).cast("array<string>"), ",").alias("overlapping"), F.array_join(context.window_starts(n, 400, 400).cast("array<string>"), ",").alias("stalled"))


_WINDOWS = """WITH o AS (SELECT o_orderkey, trunc(o_totalprice)::int % 5000 AS n FROM orders)
 SELECT o_orderkey, array_to_string(list_transform(range(0, greatest(0, ceil((n - 400) / 360.0)::int) + 1), lambda i: i * 360), ',') AS overlapping, array_to_string(list_transform(range(0, greatest(0, ceil((n - 400) / 400.0)::int) + 1), lambda i: i * 400), ',') AS stalled FROM o"""


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """All lines of orders as items: the customer is the query, the quantity the cost."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    order = Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return lines.select(F.col("o_custkey").alias("query_id"), F.row_number().over(order).cast("long").alias("position"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_id"), F.col("l_quantity").cast("long").alias("tokens"))


_ITEMS = """items AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS position, l_orderkey * 10 + l_linenumber AS frame_id, l_quantity::bigint AS tokens FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def token_budget_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return context.prefix_budget(_items(spark, sf), 200).select("query_id", "position", "frame_id", "used")


def budget_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """Items that fit are taken, others skipped."""
    return context.greedy_budget(_items(spark, sf), 100, 8).select("query_id", "position", "frame_id", "tokens")


_GREEDY = f"""WITH RECURSIVE {_ITEMS}, walk(query_id, position, remaining, taken, frame_id, tokens, ok) AS (
 SELECT query_id, position, 100 - CASE WHEN tokens <= 100 THEN tokens ELSE 0 END, CASE WHEN tokens <= 100 THEN 1 ELSE 0 END, frame_id, tokens, tokens <= 100 FROM items WHERE position = 1
 UNION ALL SELECT i.query_id, i.position, w.remaining - CASE WHEN i.tokens <= w.remaining AND w.taken < 8 THEN i.tokens ELSE 0 END, w.taken + CASE WHEN i.tokens <= w.remaining AND w.taken < 8 THEN 1 ELSE 0 END, i.frame_id, i.tokens, i.tokens <= w.remaining AND w.taken < 8
 FROM walk w JOIN items i ON i.query_id = w.query_id AND i.position = w.position + 1)
 SELECT query_id, position, frame_id, tokens FROM walk WHERE ok"""


def surrogate_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Three tiers of every document (rows only: the choice is greedy)."""
    return context.surrogate_tiers(_texts(spark, sf)).select("doc_id", *[F.md5(k).alias(k) for k in context.TIERS])


def tier_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Tiers from JSON where events have it, else from plain text."""
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"full":"'), F.col("event_type"), F.lit(' in full","gist":"'), F.col("event_type"), F.lit('","micro":"x","version":1}'))).otherwise(F.col("event_type"))
    t = context.decoded_tiers(raw)
    return e.select("event_id", t["full"].alias("full"), t["gist"].alias("gist"), t["micro"].alias("micro"))


def budget_clamp(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    c = context.clamped_config(F.col("s_acctbal").cast("int"), (F.col("s_suppkey") * 100).cast("int"), (F.col("s_nationkey") - 10).cast("int"), F.col("s_acctbal") / 1000)
    return s.select("s_suppkey", *[F.round(v, 6).alias(k) for k, v in c.items()])


def lexical_sentence(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence of a conversation's first turn that fits its last turn best."""
    c = table(spark, sf, "conversations")
    last = c.groupBy(F.col("conv_id").alias("query_id")).agg(F.max_by("text", "turn").alias("query"))
    items = c.select(F.col("conv_id").alias("query_id"), F.col("text").alias("content"), F.col("turn").alias("position")).join(last, "query_id")
    return context.lexical_sentence(items).select("query_id", "score", F.md5("answer").alias("digest"))


_SENTENCE = f"""WITH l AS (SELECT conv_id, arg_max(text, turn) AS query FROM conversations GROUP BY 1), s AS (SELECT conv_id, query, turn, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS p FROM conversations JOIN l USING (conv_id)),
 e AS (SELECT conv_id, query, turn, unnest(range(1, len(p) + 1)) AS i, p FROM s), w AS (SELECT conv_id, turn, i, p[i] AS sentence, {sql_terms('p[i]')} AS own, {sql_terms('query')} AS q FROM e),
 c AS (SELECT conv_id, turn, i, sentence, round(len(list_intersect(list_distinct(own), q)) / len(own) + CASE WHEN regexp_matches(sentence, '\\p{{Nd}}') THEN 0.15 ELSE 0.0 END, 9) AS score FROM w WHERE len(own) > 0)
 SELECT conv_id AS query_id, score, md5(sentence) AS digest FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, length(sentence), turn, i) = 1"""


def answer_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to three questions about each customer with orders, from sentences made of its name, nation, segment and last order."""
    letters = lambda c: F.initcap(F.translate(F.col(c), "#_0123456789", "xxabcdefghij"))
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), letters("n_name").alias("city"))
    who = table(spark, sf, "customer").join(last, "c_custkey").join(nations, "c_nationkey").select(F.col("c_custkey").cast("long").alias("key"), letters("c_name").alias("name"), "city", F.lower("c_mktsegment").alias("segment"), F.date_format("last", "MMMM d, yyyy").alias("day"))
    said = F.array(F.concat("name", F.lit(" owns deployment readiness. The public launch is "), "day", F.lit(".")), F.concat(F.lit("Last year "), "name", F.lit(" moved to "), "city", F.lit(" and is allergic to "), "segment", F.lit(".")))
    asks = F.array(F.concat(F.lit("Who owns readiness and when is the launch of "), "name", F.lit("?")), F.concat(F.lit("Which city did "), "name", F.lit(" move to?")), F.concat(F.lit("What is "), "name", F.lit(" allergic to?")))
    each = who.select("key", "name", F.posexplode(said).alias("position", "content"), asks.alias("asks")).select("key", "position", "content", F.posexplode("asks").alias("which", "query"))
    return answers.answers(each.select((F.col("key") * 10 + F.col("which")).alias("query_id"), "query", "content", "position", F.lit(0.0).alias("score")))


_ANSWER = """WITH l AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1), c AS (SELECT c_custkey::bigint AS k, translate(c_name, '#_0123456789', 'xxabcdefghij') AS raw, translate(n_name, '#_0123456789', 'xxabcdefghij') AS place,
 lower(c_mktsegment) AS segment, strftime(last, '%B %-d, %Y') AS day FROM customer JOIN l ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey), m AS (SELECT *, upper(raw[1]) || lower(raw[2:]) AS name, upper(place[1]) || lower(place[2:]) AS city FROM c)
 SELECT k * 10 AS query_id, name || ' and ' || day AS answer FROM m UNION ALL SELECT k * 10 + 1, city FROM m UNION ALL SELECT k * 10 + 2, 'allergic to ' || segment FROM m"""


def segment_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Ten-second windows with an overlap of two over orders as videos, at most twelve."""
    o = table(spark, sf, "orders")
    s = media.segment_windows((F.col("o_totalprice").cast("long") % 200_000).cast("long"), 10_000, 2_000, 12)
    return o.select("o_orderkey", F.explode(s).alias("s")).select("o_orderkey", "s.*")


_SEGMENTS = """WITH o AS (SELECT o_orderkey, trunc(o_totalprice)::bigint % 200000 AS d FROM orders), i AS (SELECT o_orderkey, d, unnest(range(0, least(ceil(d / 8000.0)::bigint, 12))) AS index FROM o)
 SELECT o_orderkey, index, index * 8000 AS start_ms, least(index * 8000 + 10000, d) AS end_ms, (index * 8000 + least(index * 8000 + 10000, d)) // 2 AS mid_ms FROM i"""


def interval_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    """Events as pieces of a transcript against ten-minute segments of their user's day."""
    e = event_frames(spark, sf)
    piece = e.select(F.col("user_id").cast("long").alias("video_id"), F.pmod("ts_ms", F.lit(86_400_000)).alias("from_ms"), (F.pmod("ts_ms", F.lit(86_400_000)) + 1000 + F.col("frame_id") % 50_000).alias("to_ms"), "kind", "frame_id")
    piece = piece.select("video_id", "from_ms", "to_ms", F.concat_ws("-", "kind", "frame_id").alias("text"))
    seg = e.select(F.col("user_id").cast("long").alias("video_id")).distinct().withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(143).cast("long")))).withColumn("start_ms", F.col("index") * 600_000).withColumn("end_ms", (F.col("index") + 1) * 600_000)
    return media.overlap_join(seg, piece, cell_ms=300_000).select("video_id", "index", "n_pieces", F.md5("transcript").alias("digest"))


_OVERLAP = f"""WITH {EVENT_FRAMES}, p AS (SELECT user_id::bigint AS video_id, ts_ms % 86400000 AS a, ts_ms % 86400000 + 1000 + frame_id % 50000 AS b, kind || '-' || frame_id AS t FROM event_frames),
 s AS (SELECT video_id, index, index * 600000 AS x, (index + 1) * 600000 AS y FROM (SELECT DISTINCT user_id::bigint AS video_id FROM events), (SELECT unnest(range(0, 144)) AS index))
 SELECT video_id, index, count(*) AS n_pieces, md5(string_agg(t, chr(10) ORDER BY a, b, t)) AS digest FROM s JOIN p USING (video_id) WHERE least(y, b) - greatest(x, a) >= 250 GROUP BY 1, 2"""


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as hits on orders, which are the roots; the ship month is the query."""
    return table(spark, sf, "lineitem").select(F.month("l_shipdate").cast("long").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_id"), F.col("l_discount").alias("score"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("position"), F.col("l_returnflag").alias("kind"), F.when(F.col("l_linenumber") > 1, F.col("l_linestatus")).otherwise("").alias("preview"), F.col("l_orderkey").alias("order"), F.col("l_linenumber").cast("long").alias("line"))


def root_rollup(spark: SparkSession, sf: str) -> DataFrame:
    roots = table(spark, sf, "orders").select((F.col("o_orderkey") * 10).alias("frame_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("root").alias("kind"), F.when(F.col("o_orderstatus") == "F", "deleted").otherwise("active").alias("status"))
    kids = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_id"), (F.col("l_orderkey") * 10).alias("parent_id"), F.lit("part").alias("kind"), F.lit("active").alias("status"))
    return media.root_rollup(_hits(spark, sf), roots.unionByName(kids).withColumn("superseded_by", F.lit(None).cast("long")), "root").select("query_id", "root_id", "score", F.array_join("evidence", "").alias("evidence"), F.coalesce("snippet", F.lit("-")).alias("snippet"))


_ROLLUP = """WITH h AS (SELECT month(l_shipdate)::bigint AS query_id, l_orderkey * 10 AS root_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS p, l_discount AS score, l_returnflag AS k, CASE WHEN l_linenumber > 1 THEN l_linestatus ELSE '' END AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F'),
 f AS (SELECT query_id, root_id, k, min(p) AS p FROM h GROUP BY ALL), e AS (SELECT query_id, root_id, string_agg(k, '' ORDER BY p) AS evidence FROM f GROUP BY 1, 2)
 SELECT query_id, root_id, max(score) AS score, any_value(evidence) AS evidence, coalesce(arg_min(s, p) FILTER (s <> ''), '-') AS snippet FROM h JOIN e USING (query_id, root_id) GROUP BY 1, 2"""


def best_segment(spark: SparkSession, sf: str) -> DataFrame:
    hits = _hits(spark, sf).select("query_id", F.col("order").alias("root_id"), (F.col("line") % 3).alias("index"), "frame_id", "score")
    return media.best_segments(hits).select("query_id", "root_id", "index", "frame_id", F.col("place").cast("long").alias("place"))


_BEST = """WITH h AS (SELECT month(l_shipdate)::bigint AS query_id, l_orderkey AS root_id, l_linenumber::bigint % 3 AS index, l_orderkey * 10 + l_linenumber AS frame_id, round(l_discount, 3) AS s FROM lineitem),
 b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, root_id, index ORDER BY s DESC, frame_id) = 1) SELECT query_id, root_id, index, frame_id, row_number() OVER (PARTITION BY query_id, root_id ORDER BY s DESC, index) AS place FROM b QUALIFY place <= 3"""


def geo_bin_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers, placed by their numbers, around a point."""
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 180 - 90 + F.col("s_acctbal") / 100000).alias("lat"), (F.col("s_suppkey") * 7 % 360 - 180 + F.col("s_acctbal") / 100000).alias("lon"))
    return media.near(s, 10.0, 20.0, 100_000.0).select("s_suppkey").unionByName(media.near(s, -40.0, 100.0, 0.0).select("s_suppkey"))


_GEO = """WITH s AS (SELECT s_suppkey, s_suppkey % 180 - 90 + s_acctbal / 100000 AS lat, s_suppkey * 7 % 360 - 180 + s_acctbal / 100000 AS lon FROM supplier)
 SELECT s_suppkey FROM s WHERE floor(lat * 100) BETWEEN floor((10 - 100000 / 111000.0) * 100) AND floor((10 + 100000 / 111000.0) * 100) AND floor(lon * 100) BETWEEN floor((20 - 100000 / (111000.0 * cos(radians(10)))) * 100) AND floor((20 + 100000 / (111000.0 * cos(radians(10)))) * 100)
 UNION ALL SELECT s_suppkey FROM s"""


def geo_radius_join(spark: SparkSession, sf: str) -> DataFrame:
    """Customers within each supplier's radius, all in one plan: both spread over the globe by their numbers, radii from nothing to a quarter of it."""
    places = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") * 37 % 1801 / 10 - 90).alias("lat"), (F.col("c_custkey") * 7919 % 3600 / 10 - 180).alias("lon"))
    asked = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), (F.col("s_suppkey") * 101 % 1801 / 10 - 90).alias("lat"), (F.col("s_suppkey") * 733 % 3600 / 10 - 180).alias("lon"), (F.pow(F.col("s_suppkey") % 7, F.lit(3)) * 50_000).alias("radius_m"))
    return geo.radius_join(places, asked).select("query_id", "c_custkey", (F.floor(F.col("metres") * 1000 + 0.5) / 1000).alias("metres"))


_RADIUS = f"""WITH c AS (SELECT c_custkey, c_custkey * 37 % 1801 / 10 - 90 AS lat, c_custkey * 7919 % 3600 / 10 - 180 AS lon FROM customer), q AS (SELECT s_suppkey AS query_id, s_suppkey * 101 % 1801 / 10 - 90 AS qlat, s_suppkey * 733 % 3600 / 10 - 180 AS qlon, pow(s_suppkey % 7, 3) * 50000 AS m FROM supplier),
 d AS (SELECT query_id, c_custkey, m, {media.METRES_PER_DEGREE} * degrees(2 * asin(sqrt(least(pow(sin(radians(lat - qlat) / 2), 2) + cos(radians(qlat)) * cos(radians(lat)) * pow(sin(radians(lon - qlon) / 2), 2), 1.0)))) AS metres FROM c CROSS JOIN q)
 SELECT query_id, c_custkey, round(metres, 3) AS metres FROM d WHERE metres <= m"""


def recognized_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as recognised text, by discount as confidence."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_discount").alias("confidence"), F.concat_ws("-", "l_returnflag", "l_linestatus", (F.col("l_partkey") % 5).cast("string")).alias("text"))).alias("blocks"))
    return l.select("l_orderkey", F.array_join(media.recognized_lines(F.col("blocks"), 4), "|").alias("summary"))


_LINES = """WITH l AS (SELECT l_orderkey, l_discount AS c, concat_ws('-', l_returnflag, l_linestatus, l_partkey % 5) AS t FROM lineitem), d AS (SELECT l_orderkey, t, max(c) AS c FROM l GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, length(t) DESC, t) AS n FROM d) SELECT l_orderkey, string_agg(t, '|' ORDER BY n) AS summary FROM r WHERE n <= 4 GROUP BY 1"""


def current_roots(spark: SparkSession, sf: str) -> DataFrame:
    """The newest order of each customer as the current root of an asset, and what deleting the first hundred would remove."""
    o = table(spark, sf, "orders").select((F.col("o_orderkey") * 10).alias("frame_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("root").alias("kind"), F.lit("active").alias("status"), F.lit(None).cast("long").alias("superseded_by"), dates.millis(F.col("o_orderdate")).alias("ts_ms"), F.create_map(F.lit("asset_id"), F.col("o_custkey").cast("string")).alias("metadata"))
    return media.current_roots(o, "root")


def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    roots = table(spark, sf, "orders").select((F.col("o_orderkey") * 10).alias("frame_id"), F.lit(None).cast("long").alias("parent_id"), "o_orderpriority")
    kids = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_id"), (F.col("l_orderkey") * 10).alias("parent_id"))
    return media.with_children(roots.drop("o_orderpriority").unionByName(kids), roots.filter("o_orderpriority = '1-URGENT'").select("frame_id"))


def photo_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords, signed degrees and times as cameras write them."""
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(", ", "p_type", F.upper("p_type"), "p_brand").alias("k"), F.col("p_retailprice").alias("v"))
    return p.select("p_partkey", F.array_join(files.keywords(F.col("k")), "|").alias("keywords"), F.round(files.signed_degrees(F.col("v") / 100, F.when(F.col("p_partkey") % 2 == 0, "S").otherwise("N")), 6).alias("degrees"), files.exif_millis(F.lit("2024:02:29 12:00:01")).alias("taken_ms"), media.clock((F.col("p_partkey") * 777).cast("long")).alias("clock"))


_PHOTO = """SELECT p_partkey, CASE WHEN lower(p_type) = lower(p_brand) THEN p_type ELSE p_type || '|' || p_brand END AS keywords, round(CASE WHEN p_partkey % 2 = 0 THEN -abs(p_retailprice / 100) ELSE p_retailprice / 100 END, 6) AS degrees,
 1709208001000 AS taken_ms, printf('%02d:%02d', p_partkey * 777 // 1000 // 60, p_partkey * 777 // 1000 % 60) AS clock FROM part"""


def degraded_roots(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.lit("root").alias("kind"), F.create_map(F.lit("is_local"), (F.col("c_acctbal") >= 0).cast("string")).alias("metadata"))
    return media.degraded(c, "root")


def described_images(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    labels = F.array(F.struct(F.col("p_brand").alias("label"), (F.col("p_size") / 50.0).alias("confidence")), F.struct(F.col("p_type").alias("label"), F.lit(0.35).alias("confidence")))
    return p.select("p_partkey", media.described(labels, F.when(F.col("p_partkey") % 2 == 0, F.col("p_name"))).alias("text"))


_DESCRIBED = """WITH p AS (SELECT p_partkey, p_name, p_size / 50.0 AS c, p_brand, p_type FROM part)
 SELECT p_partkey, concat_ws('; ', 'Image of ' || CASE WHEN c > 0.35 OR (c = 0.35 AND p_brand < p_type) THEN p_brand || ', ' || p_type WHEN c > 0.3 THEN p_type || ', ' || p_brand ELSE p_type END, CASE WHEN p_partkey % 2 = 0 THEN 'Text: ' || p_name END) AS text FROM p"""


def kept_rewrites(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("store"), F.col("o_orderkey").cast("string").alias("path"), dates.millis(F.col("o_orderdate")).alias("mtime_ms"))
    return maintenance.kept_rewrites(o).filter("keep").select("store", "path")


def deterministic_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the offline provider for every turn (rows only); equal texts are embedded once."""
    t = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("frame_id"), F.col("text").alias("content"))
    return embed(t).select("frame_id", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("length"))


def remembered_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames that ingest makes of documents: one for each and one for each chunk (rows only)."""
    return context.remembered(frames(spark, sf).select(F.col("frame_id").alias("doc_id"), "content"), 10_000).select("frame_id", "doc_id", "chunk", "role")


def _photos(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    blocks = F.array(F.struct((F.col("p_size") / 50.0).alias("confidence"), F.col("p_type").alias("text")), F.struct(F.lit(0.4).alias("confidence"), F.col("p_brand").alias("text")))
    return p.select(F.col("p_partkey").alias("asset_id"), (F.col("p_partkey") * 1000).alias("captured_ms"), (F.col("p_partkey") % 5 != 0).alias("is_local"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("caption"), F.lower("p_brand").alias("tags"), blocks.alias("blocks"), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("is_local"), F.lit("asked")).alias("metadata"))


def photo_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as photos: root, caption, tags, summary of their text, blocks."""
    made = library.photo_frames(_photos(spark, sf), 100)
    return made.select("frame_id", "asset_id", "kind", "parent_id", "content", "search_text", "ts_ms", F.col("metadata")["is_local"].alias("is_local"), F.col("metadata")["confidence"].cast("double").alias("confidence"), library.searchable_photo(F.col("kind")).alias("searchable"))


_PHOTOS = """WITH p AS (SELECT *, p_size / 50.0 AS c FROM part),
 parts AS (SELECT p_partkey AS a, 0 AS o, 'photo.root' AS kind, NULL AS content, NULL AS search_text, NULL::double AS confidence FROM p
  UNION ALL SELECT p_partkey, 1, 'photo.caption.short', p_name, p_name, NULL FROM p WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 0 AND p_name <> ''
  UNION ALL SELECT p_partkey, 2, 'photo.tags', lower(p_brand), lower(p_brand), NULL FROM p WHERE p_partkey % 5 <> 0
  UNION ALL SELECT p_partkey, 3, 'photo.ocr.summary', t, t, NULL FROM (SELECT p_partkey, CASE WHEN c > 0.4 OR (c = 0.4 AND (length(p_type) > length(p_brand) OR (length(p_type) = length(p_brand) AND p_type <= p_brand))) THEN p_type || chr(10) || p_brand ELSE p_brand || chr(10) || p_type END AS t FROM p) WHERE p_partkey % 5 <> 0
  UNION ALL SELECT p_partkey, 4, 'photo.ocr.block', p_type, NULL, c FROM p WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, 5, 'photo.ocr.block', p_brand, NULL, 0.4 FROM p WHERE p_partkey % 5 <> 0),
 n AS (SELECT *, 99 + row_number() OVER (ORDER BY a, o) AS frame_id FROM parts)
 SELECT frame_id, a AS asset_id, kind, CASE WHEN o > 0 THEN first_value(frame_id) OVER (PARTITION BY a ORDER BY o) END AS parent_id, content, search_text, a * 1000 AS ts_ms, 'asked' AS is_local, confidence, kind <> 'photo.ocr.block' AS searchable FROM n"""


def video_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as videos, their lines as pieces of a transcript."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("asset_id"), dates.millis(F.col("o_orderdate")).alias("captured_ms"), (F.col("o_totalprice").cast("long") % 60_000).alias("duration_ms"), (F.col("o_orderstatus") != "P").alias("is_local"), F.lit(None).cast("map<string,string>").alias("metadata"))
    start = F.col("l_linenumber") * 7_000 - 7_000
    pieces = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("asset_id"), start.cast("long").alias("from_ms"), (start + 2_000 + F.col("l_quantity").cast("long") * 100).cast("long").alias("to_ms"), F.concat_ws("-", "l_returnflag", F.col("l_partkey").cast("string")).alias("text"))
    made = library.video_frames(o, pieces, 10, length_ms=10_000, overlap_ms=2_000, most=12)
    return made.select("frame_id", "asset_id", "kind", "parent_id", F.md5(F.coalesce("search_text", F.lit("-"))).alias("digest"), "ts_ms", F.col("metadata")["segment_index"].cast("long").alias("segment"), F.col("metadata")["segment_count"].cast("long").alias("segments"), F.col("metadata")["mid_ms"].cast("long").alias("mid_ms"))


_VIDEOS = """WITH o AS (SELECT o_orderkey AS a, epoch_us(o_orderdate) // 1000 AS ts, trunc(o_totalprice)::bigint % 60000 AS d, o_orderstatus <> 'P' AS is_local FROM orders),
 i AS (SELECT a, d, unnest(range(0, least(ceil(d / 8000.0)::bigint, 12))) AS i FROM o WHERE is_local AND d > 0), s AS (SELECT a, i, i * 8000 AS x, least(i * 8000 + 10000, d) AS y FROM i),
 p AS (SELECT l_orderkey AS a, l_linenumber * 7000 - 7000 AS u, l_linenumber * 7000 - 5000 + trunc(l_quantity)::bigint * 100 AS v, concat_ws('-', l_returnflag, l_partkey) AS t FROM lineitem),
 j AS (SELECT a, i, string_agg(t, chr(10) ORDER BY u, v, t) AS t FROM s JOIN p USING (a) WHERE least(y, v) - greatest(x, u) >= 250 GROUP BY 1, 2),
 parts AS (SELECT a, -1 AS i, 'video.root' AS kind, NULL AS t, NULL::bigint AS mid FROM o UNION ALL SELECT s.a, s.i, 'video.segment', j.t, (x + y) // 2 FROM s LEFT JOIN j ON j.a = s.a AND j.i = s.i),
 n AS (SELECT *, 9 + row_number() OVER (ORDER BY a, i) AS frame_id, count(*) OVER (PARTITION BY a) - 1 AS k FROM parts)
 SELECT frame_id, a AS asset_id, kind, CASE WHEN i >= 0 THEN frame_id - i - 1 END AS parent_id, md5(coalesce(t, '-')) AS digest, ts AS ts_ms, CASE WHEN i >= 0 THEN i END AS segment, CASE WHEN i >= 0 THEN k END AS segments, mid AS mid_ms FROM n JOIN o USING (a)"""


def library_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of urgent ones' customers as items that a sync takes, and which previous root each new one replaces."""
    o = table(spark, sf, "orders")
    items = o.select(F.col("o_orderkey").alias("asset_id"), dates.millis(F.col("o_orderdate")).alias("created_ms"))
    taken = library.sync_scope(items, o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("asset_id")))
    kept = o.filter("o_orderkey % 2 = 0").select((F.col("o_orderkey") * 10).alias("frame_id"), F.lit("photo.root").alias("kind"), F.lit("active").alias("status"), F.lit(None).cast("long").alias("superseded_by"), F.lit(0).cast("long").alias("ts_ms"), F.create_map(F.lit("asset_id"), F.col("o_orderkey").cast("string")).alias("metadata"))
    new = taken.select("asset_id", F.lit("photo.root").alias("kind"), (F.col("asset_id") * 10 + 1).alias("frame_id"))
    return library.superseding(new, kept, "photo.root")


QUERIES = {
    f.__name__: f
    for f in (token_counts, chunk_windows_of_tokens, photo_ingest, video_ingest, library_sync, chunk_windows, window_plan, token_budget_prefix, budget_greedy, surrogate_tiers, tier_payloads, budget_clamp, lexical_sentence, answer_extract, segment_windows, interval_overlap_join, root_rollup, best_segment, geo_bin_filter, geo_radius_join, recognized_lines, current_roots, cascade_delete, photo_fields, degraded_roots, described_images, kept_rewrites, deterministic_embedding, remembered_frames)
}
ORACLES = {
    "photo_ingest": _PHOTOS,
    "video_ingest": _VIDEOS,
    "library_sync": "SELECT o_orderkey * 10 AS frame_id, o_orderkey * 10 + 1 AS other_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0",
    "window_plan": _WINDOWS,
    "token_budget_prefix": f"WITH {_ITEMS} SELECT query_id, position, frame_id, sum(tokens) OVER (PARTITION BY query_id ORDER BY position)::bigint AS used FROM items QUALIFY used <= 200",
    "budget_greedy": _GREEDY,
    "tier_payloads": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || ' in full' ELSE event_type END AS full, event_type AS gist, CASE WHEN event_id % 2 = 0 THEN 'x' ELSE event_type END AS micro FROM events",
    "budget_clamp": "SELECT s_suppkey, greatest(trunc(s_acctbal)::int, 0) AS context, least(greatest(s_suppkey * 100, 0), greatest(trunc(s_acctbal)::int, 0))::int AS expansion, greatest(s_nationkey - 10, 0) AS snippet, round(least(greatest(s_acctbal / 1000, 0.0), 1.0), 6) AS penalty FROM supplier",
    "lexical_sentence": _SENTENCE,
    "answer_extract": _ANSWER,
    "segment_windows": _SEGMENTS,
    "interval_overlap_join": _OVERLAP,
    "root_rollup": _ROLLUP,
    "best_segment": _BEST,
    "geo_bin_filter": _GEO,
    "geo_radius_join": _RADIUS,
    "recognized_lines": _LINES,
    "current_roots": "SELECT o_custkey::varchar AS asset_id, arg_max(o_orderkey * 10, (o_orderdate, o_orderkey)) AS frame_id FROM orders GROUP BY 1",
    "cascade_delete": "SELECT o_orderkey * 10 AS frame_id FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT l_orderkey * 10 + l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT'",
    "photo_fields": _PHOTO,
    "degraded_roots": "SELECT count(*) FILTER (c_acctbal < 0) AS degraded, count(*) AS roots FROM customer",
    "described_images": _DESCRIBED,
    "kept_rewrites": "SELECT o_custkey AS store, o_orderkey::varchar AS path FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey::varchar) <= 2",
}
