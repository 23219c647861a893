"""Recall over a library of videos: documents as segments, four to a video."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import media
from recollect.plans.library_recall import library_recall
from recollect.plans.search_queries import _ASKED, _KIND, _METRIC, _POSTINGS, _TOKENS, sql_knn, sql_lane
from recollect.plans.tables import questions, table, vectors

ROOT, BASE, TOP, LIMIT, PARTS, TOKENS = "video.root", 1_000_000_000, 40, 5, 2, 120


def video_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as questions with text, a vector, both or neither, and with ranges of time and radii, over all documents."""
    d = table(spark, sf, "documents")
    n = F.floor(F.col("doc_id") / 4).cast("long")
    null = F.lit(None).cast("long")
    when = (n * 7919 % 100_003 * 1000).alias("ts_ms")
    segments = d.select(F.col("doc_id").alias("frame_id"), (n + BASE).alias("parent_id"), F.lit("video.segment").alias("kind"), F.when(F.col("doc_id") % 23 == 4, "deleted").otherwise("active").alias("status"), null.alias("superseded_by"), when, F.col("text").alias("content"))
    roots = d.filter("doc_id % 4 = 0").select((n + BASE).alias("frame_id"), null.alias("parent_id"), F.lit(ROOT).alias("kind"), F.when(n % 11 == 5, "deleted").otherwise("active").alias("status"), F.when(n % 13 == 6, n + BASE + 1).alias("superseded_by"), when, F.lit(None).cast("string").alias("content"))
    places = roots.select("frame_id", (F.col("frame_id") * 37 % 1801 / 10 - 90).alias("lat"), (F.col("frame_id") * 7919 % 3600 / 10 - 180).alias("lon"))
    i = F.col("query_id")
    asked = questions(spark, sf).join(vectors(spark, sf).select(F.col("frame_id").alias("query_id"), "embedding"), "query_id", "left")
    asked = asked.select("query_id", F.when(i % 4 <= 1, F.col("query")).alias("query"), F.when((i % 4 == 1) | (i % 4 == 2), F.col("embedding")).alias("embedding"), F.when(i % 3 == 0, i * 100_000 % 30_000_000).alias("after_ms"), F.when(i % 3 <= 1, 60_000_000 + i * 10_000).alias("before_ms"), (i * 101 % 1801 / 10 - 90).alias("lat"), (i * 733 % 3600 / 10 - 180).alias("lon"), F.when(i % 5 == 0, 5_000_000.0).alias("radius_m"))
    found = library_recall(segments.unionByName(roots), vectors(spark, sf), asked, root_kind=ROOT, places=places, limit=LIMIT, parts=PARTS, top_k=TOP, tokens=TOKENS)
    return found.select("query_id", "root_id", F.col("position").cast("long").alias("position"), F.round("score", 6).alias("score"), F.array_join("evidence", "+").alias("evidence"), F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"), F.sha2("summary", 256).alias("summary_sha256"), "tokens", "used")


_MOST = 120
_VIDEO = rf"""WITH {_TOKENS}, {_POSTINGS}, {sql_lane('tl', _MOST)}, {sql_knn('kn', _MOST, _METRIC['cosine'], _ASKED)}, {_KIND},
 root AS (SELECT doc_id // 4 + {BASE} AS root_id, (doc_id // 4) * 7919 % 100003 * 1000 AS ts, (doc_id // 4 + {BASE}) * 37 % 1801 / 10 - 90 AS lat, (doc_id // 4 + {BASE}) * 7919 % 3600 / 10 - 180 AS lon FROM documents WHERE doc_id % 4 = 0 AND (doc_id // 4) % 11 <> 5 AND (doc_id // 4) % 13 <> 6),
 ask AS (SELECT item_id AS query_id, item_id % 4 AS m, item_id % 4 <= 1 AND trim(coalesce(text, '')) <> '' AS has_text, item_id % 4 IN (1, 2) AND item_id IN (SELECT query_id FROM ({_ASKED})) AS has_vector, CASE WHEN item_id % 3 = 0 THEN item_id * 100000 % 30000000 END AS after_ms, CASE WHEN item_id % 3 <= 1 THEN 60000000 + item_id * 10000 END AS before_ms,
  item_id * 101 % 1801 / 10 - 90 AS qlat, item_id * 733 % 3600 / 10 - 180 AS qlon, CASE WHEN item_id % 5 = 0 THEN 5000000.0 END AS radius FROM benchmark),
 ok AS (SELECT query_id, root_id, ts FROM ask CROSS JOIN root WHERE (after_ms IS NULL OR ts >= after_ms) AND (before_ms IS NULL OR ts < before_ms)
  AND (radius IS NULL OR {media.METRES_PER_DEGREE} * degrees(2 * asin(sqrt(least(pow(sin(radians(lat - qlat) / 2), 2) + cos(radians(qlat)) * cos(radians(lat)) * pow(sin(radians(lon - qlon) / 2), 2), 1.0)))) <= radius)),
 parts AS (SELECT query_id, frame_id, rank, 'text' AS source, 0.5 * wt / (60 + rank) AS part FROM tl JOIN weights USING (query_id) JOIN ask USING (query_id) WHERE has_text AND has_vector
  UNION ALL SELECT query_id, frame_id, rank, 'vector', 0.5 * wv / (60 + rank) FROM kn JOIN weights USING (query_id) JOIN ask USING (query_id) WHERE has_text AND has_vector),
 fused AS (SELECT query_id, frame_id, round(sum(part), 9) AS score, min(rank) AS best_rank, string_agg(source, '+' ORDER BY source) AS sources FROM parts GROUP BY 1, 2),
 ranked AS (SELECT query_id, frame_id, score, string_split(sources, '+') AS sources FROM (FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, frame_id) <= {_MOST})
  UNION ALL SELECT query_id, frame_id, score, ['text'] FROM tl JOIN ask USING (query_id) WHERE has_text AND NOT has_vector UNION ALL SELECT query_id, frame_id, score, ['vector'] FROM kn JOIN ask USING (query_id) WHERE has_vector AND NOT has_text),
 hits AS (SELECT r.query_id, ok.root_id, frame_id, score, sources FROM ranked r JOIN documents d ON d.doc_id = r.frame_id AND doc_id % 23 <> 4 JOIN ok ON ok.query_id = r.query_id AND ok.root_id = d.doc_id // 4 + {BASE}
  UNION ALL SELECT query_id, root_id, root_id, round(1.0 / (60 + rank), 9), ['timeline'] FROM (SELECT query_id, root_id, row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, root_id) AS rank FROM ok JOIN ask USING (query_id) WHERE NOT has_text AND NOT has_vector AND (after_ms IS NOT NULL OR before_ms IS NOT NULL OR radius IS NOT NULL)) WHERE rank <= {_MOST}),
 best AS (SELECT query_id, root_id, max(score) AS score, array_to_string(list_sort(list_distinct(flatten(list(sources)))), '+') AS evidence, row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, root_id) AS position FROM hits GROUP BY 1, 2 QUALIFY position <= {LIMIT}),
 few AS (SELECT h.query_id, h.root_id, h.frame_id, row_number() OVER (PARTITION BY h.query_id, h.root_id ORDER BY h.score DESC, h.frame_id) AS place FROM hits h JOIN best USING (query_id, root_id) WHERE h.frame_id <> h.root_id QUALIFY place <= {PARTS}),
 own AS (SELECT query_id, root_id, string_agg(frame_id::varchar, ',' ORDER BY place) AS parts, string_agg(coalesce(text, ''), chr(10) ORDER BY place) AS text FROM few JOIN documents ON doc_id = frame_id GROUP BY 1, 2),
 cut AS (SELECT b.*, coalesce(parts, '') AS parts, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '')[1:greatest(1, {TOKENS} // count(*) OVER (PARTITION BY query_id))] AS w FROM best b LEFT JOIN own USING (query_id, root_id))
 SELECT query_id, root_id, position, round(score, 6) AS score, evidence, parts, sha256(array_to_string(w, ' ')) AS summary_sha256, len(w) AS tokens, sum(len(w)) OVER (PARTITION BY query_id ORDER BY position)::bigint AS used FROM cut QUALIFY used <= {TOKENS}"""

QUERIES = {"video_recall": video_recall}
ORACLES = {"video_recall": _VIDEO}
