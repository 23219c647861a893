"""Queries of lanes, fusion and search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import text, vectors as vec
from recollect.operators import fusion, lanes, maintenance
from recollect.operators.bm25 import UNIT
from recollect.operators.boolean import boolean
from recollect.plans.search import SearchRequest, recall, search, unified
from recollect.plans.tables import EVENT_FRAMES, MEMORY_FRAMES, event_frames, frames, memory_frames, questions, table, vectors
from recollect.plans.text_queries import ORACLES as _TEXT
from recollect.plans.text_queries import sql_words
from recollect.session import staged, staging_dir
from recollect.sources.graph import VectorGraph
from recollect.sources.index import TextIndex

K = 10

_TOKENS = f"tokens AS (SELECT query_id, string_split(tokens, ' ') AS terms FROM ({_TEXT['text_search_tokens'].replace('lower(text)', 'strip_accents(lower(text))')}))"
_POSTINGS = f"""w AS (SELECT doc_id, {sql_words('strip_accents(lower(text))')} AS w FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
 p AS (SELECT doc_id, term, count(*) AS tf, any_value(len(w)) AS dl FROM (SELECT doc_id, w, unnest(w) AS term FROM w) GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df FROM p GROUP BY 1), q AS (SELECT query_id, unnest(list_distinct(terms)) AS term, len(list_distinct(terms)) AS nt FROM tokens)"""
_GAIN = "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))"


def sql_bm25(name: str, k: int, having: str = "") -> str:
    """Common table ``name`` (query_id, frame_id, score, rank); sums of whole numbers don't depend on their order."""
    return f"""{name} AS (SELECT * FROM (SELECT query_id, doc_id AS frame_id, round(raw / {UNIT}.0, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, doc_id) AS rank
 FROM (SELECT query_id, doc_id, sum(round_even({_GAIN} * {UNIT}.0, 0)::BIGINT) AS raw FROM q JOIN p USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY 1, 2 {having})) WHERE rank <= {k})"""


def sql_knn(name: str, k: int, score: str, queries: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT query_id, vec_id AS frame_id, round(raw, 6) + 0.0 AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) AS rank
 FROM (SELECT query_id, vec_id, {score} AS raw FROM ({queries}) CROSS JOIN (SELECT vec_id, embedding::double[] AS v FROM embeddings WHERE embedding IS NOT NULL))) WHERE rank <= {k})"""


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    return questions(spark, sf).select("query_id", text.search_tokens(F.col("query"), marks=False).alias("terms"))


def text_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.bm25(frames(spark, sf), _terms(spark, sf), K)


def text_bm25_and(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.bm25(frames(spark, sf), _terms(spark, sf), K, need_all=True)


def text_or_fallback_merge(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.text_lane(frames(spark, sf), _terms(spark, sf), K)


def text_phrase(spark: SparkSession, sf: str) -> DataFrame:
    asked = questions(spark, sf).select("query_id", F.array_join(text.words(F.col("query")), " ").alias("phrase"))
    return lanes.phrase_hits(frames(spark, sf), asked)


def text_indexed_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same over an index, built for the query, by block maxima."""
    index = TextIndex(spark, f"{staging_dir(spark)}/index-{uuid.uuid4().hex}")
    index.add(frames(spark, sf).select("frame_id", "content"))
    return lanes.bm25(index, _terms(spark, sf), K)


def _written(spark: SparkSession, sf: str, query) -> DataFrame:
    """Queries made of the words of each benchmark item."""
    asked = questions(spark, sf).select("query_id", text.index_words(F.col("query")).alias("w")).filter(F.size("w") >= 6)
    return asked.select("query_id", query(lambda i: F.get("w", F.lit(i))).alias("query"))


def text_boolean(spark: SparkSession, sf: str) -> DataFrame:
    """A word, a phrase and a word that must not occur; or a word and a prefix."""
    query = lambda w: F.concat(w(0), F.lit(' AND "'), w(1), F.lit(" "), w(2), F.lit('" NOT '), w(5), F.lit(" OR "), w(3), F.lit(" "), F.substring(w(4), 1, 3), F.lit("*"))
    return boolean(frames(spark, sf), _written(spark, sf, query), K)


def text_near(spark: SparkSession, sf: str) -> DataFrame:
    """The first and the third word, with at most two words between them."""
    return boolean(frames(spark, sf), _written(spark, sf, lambda w: F.concat(w(0), F.lit(" NEAR/2 "), w(2))), K)


def text_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """How many frames each beginning of a question's second word is found in."""
    found = boolean(frames(spark, sf), _written(spark, sf, lambda w: F.concat(F.substring(w(1), 1, 4), F.lit("*"))))
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("frames"), F.min("frame_id").alias("first"), F.max("frame_id").alias("last"))


_WRITTEN = f"words AS (SELECT item_id AS query_id, w FROM (SELECT item_id, {sql_words('strip_accents(lower(text))')} AS w FROM benchmark) WHERE len(w) >= 6)"
_PLACES = f"""w AS (SELECT doc_id, {sql_words('strip_accents(lower(text))')} AS w FROM documents WHERE text IS NOT NULL), st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
 places AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM w), p AS (SELECT doc_id, term, count(*) AS tf, any_value(len(w)) AS dl FROM places JOIN w USING (doc_id) GROUP BY 1, 2),
 df AS (SELECT term, count(*) AS df FROM p GROUP BY 1)"""


def _ranked_hits(terms: str) -> str:
    return f"""q AS (SELECT query_id, unnest(list_distinct({terms})) AS term FROM words), r AS (SELECT h.query_id, h.doc_id AS frame_id, coalesce(sum(round_even({_GAIN} * {UNIT}.0, 0)::BIGINT), 0) AS raw
 FROM hits h CROSS JOIN st JOIN q USING (query_id) LEFT JOIN p ON p.doc_id = h.doc_id AND p.term = q.term LEFT JOIN df ON df.term = q.term GROUP BY 1, 2)
 SELECT * FROM (SELECT query_id, frame_id, round(raw / {UNIT}.0, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, frame_id) AS rank FROM r) WHERE rank <= {K}"""


_BOOLEAN = f"""WITH {_WRITTEN}, {_PLACES}, a AS (SELECT query_id, doc_id FROM words JOIN p ON term = w[1] JOIN (SELECT x.query_id, x.doc_id FROM
 (SELECT DISTINCT query_id, doc_id FROM words JOIN places y ON y.term = w[2] JOIN places z USING (doc_id) WHERE z.term = w[3] AND z.pos = y.pos + 1) x) USING (query_id, doc_id)
 WHERE NOT EXISTS (SELECT 1 FROM p x WHERE x.doc_id = p.doc_id AND x.term = w[6])),
 b AS (SELECT DISTINCT query_id, p.doc_id FROM words JOIN p ON p.term = w[4] JOIN p y ON y.doc_id = p.doc_id AND starts_with(y.term, substr(w[5], 1, 3))),
 hits AS (SELECT * FROM a UNION SELECT * FROM b), {_ranked_hits("w[1:4]")}"""
_NEAR = f"""WITH {_WRITTEN}, {_PLACES}, hits AS (SELECT DISTINCT query_id, doc_id FROM words JOIN places x ON x.term = w[1] JOIN places y USING (doc_id) WHERE y.term = w[3] AND abs(x.pos - y.pos) <= 3),
 {_ranked_hits("[w[1], w[3]]")}"""
_PREFIX = f"""WITH {_WRITTEN}, {_PLACES}, b AS (SELECT DISTINCT substr(w[2], 1, 4) AS s FROM words), v AS (SELECT s, doc_id FROM b JOIN p ON starts_with(term, s) GROUP BY ALL),
 f AS (SELECT s, count(*) AS frames, min(doc_id) AS first, max(doc_id) AS last FROM v GROUP BY 1)
 SELECT query_id, frames, first, last FROM words JOIN f ON s = substr(w[2], 1, 4)"""


def _every(spark: SparkSession, sf: str, step: int = 25) -> DataFrame:
    v = vectors(spark, sf)
    return v.filter(F.col("frame_id") % step == 0).select(F.col("frame_id").alias("query_id"), "embedding")


_EVERY = "SELECT vec_id AS query_id, embedding::double[] AS q FROM embeddings WHERE vec_id % 25 = 0"
_METRIC = {"cosine": "list_cosine_similarity(q, v)", "dot": "list_dot_product(q, v)", "l2": "-list_sum(list_transform(list_zip(q, v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"}


def vector_knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.knn(vectors(spark, sf), _every(spark, sf), K)


def vector_knn_dot(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.knn(vectors(spark, sf), _every(spark, sf), K, metric="dot")


def vector_knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    return lanes.knn(vectors(spark, sf), _every(spark, sf), K, metric="l2")


def vector_graph_knn(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours by walks over proximity graphs, with the recall that calibration measured and the distances that each walk took."""
    graph = VectorGraph(vectors(spark, sf), k=K)
    return graph.search(_every(spark, sf)).withColumn("vectors", F.lit(graph.n))


def vector_math(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector against the next one."""
    v = vectors(spark, sf)
    both = v.select("frame_id", F.col("embedding").alias("a")).join(v.select((F.col("frame_id") - 1).alias("frame_id"), F.col("embedding").alias("b")), "frame_id")
    a, b = F.col("a"), F.col("b")

    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda s, y: s + y)

    return both.select("frame_id", F.round(vec.dot(a, b), 6).alias("dot"), F.round(vec.cosine(a, b), 6).alias("cosine"), F.round(vec.squared_distance(a, b), 6).alias("squared"), F.round(vec.distance(a, b), 6).alias("distance"), F.round(vec.magnitude(a), 6).alias("length"), F.round(total(vec.normalized(a)), 6).alias("unit_sum"), F.round(total(vec.add(a, b)), 6).alias("sum"), F.round(total(vec.subtract(a, b)), 6).alias("difference"), F.round(total(vec.scaled(a, 2.5)), 6).alias("scaled"), F.round(total(vec.blended(a, b)), 6).alias("blended"), vec.is_normalized(a).alias("is_unit"))


_MATH = """WITH e AS (SELECT vec_id, embedding::double[] AS v FROM embeddings), p AS (SELECT x.vec_id AS frame_id, x.v AS a, y.v AS b, list_transform(list_zip(x.v, y.v), lambda z: 0.6 * z[1] + 0.4 * z[2]) AS m FROM e x JOIN e y ON y.vec_id = x.vec_id + 1),
 n AS (SELECT *, sqrt(list_dot_product(a, a)) AS la, list_dot_product(a, b) AS d, list_dot_product(a, a) + list_dot_product(b, b) - 2 * list_dot_product(a, b) AS s2 FROM p)
 SELECT frame_id, round(d, 6) AS dot, round(list_cosine_similarity(a, b), 6) AS cosine, round(s2, 6) AS squared, round(sqrt(s2), 6) AS distance, round(la, 6) AS length, round(list_sum(a) / la, 6) AS unit_sum,
 round(list_sum(a) + list_sum(b), 6) AS sum, round(list_sum(a) - list_sum(b), 6) AS difference, round(2.5 * list_sum(a), 6) AS scaled, round(list_sum(m) / sqrt(list_dot_product(m, m)), 6) AS blended, abs(la - 1) <= 1e-3 AS is_unit FROM n"""


def vector_label_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    """How often neighbours share the query's label."""
    v = vectors(spark, sf)
    near = staged(lanes.knn(v, _every(spark, sf), K + 1).filter("frame_id <> query_id"))  # read twice, computed once
    labels = v.select("frame_id", "label")
    hits = near.join(labels, "frame_id").join(labels.select(F.col("frame_id").alias("query_id"), F.col("label").alias("own")), "query_id").filter("label = own").select("query_id", F.col("frame_id").alias("item"), "rank")
    every = near.select("query_id", F.col("frame_id").alias("item"))
    return maintenance.retrieval_quality(hits, every, K)


_RECALL = f"""WITH {sql_knn("r", K + 1, _METRIC["cosine"], _EVERY)}, x AS (SELECT query_id, frame_id, rank FROM r WHERE frame_id <> query_id),
 h AS (SELECT x.* FROM x JOIN embeddings a ON a.vec_id = x.frame_id JOIN embeddings b ON b.vec_id = x.query_id WHERE a.label = b.label AND rank <= {K}),
 g AS (SELECT query_id, count(DISTINCT frame_id) AS found, min(rank) AS first FROM h GROUP BY 1), w AS (SELECT query_id, count(DISTINCT frame_id) AS n FROM x GROUP BY 1)
 SELECT count(*) AS queries, round(avg(coalesce(found, 0) / n), 6) AS recall, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr, count(*) FILTER (found IS NULL) AS failures FROM w LEFT JOIN g USING (query_id)"""


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with the vector of the same number."""
    return questions(spark, sf).join(vectors(spark, sf).select(F.col("frame_id").alias("query_id"), "embedding"), "query_id", "left")


_ASKED = "SELECT item_id AS query_id, embedding::double[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id WHERE embedding IS NOT NULL"
_KIND = """kinds AS (SELECT item_id AS query_id, CASE WHEN regexp_matches(lower(text), 'when|yesterday|today|last |recent|latest|before |after |between ') THEN 'temporal'
 WHEN regexp_matches(lower(text), '^what is|^what are|^who is|^who are|define |definition of|meaning of') THEN 'factual' WHEN regexp_matches(lower(text), 'how |why |explain|describe|relate') THEN 'semantic' ELSE 'exploratory' END AS kind FROM benchmark),
 weights AS (SELECT query_id, CASE kind WHEN 'factual' THEN 0.7 WHEN 'semantic' THEN 0.3 WHEN 'temporal' THEN 0.25 ELSE 0.4 END AS wt, CASE kind WHEN 'factual' THEN 0.3 WHEN 'semantic' THEN 0.7 WHEN 'temporal' THEN 0.25 ELSE 0.5 END AS wv FROM kinds)"""
_MOST = fusion.candidate_limit(K)


def sql_fused(alpha: float = 0.5) -> str:
    return f"""WITH {_TOKENS}, {_POSTINGS}, {sql_bm25("bm", _MOST)}, {sql_knn("kn", _MOST, _METRIC["cosine"], _ASKED)}, {_KIND},
 parts AS (SELECT query_id, frame_id, rank, 'text' AS source, {alpha} * wt / (60 + rank) AS part FROM bm JOIN weights USING (query_id) WHERE {alpha} * wt > 0
  UNION ALL SELECT query_id, frame_id, rank, 'vector', {1 - alpha} * wv / (60 + rank) FROM kn JOIN weights USING (query_id) WHERE {1 - alpha} * wv > 0),
 fused AS (SELECT query_id, frame_id, round(sum(part), 9) AS score, min(rank) AS best_rank, string_agg(source, '+' ORDER BY source) AS sources FROM parts GROUP BY 1, 2),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, frame_id) AS position FROM fused)"""


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    found = search(frames(spark, sf), vectors(spark, sf), _asked(spark, sf), SearchRequest(top_k=K, rerank=False))
    return found.select("query_id", "frame_id", F.col("position").cast("long").alias("position"), "score", F.col("best_rank").cast("long").alias("best_rank"), F.array_join("sources", "+").alias("sources"))


_HELD = "held AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY position) AS final FROM ranked r JOIN documents d ON d.doc_id = r.frame_id WHERE position <= {most} {keep})"
_HYBRID = sql_fused() + ", " + _HELD.format(most=_MOST, keep="") + f" SELECT query_id, frame_id, final AS position, score, best_rank, sources FROM held WHERE final <= {K}"


def hybrid_post_filter(spark: SparkSession, sf: str) -> DataFrame:
    """English documents only, cut after ranking: fewer than k may be left."""
    found = search(frames(spark, sf), vectors(spark, sf), _asked(spark, sf), SearchRequest(top_k=K, rerank=False, keep=fusion.metadata_matches({"lang": "en"}), min_score=0.004))
    return found.select("query_id", "frame_id", F.col("position").cast("long").alias("position"), "score")


_FILTERED = sql_fused() + ", " + _HELD.format(most=_MOST, keep="AND d.lang = 'en' AND score >= 0.004") + f" SELECT query_id, frame_id, final AS position, score FROM held WHERE final <= {K}"


def hybrid_alpha_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Lanes don't depend on the share, so they are computed once."""
    asked, most, out = _asked(spark, sf).filter(F.trim(F.coalesce("query", F.lit(""))) != ""), fusion.candidate_limit(3), None
    terms = asked.select("query_id", text.search_tokens(F.col("query"), marks=False).alias("terms"))
    shared = {"text": staged(lanes.bm25(frames(spark, sf), terms, most)), "vector": staged(lanes.knn(vectors(spark, sf), asked.filter("embedding IS NOT NULL").select("query_id", "embedding"), most))}
    for alpha in (0.0, 0.25, 1.0):
        found = search(frames(spark, sf), vectors(spark, sf), asked, SearchRequest(top_k=3, alpha=alpha, rerank=False, extra_lanes=shared)).select(F.lit(alpha).alias("alpha"), "query_id", "frame_id", F.col("position").cast("long").alias("position"))
        out = found if out is None else out.unionByName(found)
    return out


def _sweep() -> str:
    most = fusion.candidate_limit(3)
    each = []
    for alpha in (0.0, 0.25, 1.0):
        sql = sql_fused(alpha).replace(f"rank <= {_MOST}", f"rank <= {most}") + ", " + _HELD.format(most=most, keep="") + f" SELECT {alpha}::double AS alpha, query_id, frame_id, final AS position FROM held WHERE final <= 3"
        each.append(f"SELECT * FROM ({sql})")
    return " UNION ALL ".join(each)


def hybrid_rrf_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Lane contributions and why each result stands below the one before."""
    asked = _asked(spark, sf)
    found = {"text": lanes.bm25(frames(spark, sf), asked.select("query_id", text.search_tokens(F.col("query"), marks=False).alias("terms")), _MOST), "vector": lanes.knn(vectors(spark, sf), asked.filter("embedding IS NOT NULL").select("query_id", "embedding"), _MOST)}
    weights = asked.select("query_id", *[fusion.lane_weight(text.query_type(F.col("query")), i, 0.5).alias(n) for i, n in enumerate(("text", "vector"))])
    ranked = fusion.tie_reasons(fusion.fuse(found, weights)).filter(F.col("position") <= K)
    return ranked.select("query_id", "frame_id", F.col("position").cast("long").alias("position"), F.array_join(F.transform("contributions", lambda c: F.concat_ws(":", c["source"], c["rank"].cast("string"))), "+").alias("contributions"), "tie_reason")


_DIAGNOSTICS = sql_fused() + f""", c AS (SELECT query_id, frame_id, string_agg(source || ':' || rank, '+' ORDER BY part DESC, source) AS contributions FROM parts GROUP BY 1, 2),
 l AS (SELECT *, lag(score) OVER o AS s, lag(best_rank) OVER o AS b FROM ranked WINDOW o AS (PARTITION BY query_id ORDER BY position))
 SELECT query_id, frame_id, position, contributions, CASE WHEN position = 1 THEN 'top_result' WHEN s <> score THEN 'fused_score' WHEN b <> best_rank THEN 'best_lane_rank' ELSE 'frame_id' END AS tie_reason FROM l JOIN c USING (query_id, frame_id) WHERE position <= {K}"""


def timeline_range(spark: SparkSession, sf: str) -> DataFrame:
    """The newest 100 live events of a month."""
    return lanes.timeline(event_frames(spark, sf), after=1704067200000, before=1706745600000, limit=100).select("frame_id", "ts_ms", "kind")


_TIMELINE = f"WITH {EVENT_FRAMES} SELECT frame_id, ts_ms, kind FROM event_frames WHERE ts_ms >= 1704067200000 AND ts_ms < 1706745600000 AND status = 'active' AND superseded_by IS NULL ORDER BY ts_ms DESC, frame_id LIMIT 100"


def timeline_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that no text has all words of get recent events instead; places are counted before the filter."""
    asked = questions(spark, sf)
    hits = lanes.bm25(frames(spark, sf), _terms(spark, sf), K, need_all=True)
    newest = event_frames(spark, sf).orderBy(F.desc("ts_ms"), "frame_id").limit(50)  # a bounded candidate list
    placed = newest.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("ts_ms"), "frame_id"))).filter("status = 'active'")
    return fusion.timeline_fallback(hits, asked, placed, limit=K).select("query_id", "frame_id", "score", F.col("place").cast("long").alias("place"))


_FALLBACK = f"""WITH {EVENT_FRAMES}, {_TOKENS}, {_POSTINGS}, {sql_bm25("hits", K, "HAVING count(*) = any_value(nt)")},
 newest AS (SELECT *, row_number() OVER (ORDER BY ts_ms DESC, frame_id) AS place FROM event_frames QUALIFY place <= 50), few AS (SELECT frame_id, place FROM newest WHERE status = 'active' ORDER BY place LIMIT {K})
 SELECT item_id AS query_id, frame_id, round(1.0 / (60 + place), 9) AS score, place FROM benchmark CROSS JOIN few WHERE item_id NOT IN (SELECT query_id FROM hits)"""


def snippet_highlights(spark: SparkSession, sf: str) -> DataFrame:
    """The stretch of the best hit of each question that holds the most of its terms."""
    hits = lanes.bm25(frames(spark, sf), _terms(spark, sf), 1)
    return hits.join(frames(spark, sf).select("frame_id", "content"), "frame_id").join(_terms(spark, sf), "query_id").select("query_id", "frame_id", lanes.snippets(F.col("content"), F.col("terms")).alias("snippet"))


_SNIPPETS = rf"""WITH {_TOKENS}, {_POSTINGS}, {sql_bm25('r', 1)}, t AS (SELECT query_id, frame_id, list_distinct(terms) AS terms, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS tokens
  FROM r JOIN tokens USING (query_id) JOIN documents ON doc_id = frame_id),
 h AS (SELECT *, len(tokens) AS n, list_transform(list_transform(tokens, lambda x: strip_accents(lower(regexp_replace(x, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')))), lambda x: CASE WHEN list_contains(terms, x) THEN x ELSE '' END) AS hits FROM t),
 s AS (SELECT *, list_transform(list_filter(range(1, n + 1), lambda i: hits[i] <> ''), lambda i: least(i, greatest(n - 9, 1))) AS places FROM h),
 b AS (SELECT *, -(list_sort(list_transform(CASE WHEN len(places) > 0 THEN places ELSE [1] END, lambda s: {{'n': len(list_distinct(list_filter(hits[s:s + 9], lambda x: x <> ''))), 's': -s}}))[-1].s) AS start FROM s)
 SELECT query_id, frame_id, CASE WHEN start > 1 THEN '...' ELSE '' END || array_to_string(list_transform(range(start, least(start + 9, n) + 1), lambda i: CASE WHEN hits[i] <> '' THEN '[' || tokens[i] || ']' ELSE tokens[i] END), ' ')
  || CASE WHEN start + 10 <= n THEN '...' ELSE '' END AS snippet FROM b"""


def rerank_head(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search with intent-aware reranking."""
    found = search(frames(spark, sf), vectors(spark, sf), _asked(spark, sf), SearchRequest(top_k=K))
    return found.select("query_id", "frame_id", F.col("position").cast("long").alias("position"), "score")


def recall_context(spark: SparkSession, sf: str) -> DataFrame:
    """Context items of every question within the token budget."""
    return recall(frames(spark, sf), vectors(spark, sf), _asked(spark, sf), SearchRequest(top_k=24)).select("query_id", "item", "kind", "frame_id", "score", F.md5("text").alias("text_md5"), "tokens")


def _found(found: DataFrame) -> DataFrame:
    return found.select("query_id", "frame_id", F.col("position").cast("long").alias("position"), F.round("score", 6).alias("score"), F.array_join("sources", "+").alias("sources"))


def unified_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text alone: frames with all terms, then with any, in the lane's own order and with its scores; live ones only."""
    return _found(unified(memory_frames(spark, sf), None, questions(spark, sf), SearchRequest(mode="text", top_k=K)))


def unified_vector(spark: SparkSession, sf: str) -> DataFrame:
    return _found(unified(memory_frames(spark, sf), vectors(spark, sf), _asked(spark, sf), SearchRequest(mode="vector", top_k=K)))


def unified_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """All lanes, the timeline for questions of a time."""
    return _found(unified(memory_frames(spark, sf), vectors(spark, sf), _asked(spark, sf), SearchRequest(top_k=K)))


def unified_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Questions that nothing survives for get the newest frames instead."""
    return _found(unified(memory_frames(spark, sf), None, questions(spark, sf), SearchRequest(mode="text", top_k=3, min_score=12.0, fallback=3)))


def session_scoped_search(spark: SparkSession, sf: str) -> DataFrame:
    """Results of one session's frames only, cut after ranking."""
    keep = fusion.frame_filter(metadata={"session_id": "2"}, after=100_000, before=900_000_000)
    return _found(unified(memory_frames(spark, sf), vectors(spark, sf), _asked(spark, sf), SearchRequest(top_k=K, keep=keep)))


_LIVE = "m.status = 'active' AND m.superseded_by IS NULL AND m.kind <> 'surrogate'"


def sql_lane(name: str, k: int) -> str:
    """Frames with all terms, then with any: ``name`` (query_id, frame_id, score, rank)."""
    return f"""{sql_bm25(name + 'a', k, 'HAVING count(*) = any_value(nt)')}, {sql_bm25(name + 'b', k)},
 {name}u AS (SELECT query_id, frame_id, score, 0 AS src, rank AS r FROM {name}a UNION ALL SELECT query_id, frame_id, score, 1, rank FROM {name}b b WHERE NOT EXISTS (FROM {name}a a WHERE a.query_id = b.query_id AND a.frame_id = b.frame_id)),
 {name} AS (SELECT * FROM (SELECT query_id, frame_id, score, row_number() OVER (PARTITION BY query_id ORDER BY src, r) AS rank FROM {name}u) WHERE rank <= {k})"""


def sql_cut(lane: str, source: str, k: int, keep: str = "true") -> str:
    return f"""SELECT query_id, l.frame_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position, score, '{source}' AS sources FROM {lane} l JOIN memory_frames m ON m.frame_id = l.frame_id WHERE {_LIVE} AND {keep} QUALIFY position <= {k}"""


def sql_unified(keep: str = "true") -> str:
    return f"""WITH {MEMORY_FRAMES}, {_TOKENS}, {_POSTINGS}, {sql_lane('tl', _MOST)}, {sql_knn('kn', _MOST, _METRIC['cosine'], _ASKED)}, {_KIND},
 newest AS (SELECT frame_id, row_number() OVER (ORDER BY ts_ms DESC, frame_id) AS rank FROM memory_frames m WHERE {_LIVE} QUALIFY rank <= {_MOST}),
 parts AS (SELECT query_id, frame_id, rank, 'text' AS source, 0.5 * wt / (60 + rank) AS part FROM tl JOIN weights USING (query_id)
  UNION ALL SELECT query_id, frame_id, rank, 'vector', 0.5 * wv / (60 + rank) FROM kn JOIN weights USING (query_id)
  UNION ALL SELECT query_id, frame_id, rank, 'timeline', 0.5 / (60 + rank) FROM newest CROSS JOIN kinds WHERE kind = 'temporal'),
 fused AS (SELECT query_id, frame_id, round(sum(part), 9) AS score, min(rank) AS best_rank, string_agg(source, '+' ORDER BY source) AS sources FROM parts GROUP BY 1, 2),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, frame_id) AS place FROM fused QUALIFY place <= {_MOST})
 SELECT query_id, r.frame_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS position, round(score, 6) AS score, sources FROM ranked r JOIN memory_frames m ON m.frame_id = r.frame_id WHERE {_LIVE} AND {keep} QUALIFY position <= {K}"""


_UNIFIED_FALLBACK = f"""WITH {MEMORY_FRAMES}, {_TOKENS}, {_POSTINGS}, {sql_lane('tl', fusion.candidate_limit(3))},
 hits AS ({sql_cut('tl', 'text', 3, 'score >= 12.0')}), newest AS (SELECT frame_id, row_number() OVER (ORDER BY ts_ms DESC, frame_id) AS position FROM memory_frames m WHERE {_LIVE} QUALIFY position <= 3)
 SELECT query_id, frame_id, position, score, sources FROM hits UNION ALL SELECT item_id, frame_id, position, round(1.0 / (60 + position), 6), 'timeline' FROM benchmark CROSS JOIN newest WHERE item_id NOT IN (SELECT query_id FROM hits) AND trim(coalesce(text, '')) <> ''"""


QUERIES = {f.__name__: f for f in (unified_text, unified_vector, unified_hybrid, unified_fallback, session_scoped_search, text_bm25_topk, text_bm25_and, text_indexed_topk, text_boolean, text_near, text_prefix, text_or_fallback_merge, text_phrase, vector_knn_cosine, vector_knn_dot, vector_knn_l2, vector_graph_knn, vector_math, vector_label_recall_at_k, hybrid_rrf, hybrid_post_filter, hybrid_alpha_sweep, hybrid_rrf_diagnostics, timeline_range, timeline_fallback, snippet_highlights, rerank_head, recall_context)}
ORACLES = {
    "text_bm25_topk": f"WITH {_TOKENS}, {_POSTINGS}, {sql_bm25('r', K)} SELECT query_id, frame_id, score, rank FROM r",
    "text_bm25_and": f"WITH {_TOKENS}, {_POSTINGS}, {sql_bm25('r', K, 'HAVING count(*) = any_value(nt)')} SELECT query_id, frame_id, score, rank FROM r",
    "text_indexed_topk": f"WITH {_TOKENS}, {_POSTINGS}, {sql_bm25('r', K)} SELECT query_id, frame_id, score, rank FROM r",
    "snippet_highlights": _SNIPPETS,
    "text_boolean": _BOOLEAN,
    "text_near": _NEAR,
    "text_prefix": _PREFIX,
    "text_or_fallback_merge": f"""WITH {_TOKENS}, {_POSTINGS}, {sql_bm25('a', K, 'HAVING count(*) = any_value(nt)')}, {sql_bm25('b', K)},
 u AS (SELECT query_id, frame_id, score, 0 AS src, rank AS r FROM a UNION ALL SELECT query_id, frame_id, score, 1, rank FROM b WHERE NOT EXISTS (FROM a WHERE a.query_id = b.query_id AND a.frame_id = b.frame_id))
 SELECT query_id, frame_id, score, row_number() OVER (PARTITION BY query_id ORDER BY src, r) AS rank FROM u QUALIFY rank <= {K}""",
    "text_phrase": f"SELECT item_id AS query_id, doc_id AS frame_id FROM benchmark b JOIN documents d ON contains(' ' || array_to_string({sql_words('d.text')}, ' ') || ' ', ' ' || array_to_string({sql_words('b.text')}, ' ') || ' ')",
    **{f"vector_knn_{m}": f"WITH {sql_knn('r', K, s, _EVERY)} SELECT query_id, frame_id, score, rank FROM r" for m, s in _METRIC.items()},
    "unified_text": f"WITH {MEMORY_FRAMES}, {_TOKENS}, {_POSTINGS}, {sql_lane('tl', _MOST)} {sql_cut('tl', 'text', K)}",
    "unified_vector": f"WITH {MEMORY_FRAMES}, {sql_knn('kn', _MOST, _METRIC['cosine'], _ASKED)} {sql_cut('kn', 'vector', K)}",
    "unified_hybrid": sql_unified(),
    "unified_fallback": _UNIFIED_FALLBACK,
    "session_scoped_search": sql_unified("m.session = 2 AND m.ts_ms >= 100000 AND m.ts_ms < 900000000"),
    "vector_math": _MATH,
    "vector_label_recall_at_k": _RECALL,
    "hybrid_rrf": _HYBRID,
    "hybrid_post_filter": _FILTERED,
    "hybrid_alpha_sweep": _sweep(),
    "hybrid_rrf_diagnostics": _DIAGNOSTICS,
    "timeline_range": _TIMELINE,
    "timeline_fallback": _FALLBACK,
}
