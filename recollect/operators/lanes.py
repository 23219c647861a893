"""Retrieval lanes: full text (BM25), vectors, timeline.  Every function takes a batch of queries.

Lanes return ``query_id, frame_id, score, rank``; rank is the 1-based position, ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import once, without_marks, words
from recollect.operators.bm25 import EVERY, matches, postings
from recollect.session import staged
from recollect.sources.index import TextIndex

MOST_RESULTS = 10_000
#: Vectors of one block of queries that a task holds.
QUERY_BLOCK = 4_096


def clamped(k: int) -> int:
    return min(max(k, 1), MOST_RESULTS)


def top(df: DataFrame, k: int, *keys: Column) -> DataFrame:
    """The first k rows of each query with their rank (a rank filter that Spark limits before the shuffle)."""
    order = Window.partitionBy("query_id").orderBy(*keys)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# ------------------------------------------------------------------- text
def bm25(frames: DataFrame | TextIndex, queries: DataFrame, k: int, *, need_all: bool = False) -> DataFrame:
    """BM25 of queries (query_id, terms) over frames or their index; ``need_all`` is AND, else any term counts."""
    want = "all" if need_all else "any"
    return matches(frames, queries, clamped(k), (want,))[want]


def text_lane(frames: DataFrame | TextIndex, queries: DataFrame, k: int) -> DataFrame:
    """What full-text search gives: frames with all terms first, then frames with any."""
    found = matches(frames, queries, clamped(k))
    return with_fallback(found["all"], found["any"], k)


def with_fallback(primary: DataFrame, fallback: DataFrame, k: int) -> DataFrame:
    """Primary hits, then fallback hits that aren't among them, each in its own order; ranks go on."""
    both = primary.withColumn("source", F.lit(0)).unionByName(fallback.withColumn("source", F.lit(1)))
    first = both.groupBy("query_id", "frame_id").agg(F.min(F.struct("source", "rank", "score")).alias("at")).select("query_id", "frame_id", "at.*").withColumnRenamed("rank", "own_rank")
    return top(first, clamped(k), F.asc("source"), F.asc("own_rank")).select("query_id", "frame_id", "score", "rank")


def phrase_hits(frames: DataFrame, phrases: DataFrame) -> DataFrame:
    """query_id, frame_id of frames that hold a phrase (query_id, phrase: its words joined by spaces) as adjacent words.

    Frames are first narrowed, by number alone, to those with the phrase's rarest word; only theirs texts are compared.
    """
    asked = phrases.filter(F.col("phrase") != "").select("query_id", "phrase", F.array_distinct(F.split(without_marks(F.col("phrase")), " ")).alias("terms"))
    each = asked.select("query_id", F.explode("terms").alias("term"))
    found = staged(postings(frames, each.select("term").distinct()).filter(F.col("term") != EVERY).select("term", "frame_id"))
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = each.join(df, "term", "left").groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("at")).select("query_id", "at.term")
    near = rarest.join(found, "term").select("query_id", "frame_id").join(asked.select("query_id", "phrase"), "query_id")
    texts = frames.select("frame_id", "content")
    held = texts.join(near, "frame_id").withColumn("line", F.array_join(words(F.col("content")), " "))
    inside = F.concat(F.lit(" "), F.col("line"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    return held.filter(inside).select("query_id", "frame_id").distinct()


def snippets(texts: Column, terms: Column, width: int = 10) -> Column:
    """The ``width`` words that hold the most different terms (the first such stretch), hits in brackets, ``...`` where text is left out.

    A stretch begins at a hit, or earlier where the text ends before it is full; without hits it is the first one.
    """
    def hits_of(tokens: Column) -> Column:
        clean = F.transform(tokens, lambda t: without_marks(F.lower(F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))))
        return F.transform(clean, lambda t: F.when(F.array_contains(terms, t), t).otherwise(""))

    def start_of(hits: Column) -> Column:
        last = F.greatest(F.size(hits) - width + 1, F.lit(1))
        places = F.array_distinct(F.filter(F.transform(hits, lambda t, i: F.when(t != "", F.least(i + 1, last))), lambda i: i.isNotNull()))
        covered = F.transform(places, lambda s: F.struct(F.size(F.array_distinct(F.filter(F.slice(hits, s, width), lambda t: t != ""))).alias("n"), (-s).alias("s")))
        return F.coalesce(-F.array_max(covered)["s"], F.lit(1))

    def shown(tokens: Column, hits: Column, start: Column) -> Column:
        marked = F.zip_with(F.slice(tokens, start, width), F.slice(hits, start, width), lambda t, h: F.when(h != "", F.concat(F.lit("["), t, F.lit("]"))).otherwise(t))
        return F.concat(F.when(start > 1, "...").otherwise(""), F.array_join(marked, " "), F.when(start + width <= F.size(tokens), "...").otherwise(""))

    tokens = F.filter(F.split(texts, r"[ \t\n\x0B\f\r]+"), lambda t: t != "")
    return once(tokens, lambda t: once(hits_of(t), lambda h: once(start_of(h), lambda s: shown(t, h, s))))


# ---------------------------------------------------------------- vectors
METRICS = ("cosine", "dot", "l2")


def knn(vectors: DataFrame, queries: DataFrame, k: int, *, metric: str = "cosine") -> DataFrame:
    """Exact nearest vectors (frame_id, embedding) of a batch of queries (query_id, embedding).

    Scores: cosine similarity, the inner product, or the negative squared distance; other than finite is 0.
    Vectors of another length than a query's aren't its candidates.  Up to ``QUERY_BLOCK`` queries are sent to
    every task, which multiplies a block of rows with them and passes on at most k rows for each, before
    anything is shuffled.  More queries are dealt into blocks, each of which meets every share of the vectors
    in a task of its own.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    k = clamped(k)
    plain = vectors.filter(F.col("embedding").isNotNull()).select(F.col("frame_id").cast("long").alias("frame_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    asked = queries.filter(F.col("embedding").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    n = asked.count()
    out = "query_id long, frame_id long, score double"
    if n <= QUERY_BLOCK:
        shared = vectors.sparkSession.sparkContext.broadcast(_by_length(asked.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROW_BLOCK):
                    yield from _nearest(shared.value, _by_length(pa.Table.from_batches([batch.slice(at, ROW_BLOCK)])), k, metric)

        found = plain.mapInArrow(run, out)
    else:
        # A share is a bounded number of rows: a task holds one share and one block, however many there are.
        shares = max(1, -(-plain.count() // SHARE_ROWS))
        blocks = -(-n // QUERY_BLOCK)

        def every(count: int):
            return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

        left = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("share", every(shares))
        right = plain.withColumn("share", F.pmod(F.xxhash64("frame_id"), F.lit(shares))).withColumn("block", every(blocks))

        def meet(q: pa.Table, x: pa.Table) -> pa.Table:
            asked_, parts = _by_length(q.select(["query_id", "embedding"])), []
            for at in range(0, x.num_rows, ROW_BLOCK):
                parts += _nearest(asked_, _by_length(x.select(["frame_id", "embedding"]).slice(at, ROW_BLOCK)), k, metric)
            return pa.Table.from_batches(parts, schema=_HITS)

        found = left.groupBy("block", "share").cogroup(right.groupBy("block", "share")).applyInArrow(meet, out)
    return top(found, k, F.desc("score"), F.asc("frame_id")).withColumn("score", F.round("score", 6) + F.lit(0.0))


#: Rows that meet the queries at once, products of both that a task holds at once, rows of a share.
ROW_BLOCK, CELLS, SHARE_ROWS = 4_096, 1 << 20, 65_536
_HITS = pa.schema([("query_id", pa.int64()), ("frame_id", pa.int64()), ("score", pa.float64())])


def _by_length(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the rows (id, vector) of each length; vectors with a null component are left out."""
    ids, lists = rows.column(0).to_numpy(), rows.column(1).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int64)
    out = {}
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        part = lists if len(own) == len(lists) else lists.take(pa.array(own))
        if n and not part.flatten().null_count:
            out[n] = (ids[own], part.flatten().to_numpy(zero_copy_only=False).reshape(len(own), n))
        elif n:
            good = np.array([None not in v for v in part.to_pylist()])
            out[n] = (ids[own][good], np.array([v for v in part.to_pylist() if None not in v], dtype=np.float64).reshape(-1, n))
    return out


def _nearest(queries: dict, rows: dict, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """The k best of a block of rows for each query, in batches of as many queries as ``CELLS`` allows.

    A product of matrices, whose last digits depend on a row's place, tells the candidates; their scores are then taken one by one, so that
    equal vectors have equal scores, and ranked unrounded.
    """
    for n in queries.keys() & rows.keys():
        (ids, q), (frame, x) = queries[n], rows[n]
        length = np.sqrt((x * x).sum(1))
        step = max(1, CELLS // max(1, len(frame)))
        for first in range(0, len(ids), step):
            yield _best(ids[first : first + step], q[first : first + step], frame, x, length, k, metric)


def _best(ids: np.ndarray, q: np.ndarray, frame: np.ndarray, x: np.ndarray, length: np.ndarray, k: int, metric: str) -> pa.RecordBatch:
    own = np.sqrt((q * q).sum(1))
    rough = q @ x.T
    if metric == "cosine":
        both = own[:, None] * length[None]
        rough = np.divide(rough, both, out=np.zeros_like(rough), where=both > 0)
    elif metric == "l2":
        rough = -((own * own)[:, None] - 2 * rough + (length * length)[None])
    rough = np.where(np.isfinite(rough), rough, 0.0)
    # What rounding may move a product by, from the lengths alone, so that it doesn't depend on what meets in a block.
    longest = float(np.nanmax(length, initial=0.0))
    scale = {"cosine": np.zeros(len(own)), "dot": own * longest, "l2": own * own + longest * longest}[metric]
    slack = 1e-9 * (1.0 + np.where(np.isfinite(scale), scale, np.inf))
    at, scores = [], []
    for i, one in enumerate(rough):
        near = np.arange(len(one)) if len(one) <= k else np.flatnonzero(one >= -np.partition(-one, k - 1)[k - 1] - slack[i])
        exact = _scores(q[i], x[near], own[i], length[near], metric)
        best = np.lexsort((frame[near], -exact))[:k]
        at.append(near[best])
        scores.append(exact[best])
    who = np.repeat(np.arange(len(ids)), [len(b) for b in at])
    return pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(frame[np.concatenate(at)]), pa.array(np.concatenate(scores))] if at else [pa.array([], f.type) for f in _HITS], schema=_HITS)


def _scores(q: np.ndarray, x: np.ndarray, own: float, length: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        s = -((x - q) ** 2).sum(1)
    else:
        s = (x * q).sum(1)
        s = np.divide(s, own * length, out=np.zeros_like(s), where=own * length > 0) if metric == "cosine" else s
    return np.where(np.isfinite(s), s, 0.0)


# --------------------------------------------------------------- timeline
def timeline(frames: DataFrame, *, after: int | None = None, before: int | None = None, limit: int = 100, newest: bool = True, include_deleted: bool = False, include_superseded: bool = False) -> DataFrame:
    """Frames with ``after <= ts_ms < before``, in order of time, then id."""
    if limit <= 0:
        return frames.limit(0)
    if after is not None:
        frames = frames.filter(F.col("ts_ms") >= after)
    if before is not None:
        frames = frames.filter(F.col("ts_ms") < before)
    if not include_deleted:
        frames = frames.filter("status = 'active'")
    if not include_superseded:
        frames = frames.filter("superseded_by IS NULL")
    return frames.orderBy(F.desc("ts_ms") if newest else F.asc("ts_ms"), "frame_id").limit(limit)
