"""BM25 of a batch of queries over frames, or over their index by block maxima.  All paths give the same rows.

Gains are rounded to whole numbers of 1 / ``UNIT`` before they are added, so that sums don't depend on their order: frames are
ranked on exact sums, ties go to the smaller id, and only the shown score is rounded.

* *Frames*: each piece of the texts is tokenised once and keeps, for each frame, the numbers of the terms that are asked for.
  Then a block of frames meets all queries at once and passes on k rows for each; no (query, frame) pair is shuffled.
* *Index*: postings lie in blocks of ``BLOCK_FRAMES`` frames of about equal length, and each (term, block) has its largest number of
  occurrences and its shortest length.  They bound what a block can give a query.  The best blocks of a query are opened first;
  their k-th score is a threshold, and of all others only those are opened that can reach it.  An open block meets its queries in one
  group and passes on what reaches their thresholds, k rows for each at most.
* More queries than ``BATCH_TERMS`` terms hold: postings are joined with them.

Statistics cover every frame that is in the index, live or not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import index_words
from recollect.session import bounded, spread, staged
from recollect.sources.index import EVERY, TextIndex, unpacked

# Parameters of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
UNIT = 1 << 40
#: Terms of all queries up to this number go to every task in one piece.
BATCH_TERMS = 200_000
#: (query, frame) pairs of one block.
CELLS = 1 << 20
#: Tokens that a task counts at once.
TOKENS = 1 << 18


def idf_of(n: float, df: float) -> float:
    return max(math.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)


def gain_of(idf, tf, length, mean: float):
    """The part of a score that one term gives, of columns or arrays."""
    return idf * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length / mean))


def idf_column(n: float) -> Column:
    return F.greatest(F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))


def gain_column(mean: float, tf: str = "tf", length: str = "length") -> Column:
    return F.rint(gain_of(F.col("idf"), F.col(tf), F.col(length), F.lit(float(mean))) * UNIT).cast("long")


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """query_id, frame_id, score, rank from query_id, frame_id, raw."""
    rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, frame_id)")
    return scored.select("query_id", "frame_id", "raw", rank.alias("rank")).filter(F.col("rank") <= k).select("query_id", "frame_id", F.round(F.col("raw") / UNIT, 6).alias("score"), "rank")


def matches(frames: DataFrame | TextIndex, queries: DataFrame, k: int, want: tuple[str, ...] = ("any", "all")) -> dict[str, DataFrame]:
    """Results of ``any`` term and of ``all`` terms for queries (query_id, terms)."""
    asked = queries.select("query_id", F.array_distinct("terms").alias("terms")).filter(F.size("terms") > 0)
    if isinstance(frames, TextIndex):
        asked = staged(asked)
        return {w: ranked(by_blocks(frames, asked, k, need_all=w == "all")[0], k) for w in want}
    size = asked.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    if size <= BATCH_TERMS:
        scored = _in_batch(frames, asked.toArrow(), k, want)
    else:
        scored = _joined(postings(frames, asked.select(F.explode("terms").alias("term")).distinct()), asked, want)
    return {w: ranked(scored.filter(F.col("want") == w), k) for w in want}


# ----------------------------------------------------------------- frames
def _in_batch(frames: DataFrame, asked: pa.Table, k: int, want: tuple[str, ...]) -> DataFrame:
    """want, query_id, frame_id, raw: the first k of each piece of the frames, at least."""
    spark = frames.sparkSession
    lists = asked.column("terms").combine_chunks() if asked.num_rows else pa.array([], pa.list_(pa.string()))
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().cast(pa.string())
    vocabulary = pc.unique(flat)
    shared = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for whole in batches:
            for batch in bounded(whole, pc.fill_null(pc.list_value_length(whole.column(1)), 0).to_numpy(zero_copy_only=False), TOKENS):
                tokens = batch.column(1)
                sizes = tokens.value_lengths().to_numpy(zero_copy_only=False)
                code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=terms), -1).to_numpy()
                row = np.repeat(np.arange(batch.num_rows), sizes)[code >= 0]
                key, tf = np.unique(row * max(len(terms), 1) + code[code >= 0], return_counts=True)
                ends = np.searchsorted(key, np.arange(batch.num_rows + 1) * max(len(terms), 1)).astype(np.int32)
                of = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % max(len(terms), 1), tf)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), *of], names=["frame_id", "length", "terms", "tfs"])

    tokens = spread(frames.filter(F.col("content").isNotNull()).select(F.col("frame_id").cast("long").alias("frame_id"), "content")).select("frame_id", index_words(F.col("content")).alias("tokens"))
    counted = staged(tokens.mapInArrow(count, "frame_id long, length int, terms array<int>, tfs array<int>"))
    # One row for each asked term, and one of all frames.
    every = counted.select("length", F.explode(F.concat("terms", F.array(F.lit(-1)))).alias("term"))
    stats = {r.term: r for r in every.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("length").alias("words")).collect()}
    frames_, words = (stats[-1].df, stats[-1].words) if -1 in stats else (0, 0)
    mean = words / frames_ if frames_ and words else 1.0
    idf = np.array([idf_of(frames_, stats[i].df) if i in stats else 0.0 for i in range(len(vocabulary))])
    # Queries of each term, one after the other.
    code = pc.index_in(flat, value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    n_terms = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    by_term = np.argsort(code, kind="stable")
    first = np.searchsorted(code[by_term], np.arange(len(vocabulary) + 1))
    plan = spark.sparkContext.broadcast((np.repeat(np.arange(len(n_terms)), n_terms)[by_term], first, n_terms, idf, asked.column("query_id").combine_chunks()))
    kind = asked.schema.field("query_id").type

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, first, n_terms, idf, ids = plan.value
        step = max(1, CELLS // max(1, len(n_terms)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n, code = part.num_rows, part.column(2).flatten().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(n), part.column(2).value_lengths().to_numpy(zero_copy_only=False))
                gain = np.rint(gain_of(idf[code], part.column(3).flatten().to_numpy().astype(np.float64), part.column(1).to_numpy()[row].astype(np.float64), mean) * UNIT)
                # Each posting meets the queries of its term.
                many = first[code + 1] - first[code]
                of = np.repeat(np.arange(len(code)), many)
                q = query[np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + first[code][of]]
                key = q * n + row[of]
                hits = np.bincount(key, minlength=len(n_terms) * n)
                raw = np.bincount(key, weights=gain[of], minlength=len(hits))  # whole numbers below 2**53: exact
                seen = np.flatnonzero(hits)
                frame = part.column(0).to_numpy()
                for w in want:
                    held = seen if w == "any" else seen[hits[seen] == n_terms[seen // n]]
                    held = held[np.lexsort((frame[held % n], -raw[held], held // n))]
                    begin = np.searchsorted(held // n, held // n)
                    held = held[np.arange(len(held)) - begin < k]
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(w), len(held)), ids.take(pa.array(held // n)), pa.array(frame[held % n]), pa.array(raw[held].astype(np.int64))], names=["want", "query_id", "frame_id", "raw"])

    found = counted.mapInArrow(score, f"want string, query_id {_spark_name(kind)}, frame_id long, raw long")
    return staged(found) if len(want) > 1 else found


def _spark_name(kind: pa.DataType) -> str:
    return "string" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else "int" if pa.types.is_int32(kind) else "long"


def postings(frames: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """term, frame_id, tf, length of frames (frame_id, content); with ``only`` (term), just those terms.

    Each frame has one row more, of the term ``EVERY``, so that their number and mean length need no second pass.
    """
    tokens = spread(frames.filter(F.col("content").isNotNull()).select("frame_id", "content")).select("frame_id", index_words(F.col("content")).alias("tokens"))
    each = tokens.select("frame_id", F.size("tokens").alias("length"), F.explode(F.concat("tokens", F.array(F.lit(EVERY)))).alias("term"))
    if only is not None:
        wanted = only.select("term").unionByName(only.sparkSession.range(1).select(F.lit(EVERY).alias("term")))
        small = only.limit(BATCH_TERMS + 1).count() <= BATCH_TERMS
        each = each.join(F.broadcast(wanted) if small else wanted, "term", "left_semi")
    return each.groupBy("term", "frame_id").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def _joined(found: DataFrame, asked: DataFrame, want: tuple[str, ...]) -> DataFrame:
    """want, query_id, frame_id, raw by joins of postings and queries, both of any size."""
    found = staged(found)
    sizes = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.avg("length").alias("mean"))
    every = sizes.filter(F.col("term") == EVERY).first()
    n, mean = (every.df, every["mean"] or 1.0) if every else (0, 1.0)
    each = asked.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    known = each.join(sizes.select("term", "df"), "term").withColumn("idf", idf_column(n))
    scored = known.join(found, "term").select("query_id", "frame_id", "n_terms", gain_column(mean).alias("gain")).groupBy("query_id", "frame_id").agg(F.sum("gain").alias("raw"), F.count(F.lit(1)).alias("hits"), F.first("n_terms").alias("n_terms"))
    kinds = F.filter(F.array(*map(F.lit, want)), lambda w: (w == "any") | (F.col("hits") == F.col("n_terms")))
    return scored.select(F.explode(kinds).alias("want"), "query_id", "frame_id", "raw")


# ------------------------------------------------------------------ index
def by_blocks(index: TextIndex, asked: DataFrame, k: int, *, need_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """query_id, frame_id, raw of all frames that may be among the first k; and query_id, opened, blocks (numbers of blocks)."""
    each = asked.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    terms = each.select("term").distinct()
    live = index.frames()
    whole = live.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    n, mean = whole.n, whole["mean"] or 1.0
    blocks = staged(index.blocks(terms))
    df = staged(blocks.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0"))
    known = staged(each.join(df, "term").withColumn("idf", idf_column(n)))
    # What a block gives at most: each of its terms as often as in any of its frames, in the shortest of them.
    bound = known.join(blocks.drop("df"), "term").select("query_id", "segment", "block", "n_terms", gain_column(mean, "max_tf", "min_length").alias("most"))
    bound = bound.groupBy("query_id", "segment", "block").agg(F.sum("most").alias("most"), F.count(F.lit(1)).alias("terms"), F.first("n_terms").alias("n_terms"))
    bounds = staged(bound.filter("terms = n_terms") if need_all else bound)
    place = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY most DESC, segment, block)")
    # As many blocks as frames are wanted: where each holds one near its bound, the threshold is close.
    first = staged(bounds.withColumn("place", place).filter(F.col("place") <= k).drop("place"))

    plan = _asked_terms(asked, known) if each.count() <= BATCH_TERMS else None

    def opened(of: DataFrame) -> DataFrame:
        some = of.select("segment", "block").distinct()
        if plan is not None:
            return _in_blocks(index.opened(some, terms), of, plan, mean, k, need_all)
        pairs = of.select("query_id", "segment", "block").join(known, "query_id").join(index.opened_each(some, terms), ["term", "segment", "block"])
        scored = pairs.groupBy("query_id", "frame_id").agg(F.sum(gain_column(mean)).alias("raw"), F.count(F.lit(1)).alias("hits"), F.first("n_terms").alias("n_terms"))
        return (scored.filter("hits = n_terms") if need_all else scored).select("query_id", "frame_id", "raw")

    seen = staged(opened(first.withColumn("least", F.lit(None).cast("long"))))
    last = seen.withColumn("place", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY raw DESC)")).filter(F.col("place") == k).select("query_id", F.col("raw").alias("least"))
    # A block that reaches the k-th score just so may hold a frame of a smaller id.
    rest = staged(bounds.join(first.select("query_id", "segment", "block"), ["query_id", "segment", "block"], "left_anti").join(last, "query_id", "left").filter(F.col("least").isNull() | (F.col("most") >= F.col("least"))))
    all_ = seen.unionByName(opened(rest))
    n_opened = first.select("query_id").unionByName(rest.select("query_id")).groupBy("query_id").agg(F.count(F.lit(1)).alias("opened"))
    return all_, bounds.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks")).join(n_opened, "query_id")


def _asked_terms(asked: DataFrame, known: DataFrame) -> tuple:
    """Queries and the terms that the index has of each, one query after the other; and the terms with their weights."""
    rows = asked.select("query_id", F.size("terms").alias("n_terms")).toArrow().combine_chunks()
    ids, n_terms = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns)
    own = known.select("query_id", "term", "idf").toArrow()
    vocabulary = pc.unique(own.column("term")).cast(pa.string())
    code = pc.index_in(own.column("term").cast(pa.string()), value_set=vocabulary).to_numpy().astype(np.int64)
    idf = np.zeros(len(vocabulary))
    idf[code] = own.column("idf").to_numpy()
    query = pc.index_in(own.column("query_id"), value_set=ids).to_numpy().astype(np.int64)
    order = np.argsort(query, kind="stable")
    return ids, n_terms.to_numpy(zero_copy_only=False), code[order], np.searchsorted(query[order], np.arange(len(ids) + 1)), vocabulary, idf


def _in_blocks(rows: DataFrame, of: DataFrame, plan: tuple, mean: float, k: int, need_all: bool) -> DataFrame:
    """query_id, frame_id, raw: of each block the first k of each query that opens it, if they reach ``least``."""
    shared = rows.sparkSession.sparkContext.broadcast(plan)

    def meet(asked: pa.Table, found: pa.Table) -> pa.Table:
        ids, n_terms, codes, first, vocabulary, idf = shared.value
        schema, parts = pa.schema([("query_id", ids.type), ("frame_id", pa.int64()), ("raw", pa.int64())]), []
        if not asked.num_rows or not found.num_rows:
            return schema.empty_table()
        found = found.combine_chunks()
        entries, size = unpacked(found.column("frames").chunk(0))
        begin = np.cumsum(size) - size
        code = pc.index_in(found.column("term").cast(pa.string()), value_set=vocabulary).to_numpy().astype(np.int64)
        frame, place = np.unique(entries["frame_id"], return_inverse=True)
        gain = np.rint(gain_of(idf[np.repeat(code, size)], entries["tf"].astype(np.float64), entries["length"].astype(np.float64), mean) * UNIT)
        by_code = np.argsort(code)
        query = pc.index_in(asked.column("query_id"), value_set=ids).to_numpy().astype(np.int64)
        least = pc.fill_null(asked.column("least"), -1).to_numpy()
        n, many = len(frame), first[query + 1] - first[query]
        bounds = np.unique(np.concatenate(([0], np.searchsorted(np.cumsum(many) * n, np.arange(CELLS, int(many.sum()) * n + CELLS, CELLS)), [len(query)])))
        for a, b in zip(bounds[:-1], bounds[1:]):
            # Terms of these queries, the block's row of each, and its postings.
            who = np.repeat(np.arange(b - a), many[a:b])
            term = codes[_spans(first[query[a:b]], many[a:b])]
            at = by_code[np.minimum(np.searchsorted(code[by_code], term), len(code) - 1)]
            who, at = who[code[at] == term], at[code[at] == term]
            each = _spans(begin[at], size[at])
            key = np.repeat(who, size[at]) * n + place[each]
            hits = np.bincount(key, minlength=(b - a) * n)
            raw = np.bincount(key, weights=gain[each], minlength=(b - a) * n)  # whole numbers below 2**53: exact
            held = np.flatnonzero(hits)
            of_query = held // n
            held = held[(raw[held] >= least[a:b][of_query]) & (not need_all or hits[held] == n_terms[query[a:b]][of_query])]
            held = held[np.lexsort((held % n, -raw[held], held // n))]  # frames are in order of their ids
            held = held[np.arange(len(held)) - np.searchsorted(held // n, held // n) < k]
            parts.append(pa.RecordBatch.from_arrays([ids.take(pa.array(query[a:b][held // n])), pa.array(frame[held % n]), pa.array(raw[held].astype(np.int64))], schema=schema))
        return pa.Table.from_batches(parts, schema=schema)

    kind = of.schema["query_id"].dataType.simpleString()
    return of.select("query_id", "segment", "block", "least").groupBy("segment", "block").cogroup(rows.groupBy("segment", "block")).applyInArrow(meet, f"query_id {kind}, frame_id long, raw long")


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .. of each span, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
