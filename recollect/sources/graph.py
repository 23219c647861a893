"""Approximate nearest vectors by proximity graphs: one graph for each shard of an index's vectors.

*Build.*  Vectors are dealt into shards of about ``SHARD_VECTORS``; in each, NN-descent finds every vector's near ones: starting from random
neighbours, the neighbours of neighbours (both ways) are compared until few lists change.  The graph that is kept joins each vector with
these, those that name it, and a few random ones, so that no part is cut off.

*Search.*  A block of queries meets each shard; all queries of a block walk together.  Each keeps a beam of the nearest vectors seen,
and expands the nearest one that it hasn't expanded, until none is left in the beam.  Lists of all shards are merged.  Scores are those of the exact lane.

*Calibration.*  The beam is widened until ``PROBES`` vectors of the index, searched exactly as well, find ``TARGET`` of their true neighbours.
What it measured and the share of distances that the search took are in the result of :meth:`VectorGraph.search`.

Defined cases: null vectors, and those with null or non-finite components, aren't in the graph; neither are vectors of another length than
the most common one (an index has one length); zero vectors have a cosine of 0; fewer vectors than k give all; an empty index finds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.session import staged

SHARD_VECTORS = 20_000
#: Near neighbours of a vector, those of them that take part in a round, and random ones.
DEGREE, SAMPLE, FAR = 16, 6, 4
ROUNDS, STILL = 12, 0.002
#: Vectors where every walk of a shard begins: the root of their number, this many at least.
ENTRIES = 16
PROBES, TARGET = 64, 0.96
FIRST_BEAM, MOST_BEAM = 16, 1_024
#: Queries of one block, which meets a copy of each shard; those of them that walk at once; tasks that groups are dealt over, at most.
QUERY_BLOCK, WALKERS, MOST_TASKS = 4_096, 1_024, 4_096
METRICS = ("cosine", "dot", "l2")


def scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of each q[i] to each x[i, j]; the larger, the nearer."""
    if metric == "l2":
        return -((x - q[:, None]) ** 2).sum(-1)
    s = np.einsum("ijk,ik->ij", x, q)
    if metric == "cosine":
        both = np.sqrt((q * q).sum(-1))[:, None] * np.sqrt((x * x).sum(-1))
        s = np.divide(s, both, out=np.zeros_like(s), where=both > 0)
    return s


def prepared(x: np.ndarray, metric: str) -> tuple[np.ndarray, str]:
    """Vectors and metric that graphs are made and walked by: of unit length and half the size for the cosine, whose lengths are then taken once."""
    if metric != "cosine":
        return x, metric
    length = np.sqrt((x * x).sum(-1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0).astype(np.float32), "dot"


def _kept(ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct ids of each row, best first, and where they stood."""
    order = np.lexsort((-s, ids), axis=1)
    sorted_ids = np.take_along_axis(ids, order, 1)
    again = np.zeros_like(sorted_ids, dtype=bool)
    again[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
    score = np.where(again, -np.inf, np.take_along_axis(s, order, 1))
    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
    at = np.take_along_axis(order, best, 1)
    return np.take_along_axis(ids, at, 1), np.take_along_axis(score, best, 1), at


def near_lists(x: np.ndarray, degree: int, metric: str, seed: int = 3) -> np.ndarray:
    """NN-descent: about the ``degree`` nearest of each vector."""
    x, metric = prepared(x, metric)
    n, rng = len(x), np.random.default_rng(seed)
    degree = min(degree, n - 1)
    step = max(1, (1 << 22) // max(1, (2 * SAMPLE) ** 2 * x.shape[1]))
    # Random others: never the vector itself.
    near = (np.arange(n)[:, None] + rng.integers(1, n, (n, degree))) % n
    own = np.concatenate([scores(x[i : i + step], x[near[i : i + step]], metric) for i in range(0, n, step)])
    near, own, _ = _kept(near, own, degree)
    for _ in range(ROUNDS):
        part = np.take_along_axis(near, rng.random(near.shape).argsort(1)[:, :SAMPLE], 1)
        # Who names a vector: as many of them as of its own.
        source, target = np.repeat(np.arange(n), part.shape[1]), part.ravel()
        order = np.lexsort((rng.random(len(target)), target))
        first = np.searchsorted(target[order], np.arange(n))
        place = np.arange(len(target)) - first[target[order]]
        back = np.repeat(np.arange(n)[:, None], SAMPLE, 1)
        few = place < SAMPLE
        back[target[order][few], place[few]] = source[order][few]
        both = np.concatenate((part, back), axis=1)
        changed = 0
        for i in range(0, n, step):
            rows = np.arange(i, min(n, i + step))
            wide = both[both[rows]].reshape(len(rows), -1)
            s = np.where(wide == rows[:, None], -np.inf, scores(x[rows], x[wide], metric))
            ids, best, at = _kept(np.concatenate((near[rows], wide), 1), np.concatenate((own[rows], s), 1), degree)
            changed += int((at >= near.shape[1]).sum())
            near[rows], own[rows] = ids, best
        if changed <= STILL * n * degree:
            break
    return near


def graph_of(x: np.ndarray, metric: str, degree: int = DEGREE) -> np.ndarray:
    """Edges of each vector, both ways and some far ones; -1 where it has fewer than the widest."""
    n = len(x)
    if n == 1:
        return np.full((1, 1), -1)
    near = near_lists(x, degree, metric)
    rng = np.random.default_rng(7)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    order = np.lexsort((rng.random(len(b)), b))
    place = np.arange(len(b)) - np.searchsorted(b[order], np.arange(n))[b[order]]
    back = np.full((n, degree), -1)
    few = place < degree
    back[b[order][few], place[few]] = a[order][few]
    far = (np.arange(n)[:, None] + rng.integers(1, n, (n, min(FAR, n - 1)))) % n
    # Each edge once, or a walk would count a vector twice.
    edges = np.sort(np.concatenate((near, back, far), axis=1), axis=1)
    edges[:, 1:][edges[:, 1:] == edges[:, :-1]] = -1
    return edges


def walk(q: np.ndarray, x: np.ndarray, edges: np.ndarray, beam: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors and scores in the beams of all queries at the end (-1: none), and the number of distances that each took."""
    exact, asked, of = x, q, metric
    (x, metric), (q, _) = prepared(x, metric), prepared(q, metric)
    n, many = len(x), len(q)
    seen = np.zeros((many, n), dtype=bool)
    start = np.unique(np.linspace(0, n - 1, min(n, max(ENTRIES, int(n**0.5)))).astype(np.int64))
    ids = np.repeat(start[None], many, 0)
    s = scores(q, x[ids], metric)
    seen[:, start] = True
    taken = np.full(many, len(start))
    width = max(beam, 1)
    ids, s, _ = _kept(ids, s, width)
    ids = np.pad(ids, ((0, 0), (0, width - ids.shape[1])), constant_values=-1)
    s = np.pad(s, ((0, 0), (0, width - s.shape[1])), constant_values=-np.inf)
    done = ids < 0
    while True:
        who = np.flatnonzero(~done.all(1))
        if not len(who):
            break
        at = (~done[who]).argmax(1)  # beams are sorted: the nearest that isn't expanded
        done[who, at] = True
        near = edges[ids[who, at]]
        fresh = (near >= 0) & ~seen[who[:, None], np.maximum(near, 0)]
        seen[who[:, None], np.where(fresh, near, ids[who, at][:, None])] = True
        taken[who] += fresh.sum(1)
        found = np.where(fresh, scores(q[who], x[np.maximum(near, 0)], metric), -np.inf)
        every, score = np.concatenate((ids[who], np.where(fresh, near, -1)), 1), np.concatenate((s[who], found), 1)
        order = np.argsort(-score, axis=1, kind="stable")[:, :width]
        ids[who], s[who] = np.take_along_axis(every, order, 1), np.take_along_axis(score, order, 1)
        old = np.concatenate((done[who], np.zeros_like(fresh)), 1)
        done[who] = np.take_along_axis(old, order, 1) | (ids[who] < 0)
    if exact is not x:
        s = s.astype(np.float64)
        step = max(1, (1 << 22) // (width * exact.shape[1]))
        for i in range(0, many, step):
            s[i : i + step] = np.where(ids[i : i + step] >= 0, scores(asked[i : i + step], exact[np.maximum(ids[i : i + step], 0)], of), -np.inf)
    return ids, s, taken


_NODES = "shard long, frame_id long, embedding array<double>, edges array<int>"
_FOUND = "query_id long, frame_id long, score double, taken long"


class VectorGraph:
    """Graphs of vectors (frame_id, embedding); ``beam`` is calibrated."""

    def __init__(self, vectors: DataFrame, *, k: int = 10, metric: str = "cosine", shard_vectors: int = SHARD_VECTORS, target: float = TARGET):
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {METRICS}")
        self.k, self.metric, self.spark = k, metric, vectors.sparkSession
        plain = vectors.select(F.col("frame_id").cast("long").alias("frame_id"), F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
        plain = staged(plain.filter(F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))))
        size = plain.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
        self.dimensions, self.n = (size.n, size["count"]) if size else (0, 0)
        self.measured, self.beam = 1.0, FIRST_BEAM
        plain = plain.filter(F.size("embedding") == self.dimensions)
        self.shards = max(1, -(-self.n // shard_vectors))

        def build(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("frame_id")
            edges = graph_of(_matrix(rows.column("embedding")), metric).astype(np.int32)
            ends = pa.array(np.arange(0, edges.size + 1, edges.shape[1], dtype=np.int32))
            return pa.table({"shard": rows.column("shard"), "frame_id": rows.column("frame_id"), "embedding": rows.column("embedding"), "edges": pa.ListArray.from_arrays(ends, pa.array(edges.ravel()))})

        # A shard by a hash of the row: rows of one id don't fill one.
        dealt = plain.select(F.pmod(F.xxhash64("frame_id", "embedding"), F.lit(self.shards)).alias("shard"), "frame_id", "embedding")
        # The rows are few and each is long work: adaptive execution would leave the shards to few tasks.
        self.nodes = staged(dealt.repartition(_tasks(self.shards), "shard").groupBy("shard").applyInArrow(build, _NODES)) if self.n else dealt
        if self.n:
            self.calibrate(target)

    def calibrate(self, target: float) -> None:
        """Widen the beam until probes find enough of their true neighbours."""
        from recollect.operators.lanes import knn

        probes = self.nodes.orderBy(F.xxhash64("frame_id", F.lit(11)), "frame_id").limit(PROBES).select(F.monotonically_increasing_id().alias("query_id"), "embedding")
        probes = staged(probes)
        want = {(r.query_id, r.frame_id) for r in knn(self.nodes.select("frame_id", "embedding"), probes, self.k, metric=self.metric).collect()}
        while True:
            got = {(r.query_id, r.frame_id) for r in self._found(probes).collect()}
            self.measured = len(got & want) / max(1, len(want))
            if self.measured >= target or self.beam >= min(MOST_BEAM, self.n):
                return
            self.beam += self.beam // 2

    def _found(self, queries: DataFrame) -> DataFrame:
        k, metric, beam, shards = self.k, self.metric, max(self.beam, self.k), self.shards
        asked = queries.filter(F.size("embedding") == self.dimensions).select("query_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"))
        blocks = max(1, -(-asked.count() // QUERY_BLOCK))

        def every(n: int):
            return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

        left = asked.select("query_id", "embedding", F.pmod(F.xxhash64("query_id", "embedding"), F.lit(blocks)).alias("block"), every(shards).alias("shard"))
        right = self.nodes.select("shard", "frame_id", "embedding", "edges", every(blocks).alias("block"))

        def meet(q: pa.Table, rows: pa.Table) -> pa.Table:
            schema = pa.schema([("query_id", pa.int64()), ("frame_id", pa.int64()), ("score", pa.float64()), ("taken", pa.int64())])
            if not q.num_rows or not rows.num_rows:
                return schema.empty_table()
            rows = rows.sort_by("frame_id")
            x, frame, edges = _matrix(rows.column("embedding")), rows.column("frame_id").to_numpy(), _matrix(rows.column("edges"))
            asked_ = _matrix(q.column("embedding"))
            parts = [walk(asked_[i : i + WALKERS], x, edges, min(beam, len(x)), metric) for i in range(0, len(asked_), WALKERS)]
            ids, s, taken = (np.concatenate(c) for c in zip(*parts))
            who = np.repeat(np.arange(q.num_rows), ids.shape[1])
            at, s = ids.ravel(), s.ravel()
            order = np.lexsort((frame[np.maximum(at, 0)], -s, who))
            who, at, s = who[order], at[order], s[order]
            few = (at >= 0) & (np.arange(len(who)) - np.searchsorted(who, who) < k)
            return pa.table([q.column("query_id").combine_chunks().take(pa.array(who[few])), pa.array(frame[at[few]]), pa.array(np.where(np.isfinite(s[few]), s[few], 0.0)), pa.array(taken[who[few]])], schema=schema)

        tasks = _tasks(blocks * shards)
        left, right = (side.repartition(tasks, "block", "shard") for side in (left, right))
        hits = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(meet, _FOUND)
        rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id)")
        return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "frame_id", F.round("score", 6).alias("score"), "rank", "taken")

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, frame_id, score, rank, taken (distances in the shard that found the row), measured_recall, beam of queries (query_id, embedding)."""
        if not self.n:
            return self.spark.createDataFrame([], "query_id long, frame_id long, score double, rank int, taken long, measured_recall double, beam int")
        return self._found(queries).withColumns({"measured_recall": F.lit(float(self.measured)), "beam": F.lit(int(self.beam))})


def _tasks(groups: int) -> int:
    """Tasks for groups that are dealt by hash: few of them get several."""
    return min(MOST_TASKS, 1 if groups == 1 else 4 * groups)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
