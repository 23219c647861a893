"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

*Fit.*  A tree of k-means splits (``BRANCH`` children a node) is fitted on the driver on a bounded
sample of ``FIT_SAMPLE`` vectors, chosen by a hash of their ids; leaves hold about ``LEAF_VECTORS``
vectors of the whole table, so their number follows the table up to the sample's bound.
*Index.*  Every vector descends to its leaf (only the tree is broadcast: at most
``FIT_SAMPLE / 4`` leaves).  Neighbouring leaves make a bundle, the unit of a task; a leaf with more
vectors than a bundle is dealt over several, so that one common vector can't fill a task.  A query goes
once to each bundle that holds leaves it visits, and comes back with one list.
*Search.*  For each query a priority queue over tree nodes yields leaves in order of the distance to
their centres.  ``visits`` leaves are searched, and more where these hold too few vectors; the number is calibrated: starting from
``FIRST_VISITS`` it is widened until ``CALIBRATION`` sample queries, searched against *all* vectors
by brute force in blocks, find ``TARGET_RECALL`` of their true neighbours in the leaves visited.

Scores are Euclidean distances of the original vectors in double precision; ties go to the smaller
id.  Vectors that hardly cluster need many leaves: ``Index.share`` is the part of them that calibration chose.

Defined cases: null vectors, zero vectors, vectors with null or non-finite components and
vectors of another length than the most common one take no part; every row of the index has a number, and that is
what makes it one: a repeated row is a candidate of its own and, as a query, has a list of its own, a query skips its own row
alone, not others of its id; null ids take no part; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

BRANCH = 8
FIT_SAMPLE = 32_768
LEAF_VECTORS = 16
#: Rows of one block of a brute-force search.
BLOCK = 2_048
#: Vectors of one bundle: a 256th of the table, within these bounds.
BUNDLE = (1_024, 65_536)
CALIBRATION = 128
FIRST_VISITS = 4
TARGET_RECALL = 0.94
#: Queries that meet one bundle in one task, about.
QUERY_BLOCK = 16_384
K = 10


def usable(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vec (array of double): the vectors that take part."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    plain = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    plain = plain.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))
    size = plain.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return plain.filter(F.size("vec") == (size.n if size else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, up to rounding."""
    return np.maximum((a * a).sum(1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(1)[None, :], 0.0)


class Tree:
    """Centres of all nodes; ``children[i]`` is empty for a leaf, whose number is ``leaf[i]``."""

    def __init__(self, sample: np.ndarray, leaves: int, branch: int = BRANCH, rounds: int = 8, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.centres, self.children, self.leaf, self.leaves = [sample.mean(0)], [[]], [-1], 0
        stop = max(2, len(sample) // max(1, leaves))
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, own = todo.pop()
            points = sample[own]
            if len(own) <= stop or len(np.unique(points, axis=0)) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            distinct = np.unique(points, axis=0)
            k = min(branch, len(distinct), max(2, len(own) // stop))
            centres = distinct[rng.choice(len(distinct), k, replace=False)]
            for _ in range(rounds):
                nearest = squared(points, centres).argmin(1)
                full = np.bincount(nearest, minlength=k) > 0
                centres = np.stack([points[nearest == i].mean(0) if full[i] else centres[i] for i in range(k)])
            nearest = squared(points, centres).argmin(1)
            for i in np.unique(nearest).tolist():
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), own[nearest == i]))
                self.centres.append(centres[i])
                self.children.append([])
                self.leaf.append(-1)
        self.points = np.stack(self.centres)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: down to the nearest child."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            kids = self.children[node]
            if not kids:
                out[own] = self.leaf[node]
                continue
            nearest = squared(x[own], self.points[kids]).argmin(1)
            todo += [(kid, part) for i, kid in enumerate(kids) if len(part := own[nearest == i])]
        return out

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each node's centre."""
        return squared(q, self.points)

    def best_bins(self, distance: list[float], visits: int, sizes: list[int] | None = None, least: int = 0) -> list[int]:
        """The first leaves by best-bin-first, the nearest open node next: ``visits`` of them, and on until they hold ``least`` vectors.

        ``distance`` is that of the query to each node.
        """
        queue, out, held, children, leaf = [(0.0, 0)], [], 0, self.children, self.leaf
        while queue and (len(out) < visits or held < least):
            _, node = heapq.heappop(queue)
            while kids := children[node]:
                near = min(kids, key=distance.__getitem__)
                for kid in kids:
                    if kid != near:
                        heapq.heappush(queue, (distance[kid], kid))
                node = near
            out.append(leaf[node])
            held += sizes[leaf[node]] if sizes else 0
        return out


def nearest(queries: np.ndarray, own: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, rough: np.ndarray | None = None) -> list[tuple[int, list[dict]]]:
    """(query's place, its k nearest among x), the row with its own number left out; exact, ties to the smaller id, then number.

    ``rough``: squared distances up to rounding, infinite where a row isn't to be looked at.
    """
    out = []
    rough = squared(queries, x) if rough is None else rough
    scale = 1e-9 * (1.0 + (x * x).sum(1).max() + (queries * queries).sum(1).max())
    for i, q in enumerate(own.tolist()):
        d = rough[i]
        d[rows == q] = np.inf
        n = min(k, int(np.isfinite(d).sum()))
        if not n:
            continue
        near = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1] + scale)
        exact = np.sqrt(((x[near] - queries[i]) ** 2).sum(1))
        best = np.lexsort((rows[near], ids[near], exact))[:k]
        out.append((i, [{"score": float(exact[j]), "vec_id": int(ids[near[j]]), "row": int(rows[near[j]])} for j in best.tolist()]))
    return out


#: What a block finds for a query: its number, its id, and up to k rows in order.
LISTS = "query long, query_id long, list array<struct<score:double,vec_id:long,row:long>>"
_LIST = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("row", pa.int64())]))


def lists_of(found: list[tuple[int, list[dict]]], own: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
    at = np.array([i for i, _ in found], dtype=np.int64)
    return [pa.array(own[at]), pa.array(ids[at]), pa.array([hits for _, hits in found], _LIST)]


def brute_force(vectors: DataFrame, queries: list[tuple[int, int, list[float]]], k: int) -> DataFrame:
    """A bounded list of queries (number, id, vector) against all vectors (row, vec_id, vec), a block of rows at a time."""
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r for r, _, _ in queries], dtype=np.int64), np.array([q for _, q, _ in queries], dtype=np.int64), np.array([v for _, _, v in queries], dtype=np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, q = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = nearest(q, own, matrix(part.column(2)), part.column(0).to_numpy(), part.column(1).to_numpy(), k)
                yield pa.RecordBatch.from_arrays(lists_of(found, own, ids), names=["query", "query_id", "list"])

    return best(vectors.select("row", "vec_id", "vec").mapInArrow(run, LISTS), k)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query over what the blocks found: merged by sorted lists of bounded length."""
    packed = found.groupBy("query", "query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("list"))), 1, k).alias("list"))
    return packed.select("query", "query_id", F.posexplode("list").alias("at", "hit")).select("query", "query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score", "hit.row")


class Index:
    """Tree, calibrated number of visits and the table (leaf, bundle, row, vec_id, vec); ``row`` is a number that no other row has."""

    def __init__(self, vectors: DataFrame, *, k: int = K, leaf_vectors: int = LEAF_VECTORS, fit_sample: int = FIT_SAMPLE, target: float = TARGET_RECALL):
        self.k, self.spark = k, vectors.sparkSession
        n = vectors.count()
        self.empty = n == 0
        if self.empty:
            self.table, self.measured, self.share = vectors.withColumn("row", F.lit(0).cast("long")), 1.0, 1.0
            return
        share = min(1.0, fit_sample / n)
        drawn = F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))
        drawn_rows = (vectors.filter(drawn) if share < 1 else vectors).limit(2 * fit_sample)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in matrix(batch.column(1))], pa.binary())], names=["vec_id", "raw"])

        sample = sorted((r.vec_id, bytes(r.raw)) for r in drawn_rows.select("vec_id", "vec").mapInArrow(packed, "vec_id long, raw binary").collect())
        points = np.stack([np.frombuffer(v, dtype=np.float64) for _, v in sample]) if sample else np.zeros((1, 1))
        self.tree = Tree(points, leaves=max(1, min(n // leaf_vectors, len(points) // 4)))
        shared = self.spark.sparkContext.broadcast(self.tree)
        self.shared = shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = shared.value.assign(matrix(batch.column(2))) if batch.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", "row", "vec_id", "vec"])

        # The numbers are fixed by being written.
        numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec")
        assigned = staged(numbered.mapInArrow(run, "leaf long, row long, vec_id long, vec array<double>"))
        # As many rows as the tree has leaves; numbered depth first, so that neighbours share a bundle.
        sizes = {r.leaf: r["count"] for r in assigned.groupBy("leaf").count().collect()}
        most = min(max(n // 256, BUNDLE[0]), BUNDLE[1])
        places, bundle, held = [], 0, 0
        for leaf in range(self.tree.leaves):
            count = sizes.get(leaf, 0)
            if held and held + count > most:
                bundle, held = bundle + 1, 0
            blocks = max(1, -(-count // most))
            places.append((leaf, bundle, blocks))
            bundle, held = (bundle + blocks, 0) if blocks > 1 else (bundle, held + count)
        self.places = self.spark.sparkContext.broadcast({leaf: (b, k) for leaf, b, k in places})
        self.sizes = self.spark.sparkContext.broadcast([sizes.get(leaf, 0) for leaf in range(self.tree.leaves)])
        where = self.spark.createDataFrame(places, "leaf long, first long, blocks int")
        self.table = assigned.join(F.broadcast(where), "leaf").withColumn("bundle", F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("first", "blocks")
        self.visits = self.calibrate(assigned, target)
        self.share = self.visits / self.tree.leaves

    def calibrate(self, vectors: DataFrame, target: float) -> int:
        probe = vectors.orderBy(F.xxhash64("row", F.lit(29)), "row").limit(CALIBRATION).collect()
        distance = self.tree.distances(np.array([r.vec for r in probe])).tolist()
        ranked = {r.row: {leaf: i for i, leaf in enumerate(self.tree.best_bins(d, self.tree.leaves))} for r, d in zip(probe, distance, strict=True)}
        visits = min(FIRST_VISITS, self.tree.leaves)
        # The leaf of each true neighbour is asked for once; widening then needs no further job.
        near = brute_force(vectors, [(r.row, r.vec_id, r.vec) for r in probe], self.k).join(vectors.select("row", "leaf"), "row").select("query", "leaf").collect()
        place = [ranked[r.query][r.leaf] for r in near]
        while place and visits < self.tree.leaves and sum(p < visits for p in place) < target * len(place):
            visits = min(self.tree.leaves, visits + max(1, visits // 16))
        self.measured = sum(p < visits for p in place) / len(place) if place else 1.0
        return visits

    def search(self, queries: DataFrame) -> DataFrame:
        """query_id, rank, vec_id, score for queries (vec_id, vec), each row a query; rows of the index (with ``row``) aren't their own neighbours."""
        if not self.empty and "row" not in queries.columns:  # numbers that no row of the index has
            queries = staged(queries.select("vec_id", "vec", (-1 - F.monotonically_increasing_id()).alias("row")))
        if self.empty:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        shared, places, sizes, visits, k, leaf_count = self.shared, self.places, self.sizes, self.visits, self.k, self.tree.leaves

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 128):
                    part = batch.slice(lo, 128)
                    row, bundles, leaves = [], [], []
                    for i, d in enumerate(tree.distances(matrix(part.column(2))).tolist()):
                        wanted: dict[int, list[int]] = {}
                        for leaf in tree.best_bins(d, visits, sizes.value, k + 1):
                            first, blocks = places.value[leaf]
                            for b in range(first, first + blocks):
                                wanted.setdefault(b, []).append(leaf)
                        row += [i] * len(wanted)
                        bundles += wanted
                        leaves += wanted.values()
                    picked = part.take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(bundles, pa.int64()), *picked.columns, pa.array(leaves, pa.list_(pa.int64()))], names=["bundle", "query", "query_id", "q", "leaves"])

        # Many queries go in blocks, each with its own copy of the bundles, so that a task holds a bounded number of either.
        parts = max(1, -(-queries.count() // QUERY_BLOCK))
        part = F.pmod(F.xxhash64("query"), F.lit(parts)).alias("part")
        routed = queries.select("row", "vec_id", "vec").mapInArrow(route, "bundle long, query long, query_id long, q array<double>, leaves array<long>").select("*", part)
        rows = self.table.select("bundle", "leaf", "row", "vec_id", "vec", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))

        def scan(left: pa.Table, right: pa.Table) -> pa.Table:
            parts = []
            if left.num_rows and right.num_rows:
                x, rows, ids, leaf = matrix(right.column("vec")), *(right.column(c).to_numpy() for c in ("row", "vec_id", "leaf"))
                q, own, asked, visited = matrix(left.column("q")), left.column("query").to_numpy(), left.column("query_id").to_numpy(), left.column("leaves").to_pylist()
                step = max(1, (1 << 22) // len(x))
                for at in range(0, len(q), step):
                    rough = squared(q[at : at + step], x)
                    for i, wanted in enumerate(visited[at : at + step]):
                        other = np.ones(leaf_count, dtype=bool)
                        other[wanted] = False
                        rough[i, other[leaf]] = np.inf
                    mine = own[at : at + step]
                    parts.append(pa.RecordBatch.from_arrays(lists_of(nearest(q[at : at + step], mine, x, rows, ids, k, rough), mine, asked[at : at + step]), schema=_HITS))
            return pa.Table.from_batches(parts, schema=_HITS)

        hits = routed.groupBy("bundle", "part").cogroup(rows.groupBy("bundle", "part")).applyInArrow(scan, LISTS)
        return best(hits, k).select("query_id", "rank", "vec_id", "score")


_HITS = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("list", _LIST)])


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the recall that calibration measured against brute force, and the share of leaves that it visits."""
    index = Index(usable(table(spark, sf_dir, "embeddings")))
    found = index.search(index.table.filter(F.col("vec_id") % 100 == 0))
    return found.withColumns({"measured_recall": F.lit(float(index.measured)), "visited_share": F.lit(float(index.share))})
