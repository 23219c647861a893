"""N-gram Jaccard join with signature trees.

A document's set is that of its distinct word shingles.  Two documents link when
``100 * |A & B| >= threshold * |A | B|``; the result gives each document its link component.

1. Documents with equal sets are one class; its smallest id stands for it.
2. Prefix filter: all sets are ordered the same way (shingles that are frequent somewhere last, then by
   hash), and linked sets share a shingle among the first ``n - ceil(threshold * n) + 1``.  Only these
   postings are moved, packed by shards of the hash space, and only shingles that two classes share
   go on.
3. Star round: within a shingle's group each document is held against one leader, the document that
   shares most of its prefix with others.  Each document's best leader is verified, which turns a
   large group of near copies into a star instead of all its pairs.
4. Signature trees: what the star round has not joined is searched exactly.  Every group becomes a
   tree over its documents, alike ones side by side, whose nodes hold OR- and AND-combined token bitmaps
   and a size range; a dual traversal drops pairs of nodes that lie in one component, whose sizes can't
   match, or whose largest possible overlap is too small.  Pairs that are left are verified on the texts.
   A group of more than ``BLOCK`` documents is cut into blocks, and each pair of blocks whose sizes may
   match is a task's unit of its own, so that a shingle that many documents have doesn't fill one task.

Every pair that the prefix filter admits is either in one component already or reaches step 4, so no
link is lost; there is no cap on groups, partners or candidates.  The driver holds counts and the
frequent shingles (at most ``mean set size / HOT_SHARE`` of them).

Defined cases: null or empty texts, and texts without words, have empty sets and link with nothing;
texts with fewer words than a shingle have their whole sequence as the one element; repeated rows and
equal sets are in one component; rows with a null id take no part in choosing it; rows that share an id
are one document with the links of all its texts; an empty table gives an empty result; further columns
are ignored.  :func:`keep_one_of_each` leaves one row of each component, nulls and repeats in the ids
notwithstanding, and all rows with empty sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, documents_of, give_back, lean, mix, numbered_rows, pack_sorted, run_hashes, staged, table, text_buffer, unpack_sorted, without_rows, word_bounds, word_hashes

SHINGLE, THRESHOLD = 5, 80
#: A shingle is frequent when this share of the documents has it.
HOT_SHARE = 0.001
HOT_LIMIT = 1_000_000
#: Postings of a shard, about.
SHARD_POSTINGS = 1 << 19
#: Pairs up to this number (24 bytes each) are broadcast for the lookup of their texts.
BROADCAST_PAIRS = 300_000
#: Documents of a leaf (up to four times as many where bitmaps are small), and nodes of a parent.
LEAF, FAN = 16, 8
#: Documents of a group that one task compares; larger groups are cut.
BLOCK = 4_096
BITS_PER_TOKEN = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ------------------------------------------------------------------- sets
def shingle_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; A-Z in lower case."""
    data, offsets = text_buffer(column)
    data = _LOWER[data]
    start, end = word_bounds(data, offsets)
    words = word_hashes(data, start, end)
    first = np.searchsorted(start, offsets)
    n = np.diff(first)
    length = np.minimum(n, shingle)
    count = np.where(n > 0, n - length + 1, 0)
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(count)))
    at = np.arange(total[-1]) - np.repeat(total[:-1] - first[:-1], count)
    hashes = run_hashes(words, at, np.repeat(length, count))
    return [np.unique(hashes[a:b]) for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]


def least_overlap(a, b, threshold: int):
    """Smallest intersection of two linked sets with a and b elements."""
    return -(-threshold * (a + b) // (100 + threshold))


def prefix_length(n: int, threshold: int) -> int:
    return n - -(-threshold * n // 100) + 1


def bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each token, by its lowest bits; ``BITS_PER_TOKEN`` times the set's size or up to twice that, 64 at least.

    At a load of an eighth to a quarter, the tokens that a set lacks show nearly all, so that little but
    links outlives the trees.  Such bitmaps compress by a quarter to nearly a half, and every group that a
    document is in gets its own copy.
    """
    bits = max(64, 1 << (BITS_PER_TOKEN * len(tokens) - 1).bit_length()) if len(tokens) else 64
    flags = np.zeros(bits, dtype=bool)
    flags[(tokens & U64(bits - 1)).astype(np.int64)] = True
    raw = np.packbits(flags, bitorder="little").tobytes()
    small = pa.compress(raw, codec="zstd", asbytes=True) if len(raw) > 64 else raw
    return bytes([len(raw).bit_length()]) + small if len(small) < len(raw) else b"\0" + raw


def bitmap_words(blob: bytes) -> np.ndarray:
    """A bitmap as 64-bit words; its first byte tells the size of a compressed one."""
    raw = blob[1:] if not blob[0] else pa.decompress(blob[1:], decompressed_size=1 << (blob[0] - 1), codec="zstd", asbytes=True)
    return np.frombuffer(raw, "<u8")


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A bitmap (64-bit words) reduced to a smaller power of two of words."""
    return np.bitwise_or.reduce(words.reshape(-1, size), axis=0) if len(words) > size else words


# ------------------------------------------------------- classes, frequent
def profile(docs: DataFrame, shingle: int) -> DataFrame:
    """kind 0: doc_id, n, digest and bitmap of each document; kind 1: shingles frequent in a part, with their count there.

    A shingle that a share of all documents has, has that share in some part, so none is missed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def frequent() -> pa.RecordBatch:
            docs = len(held)
            tokens = np.concatenate(held) if held else np.zeros(0, U64)
            held.clear()
            tokens.sort()
            first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(tokens)))
            many = times >= max(4, HOT_SHARE * docs)
            n = int(many.sum())
            return rows(1, [None] * n, times[many], tokens[first[many]].view(np.int64), [0] * n, [None] * n)

        def rows(kind, ids, n, d0, d1, bits) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), pa.array(bits, pa.binary())], names=["kind", "doc_id", "n", "d0", "d1", "bits"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = shingle_sets(part.column(1), shingle)
                digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), "<i8").reshape(-1, 2)
                yield rows(0, part.column(0).to_pylist(), [len(s) for s in sets], digests[:, 0], digests[:, 1], [bitmap(s) for s in sets])
                held += sets
                size += sum(map(len, sets))
                if size > 4_000_000:
                    yield frequent()
                    size = 0
        yield frequent()

    return docs.mapInArrow(lean(run), "kind int, doc_id long, n long, d0 long, d1 long, bits binary")


# --------------------------------------------------------------- postings
def postings(docs: DataFrame, shingle: int, threshold: int, hot: np.ndarray, shard_bits: int) -> DataFrame:
    """Prefix postings, packed by shard: shard, tokens (sorted), rest (doc_id, n, digest of each)."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_ = shared.value
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            tokens, ids, sizes, digest = [], [], [], []
            seen = set()
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for doc, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), shingle), strict=True):
                    n = len(s)
                    if not n:
                        continue
                    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()[:8]
                    if (doc, d) in seen:
                        continue
                    seen.add((doc, d))
                    need = prefix_length(n, threshold)
                    if len(hot_):
                        common = hot_[np.minimum(np.searchsorted(hot_, s), len(hot_) - 1)] == s
                        s = np.concatenate((s[~common], s[common])) if common.any() else s
                    tokens.append(s[:need])
                    ids.append(np.full(need, doc, dtype=np.int64))
                    sizes.append(np.full(need, n, dtype=np.int64))
                    digest.append(np.full(need, int.from_bytes(d, "little", signed=True), dtype=np.int64))
            if not tokens:
                continue
            t = mix(np.concatenate(tokens))  # a prefix holds the smallest hashes; mixed again, they fill all shards alike
            order = np.argsort(t, kind="stable")
            t = t[order]
            rest = np.stack([np.concatenate(x)[order] for x in (ids, sizes, digest)])
            edges = np.arange(1, 1 << shard_bits, dtype=np.uint64) << U64(64 - shard_bits) if shard_bits else np.zeros(0, U64)
            cut = np.concatenate(([0], np.searchsorted(t, edges), [len(t)]))
            filled = np.flatnonzero(np.diff(cut)).tolist()
            packed = [pa.compress(np.ascontiguousarray(rest[:, cut[s] : cut[s + 1]]).tobytes(), codec="zstd", asbytes=True) for s in filled]
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array([pack_sorted(t[cut[s] : cut[s + 1]]) for s in filled], pa.binary()), pa.array(packed, pa.binary())], names=["shard", "tokens", "rest"])

    return docs.mapInArrow(lean(run), "shard long, tokens binary, rest binary")


#: tag: 31 bits of the set's digest; with the size they tell the texts of one id apart.
SHARED = "shard long, token long, doc long, n long, tag int, g0 long, g1 long"
TAG_BITS = (1 << 31) - 1


def shared_postings(threshold: int):
    """Of a shard, the postings of shingles that at least two classes of matching sizes have; one for each class."""
    return lambda group: _shared_postings(group, threshold)


def _shared_postings(group: pa.Table, threshold: int) -> pa.Table:
    tokens = [unpack_sorted(x) for x in group.column("tokens").to_pylist()]
    rest = [np.frombuffer(pa.decompress(x, decompressed_size=24 * len(t), codec="zstd", asbytes=True), np.int64).reshape(3, -1) for x, t in zip(group.column("rest").to_pylist(), tokens, strict=True)]
    t = np.concatenate(tokens)
    ids, n, digest = np.concatenate(rest, axis=1)
    order = np.lexsort((ids, digest, n, t))
    t, ids, n, digest = t[order], ids[order], n[order], digest[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1]) | (digest[1:] != digest[:-1])
    t, ids, n, digest = t[new], ids[new], n[new], digest[new]
    # Within a shingle's documents by size, one that neither neighbour matches in size has no match at all.
    fits = (t[1:] == t[:-1]) & (100 * n[:-1] >= threshold * n[1:])
    kept = np.concatenate((fits, [False])) | np.concatenate(([False], fits)) if len(t) else np.zeros(0, bool)
    t, ids, n, digest = t[kept], ids[kept], n[kept], digest[kept]
    first = np.concatenate(([True], t[1:] != t[:-1])) if len(t) else np.zeros(0, bool)
    group_of = np.cumsum(first) - 1
    many = np.bincount(group_of)[group_of] > 1
    # A group's signature: two sums of hashes of its documents, the same for all shingles that the same documents have.
    mixed = mix(ids.view(U64) ^ mix(digest.view(U64)))
    sums = [np.add.reduceat(x, np.flatnonzero(first))[group_of].view(np.int64) for x in (mixed, mix(mixed))] if len(t) else [ids, ids]
    columns = {"token": t.view(np.int64), "doc": ids, "n": n, "tag": (digest & TAG_BITS).astype(np.int32), "g0": sums[0], "g1": sums[1]}
    out = pa.table({"shard": pa.array(np.full(int(many.sum()), group.column("shard")[0].as_py()), pa.int64())} | {k: pa.array(v[many]) for k, v in columns.items()})
    del t, ids, n, digest, tokens, rest, columns
    give_back()
    return out


# ------------------------------------------------------------- star round
def best_leaders(shared: DataFrame, threshold: int) -> DataFrame:
    """leader, doc: each document's leader with which it shares most shingles.

    Leaders come first in one order of all documents (share of the prefix that others have too, then the id),
    so that the pairs form a forest.
    """
    prefix = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    score = shared.groupBy("doc").agg(F.count(F.lit(1)).alias("common"), F.first("n").alias("n")).select("doc", (F.col("common") / prefix).alias("score"))
    scored = shared.join(score, "doc")
    lead = scored.groupBy("token").agg(F.max(F.struct("score", (-F.col("doc")).alias("back"), "n")).alias("lead"))
    pairs = scored.join(lead, "token").select(F.struct("lead.score", "lead.back").alias("rank"), (-F.col("lead.back")).alias("leader"), F.col("lead.n").alias("m"), "doc", "n")
    fits = (F.col("leader") != F.col("doc")) & (100 * F.least("n", "m") >= threshold * F.greatest("n", "m"))
    counted = pairs.filter(fits).groupBy("leader", "doc").agg(F.count(F.lit(1)).alias("common"), F.first("rank").alias("rank"), F.first("n").alias("n"))
    best = counted.filter(F.col("common") * 4 >= prefix).groupBy("doc").agg(F.max_by("leader", F.struct("common", "rank")).alias("leader"))
    return best.select("leader", "doc")


def verified(pairs: DataFrame, docs: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """The pairs (a, b) that link, held against the texts; a document that repeats is read once."""
    small = pairs.count() <= BROADCAST_PAIRS
    hint = F.broadcast if small else (lambda x: x)
    texts = docs.filter(F.col("doc_id").isNotNull())
    seconds = texts.join(hint(pairs.select("a", F.col("b").alias("doc_id"))), "doc_id").select("a", F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    firsts = texts.join(hint(pairs.select(F.col("a").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    both = seconds.join(firsts, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, U64)
        for batch in batches:
            a, b = [], []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                others = shingle_sets(part.column(3), shingle)
                for i, (x, y) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    if x != last:
                        last, own = x, shingle_sets(part.column(2).slice(i, 1), shingle)[0]
                    if len(own) and len(others[i]):
                        place = np.searchsorted(own, others[i])
                        common = int((own[np.minimum(place, len(own) - 1)] == others[i]).sum())
                        if 100 * common >= threshold * (len(own) + len(others[i]) - common):
                            a.append(x)
                            b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return both.mapInArrow(lean(run), "a long, b long").distinct()


# -------------------------------------------------------- signature trees
class Node:
    """Documents lo..hi of a tree: OR and AND of their bitmaps, size range, component if there is but one."""

    __slots__ = ("all", "any", "hi", "kids", "largest", "lo", "one", "smallest")

    def __init__(self, lo, hi, kids, any_, all_, smallest, largest, one):
        self.lo, self.hi, self.kids, self.any, self.all = lo, hi, kids, any_, all_
        self.smallest, self.largest, self.one = smallest, largest, one


def first_bits(bits: np.ndarray) -> np.ndarray:
    """Place of the lowest bit that is set in each row; equal for most rows that are much alike."""
    word = (bits != 0).argmax(1)
    value = bits[np.arange(len(bits)), word]
    low = value & (~value + U64(1))
    return word * 64 + np.log2(np.maximum(low, U64(1)).astype(float)).astype(np.int64)


class SignatureTree:
    """Bitmaps of a group, all at one resolution; what is alike is brought together, so that OR and AND of a node say much.

    Documents of one component come together, then those that agree in their first and last token outside of
    what all have, then those of like size.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, component: np.ndarray):
        own = bits & ~np.bitwise_and.reduce(bits)
        self.order = np.lexsort((sizes, first_bits(own[:, ::-1]), first_bits(own), component))
        self.bits, self.sizes, self.component = bits[self.order], sizes[self.order], component[self.order]
        size = LEAF * (4 if bits.shape[1] <= 64 else 2 if bits.shape[1] <= 256 else 1)
        level = [self.leaf(lo, min(len(sizes), lo + size)) for lo in range(0, len(sizes), size)]
        while len(level) > 1:
            level = [self.parent(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        self.root = level[0]

    def leaf(self, lo: int, hi: int) -> Node:
        own, sizes = self.component[lo:hi], self.sizes[lo:hi]
        one = int(own[0]) if (own == own[0]).all() else None
        return Node(lo, hi, None, np.bitwise_or.reduce(self.bits[lo:hi]), np.bitwise_and.reduce(self.bits[lo:hi]), int(sizes.min()), int(sizes.max()), one)

    def parent(self, kids: list[Node]) -> Node:
        one = kids[0].one if all(k.one == kids[0].one for k in kids) else None
        return Node(kids[0].lo, kids[-1].hi, kids, np.bitwise_or.reduce([k.any for k in kids]), np.bitwise_and.reduce([k.all for k in kids]), min(k.smallest for k in kids), max(k.largest for k in kids), one)


def hopeless(x: Node, y: Node, threshold: int) -> bool:
    """No pair of a document of x and one of y can link anew."""
    if x.one is not None and x.one == y.one:
        return True
    if 100 * x.largest < threshold * y.smallest or 100 * y.largest < threshold * x.smallest:
        return True
    overlap = min(x.largest - int(np.bitwise_count(x.all & ~y.any).sum()), y.largest - int(np.bitwise_count(y.all & ~x.any).sum()))
    return (100 + threshold) * overlap < threshold * (x.smallest + y.smallest)


def dual_traversal(left: SignatureTree, right: SignatureTree, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left and right as given) of the pairs that the nodes and bitmaps admit; within one tree, each pair once."""
    first, second, todo = [], [], [(left.root, right.root)]
    same = left is right
    while todo:
        x, y = todo.pop()
        if hopeless(x, y, threshold):
            continue
        if x.kids is None and y.kids is None:
            i, j = compare(left, x, right, y, threshold)
            first.append(left.order[i])
            second.append(right.order[j])
        elif same and x is y:
            todo += [(a, b) for i, a in enumerate(x.kids) for b in x.kids[i:]]
        elif y.kids is None or (x.kids is not None and x.hi - x.lo >= y.hi - y.lo):
            todo += [(k, y) for k in x.kids]
        else:
            todo += [(x, k) for k in y.kids]
    return tuple(np.concatenate(p) if p else np.zeros(0, np.int64) for p in (first, second))


def compare(left: SignatureTree, x: Node, right: SignatureTree, y: Node, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = left.bits[x.lo : x.hi], right.bits[y.lo : y.hi]
    m, n = left.sizes[x.lo : x.hi, None], right.sizes[None, y.lo : y.hi]
    lone_a = np.bitwise_count(a[:, None] & ~b[None]).sum(2, dtype=np.int64)
    lone_b = np.bitwise_count(b[None] & ~a[:, None]).sum(2, dtype=np.int64)
    overlap = np.minimum(m - lone_a, n - lone_b)
    good = ((100 + threshold) * overlap >= threshold * (m + n)) & (left.component[x.lo : x.hi, None] != right.component[None, y.lo : y.hi])
    if left is right and x is y:
        good &= np.tri(len(a), k=-1, dtype=bool)
    i, j = np.nonzero(good)
    return i + x.lo, j + y.lo


def refined(words: list[np.ndarray], n: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: int) -> np.ndarray:
    """Which pairs the documents' own bitmaps still admit, at the resolution of the smaller one of each pair."""
    length = np.array([len(w) for w in words])
    keep = np.zeros(len(i), dtype=bool)
    shape = length[i] * (1 << 32) + length[j]
    for kind in np.unique(shape).tolist():
        size = min(kind >> 32, kind & 0xFFFFFFFF)
        own = np.flatnonzero(shape == kind)
        for at in range(0, len(own), max(1, (1 << 20) // size)):
            part = own[at : at + max(1, (1 << 20) // size)]
            x, y = (np.stack([folded(words[k], size) for k in side[part].tolist()]) for side in (i, j))
            m, o = n[i[part]], n[j[part]]
            overlap = np.minimum(m - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), o - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
            keep[part] = (100 + threshold) * overlap >= threshold * (m + o)
    return keep


def units(mixed: DataFrame, threshold: int) -> DataFrame:
    """``mixed`` with the unit (shard, hot, cell, i, j) in which each document is compared, and the side it is on.

    Groups of up to ``BLOCK`` documents go by shards.  A larger one is cut into cells: sizes are classed by the
    logarithm, so that links lie within a class or between neighbours, and a class is dealt into blocks by a
    hash.  Every pair of blocks that may hold a link is a unit of its own.
    """
    small = mixed.filter(F.col("docs") <= BLOCK).select("shard", F.lit(0).cast("long").alias("hot"), F.lit(-1).cast("long").alias("cell"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"), "token", "doc", "n", "tag", "component")
    # A little wider than the ratio, so that rounding can't put linked sizes two classes apart.
    width = 1.0001 * math.log(100 / threshold) if threshold < 100 else 1e-9
    blocks = F.ceil(F.col("docs") / F.lit(BLOCK)).cast("long")
    large = mixed.filter(F.col("docs") > BLOCK).withColumn("own", F.pmod(F.xxhash64("doc", "tag"), blocks)).withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("long"))

    def place(cell, i, j, side):
        return F.struct(cell.alias("cell"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    others, own, at = F.sequence(F.lit(0).cast("long"), blocks - 1), F.col("own"), F.col("class")
    within = F.transform(others, lambda j: place(2 * at, F.least(own, j), F.greatest(own, j), own > j))
    lower = F.transform(others, lambda j: place(2 * at + 1, own, j, F.lit(False)))
    upper = F.transform(others, lambda j: place(2 * at - 1, j, own, F.lit(True)))
    each = large.withColumn("at", F.explode(F.concat(within, lower, upper)))
    return small.unionByName(each.select("shard", F.col("token").alias("hot"), "at.*", "token", "doc", "n", "tag", "component"))


def tree_pairs(threshold: int):
    """Pairs of different components in a unit that the trees can't exclude."""

    def run(group: pa.Table) -> pa.Table:
        token, doc, tag = (group.column(c).to_numpy() for c in ("token", "doc", "tag"))
        n, component, side = (group.column(c).to_numpy() for c in ("n", "component", "side"))
        cell = group.column("cell")[0].as_py()
        raw = group.column("bits").to_pylist()
        order = np.lexsort((tag, doc, n, side, token))
        cut = np.flatnonzero(np.concatenate(([True], np.diff(token[order]) != 0, [True])))
        a, b, done = [], [], set()

        def search(left: np.ndarray, right: np.ndarray | None) -> None:
            both = left if right is None else np.concatenate((left, right))
            if len(both) < 2 or (component[both] == component[both[0]]).all():
                return
            words = [bitmap_words(raw[i]) for i in both]
            least = min(map(len, words))
            bits = np.stack([folded(w, least) for w in words])
            k = len(left)
            x = SignatureTree(bits[:k], n[left], component[left])
            i, j = dual_traversal(x, x if right is None else SignatureTree(bits[k:], n[right], component[right]), threshold)
            if right is not None:
                j = j + k
            fine = refined(words, n[both], i, j, threshold)
            a.append(doc[both[i[fine]]])
            b.append(doc[both[j[fine]]])

        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own = order[lo:hi]
            if (name := doc[own].tobytes() + tag[own].tobytes()) in done:
                continue
            done.add(name)
            middle = int(np.searchsorted(side[own], 1))
            if middle < len(own):
                if middle:
                    search(own[:middle], own[middle:])
            elif cell < 0 or cell % 2 == 0:  # of two neighbouring classes, one alone has nothing to be held against
                # Sizes that can't match part a group: no pair lies across such a gap.
                gaps = np.flatnonzero(100 * n[own][:-1] < threshold * n[own][1:]) + 1
                for part in np.split(own, gaps):
                    search(part, None)
        x, y = (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        give_back()
        return pa.table({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})

    return run


# ------------------------------------------------------------- components
def roots(parents: DataFrame) -> DataFrame:
    """doc, root of a forest given as (leader, doc): pointers jump until all end at roots."""
    now = staged(parents.select("doc", F.col("leader").alias("root")))
    while True:
        up = now.select(F.col("doc").alias("root"), F.col("root").alias("higher"))
        jumped = staged(now.join(up, "root", "left").select("doc", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        now = jumped.select("doc", "root")
        if jumped.filter("moved").limit(1).count() == 0:
            return now


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of a graph (a, b), by alternating large and small stars."""
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        # Large star: each node's larger neighbours join its least one.
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = staged(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        # Small star: each node and its smaller neighbours join the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = staged(small.filter("u <> v").distinct())
        at = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (at.n, at.h) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = (at.n, at.h)


# --------------------------------------------------------------- operator
def near_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``df``."""
    docs = documents_of(df, key=key, text=text)
    seen = staged(profile(docs, shingle))
    own = seen.filter("kind = 0").select("doc_id", "n", "d0", "d1", "bits")
    size = own.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    often = seen.filter("kind = 1").groupBy("d0").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(16, HOT_SHARE * size.docs))
    hot = np.sort(np.array([r.d0 for r in often.orderBy(F.desc("n"), "d0").limit(HOT_LIMIT).select("d0").collect()], dtype=np.int64).view(U64))
    moved = size.shingles * (100 - threshold) / 100 + size.docs
    shard_bits = max(0, int(np.ceil(np.log2(max(1.0, moved / SHARD_POSTINGS)))) + 2)

    shared = staged(postings(docs, shingle, threshold, hot, shard_bits).groupBy("shard").applyInArrow(shared_postings(threshold), SHARED))
    star = staged(best_leaders(shared, threshold))
    links = verified(star.select(F.col("leader").alias("a"), F.col("doc").alias("b")), docs, shingle, threshold)
    label = roots(links.select(F.col("a").alias("leader"), F.col("b").alias("doc")))

    # Of shingles that the same documents have, one is enough for the trees.
    one = shared.groupBy("g0", "g1").agg(F.min("token").alias("token")).select("token")
    joined = staged(shared.drop("g0", "g1").join(one, "token", "left_semi").join(label, "doc", "left").select("shard", "token", "doc", "n", "tag", F.coalesce("root", "doc").alias("component")))
    several = joined.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("docs")).filter("lo < hi").select("token", "docs")
    tag = F.col("d0").bitwiseAND(TAG_BITS).cast("int")
    bits = own.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("doc"), "n", tag.alias("tag")).agg(F.first("bits").alias("bits"))
    asked = units(joined.join(several, "token"), threshold).join(bits, ["doc", "n", "tag"]).groupBy("shard", "hot", "cell", "i", "j").applyInArrow(tree_pairs(threshold), "a long, b long")
    rest = verified(staged(asked.distinct()), docs, shingle, threshold)

    # Links of both rounds as one graph: the stars of the first, and what the trees add between them.  A class of
    # equal sets is known by its smallest id, so an id with several texts is tied to the classes of all of them.
    classes = staged(own.filter("n > 0").groupBy("d0", "d1", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies"))
    named = own.select("doc_id", "n", "d0", "d1").join(classes, ["d0", "d1", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"))
    texts = own.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("d0").alias("lo"), F.max("d0").alias("hi")).filter("lo < hi").select("doc_id")
    tied = named.join(texts, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    linked = components(label.select(F.col("doc").alias("a"), F.col("root").alias("b")).unionByName(rest).unionByName(tied))
    return named.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def keep_one_of_each(df: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One row of ``df`` for each component, that with the smallest id (a null one only where there is no other)."""
    rows = numbered_rows(df, F.col(key).cast("long").alias("doc_id"))
    found = near_duplicates(rows.select("_row", F.col("row").getField(text).alias("text")), key="_row", shingle=shingle, threshold=threshold)
    ids = staged(found.select(F.col("doc_id").alias("_row"), "component_id").join(rows.select("_row", "doc_id"), "_row"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    groups = ids.groupBy("component_id").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    lost = staged(ids.join(groups, "component_id").filter(F.col("_row") != F.col("best")["_row"]).select("_row"))
    return without_rows(rows.select("row", "_row"), lost)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, threshold=85)


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
 each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
 links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
 reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(least_b, doc_id)) AS component_id FROM sets LEFT JOIN (SELECT a, min(b) AS least_b FROM reach GROUP BY 1) ON a = doc_id
"""
