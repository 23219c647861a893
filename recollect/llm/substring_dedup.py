"""Substring deduplication with a Count-min prefilter.

Windows of ``window`` consecutive words are counted in two passes over a chunk table.

1. *Sketch.*  Every chunk makes its partition's Count-min sketch with ``depth`` rows, kept sparse:
   the sorted cells that it touches, with counts that stop at two.  Rows are cut into shards of
   cells; the partial sketches of a shard are merged (added) in one task.  A merged cell never
   counts less than any window in it, so windows whose least cell is below two occur once.  The
   answer to a chunk is one bit for each cell it sent.
2. *Exact.*  Windows that the sketch estimates as repeated are grouped exactly by a 128-bit identity
   (two independent 64-bit hashes of two independent word hashes), again by shards, with one bit as
   the answer for each window.  Only windows that the sketch let through are moved.

The width grows with the number of windows (``CELLS_PER_WINDOW``), so the rate of false candidates is
the same at every size; cells, shards and chunks hold bounded amounts and a hot window adds one entry
per chunk.  What is moved: about a byte per window and row, and 16 bytes per candidate of a chunk.

Defined cases: null and empty texts have no words and keep nothing; texts with fewer words than a
window are kept whole; a repeated row repeats its windows; kept words are joined by one space; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import Chunk, chunk_table
from .common import U64, documents_of, mix, pack_bits, pack_sorted, run_hashes, staged, table, unpack_bits, unpack_sorted

WINDOW = 35
CELLS_PER_WINDOW = 8
DEPTH = 2
#: Windows of a shard, about.
SHARD_WINDOWS = 1 << 20
REQUEST = "shard long, chunk_id long, entries binary, many binary"
REPLY = "chunk_id long, shard long, flags binary"


class Sketch:
    """Shape of the sketch: rows of 2**bits cells, cut into shards; the same for all chunks."""

    def __init__(self, windows: int, depth: int = DEPTH, cells: int = CELLS_PER_WINDOW, per_shard: int = SHARD_WINDOWS):
        self.depth = depth
        self.bits = max(8, int(np.ceil(np.log2(max(1, windows) * cells))))
        self.shard_bits = min(self.bits - 1, max(0, int(np.ceil(np.log2(max(1, windows) / per_shard)))))
        self.shards = 1 << self.shard_bits

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        return mix(keys * U64(2 * row + 3) + U64(row)) >> U64(64 - self.bits)

    def split(self, cells: np.ndarray) -> np.ndarray:
        """Bounds of the shards in a sorted list of cells."""
        edges = np.arange(1, self.shards, dtype=np.uint64) << U64(self.bits - self.shard_bits)
        return np.concatenate(([0], np.searchsorted(cells, edges), [len(cells)]))


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the distinct (a, b) in order, the place of each entry among them, and how often each occurs."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    group = np.cumsum(new) - 1
    inverse = np.empty(len(x), dtype=np.int64)
    inverse[order] = group
    return order[new], inverse, np.bincount(group, minlength=int(new.sum()))


class Windows:
    """The windows of a chunk and what the two passes say about them."""

    def __init__(self, chunk: Chunk, window: int):
        self.chunk, self.window = chunk, window
        self.at = chunk.window_starts(window)
        self.key = run_hashes(chunk.words(0), self.at, window, 0)

    def candidates(self, sketch: Sketch, flags: dict[int, bytes]) -> np.ndarray:
        keep = np.ones(len(self.at), dtype=bool)
        for row in range(sketch.depth):
            cells, inverse = np.unique(sketch.cells(self.key, row), return_inverse=True)
            cut, repeated = sketch.split(cells), np.zeros(len(cells), dtype=bool)
            for s in np.flatnonzero(np.diff(cut)).tolist():
                repeated[cut[s] : cut[s + 1]] = unpack_bits(flags[row * sketch.shards + s], int(cut[s + 1] - cut[s]))
            keep &= repeated[inverse]
        return np.flatnonzero(keep)

    def identities(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.key[chosen], run_hashes(self.chunk.words(1), self.at[chosen], self.window, 1)


def sketch_requests(chunks: DataFrame, sketch: Sketch, window: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                key = Windows(Chunk(row), window).key
                out = []
                for depth in range(sketch.depth):
                    cells, times = np.unique(sketch.cells(key, depth), return_counts=True)
                    cut = sketch.split(cells)
                    for s in np.flatnonzero(np.diff(cut)).tolist():
                        a, b = cut[s], cut[s + 1]
                        low = U64(s << (sketch.bits - sketch.shard_bits))
                        out.append((depth * sketch.shards + s, row["chunk_id"], pack_sorted(cells[a:b] - low), pack_bits(times[a:b] > 1)))
                if out:
                    yield request_batch(out)

    return chunks.select("chunk_id", "doc_ids", "lengths", "payload", "raw_bytes").mapInArrow(run, REQUEST)


def request_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "chunk_id", "entries", "many"])


def replies(group: pa.Table, repeated: np.ndarray, sizes: list[int]) -> pa.Table:
    out, at = [], 0
    for n in sizes:
        out.append(pack_bits(repeated[at : at + n]))
        at += n
    return pa.table({"chunk_id": group.column("chunk_id"), "shard": group.column("shard"), "flags": pa.array(out, pa.binary())})


def merge_sketches(group: pa.Table) -> pa.Table:
    """Add the partial sketches of a shard; a cell counts as repeated from two on."""
    lists = [unpack_sorted(x) for x in group.column("entries").to_pylist()]
    sizes = [len(x) for x in lists]
    many = [unpack_bits(x, n) for x, n in zip(group.column("many").to_pylist(), sizes, strict=True)]
    cells, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(inverse, weights=1 + np.concatenate(many), minlength=len(cells))
    return replies(group, (total >= 2)[inverse], sizes)


def exact_requests(window: int, sketch: Sketch):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            w = Windows(Chunk(row), window)
            chosen = w.candidates(sketch, dict(zip(right.column("shard").to_pylist(), right.column("flags").to_pylist(), strict=True)))
            a, b = w.identities(chosen)
            place, _, times = distinct_pairs(a, b)
            a, b = a[place], b[place]
            cut = np.concatenate(([0], np.searchsorted(a, np.arange(1, sketch.shards, dtype=np.uint64) << U64(64 - sketch.shard_bits)), [len(a)])) if sketch.shards > 1 else np.array([0, len(a)])
            for s in np.flatnonzero(np.diff(cut)).tolist():
                x, y = cut[s], cut[s + 1]
                out.append((s, row["chunk_id"], a[x:y].astype("<u8").tobytes() + b[x:y].astype("<u8").tobytes(), pack_bits(times[x:y] > 1)))
        return pa.Table.from_batches([request_batch(out)]) if out else pa.table({"shard": pa.array([], pa.int64()), "chunk_id": pa.array([], pa.int64()), "entries": pa.array([], pa.binary()), "many": pa.array([], pa.binary())})

    return run


def merge_exact(group: pa.Table) -> pa.Table:
    """Count the windows of a shard by identity."""
    raw = [np.frombuffer(x, "<u8").reshape(2, -1) for x in group.column("entries").to_pylist()]
    sizes = [x.shape[1] for x in raw]
    many = [unpack_bits(x, n) for x, n in zip(group.column("many").to_pylist(), sizes, strict=True)]
    place, inverse, _ = distinct_pairs(np.concatenate([x[0] for x in raw]), np.concatenate([x[1] for x in raw]))
    total = np.bincount(inverse, weights=1 + np.concatenate(many), minlength=len(place))
    return replies(group, (total >= 2)[inverse], sizes)


def remove_covered(window: int, sketch: Sketch, emit: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, words, removed, kept = [], [], [], []
        for row in left.to_pylist():
            chunk = Chunk(row)
            w = Windows(chunk, window)
            answers = list(zip(right.column("step").to_pylist(), right.column("shard").to_pylist(), right.column("flags").to_pylist(), strict=True))
            chosen = w.candidates(sketch, {s: f for step, s, f in answers if step == 0})
            place, inverse, _ = distinct_pairs(*w.identities(chosen))
            exact = {s: f for step, s, f in answers if step == 1}
            first = w.key[chosen][place]
            shard = (first >> U64(64 - sketch.shard_bits)).astype(np.int64) if sketch.shards > 1 else np.zeros(len(first), np.int64)
            repeated = np.zeros(len(place), dtype=bool)
            for s in np.unique(shard).tolist():
                own = np.flatnonzero(shard == s)
                repeated[own] = unpack_bits(exact[s], len(own))
            start = w.at[chosen[repeated[inverse]]]
            edge = np.zeros(len(chunk.start) + 1, dtype=np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for doc, text, a, b in zip(chunk.doc_ids, chunk.texts(), chunk.first[:-1].tolist(), chunk.first[1:].tolist(), strict=True):
                own = gone[a:b]
                n = int(own.sum())
                left_ = b" ".join(compress(text.split(), (~own).tolist()) if n else text.split())
                ids.append(doc)
                words.append(b - a)
                removed.append(n)
                kept.append(hashlib.sha256(left_).hexdigest() if emit == "digest" else left_.decode())
        name = "kept_sha256" if emit == "digest" else "kept"
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()), name: pa.array(kept, pa.string())})

    return run


def remove_repeated_windows(df: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, depth: int = DEPTH, cells_per_window: int = CELLS_PER_WINDOW, emit: str = "text", **chunking) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (``emit="digest"``: their SHA-256).

    Every word goes that is covered by a window whose words also start anywhere else; windows are
    judged on the input.
    """
    chunks = chunk_table(documents_of(df, key=key, text=text), **chunking)
    words = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first().n
    sketch = Sketch(words, depth, cells_per_window)
    estimated = staged(sketch_requests(chunks, sketch, window).groupBy("shard").applyInArrow(merge_sketches, REPLY))
    open_ = chunks.select("chunk_id", "doc_ids", "lengths", "payload", "raw_bytes").groupBy("chunk_id")
    asked = open_.cogroup(estimated.groupBy("chunk_id")).applyInArrow(exact_requests(window, sketch), REQUEST)
    counted = staged(asked.groupBy("shard").applyInArrow(merge_exact, REPLY))
    answers = estimated.withColumn("step", F.lit(0)).unionByName(counted.withColumn("step", F.lit(1)))
    last = "kept_sha256 string" if emit == "digest" else "kept string"
    return open_.cogroup(answers.groupBy("chunk_id")).applyInArrow(remove_covered(window, sketch, emit), f"doc_id long, n_words long, n_removed long, {last}")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"), emit="digest")


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 each AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
 windows AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS words FROM each WHERE i + 34 <= len(w)),
 repeated AS (SELECT words FROM windows GROUP BY 1 HAVING count(*) > 1),
 starts AS (SELECT r, i, true AS starts FROM windows SEMI JOIN repeated USING (words)),
 flagged AS (SELECT r, i, w[i] AS word, coalesce(max(CASE WHEN starts THEN i END) OVER (PARTITION BY r ORDER BY i) >= i - 34, false) AS gone FROM each LEFT JOIN starts USING (r, i)),
 kept AS (SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM flagged GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
