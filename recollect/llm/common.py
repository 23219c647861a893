"""Shared pieces of the training-data operators.

* :func:`staged`: cut lineage by writing a compressed Parquet table in
  the folder that the session names in ``spark.checkpoint.dir`` (all executors see it).
* word hashing over whole Arrow buffers with NumPy: a word is a maximal run of bytes outside
  ``{0x20, 0x09-0x0D}``; no per-word Python object is made.
* a packed wire format for sorted integer lists.
* :func:`numbered_rows` / :func:`without_rows`: a decision on some rows of a table, by a number of each row,
  so that nulls and repeats in its own keys don't matter and the rows that stay aren't moved.
"""

from __future__ import annotations

import ctypes
import struct
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.session import drop_at_exit, spread, staging_dir

#: Documents up to this size are dealt out anew.
SPREAD_BYTES = 16 << 20
U64 = np.uint64
WORD_SPACE = np.zeros(256, dtype=bool)
WORD_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


# ----------------------------------------------------------------- staging
def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back (explicit schema: no listing job)."""
    spark = df.sparkSession
    folder = staging_dir(spark)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    drop_at_exit(spark, folder)
    run = _RUN.get()
    if run is not None:
        run.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths that the run of this thread has staged, in order.
_RUN: ContextVar[list[str] | None] = ContextVar("run", default=None)


def mark() -> list[str]:
    """A new run: what is staged from now on, in this thread, is its own."""
    run: list[str] = []
    _RUN.set(run)
    return run


def forget(spark: SparkSession, run: list[str]) -> None:
    """Remove the tables of a run but the newest: nothing may read them any more.  Those of other runs stay."""
    for path in run[:-1]:
        remove(spark, path)
    del run[:-1]


def release(spark: SparkSession) -> None:
    """Remove every table that :func:`staged` left for this application."""
    remove(spark, staging_dir(spark))


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Row numbers up to this count (8 bytes each) are broadcast to drop rows; beyond it both sides are shuffled.
BROADCAST_ROWS = 2_000_000


def numbered_rows(df: DataFrame, *more, name: str = "_row") -> DataFrame:
    """A staged copy of ``df`` as ``row`` (a struct of its columns), a number that no other row has, and further columns.

    The number is fixed by being written, whatever a later scan or a task that runs again does.
    """
    return staged(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias(name), *more))


def without_rows(numbered: DataFrame, lost: DataFrame, name: str = "_row") -> DataFrame:
    """The rows of :func:`numbered_rows` whose number isn't in ``lost``, as they were."""
    small = lost.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    kept = numbered.join(F.broadcast(lost) if small else lost, name, "left_anti")
    return kept.select(*[F.col("row").getField(f.name).alias(f.name) for f in numbered.schema["row"].dataType.fields])


def give_back() -> None:
    """Return what this worker no longer uses to the system: workers stay when a stage ends."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving memory back at the end of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, under fixed names; null text becomes empty.

    A table of a few megabytes may be one piece of a file, and is dealt out over all cores.
    """
    return spread(df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")), SPREAD_BYTES)


# ----------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift multiply); returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Poly:
    """Polynomial hashes of slices by prefix sums, modulo 2**64; the multiplier is odd and so has an inverse."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.code = rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
        base = (int(rng.integers(1, 2**62)) * 8 + 3) % 2**64
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=U64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, r in (("up", self.base), ("down", self.inverse)):
                a = np.full(n, r, dtype=U64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=U64))

    def slices(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``values[start:end]`` for each pair of bounds, the same wherever the slice lies."""
        self.powers(len(values) + 1)
        total = np.empty(len(values) + 1, dtype=U64)
        total[0] = 0
        np.cumsum(values * self.up[: len(values)], out=total[1:], dtype=U64)
        return mix((total[end] - total[start]) * self.down[start])


_WORDS = {0: Poly(11), 1: Poly(23)}
_RUNS = {0: Poly(37), 1: Poly(53)}
_BLOCK = 1 << 20


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = WORD_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of the texts ``data[offsets[i]:offsets[i+1]]``; words never span texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hash of each word, a block of about a megabyte at a time (one word may make a block longer)."""
    out, at = np.empty(len(start), dtype=U64), 0
    poly = _WORDS[which]
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + _BLOCK, side="right")))
        lo, hi = start[at], end[to - 1]
        out[at:to] = poly.slices(poly.code[data[lo:hi]], start[at:to] - lo, end[at:to] - lo)
        at = to
    return out


def run_hashes(words: np.ndarray, start: np.ndarray, length, which: int = 0) -> np.ndarray:
    """Hash of ``length`` consecutive words from each start."""
    return _RUNS[which].slices(words, start, start + length)


def text_buffer(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


# ----------------------------------------------------------- packed lists
def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted uint64 list as zstd-compressed byte planes of its differences."""
    gaps = np.diff(values, prepend=U64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    parts = []
    for p in planes:
        raw = np.ascontiguousarray(p).tobytes()
        small = pa.compress(raw, codec="zstd", asbytes=True) if len(raw) > 64 else raw
        parts.append(small if len(small) < len(raw) else raw)
    return struct.pack("<IB", len(values), width) + struct.pack(f"<{width}I", *map(len, parts)) + b"".join(parts)


def unpack_sorted(blob: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<IB", blob)
    sizes, at = struct.unpack_from(f"<{width}I", blob, 5), 5 + 4 * width
    gaps = np.zeros((n, 8), dtype=np.uint8)
    for i, size in enumerate(sizes):
        part = blob[at : at + size]
        at += size
        gaps[:, i] = np.frombuffer(part if size == n else pa.decompress(part, decompressed_size=n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=U64)


def pack_bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=n).astype(bool)

