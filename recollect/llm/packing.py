"""Best-fit packing of token sequences by the sum-of-squares rule.

Every document becomes its ids and an end id; a longer one than the capacity is cut into full pieces,
its first piece taking the remainder.  Full pieces are sequences of their own.  The others are dealt
at random into groups of about ``GROUP`` pieces; within a group they are taken from longest to
shortest, and each goes where the sum of squared counts of open bins per residual gap becomes
smallest: into a bin with some gap, or into a new one.  A group's state is one counter per gap, so a
piece costs one vector operation of at most ``capacity`` steps, whatever the number of bins.

The waste of a group is a few bins: on the test tables the sequences are within 1 % of total / capacity.

Defined cases: null and empty texts are the end id alone; an added token of the vocabulary file that a text holds literally is its one id; repeated rows are packed again; pieces of
equal length are taken by ``doc_id`` and piece; an empty table gives no sequences; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_of, staged, table

CAPACITY = 2048
GROUP = 8192
VOCABULARY_FILE = "byte_bpe_50k.json"


def default_vocabulary() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARY_FILE), "rb") as f:
        return f.read()


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_READY: dict[str, Coder] = {}


class Coder:
    """Ids as ``tokenizers`` gives them with the file as it is (``add_special_tokens=False``).

    A text that holds one of the file's added tokens goes to that library; any other one to the faster
    ``tiktoken`` with the same vocabulary, which gives the same ids there.
    """

    def __init__(self, vocabulary: bytes, pattern: str):
        import tiktoken

        spec, letters = json.loads(vocabulary), byte_letters()
        self.added = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in set(self.added)}
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary, self.whole = vocabulary, None

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not any(t in text for t in self.added):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_str(self.vocabulary.decode())
            self.whole.no_truncation()
            self.whole.no_padding()
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def tokenizer_for(vocabulary: bytes, pattern: str) -> Coder:
    key = hashlib.sha256(vocabulary + pattern.encode()).hexdigest()
    if key not in _READY:
        _READY[key] = Coder(vocabulary, pattern)
    return _READY[key]


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(at, capacity) for at in range(first, n, capacity)]


class Bins:
    """Open bins by residual gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """Put a piece of 0 < size <= capacity away; the bin and the place in it."""
        count, capacity = self.count, self.capacity
        # Growth of the sum of squares when a bin of gap g gets the piece: gap g loses a bin, gap g - size gains one.
        gaps = count[size:capacity]
        growth = np.where(gaps > 0, 2 * (count[: capacity - size] - gaps + 1), np.iinfo(np.int64).max)
        if len(gaps) and gaps[0] > 0:
            growth[0] = 1 - 2 * gaps[0]  # the bin is full and no longer counts
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        at = int(growth.argmin()) if len(growth) else -1
        if at >= 0 and gaps[at] > 0 and growth[at] <= fresh:
            gap = size + at
            which = self.open[gap].pop()
            count[gap] -= 1
        else:
            gap, which = capacity, self.made
            self.made += 1
        if gap > size:
            self.open[gap - size].append(which)
            count[gap - size] += 1
        return which, capacity - gap


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, longest first (stable)."""
    bins, which, offset = Bins(capacity), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        which[i], offset[i] = bins.place(int(sizes[i]))
    return which, offset


def cut_documents(df: DataFrame, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, vocabulary: bytes | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): the pieces that are to be packed."""
    import public_tokenizers

    shared = df.sparkSession.sparkContext.broadcast(default_vocabulary() if vocabulary is None else vocabulary)
    pattern = public_tokenizers.PATTERN
    end = np.array([end_id], dtype="<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.binary())] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer_for(shared.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for doc, text_ in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = coder.encode(text_) + end
                    for i, (start, length) in enumerate(piece_bounds(len(raw) // 4, capacity)):
                        own = raw[4 * start : 4 * (start + length)]
                        rows.append((doc, i, start, length, zlib.crc32(own), own)[: len(schema)])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return documents_of(df, key=key, text=text).mapInArrow(run, kinds)


def pack_documents(df: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP, **cut) -> DataFrame:
    """The pieces with sequence_id and offset."""
    pieces = staged(cut_documents(df, capacity=capacity, **cut))
    partial = pieces.filter(F.col("length") < capacity)
    groups = max(1, round(partial.count() / group))
    columns = pieces.columns

    def run(table_: pa.Table) -> pa.Table:
        table_ = table_.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        which, offset = pack_sizes(table_.column("length").to_numpy(), capacity)
        which = which + (table_.column("_group").to_numpy() << 32)
        return table_.select(columns).append_column("sequence_id", pa.array(which)).append_column("offset", pa.array(offset))

    kinds = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    # The number of a row in the staged table, so that rows that repeat are dealt apart too.
    row = F.monotonically_increasing_id()
    dealt = partial.withColumn("_row", row).withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "_row"), F.lit(groups)).cast("long")).drop("_row")
    packed = dealt.groupBy("_group").applyInArrow(run, kinds)
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
