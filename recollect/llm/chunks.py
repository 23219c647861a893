"""Chunk tables: whole documents gathered into compressed blocks of some megabytes.

Operators over word windows visit the corpus more than once.  A chunk table fixes, in the shared
folder, which documents make a block and in what order, so that a later pass can be answered by
*ordinals* (one bit for each entry of a list that the block can make again) instead of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import staged, text_buffer, word_bounds, word_hashes

CHUNK_BYTES = 8 << 20


def chunk_table(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """chunk_id, doc_ids, lengths (UTF-8 bytes), payload (zstd), raw_bytes, n_words from doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def row() -> pa.RecordBatch:
            raw = b"".join(texts)
            offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(t) for t in texts], dtype=np.int64)))
            words = len(word_bounds(np.frombuffer(raw, np.uint8), offsets)[0])
            packed = pa.Codec("zstd", compression_level=6).compress(raw, asbytes=True) if raw else b""
            values = [base + made, ids, [len(t) for t in texts], packed, len(raw), words]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["chunk_id", "doc_ids", "lengths", "payload", "raw_bytes", "n_words"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text or b"")
                held += len(texts[-1])
                if held >= chunk_bytes:
                    yield row()
                    made, held = made + 1, 0
                    ids.clear()
                    texts.clear()
        if ids:
            yield row()

    return staged(docs.select("doc_id", "text").mapInArrow(run, "chunk_id long, doc_ids array<long>, lengths array<long>, payload binary, raw_bytes long, n_words long"), codec="uncompressed")


class Chunk:
    """One row of a chunk table, opened: bytes, document offsets, word bounds."""

    def __init__(self, row: dict):
        self.id, self.doc_ids = row["chunk_id"], row["doc_ids"]
        self.raw = pa.decompress(row["payload"], decompressed_size=row["raw_bytes"], codec="zstd", asbytes=True) if row["raw_bytes"] else b""
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        self.offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(row["lengths"], dtype=np.int64)))
        self.start, self.end = word_bounds(self.data, self.offsets)
        #: First word of each document, and the number of all.
        self.first = np.searchsorted(self.start, self.offsets)

    def words(self, which: int = 0) -> np.ndarray:
        return word_hashes(self.data, self.start, self.end, which)

    def window_starts(self, length: int) -> np.ndarray:
        """Words at which ``length`` words of one document start."""
        n = np.diff(self.first)
        stop = np.repeat(self.first[1:], n)
        at = np.arange(len(self.start))
        return at[at + length <= stop]

    def texts(self) -> Iterator[bytes]:
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            yield self.raw[a:b]


__all__ = ["CHUNK_BYTES", "Chunk", "chunk_table", "text_buffer"]
