"""Embedding providers as Arrow functions, and the deterministic one used offline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_vector(text: str, dimensions: int) -> np.ndarray:
    """A text's hash drives a linear congruential generator; the vector has unit length."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = ((h ^ b) * 0x100000001B3) % 2**64
    out = np.empty(dimensions)
    for i in range(dimensions):
        h = (h * 6364136223846793005 + 1442695040888963407) % 2**64
        out[i] = (h >> 40) / float(1 << 24) * 2 - 1
    length = np.sqrt((out * out).sum())
    return (out / length if length > 0 else out).astype(np.float32)


def embed(texts: DataFrame, provider: Callable[[list[str]], list[np.ndarray]] | None = None, *, dimensions: int = 64, batch: int = 256) -> DataFrame:
    """frame_id, embedding of texts (frame_id, content); equal texts are embedded once.

    A provider takes a list of texts and returns as many vectors; it runs where the data is.
    """
    call = provider or (lambda xs: [hashed_vector(x, dimensions) for x in xs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = call(part.column(1).to_pylist())
                if len(vectors) != part.num_rows:
                    raise ValueError("a provider must return a vector for each text")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.asarray(v, np.float32) for v in vectors], pa.list_(pa.float32()))], names=["text_hash", "embedding"])

    keyed = texts.filter("content IS NOT NULL").select("frame_id", F.sha2("content", 256).alias("text_hash"), "content")
    distinct = keyed.groupBy("text_hash").agg(F.first("content").alias("content"))
    return keyed.select("frame_id", "text_hash").join(distinct.mapInArrow(run, "text_hash string, embedding array<float>"), "text_hash").select("frame_id", "embedding")
