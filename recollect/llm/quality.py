"""Quality classifier: ordinal cumulative-link regression on graded ratings.

All grades share one weight vector over hashed text features; ordered thresholds cut the score:
``P(grade > j) = sigmoid(score - cut_j)``.  From that follow the expected grade and the tail
probabilities that selection uses.  Cuts are kept in order by fitting the first and the logarithms of
their distances.

Features are the distinct words of the whole text (letters and digits, lower case), hashed to
``2**BITS`` weights, each valued (1 + ln count) / sqrt(1 + ln distinct), and a few shape features (shares of symbols,
capitals, repeated words) of the same table.

The model is fitted on the driver, on a bounded sample of ``TRAIN_DOCS`` labelled documents chosen by a
hash of the id; its size is fixed (2 MB), so that it may be broadcast.  Scoring is one pass, no shuffle.

Defined cases: null and empty texts have no word features and get a score from their shape; labels
without a document, null labels and null ids are left out of the sample; with fewer than two grades in
the sample every document gets the one grade; of several texts of a labelled id one is fitted on, so that an
id of many rows fills no sample; repeated rows are scored again; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, documents_of, table, text_buffer, word_bounds, word_hashes

BITS = 18
#: Bound on the labelled documents that the model is fitted on, and on their features.
TRAIN_DOCS = 6_000
ROUNDS, BATCH, RATE, DECAY = 30, 64, 1.0, 1e-4
#: Grades weigh share ** -BALANCE: rare ones count for more than their number.
BALANCE = 0.5
#: Features of fewer training documents keep weight zero: they would only tell documents apart.
LEAST_DOCS = 3
#: A document is kept when the probability of the highest grade is at least this.
KEEP = 0.2

_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_SYMBOL = _SEPARATOR.copy()
_SYMBOL[[9, 10, 11, 12, 13, 32]] = False


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indices and values of each text."""
    data, offsets = text_buffer(column)
    start, end = word_bounds(data, offsets, _SEPARATOR)
    words = (word_hashes(_LOWER[data], start, end) >> U64(64 - BITS)).astype(np.int64)
    first = np.searchsorted(start, offsets)
    symbols, capitals = (np.concatenate(([0], np.cumsum(kind[data]))) for kind in (_SYMBOL, _UPPER))
    out = []
    for i in range(len(offsets) - 1):
        own = words[first[i] : first[i + 1]]
        distinct, times = np.unique(own, return_counts=True)
        a, b = offsets[i], offsets[i + 1]
        size = max(1, int(b - a))
        shape = [
            int(20 * (symbols[b] - symbols[a]) / size),
            32 + int(20 * (capitals[b] - capitals[a]) / size),
            64 + int(10 * len(distinct) / max(1, len(own))),
            96 + min(16, int(size).bit_length()),
        ]
        shape = [(x * 2654435761 + 97) % (1 << BITS) for x in shape]
        value = (1.0 + np.log(times)) / np.sqrt(1.0 + np.log(max(1, len(distinct))))
        out.append((np.concatenate((distinct, np.array(shape, dtype=np.int64))), np.concatenate((value, np.ones(len(shape))))))
    return out


class CumulativeLink:
    """Shared weights and ordered cuts for grades 0 .. k."""

    def __init__(self, k: int, size: int = 1 << BITS):
        self.k, self.w = k, np.zeros(size)
        self.first, self.steps = -1.0, np.zeros(max(0, k - 1))

    @property
    def cuts(self) -> np.ndarray:
        return self.first + np.concatenate(([0.0], np.cumsum(np.exp(self.steps)))) if self.k > 1 else np.array([self.first])

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(self.w[at] @ value)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each score and cut."""
        return 1.0 / (1.0 + np.exp(np.clip(self.cuts[None, :] - np.asarray(score)[:, None], -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, seed: int = 3) -> CumulativeLink:
        """AdaGrad on the likelihood; grades are weighted so that rare ones count as much as others."""
        rng = np.random.Generator(np.random.PCG64(seed))
        held = np.bincount(np.concatenate([a for a, _ in rows]), minlength=len(self.w)) >= LEAST_DOCS
        rows = [(a[held[a]], v[held[a]]) for a, v in rows]
        share = np.bincount(grades, minlength=self.k + 1) / len(grades)
        weight = (1.0 / np.maximum(share, 1e-9) ** BALANCE)[grades]
        weight /= weight.mean()
        seen, seen_first, seen_steps = np.full(len(self.w), 1e-2), 1e-2, np.full(len(self.steps), 1e-2)
        for _ in range(ROUNDS):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), BATCH):
                own = order[lo : lo + BATCH]
                at = np.concatenate([rows[i][0] for i in own])
                value = np.concatenate([rows[i][1] for i in own])
                doc = np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own])
                score = np.bincount(doc, weights=self.w[at] * value, minlength=len(own))
                tail = self.tails(score)
                # P(grade = g) = above[g] - above[g + 1], with above[0] = 1 and above[k + 1] = 0.
                above = np.concatenate((np.ones((len(own), 1)), tail, np.zeros((len(own), 1))), axis=1)
                g = grades[own]
                i = np.arange(len(own))
                chance = np.maximum(above[i, g] - above[i, g + 1], 1e-12)
                slope = above * (1 - above)
                up, down = slope[i, g] / chance, slope[i, g + 1] / chance
                d_score = -(up - down) * weight[own] / len(own)
                d_cut = np.zeros(self.k + 2)
                np.add.at(d_cut, g, up * weight[own] / len(own))
                np.add.at(d_cut, g + 1, -down * weight[own] / len(own))
                d_cut = d_cut[1:-1]
                step = np.bincount(at, weights=(d_score[doc] * value), minlength=len(self.w))[touched := np.unique(at)] + DECAY * self.w[touched]
                seen[touched] += step * step
                self.w[touched] -= RATE * step / np.sqrt(seen[touched])
                seen_first += (total := d_cut.sum()) ** 2
                self.first -= RATE * total / np.sqrt(seen_first)
                if self.k > 1:
                    later = np.array([d_cut[j + 1 :].sum() for j in range(self.k - 1)]) * np.exp(self.steps)
                    seen_steps += later * later
                    self.steps -= RATE * later / np.sqrt(seen_steps)
        return self


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 toxic, 1 of low quality, 2 good."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    return known.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, grades: DataFrame, *, train_docs: int = TRAIN_DOCS) -> CumulativeLink:
    """Fit on a sample of labelled documents; ``docs`` has doc_id and text, ``grades`` doc_id and grade."""
    drawn = F.xxhash64("doc_id", F.lit(41))
    share = 2 * train_docs / max(1, grades.count())
    few = grades if share >= 1 else grades.filter(drawn < F.lit(int(share * 2**64) - 2**63))  # about twice the sample, so that no task orders all labels
    chosen = few.orderBy(drawn, "doc_id").limit(train_docs)
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("grade").cast("int").alias("grade"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(batch.column(1)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.astype("<i4").tobytes() for a, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())], names=["doc_id", "grade", "at", "value"])

    listed = sample.mapInArrow(run, "doc_id long, grade int, at binary, value binary")
    seen = sorted(listed.groupBy("doc_id", "grade").agg(F.min(F.struct("at", "value")).alias("x")).select("doc_id", "grade", "x.*").collect(), key=lambda r: r.doc_id)
    rows = [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["value"], "<f4").astype(float)) for r in seen]
    target = np.array([r["grade"] for r in seen], dtype=np.int64)
    top = int(target.max()) if len(target) else 0
    if len(set(target.tolist())) < 2:
        model = CumulativeLink(max(1, top))
        model.first, model.steps = -40.0 if top else 40.0, model.steps
        return model
    return CumulativeLink(top).fit(rows, target)


def score_documents(df: DataFrame, model: CumulativeLink, *, key: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """doc_id, expected_grade, tail_1 .. tail_k (probability of at least that grade) and kept."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    k = model.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                tail = m.tails(np.array([m.score(a, v) for a, v in features(part.column(1))]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tail.sum(1)), *[pa.array(np.ascontiguousarray(tail[:, j])) for j in range(k)], pa.array(tail[:, -1] >= keep)], names=["doc_id", "expected_grade", *[f"tail_{j + 1}" for j in range(k)], "kept"])

    tails = ", ".join(f"tail_{j + 1} double" for j in range(k))
    return documents_of(df, key=key, text=text).mapInArrow(run, f"doc_id long, expected_grade double, {tails}, kept boolean")


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(documents_of(docs), graded(table(spark, sf_dir, "labels"))))
