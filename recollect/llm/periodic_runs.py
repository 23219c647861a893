"""Runs of repeated words (tandem repeats of an exponent of four or more) by block convolution.

At scale W (1, 2, 4, ..) periods q with W < q <= 2 W are found (at W = 1 also q = 1).  A run of such a period is longer than four
W, so it holds a block of W words that starts at a multiple of W, less than W words after the run does; and that block occurs
again q words later, still inside the run.  Words are numbered within their document; for each block b and the window that
follows it, the sums

    S(d) = sum over i < W of (x[b + i] - x[b + d + i]) ** 2,    W < d <= 2 W

come from prefix sums of squares and one cyclic convolution of 2 W numbers, a number-theoretic transform modulo as many
primes as exceed the largest possible sum together: so ``S(d) = 0`` is exact, and means that the block occurs at distance d.  Blocks that
hold a word without any occurrence at those distances are left out before the transform: they can't match.

Each distance is a seed.  It is dropped if a known run of a smaller period covers both occurrences (no primitive
period fits then, by the theorem of Fine and Wilf), or if the three periods from the block on aren't equal by a rolling hash (inside a
run they are); else it is extended, word by word, to both sides.  What is long enough is a run, under its smallest period.

All documents of a batch go through one scale together, some millions of numbers at a time; one document is never split.
Documents of up to 2**27 words are taken.

Defined cases: null and empty texts have no words and no runs; a null id has no decimal form, so the words of its row
stay as they are; rows that repeat are judged each by itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents_of, lean, table

LEAST_LENGTH, EXPONENT = 6, 4
#: Words of documents that are searched together, about, and numbers of one transform.
GROUP_WORDS, TRANSFORM_NUMBERS = 1 << 18, 1 << 21
#: Primes k * 2**m + 1 below 2**31, with a generator of each.
PRIMES = [(2013265921, 31), (1811939329, 13), (469762049, 3)]
_U = np.uint64


class Transform:
    """Number-theoretic transforms of rows of ``size`` numbers (a power of two) modulo a prime."""

    _made: dict[tuple[int, int], Transform] = {}

    def __init__(self, prime: int, generator: int, size: int):
        self.p, self.size = _U(prime), size
        root = pow(generator, (prime - 1) // size, prime)
        self.down, self.up = self._twiddles(prime, root), self._twiddles(prime, pow(root, -1, prime))
        self.inverse = _U(pow(size, -1, prime))

    @classmethod
    def of(cls, prime: int, generator: int, size: int) -> Transform:
        if size > 1 << 16:  # rare, and large
            return cls(prime, generator, size)
        made = cls._made.get((prime, size))
        if made is None:
            made = cls._made[prime, size] = cls(prime, generator, size)
        return made

    def _twiddles(self, prime: int, root: int) -> np.ndarray:
        """Powers of the root, the first half of a circle, by doubling."""
        out = np.ones(max(1, self.size // 2), dtype=_U)
        have, step = 1, root
        while have < len(out):
            out[have : 2 * have] = out[:have] * _U(pow(root, have, prime)) % _U(prime)
            have *= 2
        return out

    def forward(self, a: np.ndarray) -> np.ndarray:
        """Decimation in frequency: natural order in, reversed bits out."""
        p, width = self.p, self.size // 2
        while width:
            v = a.reshape(len(a), -1, 2, width)
            low, high = v[:, :, 0], v[:, :, 1]
            w = self.down[:: self.size // (2 * width)][:width]
            both = low + high
            less = (low + (p - high)) % p * w % p
            a = np.stack((np.where(both >= p, both - p, both), less), axis=2).reshape(len(a), self.size)
            width //= 2
        return a

    def backward(self, a: np.ndarray) -> np.ndarray:
        """Decimation in time: reversed bits in, natural order out."""
        p, width = self.p, 1
        while width < self.size:
            v = a.reshape(len(a), -1, 2, width)
            w = self.up[:: self.size // (2 * width)][:width]
            low, high = v[:, :, 0], v[:, :, 1] * w % p
            both = low + high
            a = np.stack((np.where(both >= p, both - p, both), (low + (p - high)) % p), axis=2).reshape(len(a), self.size)
            width *= 2
        return a * self.inverse % p


def mismatches(x: np.ndarray, starts: np.ndarray, w: int, most: int) -> np.ndarray:
    """Whether S(d) is 0, for each block start and d = w + 1 .. 2 w (at w = 1: d = 1 .. 2); codes are below ``most``, and ``x`` ends with 3 w + 2 numbers more."""
    first = 1 if w == 1 else w + 1
    n, size = 2 * w - first + 1, 2 * w if w > 1 else 4
    zero = np.ones((len(starts), n), dtype=bool)
    later_at = starts[:, None] + np.arange(first, 2 * w + 1)
    bound, modulus = w * most * most, 1
    for prime, generator in PRIMES:
        t, p = Transform.of(prime, generator, size), _U(prime)
        block, window = np.zeros((len(starts), size), dtype=_U), np.zeros((len(starts), size), dtype=_U)
        square = np.concatenate((np.zeros(1, _U), np.cumsum(x * x % p, dtype=_U)))
        own, later = square[starts + w] - square[starts], square[later_at + w] - square[later_at]
        # The block backwards, so that the product of the transforms is a correlation: lag j stands at w - 1 + j.
        block[:, :w] = x[starts[:, None] + np.arange(w - 1, -1, -1)] % p
        reach = min(size, n + w - 1)
        window[:, :reach] = x[starts[:, None] + first + np.arange(reach)] % p
        product = t.backward(t.forward(block) * t.forward(window) % p)
        cross = product[:, (w - 1 + np.arange(n)) % size]
        zero &= (own[:, None] % p + later % p + (p - cross) + (p - cross)) % p == 0
        modulus *= prime
        if modulus > bound:
            return zero
    raise ValueError("a document has more words than the transforms can hold")


def runs_of(codes: np.ndarray, first: np.ndarray, *, least: int = LEAST_LENGTH, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each document, sorted; ``codes`` are dense word numbers of each, ``first`` has where documents begin, and the end."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in range(len(first) - 1)]
    total, longest = len(codes), int(np.diff(first).max(initial=0))
    if longest < min(least, exponent):
        return [[] for _ in found]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop, begin = first[1:][doc], first[:-1][doc]
    most = int(codes.max(initial=0)) + 1
    # Places of equal words of one document, next to each other and in order.
    same = doc * most + codes
    order = np.argsort(same, kind="stable")
    place = same[order] * total + order
    # A number is added to a power series of the words: equal stretches have equal hashes.
    powers = np.ones(total + 1, dtype=_U)
    np.cumprod(np.full(total, 0x9E3779B97F4A7C15, dtype=_U), out=powers[1:])
    mixed = (codes.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93)
    mixed ^= mixed >> _U(32)
    mixed *= _U(0xD6E8FEB86659FD93)
    series = np.concatenate((np.zeros(1, _U), np.cumsum(mixed * powers[:-1], dtype=_U)))
    reach = np.zeros(total, dtype=np.int64)  # how far known runs that began reach
    w = 1
    while exponent * (w + 1 if w > 1 else 1) <= longest:
        # Padding after the end: windows may look beyond it, and what they find there is dropped.
        padded = np.concatenate((codes.astype(_U), np.full(3 * w + 2, most, dtype=_U)))
        near, far = (1, 2) if w == 1 else (w + 1, 2 * w)
        blocks = np.flatnonzero(((np.arange(total) - begin) % w == 0) & (np.arange(total) + 3 * near <= stop))
        if len(blocks):
            again = np.searchsorted(place, place + near)
            meets = np.zeros(total, dtype=bool)
            meets[order] = place[np.minimum(again, total - 1)] <= place + far
            meets[order] &= again < total
            lacks = np.concatenate((np.zeros(1, np.int64), np.cumsum(~meets)))
            blocks = blocks[lacks[blocks + w] == lacks[blocks]]
        step, fresh = max(1, TRANSFORM_NUMBERS // (2 * w)), []
        for at in range(0, len(blocks), step):
            part = blocks[at : at + step]
            b, d = np.nonzero(mismatches(padded, part, w, most + 1))
            b, d = part[b], d + near
            inside = (b + 3 * d <= stop[b]) & (reach[b] < b + d + w)
            b, d = b[inside], d[inside]
            equal = (series[b + 2 * d] - series[b]) * powers[d] == series[b + 3 * d] - series[b + d]
            fresh.append(np.stack((b[equal], d[equal])))
        seeds = np.concatenate(fresh, axis=1) if fresh else np.zeros((2, 0), np.int64)
        _extend(codes, first, doc, seeds, found, reach, least, exponent)
        np.maximum.accumulate(reach, out=reach)
        w *= 2
    return [sorted((s, length, q) for (s, length), q in runs.items()) for runs in found]


def _extend(codes, first, doc, seeds, found, reach, least, exponent) -> None:
    """Extend seeds (place, distance) to maximal stretches, one for all the seeds that lie in it."""
    seeds = seeds[:, np.lexsort((seeds[0], seeds[1]))]
    done: tuple[int, int] = (-1, -1)
    for b, d in seeds.T.tolist():
        if done[0] == d and b + d < done[1]:  # both its occurrences lie in the last stretch of this period
            continue
        lo, hi = int(first[doc[b]]), int(first[doc[b] + 1])
        end = b + d + _equal(codes, b, b + d, hi - b - d, 1)
        start = b - _equal(codes, b - 1, b + d - 1, b - lo, -1)
        done = (d, end)
        length = end - start
        if length >= max(least, exponent * d):
            key, runs = (start - lo, length), found[doc[b]]
            runs[key] = min(runs.get(key, d), d)
            reach[start] = max(reach[start], end)


def _equal(codes: np.ndarray, i: int, j: int, most: int, way: int) -> int:
    """How many words from i on equal those from j on, to the right (1) or left (-1), ``most`` at most."""
    have, step = 0, 64
    while have < most:
        k = min(step, most - have)
        if way > 0:
            differ = codes[i + have : i + have + k] != codes[j + have : j + have + k]
        else:
            differ = (codes[i - have - k + 1 : i - have + 1] != codes[j - have - k + 1 : j - have + 1])[::-1]
        if differ.any():
            return have + int(differ.argmax())
        have, step = have + k, step * 2
    return have


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a document as the contract takes them: every tenth one, by a checksum of its id, repeats from some word on."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(x, len(seen)) for x in words), dtype=np.int64, count=len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words without the later periods of each run."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


_OUT = "doc_id long, n_words long, n_runs long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(df: DataFrame, *, key: str = "doc_id", text: str = "text", change=None) -> DataFrame:
    """doc_id, n_words, n_runs, runs (start, length, period), collapsed (words that stay, joined by one space)."""

    def row(doc_id, words, runs):
        return doc_id, len(words), len(runs), [{"start": s, "length": n, "period": q} for s, n, q in runs], b" ".join(collapsed(words, runs)).decode()

    return _each(documents_of(df, key=key, text=text), row, _OUT, change)


def _each(docs: DataFrame, row, schema: str, change=None) -> DataFrame:
    """A row of each document, from its id, words (after ``change``) and runs."""
    names = [part.strip().split(" ")[0] for part in _fields(schema)]
    kinds = [_ARROW.get(part.strip().split(" ", 1)[1], _RUNS) for part in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group: list[tuple] = []
            held = 0
            for i in range(batch.num_rows):
                doc_id = batch.column(0)[i].as_py()
                # Splitting bytes takes exactly the six ASCII spaces.
                words = (batch.column(1)[i].as_py() or "").encode().split()
                words = change(words, doc_id) if change else words
                group.append((doc_id, words))
                held += len(words)
                if held >= GROUP_WORDS:
                    yield flushed(group)
                    group, held = [], 0
            if group:
                yield flushed(group)

    def flushed(group: list[tuple]) -> pa.RecordBatch:
        codes = [numbered(words) for _, words in group]
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(c) for c in codes], dtype=np.int64)))
        runs = runs_of(np.concatenate(codes), first)
        out = [row(doc_id, words, found) for (doc_id, words), found in zip(group, runs, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_ARROW = {"long": pa.int64(), "string": pa.string()}


def _fields(schema: str) -> list[str]:
    """Fields of a schema; commas inside brackets don't count."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def row(doc_id, words, runs):
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
        return doc_id, len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _each(documents_of(table(spark, sf_dir, "documents")), row, schema, planted)
