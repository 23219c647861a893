"""Byte-level BPE encoding and decoding.

Two tiers.  A minimal perfect hash over the vocabulary (one slot for each token, no empty slot)
resolves every pre-token that is itself a token.  What misses is merged with a heap of candidate
pairs over doubly linked bytes: the lowest rank, then the leftmost pair, is taken until none is left.

Texts are cut at single spaces between non-space characters before the pre-tokenizer runs: its
pattern always starts a pre-token there, so the pieces encode independently and can be memoised in a
table of each Python worker, bounded in bytes; long pieces aren't memoised.  The table has two halves: once
the newer one is full, the older one goes, and what is met again moves to the newer.  There is no shuffle.

Defined cases: null and empty texts have no ids; lone surrogates can't occur (Arrow strings are
UTF-8); rows that repeat are encoded again; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import U64, Poly, documents_of, mix, table

#: White space as Unicode's White_Space property has it (fixed values).
SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
RANKS_FILE = "byte_bpe_50k.tiktoken"
#: Letters and numbers of newer Unicode tables than those of the library (fixed values: code points, in hexadecimal).
NEWER_LETTERS = "558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2 a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11df1-11df1 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
NEWER_NUMBERS = "11de0-11de9 1246f-1246f 12475-1247f 12550-12686 16ff4-16ff6"
#: About the bytes that one Python worker remembers, and the letters of the longest piece or pre-token among them.
MEMO_BYTES, MEMO_LENGTH = 256 << 20, 200
#: What an entry takes besides its letters and ids.
ENTRY_BYTES = 200
#: Texts with any of these, or with space beside space, are cut by the slower, general rule.
_OTHER_SPACE = re.compile(f"[{SPACE.replace(chr(92) + 'x20', '').replace(chr(92) + 'x09-' + chr(92) + 'x0d', chr(92) + 'x09' + chr(92) + 'x0b-' + chr(92) + 'x0d')}]")
_CUT = regex.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")


def _class(ranges: str) -> str:
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in ranges.split())


_NEWER = re.compile(f"[{_class(NEWER_LETTERS)}{_class(NEWER_NUMBERS)}]")


def default_ranks() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(RANKS_FILE), "rb") as f:
        return f.read()


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def parse_ranks(raw: bytes) -> list[bytes]:
    """Token bytes by rank."""
    pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in raw.splitlines() if line)]
    out = [b""] * (max(r for _, r in pairs) + 1)
    for token, rank in pairs:
        out[rank] = token
    return out


class PerfectHash:
    """Minimal perfect hash: keys are bucketed, and each bucket's displacement sends its keys to free slots.

    Buckets with one key store the slot itself (as a negative displacement).  A lookup verifies the
    key's bytes, so that strangers are refused.
    """

    def __init__(self, keys: list[bytes]):
        self.poly, self.n, self.buckets = Poly(71), len(keys), max(1, len(keys))
        h = self.hash(keys)
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, b in enumerate((h % U64(self.buckets)).tolist()):
            members[b].append(i)
        slot_of = np.full(self.n, -1, dtype=np.int64)
        free = np.ones(self.n, dtype=bool)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        for b in order:
            own = members[b]
            if len(own) < 2:
                break
            d = 1
            while True:
                at = self.place(h[own], np.full(len(own), d, dtype=np.int64))
                if free[at].all() and len(set(at.tolist())) == len(own):
                    break
                d += 1
            self.shift[b], slot_of[at] = d, own
            free[at] = False
        rest = iter(np.flatnonzero(free).tolist())
        for b in order:
            if len(members[b]) == 1:
                at = next(rest)
                self.shift[b], slot_of[at] = -1 - at, members[b][0]
        self.ids = slot_of
        self.keys = [keys[i] for i in slot_of.tolist()]

    def hash(self, keys: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"".join(keys), dtype=np.uint8)
        end = np.cumsum([len(k) for k in keys], dtype=np.int64)
        start = np.concatenate((np.zeros(1, np.int64), end[:-1]))
        return self.poly.slices(self.poly.code[data], start, end)

    def place(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(h ^ (d.astype(U64) * U64(0x9E3779B97F4A7C15))) % U64(self.n)).astype(np.int64)

    def lookup(self, keys: list[bytes]) -> list[int]:
        """Identifier of each key, -1 where it isn't in the set."""
        h = self.hash(keys)
        d = self.shift[(h % U64(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, self.place(h, d))
        known, ids = self.keys, self.ids[slot].tolist()
        return [i if known[s] == k else -1 for i, s, k in zip(ids, slot.tolist(), keys, strict=True)]


class Encoder:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        self.tokens = parse_ranks(ranks)
        self.hash = PerfectHash(self.tokens)
        self.decimal = [b"%d" % i for i in range(len(self.tokens))]
        rank = {t: i for i, t in enumerate(self.tokens)}
        self.byte = [rank[bytes([i])] for i in range(256)]
        # Which two tokens make a third, whatever the cut: a pair's rank is that of its bytes.
        self.pairs: list[dict[int, int]] = [{} for _ in self.tokens]
        for i, t in enumerate(self.tokens):
            for k in range(1, len(t)):
                if t[:k] in rank and t[k:] in rank:
                    self.pairs[rank[t[:k]]][rank[t[k:]]] = i
        # The same of two bytes, -1 for none.
        self.bytes = [[self.pairs[a].get(b, -1) for b in self.byte] for a in self.byte]
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}", f"[^{SPACE}\\p{{L}}").replace(r"\s+(?!\S)|\s+", f"[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"))
        older = self.pattern.pattern.replace(r"\p{L}", f"[\\p{{L}}--[{_class(NEWER_LETTERS)}]]").replace(r"\p{N}", f"[\\p{{N}}--[{_class(NEWER_NUMBERS)}]]")
        self.older = regex.compile(older, regex.V1)  # for pieces that hold what the library doesn't know yet
        self.memo: dict[str, bytes] = {}  # of pieces and pre-tokens, the newer half
        self.known: dict[str, bytes] = {}  # the older half
        self.held = self.older_held = 0

    def merge(self, word: bytes) -> list[int]:
        """Heap over linked bytes; for pre-tokens that aren't tokens."""
        pairs, two = self.pairs, self.bytes
        ids = [self.byte[x] for x in word]
        end = len(ids)
        shift = end.bit_length()
        mask = (1 << shift) - 1
        # rank[i]: of the pair that starts at i just now; a heap entry with another rank is stale.
        rank = [two[a][b] for a, b in pairwise(word)]
        heap = [r << shift | i for i, r in enumerate(rank) if r >= 0]
        rank.append(-1)
        heapify(heap)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        while heap:
            x = heappop(heap)
            i, r = x & mask, x >> shift
            if rank[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], rank[j] = r, -1, -1
            if k < end:
                before[k] = i
                rank[i] = s = pairs[r].get(ids[k], -1)
                if s >= 0:
                    heappush(heap, s << shift | i)
            else:
                rank[i] = -1
            k = before[i]
            if k >= 0:
                rank[k] = s = pairs[ids[k]].get(r, -1)
                if s >= 0:
                    heappush(heap, s << shift | k)
        return [i for i in ids if i >= 0]

    def remember(self, text: str, ids: bytes) -> None:
        if text not in self.memo:
            self.memo[text] = ids
            self.held += ENTRY_BYTES + len(text) + len(ids)

    def cut(self, piece: str) -> list[str]:
        """Pre-tokens of a piece."""
        return self.pattern.findall(piece) if piece.isascii() or not _NEWER.search(piece) else self.older.findall(piece)

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Put pieces into the memo: one batched hash lookup for all their pre-tokens, the heap for what misses.

        A piece that is one pre-token has one entry for both.  What is too long for the memo is returned.
        """
        memo, older = self.memo, self.known
        split = [self.cut(p) for p in pieces]
        whole = {s[0] for s in split if len(s) == 1}
        inner = {t for s in split if len(s) > 1 for t in s} - whole
        # Pre-tokens that would be cut further if they stood alone can't share an entry with a piece.
        own: dict[str, bytes] = {t: b"" for t in inner if self.cut(t) != [t]}
        for t in inner - own.keys():
            if t not in memo and t in older:
                self.remember(t, older[t])
        new = [*whole, *own, *(t for t in inner if t not in own and t not in memo)]
        raw = [t.encode() for t in new]
        for t, b, i in zip(new, raw, self.hash.lookup(raw) if raw else [], strict=True):
            ids = pack("<I", i) if i >= 0 else pack(f"<{len(ids := self.merge(b))}I", *ids)
            if len(t) > MEMO_LENGTH or t in own:
                own[t] = ids
            else:
                self.remember(t, ids)
        get = (lambda t: own[t] if t in own else memo[t]) if own else memo.__getitem__
        once = {}
        for p, s in zip(pieces, split, strict=True):
            ids = b"".join(map(get, s)) if len(s) > 1 else get(s[0])
            if len(p) > MEMO_LENGTH:
                once[p] = ids
            else:
                self.remember(p, ids)
        return once

    @staticmethod
    def pieces(text: str) -> list[str]:
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or _OTHER_SPACE.search(text):
            first, *rest = _CUT.split(text)
        else:
            first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; what is new is learnt for all texts at once."""
        if self.held - self.older_held > MEMO_BYTES // 2:
            self.held -= self.older_held
            self.known, self.older_held, self.memo = self.memo, self.held, {}
        parts = [self.pieces(t) if t else [] for t in texts]
        memo, older = self.memo, self.known
        new = []
        for p in {p for ps in parts for p in ps if p not in memo}:
            if p in older:
                self.remember(p, older[p])
            else:
                new.append(p)
        once = self.learn(new) if new else {}
        get = (lambda p: once[p] if p in once else memo[p]) if once else memo.__getitem__
        return [b"".join(map(get, ps)) for ps in parts]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_batch([text])[0], dtype="<u4").tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(ranks: bytes, pattern: str) -> Encoder:
    """A worker's encoder, made once for each vocabulary."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def encode_documents(df: DataFrame, *, key: str = "doc_id", text: str = "text", ranks: bytes | None = None, pattern: str | None = None, emit: str = "ids") -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary); with ``emit="digest"``, their counts and digests instead.

    ``ranks`` is the content of a rank file (under a megabyte for 50,000 tokens), sent with the task.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(default_ranks() if ranks is None else ranks)
    rule = default_pattern() if pattern is None else pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_for(shared.value, rule)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for packed in coder.encode_batch(part.column(1).to_pylist()):
                    ids = np.frombuffer(packed, dtype="<u4").tolist()
                    if emit == "ids":
                        rows.append((ids, coder.decode(ids)))
                    else:
                        rows.append((len(ids), hashlib.sha256(b" ".join(map(coder.decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.list_(pa.int32()), pa.binary()] if emit == "ids" else [pa.int64(), pa.string(), pa.string()]
                names = ["ids", "decoded"] if emit == "ids" else ["n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", *names])

    schema = "doc_id long, ids array<int>, decoded binary" if emit == "ids" else "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return documents_of(df, key=key, text=text).mapInArrow(run, schema)


def decode_ids(df: DataFrame, *, key: str = "doc_id", ids: str = "ids", ranks: bytes | None = None) -> DataFrame:
    """doc_id and decoded (binary) of a column of id lists; a null list decodes to nothing."""
    shared = df.sparkSession.sparkContext.broadcast(default_ranks() if ranks is None else ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = parse_ranks(shared.value)
        for batch in batches:
            out = [b"".join(map(tokens.__getitem__, x or [])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return df.select(df[key].cast("long").alias("doc_id"), df[ids].alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), emit="digest")
