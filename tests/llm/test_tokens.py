"""Byte-level BPE and packing against the public libraries."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from recollect.llm import bpe, packing

NEWER = "\u088f\u0c5c\ua7ce\U00018d88\U00018e9a\U0001915a\U000190f6\U000323b5\U00011de3\U0001246f"
LETTERS = NEWER + "ab'stTé 中　\n\t \x1c\x85\xa0  12３.,!?'re'll😀 ñ́-"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS_FILE), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.default_ranks(), bpe.default_pattern())


def samples(n=2000):
    r = random.Random(3)
    return ["", " ", "  ", "a", "<|endoftext|>", "x" * 3000, "Then thwhorly " * 400, *["".join(r.choice(LETTERS) for _ in range(r.randrange(30))) for _ in range(n)]]


def test_encoder_matches_the_library_and_decodes(encoder, reference):
    texts = samples()
    for t, got in zip(texts, encoder.encode_batch(texts), strict=True):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == reference.encode_ordinary(t)
        assert encoder.decode(ids) == t.encode()


def test_memo_is_bounded_in_bytes(encoder, reference, monkeypatch):
    """Long pieces aren't remembered, and a full memo is emptied; the ids stay the library's."""
    own = bpe.Encoder(bpe.default_ranks(), bpe.default_pattern())
    monkeypatch.setattr(bpe, "MEMO_BYTES", 20_000)
    r = random.Random(6)
    for _ in range(40):
        texts = ["".join(r.choice("abcdef中文") for _ in range(r.choice([5, 3000]))) + " " + "xy" * r.randrange(200) for _ in range(5)]
        for t, got in zip(texts, own.encode_batch(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == reference.encode_ordinary(t)
        assert max(map(len, [*own.memo, *own.known])) <= bpe.MEMO_LENGTH
        assert own.held < 20_000 + 5 * 4 * (bpe.ENTRY_BYTES + 5 * bpe.MEMO_LENGTH)


def test_perfect_hash_is_minimal_and_refuses_strangers(encoder):
    h = encoder.hash
    assert sorted(h.ids.tolist()) == list(range(h.n))
    assert h.lookup(encoder.tokens) == list(range(h.n))
    assert h.lookup([b"no such token at all", b"\xff\xfe\xfd"]) == [-1, -1]


def test_query_columns(spark, reference):
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(df, emit="digest").collect()}
    want = set()
    for d, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.add((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    ids = bpe.encode_documents(df)
    assert {r.decoded.decode() for r in bpe.decode_ids(ids, ids="ids").collect()} == {"Hello wörld", ""}
    assert bpe.encode_documents(df.limit(0)).collect() == []


def test_packing(spark):
    r = random.Random(9)
    words = ["then", "thwhorly", "ération", "x1", "\n"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 5, 300, 900, 2000])))) for i in range(80)] + [(500, None), (501, "z " * 3000), (501, "z " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS piece", "'q' AS sequence_id")
    got = packing.pack_documents(df, capacity=512).collect()
    t = Tokenizer.from_file(P.path(packing.VOCABULARY_FILE))
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 0] for d, x in rows}
    pieces, sequences = {}, {}
    for p in got:
        own = ids[p.doc_id][p.start : p.start + p.length]
        assert p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        assert p.length == 512 or p.piece == 0
        pieces.setdefault(p.doc_id, []).append((p.piece, p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for d, own in pieces.items():
        copies = 2 if d == 501 else 1
        assert sum(n for _, _, n in own) == copies * len(ids[d])
        assert [p for p, _, _ in sorted(own)][::copies] == list(range(len(own) // copies))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 512
    total = sum(n for own in pieces.values() for _, _, n in own)
    assert len(sequences) <= -(-total // 512) * 1.06 + 2
    assert packing.pack_documents(df.limit(0)).collect() == []


def test_sum_of_squares_rule():
    """Each choice is one of those that make the sum smallest."""
    r = random.Random(2)
    bins = packing.Bins(20)
    for _ in range(400):
        size = r.randrange(1, 21)
        before = bins.count.copy()

        def after(gap, before=before, size=size):
            c = before.copy()
            if gap < 20:
                c[gap] -= 1
            if gap > size:
                c[gap - size] += 1
            return int((c[1:20] ** 2).sum())

        options = [after(g) for g in range(size, 20) if before[g]] + [after(20)]
        bins.place(size)
        assert int((bins.count[1:20] ** 2).sum()) == min(options)


def test_packing_takes_added_tokens_as_the_library_does(spark):
    """The reference is the tokenizer as loaded."""
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f"{end}{end}", f" x {end}  {end} y", f"{end[:-1]} {end}", end[:-1], "é " * 700 + end + " z" * 700, "plain", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = Tokenizer.from_file(P.path(packing.VOCABULARY_FILE))
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    got = {}
    for p in packing.cut_documents(df, capacity=512, with_ids=True).collect():
        assert p.length * 4 == len(p.ids)
        assert p.ids_crc32 == zlib.crc32(p.ids)
        got.setdefault(p.doc_id, []).append((p.start, list(struct.unpack(f"<{p.length}I", p.ids))))
    for d, x in enumerate(texts):
        assert [i for _, own in sorted(got[d]) for i in own] == [*t.encode(x or "", add_special_tokens=False).ids, 0]


def test_words_in_use_outlast_a_full_memo(reference, monkeypatch):
    """What every batch holds is merged once, however often new words fill the memo; a piece that is one pre-token has one entry."""
    own = bpe.Encoder(bpe.default_ranks(), bpe.default_pattern())
    monkeypatch.setattr(bpe, "MEMO_BYTES", 20_000)
    merged, merge = [], own.merge
    monkeypatch.setattr(own, "merge", lambda word: merged.append(word) or merge(word))
    for i in range(60):
        text = " ".join([f"qzxv{chr(97 + i % 26)}{chr(97 + i // 26)}{'jkw'[j % 3]}{chr(97 + j)}" for j in range(20)] + ["x sttible's", "sttible!", "  sttible"])
        assert np.frombuffer(own.encode_batch([text])[0], "<u4").tolist() == reference.encode_ordinary(text)
    assert merged.count(b" sttible") == 1
    assert own.held < 20_000 + 25 * (bpe.ENTRY_BYTES + 5 * bpe.MEMO_LENGTH)
