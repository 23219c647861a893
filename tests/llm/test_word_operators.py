"""Substring deduplication, the Jaccard join and exact deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from recollect.llm import common, divergence, exact_dedup, jaccard_join, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1):
    """Copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "naïve", "x y", "WORD"]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.choice([3, 20, 60, 90]))) for _ in range(25)]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    texts = [None, "", "  \n", "one", "a b c", "A b C", " ".join(r.choice(vocabulary) for _ in range(5000))]
    for t in base:
        words = t.split(" ")
        texts += [t, t, t + "  tail"]
        for _ in range(3):
            w = list(words)
            w[r.randrange(len(w))] = "changed"
            texts.append("\n".join(w) if r.random() < 0.3 else " ".join(w))
        if r.random() < 0.5:
            texts.append(" ".join(words[:9]) + " " + passage + " " + " ".join(words[9:]))
    texts.append(passage + " " + passage)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    return [*rows, rows[10], rows[20]]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.selectExpr("doc_id", "text", "1 AS n", "'x' AS chunk_id", "doc_id AS shard", "'y' AS kept") if extra else df


def test_packed_lists_round_trip():
    r = np.random.default_rng(1)
    for values in ([], [7], [0, 0, 2**63 + 5], np.sort(r.integers(0, 2**62, 5000))):
        v = np.array(values, dtype=np.uint64)
        assert (common.unpack_sorted(common.pack_sorted(v)) == v).all()


def test_substring_dedup(spark):
    rows = corpus()
    window = 12
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    want = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        want.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    got = substring_dedup.remove_repeated_windows(frame(spark, rows), window=window, chunk_bytes=4000).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)
    narrow = substring_dedup.remove_repeated_windows(frame(spark, rows), window=window, depth=1, cells_per_window=1, chunk_bytes=4000, emit="digest").collect()
    assert sorted((r.doc_id, r.kept_sha256) for r in narrow) == sorted((d, hashlib.sha256(k.encode()).hexdigest()) for d, _, _, k in want)


def components(rows, shingle, threshold):
    sets = {}
    for doc, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[doc] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} - {()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            held[x].append(d)
    for a, b in {(a, b) for ds in held.values() for a in ds for b in ds if a < b}:
        common_ = len(sets[a] & sets[b])
        if 100 * common_ >= threshold * (len(sets[a]) + len(sets[b]) - common_):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("shingle", "threshold"), [(4, 85), (2, 60)])
def test_jaccard_join(spark, shingle, threshold):
    rows = corpus()
    want = components(rows, shingle, threshold)
    got = jaccard_join.near_duplicates(frame(spark, rows), shingle=shingle, threshold=threshold).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_signature_tree_loses_no_pair():
    """The tree's pairs hold every link between components, whatever the shape of the group."""
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(80)]
    sets = []
    for _ in range(120):
        s = set(base if r.random() < 0.7 else [r.getrandbits(64) for _ in range(80)])
        for x in r.sample(sorted(s), r.randrange(0, 12)):
            s.remove(x)
            s.add(r.getrandbits(64))
        sets.append(np.array(sorted(s), dtype=np.uint64))
    bits = np.stack([jaccard_join.bitmap_words(jaccard_join.bitmap(s)) for s in sets])
    n, own = np.array([len(s) for s in sets]), np.arange(len(sets))
    tree = jaccard_join.SignatureTree(bits, n, own)
    a, b = jaccard_join.dual_traversal(tree, tree, 85)
    found = {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    left, right = (jaccard_join.SignatureTree(bits[h], n[h], own[h]) for h in (slice(0, 50), slice(50, None)))
    a, b = jaccard_join.dual_traversal(left, right, 85)
    across = {(i, j + 50) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - c)}
    assert links <= found
    assert {(i, j) for i, j in links if i < 50 <= j} <= across
    assert links
    one = jaccard_join.SignatureTree(bits, n, np.zeros(len(sets), dtype=np.int64))
    assert len(jaccard_join.dual_traversal(one, one, 85)[0]) == 0


def test_a_shingle_of_all_documents_is_cut_into_units(spark, monkeypatch):
    """One passage in every document, relatives above and below the threshold, groups far beyond a block."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    r = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(150):
        tail = " ".join(f"t{i % 30}x{j}" for j in range(r.choice([4, 8, 12]))) if r.random() < 0.7 else " ".join(f"u{i}x{j}" for j in range(r.randrange(30)))
        rows.append((i, f"{passage} {tail}"))
    want = components(rows, 4, 85)
    got = jaccard_join.near_duplicates(frame(spark, rows), shingle=4, threshold=85).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert 1 < len({c for _, c in want.values()}) < 150


def test_an_id_with_several_texts(spark):
    """It has the links of all its texts."""
    r = random.Random(4)
    a, b, c = (" ".join(f"{x}{r.randrange(50)}" for _ in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (2, a + " tail"), (7, b + " tail"), (9, c), (1, None), (3, b)]
    got = {(x.doc_id, x.component_id) for x in jaccard_join.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(5, 2), (2, 2), (7, 2), (3, 2), (9, 9), (1, 1)}


@pytest.mark.parametrize("keep", [exact_dedup.keep_one, jaccard_join.keep_one_of_each])
def test_one_row_of_each_stays(spark, keep):
    """Null ids, rows that repeat, two texts under one id, column names of the operators' own."""
    text = "a b c d e f g h"
    rows = [(1, text), (1, text), (1, "other words are these here"), (None, text), (None, "alone w x y z"), (None, "alone w x y z"), (2, None), (3, "k l m n o p q"), (4, "k l m n o p q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS _row", "8 AS row", "9 AS _stay", "'z' AS recipe", "text AS best")
    kept = keep(df)
    assert kept.columns == df.columns
    assert kept.dtypes == df.dtypes
    best = 4 if keep is exact_dedup.keep_one else 3
    assert sorted(map(str, ((x.doc_id, x.text, x._row, x.row, x.best) for x in kept.collect()))) == sorted(map(str, ((d, t, 7, 8, t) for d, t in [(1, text), (1, rows[2][1]), (None, rows[4][1]), (2, None), (best, rows[7][1])])))
    assert keep(df.limit(0)).collect() == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in jaccard_join.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_exact_dedup(spark):
    rows = corpus()
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    want = sorted((d, max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)
    got = exact_dedup.exact_duplicates(frame(spark, rows))
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == want
    assert "Python" not in got._jdf.queryExecution().toString()


def test_chunks_join_to_the_text(spark):
    rows = [(i, t) for i, t in enumerate(["", "ab", "x" * 10_000, "then " * 3000, "né\n" * 2500])]
    df = frame(spark, rows, extra=False)
    for r in df.select("text", exact_dedup.chunks_of(df.text).alias("c")).collect():
        assert "".join(r.c) == r.text
        assert all(len(c) <= exact_dedup.MAX_CHUNK for c in r.c)


def test_ambiguous_identifiers_are_lengthened(spark):
    df = common.documents_of(frame(spark, [(1, "same"), (2, "same"), (3, "other")], extra=False))
    ids = [r[0] for r in df.selectExpr("xxhash64(text)").collect()]
    got = {r.doc_id: r.recipe for r in exact_dedup.recipes(df, ids).collect()}
    assert got[1] == got[2] != got[3]
    assert hashlib.sha256(b"same").hexdigest() in got[1][0]


@pytest.mark.parametrize("run", [lambda d: substring_dedup.remove_repeated_windows(d), lambda d: jaccard_join.near_duplicates(d), lambda d: exact_dedup.exact_duplicates(d)])
def test_empty_table(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_null_ids(spark):
    rows = [(None, "a b c d e f"), (None, None), (5, "a b c d e f")]
    assert len(substring_dedup.remove_repeated_windows(frame(spark, rows, extra=False), window=3).collect()) == 3
    assert len(jaccard_join.near_duplicates(frame(spark, rows, extra=False)).collect()) == 3
    got = exact_dedup.exact_duplicates(frame(spark, rows, extra=False)).collect()
    assert sum(r.kept for r in got if r.keep_id == 5) == 1


def test_terms_of_bytes_are_those_of_the_text():
    """Only ASCII letters are lower-cased; those of other alphabets, which are costly in strings, stay."""
    for text in ("", "ABZ abz", "Ünïcode ÀÉ İ ẞ ΑΒΓ Ж", "a_B-c\x00D E\U0001F600Z", "KK[A]`z{Q}"):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        assert divergence.terms_of(text.encode()) == divergence.TERM.findall(lower)
