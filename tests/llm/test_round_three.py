"""Shards, periodic runs and source divergence against plain versions, with odd rows."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from recollect.llm import divergence, periodic_runs, sharding

SF = os.environ.get("RECOLLECT_TEST_DATA", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, size string, row string, shard string, key string, range string"


def odd(spark, rows):
    """Rows (doc_id, text, lang, source) with further columns of clashing names."""
    return spark.createDataFrame([(*r, *"abcde") for r in rows], SCHEMA)


# ----------------------------------------------------------------- shards
def placed(df):
    return [(r.key, r.size, r.text_crc32, r.shard, r.slot) for r in df.collect()]


def well_placed(rows, shards):
    """Slots without gaps; the bytes of each shard."""
    by = defaultdict(list)
    for _, size, _, shard, slot in rows:
        by[shard].append((slot, size))
    assert set(by) <= set(range(shards))
    for items in by.values():
        assert sorted(s for s, _ in items) == list(range(len(items)))
    return [sum(z for _, z in by[s]) for s in range(shards)]


def test_shards_of_odd_rows(spark):
    rows = [(None, "a", "en", "s")] * 3 + [(1, None, "en", "s"), (1, "", "en", "s"), (2, "é\U0001f600", "en", "s"), (3, "x" * 100_000, "en", "s")] + [(7, "copy", "en", "s")] * 500
    got = placed(sharding.assign(odd(spark, rows), 4))
    assert Counter((k, z, c) for k, z, c, *_ in got) == Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    load = well_placed(got, 4)
    assert max(load) == 100_016 and max(sorted(load)[:3]) - min(load) <= 2 * 22
    assert placed(sharding.assign(odd(spark, []), 4)) == []
    assert well_placed(placed(sharding.assign(odd(spark, [(5, "one", "", "")]), 4)), 4).count(0) == 3


@pytest.mark.parametrize("hot", [False, True])
def test_shards_are_equal_and_in_order(spark, monkeypatch, hot):
    """Many small records, a third of them of one key, more ranges than shards: shards are equal and in order of keys."""
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    df = spark.range(6000).selectExpr(f"if({hot} AND id % 3 = 0, 77, id * 7919 % 6007) AS doc_id", "repeat('w', int(id * 31 % 97)) AS text")
    got = placed(sharding.assign(df, 5))
    load = well_placed(got, 5)
    assert max(load) - min(load) <= 2 * (97 + 16)
    ends = sorted((min(k for k, *_, s, _ in got if s == i), max(k for k, *_, s, _ in got if s == i)) for i in range(5))
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    """Few samples give bad splitters; the ranges are mended before they are sorted."""
    monkeypatch.setattr(sharding, "SAMPLES", 1)
    df = spark.range(5000).selectExpr("id AS doc_id", "repeat('w', int(id % 50)) AS text")
    load = well_placed(placed(sharding.assign(df, 7)), 7)
    assert max(load) - min(load) <= 2 * 66


def test_written_shards_hold_all_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 7)
    rows = [(i if i % 5 else None, "text " * (i % 9), "en", "s") for i in range(60)]
    sharding.write_shards(odd(spark, rows), str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert Counter(tuple(r.row)[:2] for r in back.collect()) == Counter(r[:2] for r in rows)
    assert back.select("shard", "slot").distinct().count() == 60


# ------------------------------------------------------------------- runs
def plain_runs(x):
    """Maximal stretches of each period, the smallest period of each stretch."""
    out = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def test_runs_equal_brute_force():
    rnd, docs = random.Random(9), [[0] * 700, ([0] * 40 + [1]) * 9, [], [1], list(range(300)) * 5, list(range(128)) * 4]
    for _ in range(400):
        m, n = rnd.choice([1, 2, 3, 6]), rnd.randrange(70)
        x, root = [rnd.randrange(m) for _ in range(n)], [rnd.randrange(m) for _ in range(rnd.randrange(1, 40))]
        docs.append(x[: n // 2] + root * rnd.randrange(7) + x[n // 2 :])
    codes = [periodic_runs.numbered([str(v).encode() for v in x]) for x in docs]
    first = np.cumsum([0, *map(len, codes)])
    assert periodic_runs.runs_of(np.concatenate(codes), first) == [plain_runs(x) for x in docs]


@pytest.mark.parametrize("w", [1, 2, 8, 64])
@pytest.mark.parametrize("most", [3, 1 << 27])
def test_sums_of_squares_are_exact(w, most):
    """Zero mismatches and nothing else, with as many primes as the largest sum needs."""
    rng = np.random.default_rng(w)
    x = rng.integers(0, 3, 40 * w + 50) * (most // 3)
    x[5 * w : 9 * w] = x[3 * w : 7 * w]
    starts = np.arange(0, 30 * w, w)
    got = periodic_runs.mismatches(x.astype(np.uint64), starts, w, most)
    near = 1 if w == 1 else w + 1
    want = [[bool((x[b : b + w] == x[b + d : b + d + w]).all()) for d in range(near, 2 * w + 1)] for b in starts]
    assert got.tolist() == want


def test_a_prime_sum_is_no_match():
    """A sum that is a multiple of the first prime isn't 0."""
    p = periodic_runs.PRIMES[0][0]
    a, b = next((a, b) for a in range(1, 50000) if (b := round((p - a * a) ** 0.5)) ** 2 == p - a * a)
    x = np.array([0, 0, 9, a, b, 0, 0, 0, 0, 0, 0, 0], dtype=np.uint64)
    assert not periodic_runs.mismatches(x, np.array([0]), 2, 50000)[0, 0]


def test_op12(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in periodic_runs.op12_periodic_runs(spark, SF).collect()}
    for doc, text in docs:
        w = (text or "").encode().split()
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = plain_runs(w)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert got[doc] == (doc, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_of_odd_rows(spark):
    rows = [(None, "a a a a a a b", "", ""), (1, None, "", ""), (2, "", "", ""), (3, "x y " * 9000 + "z", "", ""), (3, "x y " * 9000 + "z", "", ""), (4, "a\u00a0a a\u00a0a\x0ba\u00a0a\ta\u00a0a a\u00a0a a\u00a0a", "", "")]
    got = sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(odd(spark, rows)).collect()], key=str)
    assert got == sorted([(None, 7, [(0, 6, 1)], "a b"), (1, 0, [], ""), (2, 0, [], ""), (3, 18001, [(0, 18000, 2)], "x y z"), (3, 18001, [(0, 18000, 2)], "x y z"), (4, 6, [(0, 6, 1)], "a\u00a0a")], key=str)
    assert periodic_runs.periodic_runs(odd(spark, [])).collect() == []


# ------------------------------------------------------------- divergence
def plain_divergence(rows, least, most):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = divergence.TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        groups.add((lang, source))
        n[lang, source].update(terms)
        n[lang, None].update(terms)
        docs[lang].update(set(terms))
    p = {}
    for lang, source in [*groups, *{(g[0], None) for g in groups}]:
        kept = [t for t, c in docs[lang].items() if c >= least]
        total = sum(n[lang, source][t] for t in kept) + 5 * len(kept)
        p[lang, source] = {t: 1 + 10**9 * (n[lang, source][t] + 5) // total for t in kept}
    out = []
    for lang, source in groups:
        own = p[lang, source]
        pairs = sorted((-sum(abs(v - p[lang, other][t]) for t, v in own.items()), other.encode()) for at, other in groups if at == lang and other != source)
        terms = sorted((p[lang, None][t] - v, t.encode()) for t, v in own.items() if n[lang, source][t] and v > p[lang, None][t])
        out += [(lang, source, part, item.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", terms[:most])) for i, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("classes", [1, 3, 1000])
def test_divergence_of_odd_rows(spark, monkeypatch, classes):
    monkeypatch.setattr(divergence, "BLOCK_CLASSES", classes)
    monkeypatch.setattr(divergence, "HELD_COUNTS", 5)
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["Aa", "b-b", "É", "é", "日本", "c3d", "the", "x_y"]) for _ in range(rnd.randrange(9))), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", None, "s10"])) for i in range(120)]
    rows += [(None, None, "en", "only null"), (1, "", "fr", "alone"), (1, "rare", "it", "a"), (1, "rare", "it", "b")] + rows[:5]
    got = sorted(tuple(r) for r in divergence.divergence(odd(spark, rows), min_documents=3, most_terms=4).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_divergence(rows, 3, 4)


def test_no_documents_no_divergence(spark):
    assert divergence.divergence(odd(spark, [])).collect() == []


def test_large_counts_are_exact(spark):
    """A billion times a count is more than 64 bits hold."""
    from pyspark.sql import functions as F

    c, n, v = 987_654_321_987, 123_456_789_012_345, 10_000_019
    got = spark.range(1).select(divergence.share(F.lit(c), F.lit(n), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (c + 5) // (n + 5 * v)
