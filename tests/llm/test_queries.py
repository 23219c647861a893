"""Every registered query with its true parameters on the small tables, against brute force or a plain version."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from recollect.llm import bpe, language_id, packing, pii, queries, warc

from .test_models import plain_spans
from .test_word_operators import WORD, components

SF = os.environ.get("RECOLLECT_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_op1(spark, documents):
    words = [WORD.findall(t or "") for _, t in documents]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = set()
    for (doc, _), w in zip(documents, words, strict=True):
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone |= set(range(i, i + 35))
        want.add((doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    assert {tuple(r) for r in rows(spark, "op1_substring_dedup")} == want


def test_op2(spark, documents):
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANKS_FILE), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for d, t in documents:
        ids = library.encode_ordinary(t or "")
        want.add((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {tuple(r)[:4] for r in rows(spark, "op2_bpe")} == want


class PlainText(HTMLParser):
    """Visible words of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.title, self.out = 0, False, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template")
        self.title = tag == "title"
        self.out.append(" " if tag in warc._BLOCK else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template")
        self.title = False
        self.out.append(" " if tag in warc._BLOCK else "")

    def handle_data(self, data):
        if not self.hidden and not self.title:
            self.out.append(data)


def test_op3(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = rows(spark, "op3_warc_derivatives")
    assert Counter((r.page_id, r.type) for r in found) == Counter({(p, t): 1 for p in pages for t in ("conversion", "metadata")})
    built = {(r.page_id, r.type): r for r in warc.build(spark.read.parquet(f"{SF}/pages.parquet"), responses=True).collect()}
    for r in found:
        full, response = built[r.page_id, r.type], built[r.page_id, "response"]
        assert r.block_sha256 == hashlib.sha256(full.block).hexdigest()
        assert r.refers_to == response.record_id
        assert r.source_digest == response.payload_digest == warc.sha1((pages[r.page_id].html or "").encode())
        assert r.target_uri == pages[r.page_id].url
        if r.type == "conversion":
            plain = PlainText()
            plain.feed(pages[r.page_id].html or "")
            plain.close()
            assert bytes(full.block).decode().split() == "".join(plain.out).split()


def test_op4(spark, documents):
    found = {r.doc_id: r for r in rows(spark, "op4_ordinal_quality")}
    assert set(found) == {d for d, _ in documents}
    for r in found.values():
        assert 1 >= r.tail_1 >= r.tail_2 >= 0
        assert math.isclose(r.expected_grade, r.tail_1 + r.tail_2, abs_tol=1e-9)
        assert r.kept == (r.tail_2 >= 0.2)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [found[d].kept for d, r in labels.items() if r.quality and not r.toxic]
    toxic = [found[d].kept for d, r in labels.items() if r.toxic]
    assert sum(good) >= 0.95 * len(good)
    assert sum(toxic) <= 0.05 * len(toxic)


def test_op5(spark, documents):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, "op5_jaccard_join")} == components(documents, 4, 85)


def test_op6_is_the_posterior(spark):
    """A plain version of the fusion over the same trigram model."""
    table = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(language_id.evidence(df, key="doc_id", text="text", declared="lang", host="source"))
    import pyarrow as pa

    n, log = model.scores(pa.array([r["text"] for r in table], pa.string()))
    log = log * np.minimum(1.0, language_id.TEMPER / np.maximum(n, 1))[:, None]
    k = len(model.languages)
    guess = [int(x.argmax()) if m else -1 for x, m in zip(log, n, strict=True)]
    overall = np.bincount([g for g in guess if g >= 0], minlength=k).astype(float)
    prior = (overall + 1) / (overall.sum() + k)
    # Sources of documents have no dot: a host is its own domain, and there is no suffix.
    host, declared = defaultdict(lambda: np.zeros(k)), defaultdict(lambda: np.zeros(k))
    for r, g in zip(table, guess, strict=True):
        if g >= 0:
            host[r["source"]][g] += 1
            declared[r["lang"]][g] += bool(r["lang"])
    by = sum(v for c, v in declared.items() if c)
    values = len({r["lang"] for r in table if r["lang"]})
    want = {}
    for r, own in zip(table, log, strict=True):
        total = own.copy()
        if r["source"]:
            c = host[r["source"]]
            domain = (c + 5 * prior) / (c.sum() + 5)
            total += np.log((c + 5 * domain) / (c.sum() + 5))
        else:
            total += np.log(prior)
        if r["lang"]:
            total += np.log((declared[r["lang"]] + 0.5) / (by + 0.5 * (values + 1)))
        p = np.exp(total - total.max())
        want[r["doc_id"]] = (model.languages[int(total.argmax())], 1 / p.sum())
    for r in rows(spark, "op6_language_id"):
        language, posterior = want[r.doc_id]
        assert r.language == language
        assert math.isclose(r.posterior, posterior, rel_tol=1e-6)
        assert r.kept == (posterior >= 0.5 and language != "und")


def test_op6_without_declarations(spark):
    """Text, host and the rest alone tell held-out documents: a third of them declare nothing."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{SF}/documents.parquet")
    hidden = df.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    real = {r.doc_id: r.lang for r in df.filter("doc_id % 3 = 0 AND n_chars >= 40").collect()}
    told = {r.id: r.language for r in language_id.identify(hidden).collect()}
    assert sum(told[d] == x for d, x in real.items()) >= 0.97 * len(real)


def test_op7(spark, documents):
    t = Tokenizer.from_file(P.path(packing.VOCABULARY_FILE))
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4") for d, x in documents}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op7_best_fit_packing"):
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, own in ids.items():
        at = 0
        for i, (piece, start, length) in enumerate(sorted(pieces[d])):
            assert (piece, start) == (i, at)
            assert length == 2048 or i == 0
            at += length
        assert at == len(own)
        assert len(pieces[d]) == -(-len(own) // 2048)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.02 * sum(map(len, ids.values())) / 2048 + 2


def test_op9(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    good = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in table if r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids.tolist()])
    hits = defaultdict(dict)
    for r in rows(spark, "op9_kmeans_tree"):
        assert math.isclose(r.score, math.sqrt(((good[r.vec_id] - good[r.query_id]) ** 2).sum()), rel_tol=1e-12)
        hits[r.query_id][r.rank] = (r.score, r.vec_id)
    found = 0
    for q in [i for i in ids.tolist() if i % 100 == 0]:
        d = np.sqrt(((x - good[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        assert sorted(hits[q]) == list(range(1, 11))
        assert [hits[q][i] for i in range(1, 11)] == sorted(hits[q].values())
        found += len(best & {v for _, v in hits[q].values()})
    assert found >= 9 * len(hits)


def plain_maximisation(counts, rounds=50):
    """Posterior of each vote pattern by expectation-maximisation, a pattern and a labeler at a time."""
    post = {v: (sum(x > 0 for x in v) + 1) / (sum(x != 0 for x in v) + 2) for v in counts}
    for _ in range(rounds):
        share = {}
        for y in (0, 1):
            weight = {v: n * (post[v] if y else 1 - post[v]) for v, n in counts.items()}
            for j in range(5):
                of = {x: 1 + sum(w for v, w in weight.items() if v[j] == x) for x in (-1, 0, 1)}
                share |= {(j, y, x): of[x] / sum(of.values()) for x in of}
        prior = min(max(sum(n * post[v] for v, n in counts.items()) / sum(counts.values()), 0.01), 0.99)
        for v in counts:
            yes = prior * math.prod(share[j, 1, v[j]] for j in range(5))
            no = (1 - prior) * math.prod(share[j, 0, v[j]] for j in range(5))
            post[v] = yes / (yes + no)
    return post


def test_op10(spark, documents):
    model = pii.Model(pii.scanned(spark.read.parquet(f"{SF}/documents.parquet")))
    counts = defaultdict(Counter)
    want = {}
    for d, t in documents:
        base = [(k, a, b) for k, found in plain_spans(t or "").items() for a, b in found]
        listed, candidates = pii.scan(t or "")
        assert listed == base
        for kind, _, _, votes, _ in candidates:
            counts[kind][tuple(pii.votes_from(votes))] += 1
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in model.spans(listed, candidates))
        n = Counter(k for k, _, _ in base)
        want[d] = (n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest(), spans)
    for kind, own in counts.items():
        for votes, p in plain_maximisation(own).items():
            assert math.isclose(model.posterior[kind, pii.pattern_code(votes)], p, rel_tol=1e-6, abs_tol=1e-9)
    assert {r.doc_id: tuple(r)[1:] for r in rows(spark, "op10_weak_pii")} == want


def test_language_id_pages(spark):
    found = rows(spark, "language_id_pages")
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert {r.page_id for r in found} == {r.page_id for r in pages}
    declared = {r.page_id: m.group(1)[:2].lower() for r in pages if (m := re.search(r"(?i)<html[^>]*\slang=[\"']?([A-Za-z-]+)", r.html or ""))}
    assert sum(r.language == declared[r.page_id] for r in found if r.page_id in declared) >= 0.9 * len(declared)
