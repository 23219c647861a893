"""Language ID, quality, PII, neighbours and WARC: brute force, held-out accuracy, round trips."""

import gzip
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.llm import ann, language_id, pii, quality, warc

# ----------------------------------------------------------------- PII
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def good(kind, s):
        if kind == "ip":
            return all(int(x) <= 255 for x in s.split("."))
        if kind == "card":
            d = [int(c) for c in reversed(digits(s))]
            return 13 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0
        return kind == "email" or 9 <= len(digits(s)) <= 15

    return {k: [m.span() for m in p.finditer(text) if good(k, m.group())] for k, p in PATTERNS.items()}


@pytest.mark.parametrize("letters", ["a.@-b1+ %", "0123.456 ..2", "0123456789 --", "+1234567890 ().-", "a@b.c@d.e 1.2.3.4"])
def test_base_spans(letters):
    r = random.Random(1)
    for _ in range(3000):
        t = "".join(r.choice(letters) for _ in range(r.randrange(45)))
        assert pii.base_spans(t)[0] == plain_spans(t), t


def test_base_spans_are_linear_in_long_texts():
    for t in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a.b@" * 50_000, "1-" * 100_000):
        pii.scan(t)


def test_reliabilities_find_the_better_labeler():
    r = np.random.default_rng(2)
    truth = r.random(4000) < 0.4
    votes = np.stack([np.where(r.random(4000) < right, truth, ~truth) * 2 - 1 for right in (0.95, 0.8, 0.8, 0.6, 0.55)], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, table, post = pii.reliabilities(patterns, counts.astype(float))
    right = [(table[j, 1, 2] + table[j, 0, 0]) / 2 for j in range(5)]
    assert right[0] > right[1] > right[3]
    assert abs(prior - 0.4) < 0.08
    assert ((post[inverse.reshape(-1)] > 0.5) == truth).mean() > 0.93


def test_pii_find_and_redact(spark):
    rows = [(1, "mail bob.x@site.example.com or +1 (555) 555-1234, 4111 1111 1111 1111 at 10.0.0.1"), (2, None), (3, ""), (4, 'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x'), (4, 'é token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x'), (5, "nothing here 300.1.1.1")]
    rows += [(100 + i, f'word token = "{i:02d}a9b8c7d6e5f40123456789abcdef0123456789" tail') for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "2 AS spans")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert len(pii.find(df).collect()) == len(rows)
    assert [s.kind for s in got[1].base] == ["email", "ip", "card", "phone"]
    assert got[2].spans == [] == got[3].spans == got[5].spans
    assert [(s.kind, s.start, s.stop) for s in got[4].spans] == [("secret", 11, 51)]
    masked = {r.doc_id: r for r in pii.redact(df).collect()}
    assert masked[1].text == "mail <EMAIL> or <PHONE>, <CARD> at <IP>"
    assert masked[4].text == 'é token = "<SECRET>" x'
    assert masked[2].text is None
    assert masked[5].base == 1
    assert pii.find(df.limit(0)).collect() == []


# ---------------------------------------------------------- language ID
LANGUAGES = {"en": ["the", "and", "with", "that", "thing"], "de": ["der", "und", "nicht", "schön", "über"], "fr": ["les", "été", "dans", "que", "leçon"]}


def language_rows(n=60):
    r = random.Random(4)
    rows = []
    for i in range(n):
        lang = list(LANGUAGES)[i % 3]
        rows.append((i, " ".join(r.choice(LANGUAGES[lang]) for _ in range(r.randrange(5, 60))), lang, f"http://www.site{i % 7}.{'de' if lang == 'de' else 'com'}/x", f"h{i % 4}"))
    return rows


def test_language_id(spark):
    rows = [*language_rows(), (100, "", "de", "http://a.de/", None), (101, None, None, None, None), (102, "%%% 123 ###", None, "no url", "h1"), (103, "そのようなことはない" * 5, None, None, "h1"), (0, "the and", "en", None, "h0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, url string, source string").selectExpr("*", "1 AS guess", "2 AS posterior")
    got = {r.id: r for r in language_id.identify(df, url="url").collect()}
    assert len(language_id.identify(df, url="url").collect()) == len(rows)
    assert all(got[i].language == lang and got[i].kept for i, _, lang, _, _ in language_rows() if i)
    assert got[100].language == "de"
    assert not got[103].kept
    kept = language_id.keep_known(df, url="url")
    assert kept.columns == df.columns
    assert 103 not in {r.doc_id for r in kept.collect()}
    assert language_id.identify(df.limit(0)).collect() == []
    assert not any(r.kept for r in language_id.identify(df.withColumn("lang", df.lang.substr(1, 0))).collect())


def test_host_prior_decides_where_the_text_is_silent(spark):
    rows = [(i, "der und nicht über", "de", "h1") for i in range(30)] + [(i, "les été dans que", "fr", "h2") for i in range(30, 60)] + [(100, "", None, "h1"), (101, "", None, "h2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.id: r.language for r in language_id.identify(df).collect()}
    assert (got[100], got[101]) == ("de", "fr")


# -------------------------------------------------------------- quality
def test_ordinal_model_orders_grades_on_held_out_rows():
    r = random.Random(6)
    plain = [f"word{i}" for i in range(300)]
    texts, grades = [], []
    for i in range(600):
        g = i % 3
        words = [r.choice(plain) for _ in range(60)] + [["vile", "nasty"], ["junk", "spam"], ["good", "fine"]][g] * 2
        r.shuffle(words)
        texts.append(" ".join(words))
        grades.append(g)
    rows, target = quality.features(pa.array(texts)), np.array(grades)
    model = quality.CumulativeLink(2).fit(rows[:450], target[:450])
    assert model.cuts[0] < model.cuts[1]
    tails = model.tails(np.array([model.score(*x) for x in rows[450:]]))
    assert ((tails > 0.5).sum(1) == target[450:]).mean() > 0.95
    assert (tails[:, 0] >= tails[:, 1]).all()


def test_quality_sample_is_bounded(spark):
    """Drawn by a share of the labels, and one row of an id with many: the model is that of the sample alone."""
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('word ', if(id % 2 = 0, 'good', 'junk'), ' x', id % 7) AS text")
    grades = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS grade")
    first = grades.orderBy(F.xxhash64("doc_id", F.lit(41)), "doc_id").limit(40)
    plain = quality.train(docs.join(first.select("doc_id"), "doc_id"), first, train_docs=40)
    hot = docs.unionByName(docs.filter("doc_id < 200").crossJoin(spark.range(20)).select("doc_id", "text"))
    for rows in (docs, hot):
        got = quality.train(rows, grades, train_docs=40)
        assert np.allclose(got.w, plain.w)
        assert np.allclose(got.cuts, plain.cuts)


def test_quality_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (3, "x" * 100_000)], "doc_id long, text string").selectExpr("*", "1 AS kept")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(quality.documents_of(df), quality.graded(labels))
    got = quality.score_documents(df, model).collect()
    assert len(got) == 4
    assert all(0 <= r.expected_grade <= 2 for r in got)
    assert quality.score_documents(df.limit(0), model).collect() == []
    assert quality.train(quality.documents_of(df.limit(0)), quality.graded(labels)).k == 1


# ------------------------------------------------------------ neighbours
def test_neighbours(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(30, 16))
    x = (centres[r.integers(0, 30, 4000)] + 0.3 * r.normal(size=(4000, 16))).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0, None] * 8), (5004, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS leaf", "2 AS bundle")
    usable = ann.usable(df)
    assert usable.count() == 4000
    index = ann.Index(usable, leaf_vectors=40, fit_sample=1500)
    got = {}
    for h in index.search(index.table.filter("vec_id % 50 = 0")).collect():
        got.setdefault(h.query_id, {})[h.rank] = (h.vec_id, h.score)
    y, found = x.astype(float), 0
    for q, hits in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(4000), d))[:10]
        found += len({v for v, _ in hits.values()} & set(best.tolist()))
        assert list(hits) and sorted(hits) == list(range(1, 11))
        assert [hits[i + 1] for i in range(10)] == sorted(hits.values(), key=lambda h: (h[1], h[0]))
        assert all(abs(d[v] - s) < 1e-12 for v, s in hits.values())
    assert len(got) == 80
    assert found / 800 >= 0.9
    assert index.visits < index.tree.leaves
    assert index.share == index.visits / index.tree.leaves
    assert [got[200][i][0] for i in range(1, 11)] == list(range(100, 110))


def test_neighbours_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    usable = ann.usable(df)
    index = ann.Index(usable)
    assert [(h.rank, h.vec_id) for h in sorted(index.search(index.table.filter("vec_id = 0")).collect(), key=lambda h: h.rank)] == [(1, 1), (2, 2)]
    # A query from elsewhere isn't one of the rows.
    assert [(h.rank, h.vec_id) for h in sorted(index.search(usable.filter("vec_id = 0")).collect(), key=lambda h: h.rank)] == [(1, 0), (2, 1), (3, 2)]
    empty = ann.usable(df.limit(0))
    assert ann.Index(empty).search(empty).collect() == []


def test_rows_are_what_makes_a_neighbour(spark, tmp_path):
    """Repeated rows, two vectors of one id, queries among them: the query's result is that of brute force over rows."""
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [rows[100]] * 2 + [(200, rows[7][1]), (200, rows[8][1]), (7, rows[200][1]), (300, None)] + [rows[9]] * 12
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v]
    want = []
    for at, (q, v) in enumerate(good):
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for other, (i, x) in enumerate(good) if other != at)[:10]
            want += [(q, rank + 1, i, round(d, 9)) for rank, (d, i) in enumerate(near)]
    found = ann.op9_kmeans_tree(spark, str(tmp_path)).collect()
    got = [(h.query_id, h.rank, h.vec_id, round(h.score, 9)) for h in found]
    assert Counter(x[:2] for x in got) == Counter(x[:2] for x in want)
    # A neighbour that is missed moves up those after it.
    assert sum((Counter((q, i, d) for q, _, i, d in got) & Counter((q, i, d) for q, _, i, d in want)).values()) >= 0.9 * len(want)
    assert [x for x in got if x[0] == 100 and x[1] < 3] == [(100, rank, 100, 0.0) for _ in range(3) for rank in (1, 2)] or Counter(x for x in got if x[0] == 100 and x[1] < 3) == Counter({(100, 1, 100, 0.0): 3, (100, 2, 100, 0.0): 3})
    assert {h.measured_recall >= 0.9 and 0 < h.visited_share <= 1 for h in found} == {True}


# ----------------------------------------------------------------- WARC
PAGE = "<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style></head><body><script>var x='<p>';</script><h1>Head</h1><p>One<br>two &lt;3<!-- no --> <b>bold</b></p></body></html>"


def test_warc_round_trip_and_links(spark, tmp_path):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "http://b.example/", ""), (3, "http://b.example/", ""), (4, "http://c.example/", "<p" + "<" * 5000 + "x" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS record_id", "2 AS type")
    built = warc.build(df, responses=True)
    folder = str(tmp_path / "warc")
    warc.save(built, folder)
    back = warc.read_records(spark, folder).collect()
    assert len(back) == len(built.collect()) == 15
    for r in back:
        h = r.headers
        assert h["warc-block-digest"] == warc.sha1(bytes(r.block))
        if h["warc-type"] != "response":
            source = next(x for x in back if x.headers["warc-record-id"] == h["warc-refers-to"])
            assert source.headers["warc-type"] == "response"
            assert source.headers["warc-payload-digest"] == h["warc-source-payload-digest"]
            assert source.headers.get("warc-target-uri") == h.get("warc-target-uri")
            partner = next(x for x in back if x.headers["warc-record-id"] == h["warc-concurrent-to"])
            assert partner.headers["warc-concurrent-to"] == h["warc-record-id"]
    text = next(bytes(r.block).decode() for r in back if r.headers["warc-type"] == "conversion" and r.headers.get("warc-target-uri") == "http://a.example/x")
    assert text == "Head\nOne\ntwo <3 bold"
    about = next(bytes(r.block).decode() for r in back if r.headers["warc-type"] == "metadata" and r.headers.get("warc-target-uri") == "http://a.example/x")
    assert "source-content-type: text/html; charset=utf-8" in about
    assert "title: A & B" in about
    again = {(r.type, r.record_id, bytes(r.record)) for r in warc.derive_records(warc.read_records(spark, folder)).collect()}
    assert again == {(r.type, r.record_id, bytes(r.record)) for r in built.collect() if r.type != "response"}
    assert warc.build(df.limit(0)).collect() == []


def text_of(headers, block):
    made = {dict(h)["WARC-Type"]: b.decode() for h, b in warc.derive(headers, block)}
    return made["conversion"], made["metadata"]


SOURCE = {"warc-record-id": "<urn:a>", "warc-type": "response"}


def test_captured_responses_as_servers_send_them():
    """Heads that end their lines by LF, names with line ends, folded values, codings of content and transfer."""
    text, about = text_of(SOURCE, b"HTTP/1.1 200 OK\nContent-Type: text/html\n\n<p>hi</p>")
    assert text == "hi" and "http-status: HTTP/1.1 200 OK\r\n" in about and "source-content-type: text/html\r\n" in about
    _, about = text_of(SOURCE, b"HTTP/1.1 200 OK\r\nX-A\x0bB\rEvil: 1\r\nLong: a\r\n  b\r\n\r\nx")
    assert all(": " in line for line in about.strip().split("\r\n")) and "source-long: a b\r\n" in about and "\r\nEvil" not in about and "\nEvil" not in about
    page = "<p>gr\u00fcn</p>".encode()
    deflate = zlib.compressobj(wbits=-15)
    raw = deflate.compress(page) + deflate.flush()
    for name, body in (("gzip", gzip.compress(page)), ("x-gzip", gzip.compress(page)), ("deflate", zlib.compress(page)), ("deflate", raw), ("identity", page), ("deflate, gzip", gzip.compress(zlib.compress(page)))):
        assert text_of(SOURCE, b"HTTP/1.1 200 OK\r\nContent-Encoding: " + name.encode() + b"\r\n\r\n" + body)[0] == "gr\u00fcn"
        chunks = b"".join(b"%x;note=1\r\n%s\r\n" % (len(body[i : i + 5]), body[i : i + 5]) for i in range(0, len(body), 5)) + b"0\r\nTrailer: 1\r\n\r\n"
        assert text_of(SOURCE, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: " + name.encode() + b"\r\n\r\n" + chunks)[0] == "gr\u00fcn"
    # Decoded by the crawler already, though the headers still say otherwise: taken as it is.
    assert text_of(SOURCE, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + page)[0] == "gr\u00fcn"
    text, about = text_of(SOURCE, b"HTTP/1.1 200 OK\r\nContent-Encoding: br\r\n\r\n\x8b\x02\x80")
    assert text == "" and "content-coding-unread: br\r\n" in about
    assert text_of(SOURCE, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(page * 999)[:60])[0].startswith("gr\u00fcn")


def test_tags_with_quoted_ends():
    assert warc.visible_text('<a title="x>y">link</a> <b data-x=\'a>b\' c>bold</b>')[0] == "link bold"
    assert warc.visible_text('<a title="open>rest</a> and more')[0] == "rest and more"
    assert warc.visible_text("<p>it's 1 < 2 > 0</p><i class=a'b>x</i>") [0] == "it's 1 < 2 > 0\nx"
    assert warc.visible_text('<script src="a>b">var x</script>z<!-- > -->!<!doctype html>')[0] == "z!"


def test_malformed_records_are_reported(spark, tmp_path):
    """One bad record costs neither the job nor the records around it; what is wrong is in its row."""
    good = warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:b>")], b"HTTP/1.1 200 OK\r\n\r\n<p>b</p>", compressed=False)
    plain = good + b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno length\r\n\r\n" + good.replace(b"urn:b", b"urn:c") + b"trailing bytes"
    parts = [good, b"nonsense", b"WARC/1.1\r\nContent-Length: x\r\n\r\n", good.replace(b"<urn:b>", b""), good.replace(b"Content-Length: ", b"Content-Length: 9"), good.replace(b"urn:b", b"urn:d")]
    (tmp_path / "plain.warc").write_bytes(plain)
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in parts) + b"\x1f\x8b broken")
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "lf.warc").write_bytes(good.replace(b"\r\n", b"\n").replace(b"urn:b", b"urn:e").replace(b"Content-Length: 27", b"Content-Length: 25"))
    records = warc.read_records(spark, str(tmp_path))
    rows = records.collect()
    assert {r.headers.get("warc-record-id") for r in rows if r.error is None} == {"<urn:b>", "<urn:c>", "<urn:d>", "<urn:e>", ""}
    assert len([r for r in rows if r.error]) >= 6 and all(r.file for r in rows)
    made = warc.derive_records(records).collect()
    assert {r.refers_to for r in made if not r.error} == {"<urn:b>", "<urn:c>", "<urn:d>", "<urn:e>"}
    assert {bytes(r.block) for r in made if r.type == "conversion"} == {b"b"}
    assert [r.error for r in made if r.error] == ["no record id"]
    headers = dict(SOURCE) | {"warc-target-uri": "u"}
    assert {dict(h)["WARC-Refers-To"] for h, _ in warc.derive(headers, b"")} == {"<urn:a>"}


def test_warc_values_end_no_line(tmp_path):
    """Neither a URL nor a source's header or title can add a header or end a record."""
    url = "http://a.example/\r\nX-Evil: 1\r\n\r\nWARC/1.1"
    headers, block = warc.response_of(1, url, "<title>x\r\n\r\ny</title>")
    block = block.replace(b"Content-Type", b"X-Odd: a\nb\rc\r\nContent-Type")
    raw = warc.write_record(headers, block) + b"".join(warc.write_record(h, b) for h, b in warc.derive({k.lower(): v for k, v in headers}, block))
    back = list(warc.parse(raw))
    assert len(back) == 3
    assert all("x-evil" not in h and h["warc-target-uri"] == "http://a.example/%0D%0AX-Evil: 1%0D%0A%0D%0AWARC/1.1" for h, _ in back)
    about = dict(line.split(": ", 1) for line in back[2][1].decode().strip().split("\r\n"))
    assert about["title"] == "x y"
    assert about["source-x-odd"] == "a b c"
    assert [len(m) for m in warc.members(raw, step=7)] == [len(m) for m in warc.members(raw)]


def test_language_keeps_rows_as_they_are(spark):
    """Null ids, rows that repeat, two texts under one id, column names of the operator's own."""
    german = "der und die das nicht mit auf über für " * 4
    rows = [(None, german), (None, german), (1, german), (1, "そのようなことはない" * 9), (2, None), (3, german)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("'de' AS lang", "doc_id", "text", "'s' AS source", "1 AS log", "2 AS `none`", "3 AS row", "4 AS _stay", "5 AS id")
    df = df.withColumn("lang", F.when(F.col("text").isNull() | F.col("text").startswith("そ"), None).otherwise(F.col("lang")))
    kept = language_id.keep_known(df)
    assert kept.dtypes == df.dtypes
    told = {x.id for x in language_id.identify(df, key="doc_id").filter("kept").collect()}
    assert told >= {None, 1, 3}
    got = [(x.doc_id, x.text, x.log, x.row, x.id) for x in kept.collect()]
    assert all(g[2:] == (1, 3, 5) for g in got)
    assert sorted(str(g[:2]) for g in got if g[1]) == sorted(str(r) for r in rows if r[1] == german)


def test_warc_text_after_hidden_elements_is_whole():
    """U+0130 is two characters in lower case; places must be those of the source."""
    page = "<title>İİİ</title><p>İİİİ İstanbul</p><STYLE>p { }</Style>İzmir<script>x < 1</SCRIPT ><p>abcdef</p>"
    assert warc.visible_text(page) == ("İİİİ İstanbul\nİzmir\nabcdef", "İİİ")
    assert warc.visible_text("İ<script>x</\u017fcript>y</script>z") == ("İz", "")


def test_every_declared_language_is_told(spark):
    """Fifty languages of as many alphabets, one far more frequent than the sample of each."""
    r = random.Random(8)
    names = [a + b for a in "abcde" for b in "klmnopqrst"]
    letters = {x: [chr(0x3400 + 40 * i + j) for j in range(12)] for i, x in enumerate(names)}

    def text(x):
        return " ".join("".join(r.choice(letters[x]) for _ in range(3)) for _ in range(12))

    rows = [(i, text(names[0]), names[0], "h") for i in range(6000)]
    rows += [(10_000 + 10 * i + j, text(x), x, f"h{i}") for i, x in enumerate(names[1:]) for j in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.id: (x.language, x.kept) for x in language_id.identify(df).collect()}
    assert all(got[i] == (lang, True) for i, _, lang, _ in rows)


def test_a_rare_language_keeps_its_rows_in_a_large_table(spark, monkeypatch):
    """The rows that a language is fitted on don't shrink as others grow; tables beyond the broadcast bound are shuffled."""
    monkeypatch.setattr(language_id, "BROADCAST_HOSTS", 1)
    rows = [(i, "der und nicht über", "de", "h1") for i in range(20_000)] + [(30_000, "les été dans que leçon", "fr", "h2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.id: (x.language, x.kept) for x in language_id.identify(df).collect()}
    assert got[30_000] == ("fr", True)
    assert set(got.values()) == {("fr", True), ("de", True)}
