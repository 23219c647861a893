"""Lanes, indexes and unified search against plain versions."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from recollect import session
from recollect.functions import text
from recollect.functions.tokens import BytePairs, WordPieces
from recollect.operators import bm25, context, facts, fusion, lanes, library, media
from recollect.operators import boolean as boolean_module
from recollect.operators.boolean import boolean
from recollect.plans.search import SearchRequest, unified
from recollect.sources import index as index_module
from recollect.sources.graph import VectorGraph
from recollect.sources.index import IndexRuleError, TextIndex, VectorIndex
from recollect.streaming import ingest


def corpus(n=60):
    r = random.Random(4)
    common = ["the", "of", "and"]
    return [(i, " ".join(r.choice(common) if r.random() < 0.6 else f"w{r.randrange(30)}" for _ in range(r.randrange(3, 25)))) for i in range(n)] + [(n, None), (n + 1, "")]


QUERIES = [(1, ["w1", "w2"]), (2, ["the", "w3"]), (3, ["the", "of"]), (4, ["absent"]), (5, ["and", "w4", "w5", "absent"]), (6, [])]


def plain_bm25(rows, terms, need_all):
    docs = {i: Counter(c.split()) for i, c in rows if c is not None}
    n, mean = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    df = {t: sum(t in d for d in docs.values()) for t in terms}
    out = []
    for i, d in docs.items():
        hits = [t for t in terms if t in d]
        if hits and (not need_all or len(hits) == len(terms)):
            out.append((sum(round(max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * d[t] * 2.2 / (d[t] + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean)) * 2**40) for t in hits), i))
    return [(i, round(s / 2**40, 6)) for s, i in sorted(out, key=lambda x: (-x[0], x[1]))]


def hits_of(df):
    got = {}
    for x in sorted(df.collect(), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append((x.frame_id, x.score))
    return got


def same_hits(got, rows, queries, k, need_all):
    for query, terms in queries:
        want = plain_bm25(rows, terms, need_all)[:k]
        assert [i for i, _ in got.get(query, [])] == [i for i, _ in want]
        assert [s for _, s in got.get(query, [])] == pytest.approx([s for _, s in want], abs=2e-6)


@pytest.mark.parametrize("path", ["batch", "small blocks", "joined", "index"])
@pytest.mark.parametrize("need_all", [False, True])
def test_bm25_is_exact(spark, monkeypatch, tmp_path, path, need_all):
    """All paths rank alike, and as the plain version does."""
    rows = corpus()
    f = spark.createDataFrame(rows, "frame_id long, content string")
    q = spark.createDataFrame(QUERIES, "query_id long, terms array<string>")
    if path == "small blocks":
        monkeypatch.setattr(bm25, "CELLS", 17)
    if path == "joined":
        monkeypatch.setattr(bm25, "BATCH_TERMS", 1)
    if path == "index":
        monkeypatch.setattr(index_module, "BLOCK_FRAMES", 4)
        index = TextIndex(spark, str(tmp_path / "i"))
        index.add(f)
        f = index
    same_hits(hits_of(lanes.bm25(f, q, 7, need_all=need_all)), rows, QUERIES, 7, need_all)


def adversarial():
    """One term in just under half of the frames, fifteen terms in all others: what only common terms find may still come first."""
    n = 2001
    return [(i, " ".join(f"c{j}" for j in range(15)) + " " + " ".join(["pad"] * 40)) if i < 1001 else (i, "half") for i in range(n)], [(1, ["half", *(f"c{j}" for j in range(15))]), (2, ["half"]), (3, ["c1", "pad"])]


@pytest.mark.parametrize("path", ["batch", "joined", "index"])
def test_common_terms_count(spark, monkeypatch, tmp_path, path):
    rows, queries = adversarial()
    f = spark.createDataFrame(rows, "frame_id long, content string")
    if path == "joined":
        monkeypatch.setattr(bm25, "BATCH_TERMS", 1)
    if path == "index":
        monkeypatch.setattr(index_module, "BLOCK_FRAMES", 16)
        index = TextIndex(spark, str(tmp_path / "i"))
        index.add(f)
        f = index
    got = hits_of(lanes.bm25(f, spark.createDataFrame(queries, "query_id long, terms array<string>"), 3))
    same_hits(got, rows, queries, 3, False)
    assert [i for i, _ in got[1]] == [1001, 1002, 1003]


def test_scores_are_ranked_before_they_are_rounded(spark):
    """Frames whose scores are equal to six digits are in their true order."""
    rows = [(i, "x " + "y " * (1_000_000 - i)) for i in range(3)] + [(i, "z") for i in range(5, 9)]
    got = hits_of(lanes.bm25(spark.createDataFrame(rows, "frame_id long, content string"), spark.createDataFrame([(1, ["x"])], "query_id long, terms array<string>"), 5))
    assert [i for i, _ in got[1]] == [2, 1, 0] and len({s for _, s in got[1]}) == 1
    v = spark.createDataFrame([(1, [1.0, 1e-4]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "frame_id long, embedding array<double>")
    near = lanes.knn(v, spark.createDataFrame([(5, [1.0, 0.0])], "query_id long, embedding array<double>"), 3)
    assert [(r.frame_id, r.score) for r in near.orderBy("rank").collect()] == [(2, 1.0), (3, 1.0), (1, 1.0)]


def test_block_maxima_leave_blocks_closed(spark, tmp_path, monkeypatch):
    """Blocks that can't reach the k-th score aren't opened, and the result is that of all."""
    monkeypatch.setattr(index_module, "BLOCK_FRAMES", 8)
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["rare"] if r.random() < 0.001 else ["a", "b", "c", "d"]) for _ in range(r.randrange(5, 60)))) for i in range(3000)]
    index = TextIndex(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame(rows[:1800], "frame_id long, content string"))
    index.add(spark.createDataFrame(rows[1500:], "frame_id long, content string"))
    queries = [(1, ["rare", "a"]), (2, ["a"]), (3, ["b", "c", "absent"])]
    q = spark.createDataFrame(queries, "query_id long, terms array<string>")
    same_hits(hits_of(lanes.bm25(index, q, 10)), rows, queries, 10, False)
    opened = {x.query_id: x.opened / x.blocks for x in bm25.by_blocks(index, q, 10)[1].collect()}
    assert opened[1] < 0.5, opened
    assert index.compact()
    same_hits(hits_of(lanes.bm25(index, q, 10, need_all=True)), rows, queries, 10, True)


def test_marks_are_folded(spark):
    f = spark.createDataFrame([(1, "Café Zürich"), (2, "cafe zurich"), (3, "tea")], "frame_id long, content string")
    q = spark.createDataFrame([(1, "CAFÉ?")], "query_id long, query string").select("query_id", text.search_tokens(F.col("query"), marks=False).alias("terms"))
    assert {x.frame_id for x in lanes.bm25(f, q, 5).collect()} == {1, 2}
    assert spark.range(1).select(facts.alias_key(F.lit("  ＡＬＩＣＥ  Ｏ’Brién ﬁn "))).first()[0] == "alice o’brien fin"


def test_text_index(spark, tmp_path):
    """Segments, newer and removed frames, compaction: always what a search of the frames that count gives."""
    rows = corpus()
    q = spark.createDataFrame(QUERIES, "query_id long, terms array<string>")
    schema = "frame_id long, content string"

    def found(source):
        return sorted(map(tuple, lanes.bm25(source, q, 5).collect()))

    index = TextIndex(spark, str(tmp_path / "i"))
    assert found(index) == []
    assert index.add(spark.createDataFrame(rows[:40], schema)) == 0
    assert index.add(spark.createDataFrame(rows[40:], schema)) == 1
    live = dict(rows)
    assert found(index) == found(spark.createDataFrame(list(live.items()), schema))
    change = [(3, "w1 w1 w2 new"), (5, None), (99, "w3")]
    assert index.add(spark.createDataFrame(change, schema)) == 2
    live |= dict(change)
    want = found(spark.createDataFrame(list(live.items()), schema))
    assert found(index) == want
    assert index.compact() is True
    assert index.compact() is False
    assert len(index.segments()) == 1
    assert found(TextIndex(spark, str(tmp_path / "i"))) == want


def test_vector_index(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v"))
    schema = "seq long, frame_id long, embedding array<float>"
    first = [(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0]), (3, 1, [0.5, 0.5])]
    assert index.add_after(spark.createDataFrame(first, schema)) == 0
    assert index.add_after(spark.createDataFrame(first, schema)) is None
    more = [*first, (4, 3, [2.0, 2.0]), (5, 2, None)]
    assert index.add_after(spark.createDataFrame(more, schema)) == 1
    assert index.last_seq() == 5
    assert {x.frame_id: list(x.embedding) for x in index.vectors().collect()} == {1: [0.5, 0.5], 3: [2.0, 2.0]}
    with pytest.raises(IndexRuleError):
        index.add(spark.createDataFrame([(9, [1.0, 2.0, 3.0])], "frame_id long, embedding array<float>"))
    with pytest.raises(IndexRuleError):
        index.add(spark.createDataFrame([(9, [1.0]), (8, [1.0, 2.0])], "frame_id long, embedding array<float>"))
    assert index.compact() is True
    assert index.add_after(spark.createDataFrame([(1, 7, [4.0, 4.0])], schema)) == 3
    assert {x.frame_id for x in index.vectors().collect()} == {7}


@pytest.mark.parametrize("metric", lanes.METRICS)
def test_knn_in_blocks(spark, monkeypatch, metric):
    """Many queries in blocks give what few at once give; vectors of other lengths are no candidates."""
    r = np.random.default_rng(3)
    v = [(i, r.normal(size=4).round(3).tolist()) for i in range(50)] + [(60, [1.0, 2.0]), (61, None), (62, [None, 1.0, 2.0, 3.0])]
    f = spark.createDataFrame(v, "frame_id long, embedding array<double>")
    q = spark.createDataFrame([(i, r.normal(size=4).round(3).tolist()) for i in range(9)] + [(20, [1.0, 1.0])], "query_id long, embedding array<double>")
    one = sorted(map(tuple, lanes.knn(f, q, 4, metric=metric).collect()))
    monkeypatch.setattr(lanes, "QUERY_BLOCK", 3)
    monkeypatch.setattr(lanes, "ROW_BLOCK", 7)
    assert sorted(map(tuple, lanes.knn(f, q, 4, metric=metric).collect())) == one
    assert len(one) == 9 * 4 + 1


def test_phrases(spark):
    f = spark.createDataFrame([(1, "Red green BLUE."), (2, "green red blue"), (3, "a red-green blue sky"), (4, None)], "frame_id long, content string")
    q = spark.createDataFrame([(1, "red green blue"), (2, "blue sky"), (3, ""), (4, "no such")], "query_id long, phrase string")
    assert {tuple(x) for x in lanes.phrase_hits(f, q).collect()} == {(1, 1), (1, 3), (2, 3)}


def memory(spark):
    rows = [(1, "alpha beta", 10, "active", None, "chunk"), (2, "alpha", 20, "active", None, "chunk"), (3, "beta", 30, "deleted", None, "chunk"), (4, "beta gamma", 40, "active", 5, "chunk"), (5, "gamma", 50, "active", None, "chunk"), (6, "alpha beta", 60, "active", None, "surrogate")]
    return spark.createDataFrame(rows, "frame_id long, content string, ts_ms long, status string, superseded_by long, kind string").withColumn("metadata", F.create_map(F.lit("session_id"), (F.col("frame_id") % 2).cast("string")))


def test_unified_search(spark, tmp_path):
    f = memory(spark)
    q = spark.createDataFrame([(1, "alpha beta"), (2, "when was gamma"), (3, "absent"), (4, "  ")], "query_id long, query string")

    def run(request, **more):
        out = {}
        for x in unified(f, more.pop("vectors", None), more.pop("questions", q), request, **more).orderBy("query_id", "position").collect():
            out.setdefault(x.query_id, []).append((x.frame_id, tuple(x.sources)))
        return out

    alone = run(SearchRequest(mode="text", top_k=5))
    # All terms first; deleted, superseded and surrogate frames go after ranking.
    assert alone == {1: [(1, ("text",)), (2, ("text",))], 2: [(5, ("text",))]}
    index = TextIndex(spark, str(tmp_path / "t"))
    index.add(f.select("frame_id", "content"))
    assert run(SearchRequest(mode="text", top_k=5), index=index) == alone
    assert run(SearchRequest(mode="text", top_k=2, fallback=2))[3] == [(5, ("timeline",)), (2, ("timeline",))]
    assert 4 not in run(SearchRequest(mode="text", top_k=2, fallback=2))
    hybrid = run(SearchRequest(top_k=3))
    assert hybrid[2][0] == (5, ("text", "timeline"))
    assert {s for rows in (hybrid[1],) for _, s in rows} == {("text",)}
    # A structured hit takes its question out of the single lane's order, and no other.
    hits = spark.createDataFrame([(1, 5, 1)], "query_id long, frame_id long, rank int")
    both = run(SearchRequest(mode="text", top_k=5), structured=hits)
    assert (5, ("structured",)) in both[1]
    assert both[2] == alone[2]
    keep = fusion.frame_filter(metadata={"session_id": "1"}, after=10, before=50, only=[1, 5, 2])
    assert run(SearchRequest(mode="text", top_k=5, keep=keep)) == {1: [(1, ("text",))]}
    with pytest.raises(ValueError):
        unified(f, None, q, SearchRequest(mode="vector"))
    assert run(SearchRequest(top_k=0)) == {}


def test_tokens_of_a_vocabulary(spark):
    own = BytePairs.from_file(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    texts = ["Hello wörld, it's 12 o'clock", "", None, "日本語 text " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    coder = own.coder()
    c = F.col("content")
    for x in df.select("doc_id", own.ids(c).alias("ids"), own.count(c).alias("n"), own.text(own.ids(c)).alias("back"), own.truncated(c, 5).alias("cut")).collect():
        want = coder.encode_ordinary(texts[x.doc_id] or "")
        assert (x.ids, x.n, x.back) == (want, len(want), texts[x.doc_id] or "")
        assert (x.cut or "") == (coder.decode_bytes(want[:5]).decode("utf-8", "ignore") if len(want) > 5 else texts[x.doc_id] or "")
    long = "some words and 123 more " * 30
    one = spark.createDataFrame([(1, long)], "doc_id long, content string")
    parts = context.chunks(one, target=20, overlap=0, vocabulary=own).orderBy("chunk").collect()
    assert "".join(p.content for p in parts) == long
    assert all(p.tokens <= 20 for p in parts)


def test_word_pieces(spark):
    words = ["[UNK]", "un", "##aff", "##able", "##ed", "hello", ",", "cafe"]
    got = [x[0] for x in spark.createDataFrame([("Unaffable, HELLO Café",), (None,), ("a" * 101 + " unaffed",)], "t string").select(WordPieces(words).ids(F.col("t"))).collect()]
    assert got == [[1, 2, 3, 6, 5, 7], [], [0, 1, 2, 4]]


def test_best_segment_ties(spark):
    """Within the tie the older frame wins; beyond it the score."""
    rows = [(1, 1, 0, 9, 0.5), (1, 1, 0, 3, 0.4994), (1, 1, 0, 2, 0.498), (1, 1, 1, 4, 0.9)]
    hits = spark.createDataFrame(rows, "query_id long, root_id long, index long, frame_id long, score double")
    assert {(x["index"], x.frame_id, x.place) for x in media.best_segments(hits).collect()} == {(1, 4, 1), (0, 3, 2)}


def test_metadata_merge_and_photo_kinds(spark):
    user, derived = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("9"), F.lit("c"), F.lit("3"))
    none = F.lit(None).cast("map<string,string>")
    row = spark.range(1).select(library.merged_metadata(user, derived).alias("x"), library.merged_metadata(none, derived).alias("y"), library.merged_metadata(user, none).alias("z")).first()
    assert row.x == {"a": "1", "b": "2", "c": "3"}
    assert row.y == {"b": "9", "c": "3"}
    assert row.z == {"a": "1", "b": "2"}
    kinds = spark.createDataFrame([(k,) for k in [*library.PHOTO.values(), "video.root"]], "kind string")
    assert {x.kind for x in kinds.filter(library.searchable_photo(F.col("kind"))).collect()} == set(library.PHOTO.values()) - {"photo.ocr.block"}


def test_context_takes_whole_texts_for_dates(spark):
    ranked = spark.createDataFrame([(1, "when did it launch", 1, 1, 0.9, "a ..."), (1, "when did it launch", 2, 2, 0.8, "b ..."), (2, "colours", 1, 1, 0.9, "a ..."), (2, "colours", 2, 2, 0.8, "b ...")], "query_id long, query string, frame_id long, position int, score double, preview string")
    contents = spark.createDataFrame([(1, "a whole"), (2, "b whole text")], "frame_id long, content string")
    got = {(x.query_id, x.kind): x.text for x in context.assemble(ranked, contents).collect()}
    assert got == {(1, "expanded"): "a whole", (1, "snippet"): "b whole text", (2, "expanded"): "a whole", (2, "snippet"): "b ..."}


def test_small_tables_are_spread(spark):
    df = spark.range(100).coalesce(1)
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(x.id for x in session.spread(df).collect()) == list(range(100))


# ------------------------------------------------------------ query syntax
def plain_boolean(query, docs):
    """Frames that a written query finds, clause by clause."""
    def words(t):
        return re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)))

    def holds(clause, w):
        if m := re.fullmatch(r"(\S+) NEAR(?:/(\d+))? (\S+)", clause):
            a, b = words(m[1])[0], words(m[3])[0]
            return any(x == a and y == b and (a == b or abs(i - j) - 1 <= int(m[2] or 10)) for i, x in enumerate(w) for j, y in enumerate(w))
        c = words(clause)
        if clause.endswith("*"):
            return any(x.startswith(c[0]) for x in w)
        return any(w[i : i + len(c)] == c for i in range(len(w)))

    found = set()
    for i, text_ in docs:
        w = words(text_ or "")
        for group in re.split(r"\s+OR\s+", query):
            parts = re.findall(r'-?(?:"[^"]*"|\S+ NEAR\S* \S+|[^\s"]+)', re.sub(r"\bNOT ", "-", re.sub(r"\bAND ", "", group)))
            parts = [x for x in parts if words(x)]
            must = [x for x in parts if not x.startswith("-")]
            if text_ is not None and must and all(holds(x, w) for x in must) and not any(holds(x[1:], w) for x in parts if x.startswith("-")):
                found.add(i)
    return found


@pytest.mark.parametrize("path", ["batch", "joined"])
def test_written_queries(spark, monkeypatch, path):
    if path == "joined":
        monkeypatch.setattr(boolean_module, "BATCH_TERMS", 1)
    r = random.Random(8)
    docs = [(i, " ".join(r.choice(["red", "Blue", "green", "grün", "bl", "e-mail", "x1"]) for _ in range(r.randrange(1, 12)))) for i in range(80)] + [(90, None), (91, ""), (92, "red"), (92, "red")]
    queries = ["red", "red AND blue", "red blue NOT green", 'red "blue green"', '-"blue green" red', "bl*", "bl* NOT blue", "red NEAR/1 x1", "x1 NEAR red", "red NEAR/0 blue OR grun NEAR/2 x1", "e-mail", 'red OR "bl bl" OR missing', "-red", "", "red NEAR/3 red", "BLUE grün*", '"red blue red"']
    f = spark.createDataFrame(docs, "frame_id long, content string")
    q = spark.createDataFrame([*enumerate(queries), (99, None)], "query_id long, query string")
    got = {}
    for x in boolean(f, q).collect():
        got.setdefault(x.query_id, set()).add(x.frame_id)
    for i, query in enumerate(queries):
        assert got.get(i, set()) == plain_boolean(query, docs), query
    assert 99 not in got
    first = boolean(f, q, 2).filter("query_id = 0").orderBy("rank").collect()
    assert [x.rank for x in first] == [1, 2] and first[0].score >= first[1].score
    both = sorted(map(tuple, boolean(f, q).collect()))
    monkeypatch.setattr(boolean_module, "BATCH_TERMS", 1 if path == "batch" else 1000)
    assert [x[:2] for x in both] == [tuple(x)[:2] for x in sorted(map(tuple, boolean(f, q).collect()))]
    assert boolean(f.limit(0), q).collect() == [] and boolean(f, q.limit(0)).collect() == []


# --------------------------------------------------------- streaming index
def test_index_stream_is_exactly_once(spark, tmp_path):
    """Killed after a segment was committed and before the stream knew: the restart adds nothing twice, and the index is that of the batch."""
    schema = "seq long, frame_id long, content string"
    r = random.Random(7)
    changes = [(i, r.randrange(12), None if r.random() < 0.15 else " ".join(r.choice(["a", "b", "c", "rare"]) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    for part in range(6):
        spark.createDataFrame(changes[part * 10 : part * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    queries = spark.createDataFrame([(1, ["a", "rare"]), (2, ["b"])], "query_id long, terms array<string>")
    index = TextIndex(spark, str(tmp_path / "index"))

    def run(on, checkpoint="ck", name="changes"):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = ingest.index_stream(stream, on, str(tmp_path / checkpoint), name=name, compact_after=3)
        q.awaitTermination()

    class Killed(TextIndex):
        left = 2

        def add(self, *args, **more):
            made = super().add(*args, **more)
            self.left -= 1
            if not self.left:
                raise RuntimeError("killed")
            return made

    with pytest.raises(Exception, match="killed"):
        run(Killed(spark, index.path))
    assert index.last_batch("changes") == 1
    run(index)
    run(index)  # nothing is left to do
    assert index.last_batch("changes") == 5 and len(index.segments()) <= 4
    newest = {}
    for seq, frame, content in changes:
        newest[frame] = content
    whole = TextIndex(spark, str(tmp_path / "whole"))
    whole.add(spark.createDataFrame(list(newest.items()), "frame_id long, content string"))
    want = sorted(map(tuple, lanes.bm25(whole, queries, 20).collect()))
    assert sorted(map(tuple, lanes.bm25(index, queries, 20).collect())) == want
    assert index.add(spark.createDataFrame([(99, "rare")], "frame_id long, content string"), batch=("changes", 5)) is None
    several = len(index.segments()) > 1
    assert index.compact() is several
    assert index.vacuum() > 0 and sorted(map(tuple, lanes.bm25(index, queries, 20).collect())) == want
    # The stream's place survives compaction.
    assert index.last_batch("changes") == 5


def test_two_writers_keep_both_commits(spark, tmp_path, monkeypatch):
    """Both saw the same last number; a compaction doesn't override what was added meanwhile."""
    schema = "frame_id long, content string"
    one, two = TextIndex(spark, str(tmp_path / "i")), TextIndex(spark, str(tmp_path / "i"))
    one.add(spark.createDataFrame([(1, "old"), (2, "old")], schema))
    stale = one._entries()
    two.add(spark.createDataFrame([(1, "middle")], schema))
    monkeypatch.setattr(one, "_entries", lambda: stale)
    assert one.add(spark.createDataFrame([(2, "new")], schema)) == 2
    monkeypatch.undo()
    seen = two.segments()
    assert [x.segment for x in seen] == [0, 1, 2]
    monkeypatch.setattr(one, "segments", lambda: seen)
    two.add(spark.createDataFrame([(1, "newest")], schema))
    one.compact()  # of the three that it saw
    monkeypatch.undo()
    q = spark.createDataFrame([(i, [w]) for i, w in enumerate(["old", "middle", "new", "newest"])], "query_id long, terms array<string>")
    assert {(x.query_id, x.frame_id) for x in lanes.bm25(two, q, 5).collect()} == {(2, 2), (3, 1)}


# --------------------------------------------------------- proximity graphs
@pytest.mark.parametrize("metric", lanes.METRICS)
def test_graph_search(spark, metric):
    """Most of the true neighbours from a small part of the distances, over several shards; odd vectors stay out."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 16))).round(4)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7000, None), (7001, [None] * 16), (7002, [float("nan")] * 16), (7003, [1.0])]
    v = spark.createDataFrame(rows, "frame_id long, embedding array<double>")
    q = v.filter("frame_id % 60 = 0 AND frame_id < 6000").select(F.col("frame_id").alias("query_id"), "embedding")
    graph = VectorGraph(v, metric=metric, shard_vectors=3000, k=10)
    assert graph.n == 6000 and graph.shards == 2
    got = graph.search(q).collect()
    want = {(r.query_id, r.frame_id): r.score for r in lanes.knn(v.filter("frame_id < 7000"), q, 10, metric=metric).collect()}
    found = {(r.query_id, r.frame_id): r.score for r in got}
    assert len(got) == 1000 and len(found) == 1000
    assert len(found.keys() & want.keys()) >= 950 and graph.measured >= 0.95
    assert all(found[k] == pytest.approx(want[k], abs=2e-6) for k in found.keys() & want.keys())
    assert sum(r.taken for r in got) / len(got) < 0.15 * 3000  # of small shards; the larger a shard, the smaller the part
    assert sorted({r["rank"] for r in got}) == list(range(1, 11))


def test_graph_of_few(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.0, 1.0])], "frame_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None), (7, [1.0])], "query_id long, embedding array<double>")
    assert [(r.query_id, r.frame_id, r.score) for r in VectorGraph(v, k=5).search(q).orderBy("rank").collect()] == [(9, 1, 1.0), (9, 2, 1.0), (9, 2, 0.0)]
    assert VectorGraph(v.limit(0)).search(q).collect() == []
    assert VectorGraph(v.limit(1)).search(q).count() == 1
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.add(v.limit(2))
    assert {r.frame_id for r in index.graph(k=1).search(q).collect()} == {1}


def test_snippets_cover_the_most_terms(spark):
    """Not the first hit but the stretch with the most different terms, the first of these; short texts whole."""
    rows = [("red " + "x " * 20 + "(Red) blue, green " + "y " * 20 + "blue green red", "...[(Red)] [blue,] [green] y y y y y y y..."), ("a b red", "a b [red]"), ("none here " * 8, "none here none here none here none here none here..."), ("", ""), ("x " * 12 + "BLEU bl\u00fce", "...x x x x x x x x BLEU [bl\u00fce]")]
    df = spark.createDataFrame([(i, t, w) for i, (t, w) in enumerate(rows)], "id long, text string, want string")
    terms = F.array(*map(F.lit, ["red", "blue", "green"]))
    assert [r.got for r in df.withColumn("got", lanes.snippets(F.col("text"), terms)).orderBy("id").collect()] == [w for _, w in rows]
