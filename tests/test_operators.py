"""Golden cases of single operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from recollect.functions import dates, scores, text
from recollect.functions.embed import embed, hashed_vector
from recollect.operators import answers, context, facts, fusion, geo, lanes, maintenance, media
from recollect.plans.search import SearchRequest, recall, search
from recollect.sources import files
from recollect.sources.frames import Store, StoreError, check_dimensions
from recollect.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_fusion_golden(spark):
    a = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "query_id long, frame_id long, rank int")
    b = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id long, frame_id long, rank int")
    for alpha, first in ((0.5, 1), (1.0, 0), (0.0, 1)):
        w = spark.createDataFrame([(1, alpha, 1 - alpha)], "query_id long, text double, vector double")
        got = fusion.fuse({"text": a, "vector": b}, w).orderBy("position").collect()
        assert got[0].frame_id == first
        assert len(got) == (3 if alpha == 0.5 else 2)


@pytest.mark.parametrize("shuffles", [1, 4, 17])
def test_fusion_does_not_depend_on_partitions_or_order(spark, shuffles):
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    try:
        a = spark.createDataFrame([(q, f, f % 5 + 1) for q in range(4) for f in range(20)], "query_id long, frame_id long, rank int")
        w = spark.createDataFrame([(q, 0.5, 0.5) for q in range(4)], "query_id long, text double, vector double")
        x = [tuple(r) for r in fusion.fuse({"text": a, "vector": a.filter("rank < 4")}, w).select("query_id", "frame_id", "position").orderBy("query_id", "position").collect()]
        y = [tuple(r) for r in fusion.fuse({"vector": a.filter("rank < 4").repartition(7), "text": a.repartition(3)}, w).select("query_id", "frame_id", "position").orderBy("query_id", "position").collect()]
        assert x == y
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_bm25_ties_go_to_the_smaller_id(spark):
    f = spark.createDataFrame([(2, "alpha beta"), (1, "alpha beta"), (3, "gamma"), (4, "delta"), (5, None)], "frame_id long, content string")
    q = spark.createDataFrame([(7, ["alpha"])], "query_id long, terms array<string>")
    assert [r.frame_id for r in lanes.bm25(f, q, 10).orderBy("rank").collect()] == [1, 2]


def test_profile_sentence_wins(spark):
    docs = [(1, "Profile: Person18 moved to Seattle in 2021."), (2, "Person18 is allergic to peanuts."), (3, "Person18 prefers short status updates.")]
    f = spark.createDataFrame(docs, "frame_id long, content string")
    q = spark.createDataFrame([(1, "Which city did Person18 move to?")], "query_id long, query string")
    got = search(f, None, q, SearchRequest(mode="text", top_k=3)).orderBy("position").collect()
    assert got[0].frame_id == 1
    assert {r.frame_id for r in got} == {1, 2, 3}
    assert search(f, None, q, SearchRequest(mode="text", top_k=0)).count() == 0
    with pytest.raises(ValueError):
        search(f, None, q, SearchRequest(mode="vector"))


def test_settled_launch_date_wins(spark):
    docs = [(1, "Draft memo: the Atlas10 public launch target is tentative, maybe July 9, 2026."), (2, "The Atlas10 public launch is July 4, 2026.")]
    f = spark.createDataFrame(docs, "frame_id long, content string")
    q = spark.createDataFrame([(1, "When is the public launch of Atlas10?")], "query_id long, query string")
    assert search(f, None, q, SearchRequest(mode="text", top_k=2)).orderBy("position").first().frame_id == 2


def test_recall_fits_the_budget(spark):
    f = spark.createDataFrame([(i, f"alpha note {i} " + "word " * 50) for i in range(30)], "frame_id long, content string")
    q = spark.createDataFrame([(1, "alpha note")], "query_id long, query string")
    got = recall(f, None, q, SearchRequest(mode="text", top_k=20), budget=150).collect()
    assert sum(r.tokens for r in got) <= 150
    assert [r.kind for r in sorted(got, key=lambda r: r.item)][0] == "expanded"


@pytest.mark.parametrize(("literal", "key"), [("13 Aug 2026", "2026-08-13"), ("August 13 2026", "2026-08-13"), ("2026/8/13", "2026-08-13"), ("2026-02-30", None), ("31 Apr 2026", None), ("2026-13-01", None), ("2028-02-29", "2028-02-29"), ("Sept. 3, 2024", "2024-09-03")])
def test_dates(spark, literal, key):
    assert one(spark, dates.date_key(F.lit(literal))) == key
    assert one(spark, dates.date_keys(F.lit(f"on {literal} it was"))) == ([key] if key else [])


def test_segments_golden(spark):
    got = one(spark, media.segment_windows(F.lit(10_000).cast("long"), 4000, 1000, 100))
    assert [(s.start_ms, s.end_ms) for s in got] == [(0, 4000), (3000, 7000), (6000, 10000), (9000, 10000)]
    assert one(spark, media.segment_windows(F.lit(0).cast("long"), 4000, 1000, 100)) == []


def test_window_starts(spark):
    assert one(spark, context.window_starts(F.lit(24), 10, 3)) == [0, 7, 14]
    assert one(spark, context.window_starts(F.lit(24), 10, 10)) == [0, 10, 20]
    assert one(spark, context.window_starts(F.lit(5), 10, 3)) == [0]


def test_chunks_give_the_text_back(spark):
    t = "Ein Wörtchen, zwei 123 words — it's fine.\n\n" * 40
    df = spark.createDataFrame([(1, t), (2, "  "), (3, None)], "doc_id long, content string")
    got = context.chunks(df, target=50, overlap=0).orderBy("chunk").collect()
    assert "".join(r.content for r in got) == t


def test_facts_validity(spark):
    s = spark.createDataFrame([(1, 1, 100, 200, 0, None)], "span_id long, fact_id long, valid_from_ms long, valid_to_ms long, system_from_ms long, system_to_ms long")
    assert facts.as_of(s, valid_ms=100).count() == 1
    assert facts.as_of(s, valid_ms=200).count() == 0
    twice = spark.createDataFrame([(1, 50), (1, 50)], "fact_id long, at_ms long")
    assert facts.as_of(facts.retract(s, twice), system_ms=60, valid_ms=150).count() == 0
    assert facts.bad_retractions(s, spark.createDataFrame([(1, 0)], "fact_id long, at_ms long")).count() == 1


def test_aliases(spark):
    assert {one(spark, facts.alias_key(F.lit(a))) for a in ("Alice", "ALICE", " alice  ")} == {"alice"}


def test_answer_golden(spark):
    items = [(1, "Who owns deployment readiness and when is the public launch?", "Noah owns deployment readiness.", 1), (1, "Who owns deployment readiness and when is the public launch?", "The public launch is July 4, 2026.", 2), (2, "What is the dog's name and when was it adopted?", "They adopted a dog named Pixel in July 2024.", 1), (3, "Nothing of it?", "  ", 1)]
    df = spark.createDataFrame(items, "query_id long, query string, content string, position int").withColumn("score", F.lit(0.0))
    assert {r.query_id: r.answer for r in answers.answers(df).collect()} == {1: "Noah and July 4, 2026", 2: "Pixel in July 2024"}


def test_store_commits_and_recovers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with pytest.raises(StoreError):
        store.frames()
    m = spark.createDataFrame([(1, "put", 1, None, "a", 10), (2, "put", 2, None, "b", 20), (3, "supersede", 1, 2, None, None), (4, "delete", 2, None, None, None)], "seq long, op string, frame_id long, other_id long, content string, ts_ms long")
    assert store.commit(m.filter("seq < 3")) == 1
    assert store.commit(m.filter("seq < 3")) == 1
    assert store.commit(m) == 2
    got = {r.frame_id: r for r in store.frames().collect()}
    assert got[1].superseded_by == 2 and got[2].supersedes == 1 and got[2].status == "deleted"
    (tmp_path / "s" / "frames" / "g=9-partial").mkdir()
    assert store.head().generation == 2


def test_streaming_commit_and_counts(spark, tmp_path):
    schema = "seq long, op string, frame_id long, other_id long, content string, ts_ms long"
    for i in range(3):
        spark.createDataFrame([(i, "put", i, None, f"t{i}", i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    q = ingest.commit_stream(ingest.mutation_files(spark, str(tmp_path / "in"), schema, 1), store, str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert store.frames().count() == 3
    assert ingest.should_commit(90, 100, 128 * 1024, least=1) is True
    assert ingest.should_commit(10, 100, 128 * 1024) is False
    ops = spark.createDataFrame([("a", 1, "put", "x"), ("a", 3, "delete", None), ("b", 2, "put", "y")], "key string, seq long, op string, value string")
    assert {r.key: r.op for r in ingest.newest_per_key(ops).collect()} == {"a": "delete", "b": "put"}


def test_streaming_chunks_equal_the_batch(spark, tmp_path):
    rows = [(i, "some words here " * (i + 1) * 20) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, content string").write.parquet(str(tmp_path / "t"))
    stream = ingest.chunk_stream(spark.readStream.schema("doc_id long, content string").parquet(str(tmp_path / "t")), target=20, overlap=5)
    q = stream.writeStream.format("memory").queryName("chunks_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = context.chunks(spark.read.parquet(str(tmp_path / "t")), target=20, overlap=5)
    assert sorted(map(tuple, spark.sql("SELECT * FROM chunks_out").collect())) == sorted(map(tuple, batch.collect()))


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "frame_id long, content string")
    got = {r.frame_id: r.embedding for r in embed(df, dimensions=8).collect()}
    assert got[1] == got[3] != got[2]
    assert abs(sum(x * x for x in hashed_vector("a", 8)) - 1) < 1e-5
    assert check_dimensions(spark.createDataFrame([(1, [1.0])], "frame_id long, embedding array<float>")) == 1
    with pytest.raises(StoreError):
        check_dimensions(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "frame_id long, embedding array<float>"))


def test_text_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Höhe", encoding="utf-8")
    (tmp_path / "b.txt").write_text("   ")
    (tmp_path / "c.txt").write_bytes(b"\xff\xfe")
    got = files.text_files(spark, str(tmp_path)).collect()
    assert [(r.content, r.metadata["source_extension"]) for r in got] == [("# Höhe", "md")]


def test_small_functions(spark):
    assert one(spark, text.terms(F.lit("The studies moved quickly; boxes and cities"))) == ["study", "mov", "quickly", "box", "city"]
    assert one(spark, text.entity_terms(F.lit("Did Person 18 from atlas10 move to Oslo?"))) == ["atlas10", "oslo", "person", "person18"]
    assert one(spark, text.query_type(F.lit("What is this?"))) == "factual"
    assert one(spark, F.round(scores.clamp01(F.lit(float("nan"))), 3)) == 0.0
    h = 0xCBF29CE484222325
    for b in "héllo".encode():
        h = ((h ^ b) * 0x100000001B3) % 2**64
    assert one(spark, text.fnv1a(F.lit("héllo"))) % 2**64 == h
    assert one(spark, maintenance.drift(F.lit(100.0), F.lit(110.0))) == pytest.approx(10.0)


def test_budget_queries_walk_all_lines_of_a_customer(spark, tmp_path):
    """Lines after the fiftieth count: a small one is taken after many that don't fit."""
    from recollect.plans.context_queries import budget_greedy, token_budget_prefix

    quantity = {1: [60, *[50] * 59, 30, 10, 5], 2: [3] * 70, 3: [0] * 60}
    lines = [(100 * c + i // 7, i % 7 + 1, i, float(n), c) for c, own in quantity.items() for i, n in enumerate(own)]
    spark.createDataFrame([x[:4] for x in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(sorted({(x[0], x[4]) for x in lines}), "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    greedy, prefix = set(), set()
    for c, own in quantity.items():
        left, taken, used = 100, 0, 0
        for i, n in enumerate(own, 1):
            used += n
            if used <= 200:
                prefix.add((c, i, used))
            if n <= left and taken < 8:
                left, taken = left - n, taken + 1
                greedy.add((c, i, n))
    assert {(r.query_id, r.position, r.tokens) for r in budget_greedy(spark, str(tmp_path)).collect()} == greedy
    assert {(r.query_id, r.position, r.used) for r in token_budget_prefix(spark, str(tmp_path)).collect()} == prefix


def test_radius_join_equals_brute_force(spark):
    """Poles, the date line, radii from nothing to the whole globe; odd rows take no part."""
    r = random.Random(6)
    places = [(i, r.choice([r.uniform(-90, 90), 90.0, -90.0, 89.99, 0.0]), r.choice([r.uniform(-180, 180), 180.0, -180.0, 179.99, 540.0])) for i in range(400)] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, 91.0, 0.0), (903, 5.0, float("inf"))]
    asked = [(i, *r.choice(places[:400])[1:], r.choice([0.0, 1.0, 500.0, 1e4, 3e5, 2e6, 9e6, 1.2e7, 2e7])) for i in range(150)] + [(900, 0.0, 0.0, -1.0), (901, 0.0, 0.0, None), (902, None, 0.0, 1e9)]

    def apart(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return math.degrees(2 * math.asin(math.sqrt(min(h, 1.0)))) * media.METRES_PER_DEGREE

    p, q = spark.createDataFrame(places, "row long, lat double, lon double"), spark.createDataFrame(asked, "query_id long, lat double, lon double, radius_m double")
    got = {(x.query_id, x.row): x.metres for x in geo.radius_join(p, q).collect()}
    want = {(i, j): m for i, a, b, radius in asked[:150] for j, c, d in places[:400] if (m := apart(a, b, c, d)) <= radius}
    edge = {(i, j) for i, a, b, radius in asked[:150] for j, c, d in places[:400] if abs(apart(a, b, c, d) - radius) < 1e-3}
    assert got.keys() - edge == want.keys() - edge and len(want) > 5000
    assert all(abs(got[k] - want[k]) < 1e-3 for k in got.keys() & want.keys())
    assert geo.radius_join(p, q.limit(0)).collect() == [] and geo.radius_join(p.limit(0), q).collect() == []
