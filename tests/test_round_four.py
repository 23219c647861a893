"""What the findings of round three named: memory of tasks, and work that follows the input."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recollect.functions.tokens import BytePairs
from recollect.operators import bm25, context, geo, lanes
from recollect.operators import boolean as boolean_module
from recollect.session import bounded


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def vocabulary() -> BytePairs:
    import public_tokenizers

    return BytePairs.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_windows_of_tokens_leave_one_pass(spark):
    """Ids stay in the task that makes them: no window carries its whole text and all its ids through the plan."""
    words = vocabulary()
    texts = {1: "one two", 2: " ".join(f"w{i} é" for i in range(900)), 3: None, 4: " \n", 5: "", 6: "x" * 5_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, content string")
    got = context.chunks(df, vocabulary=words, target=50, overlap=10)
    plan = plan_of(got)
    assert "ArrowEvalPython" not in plan and "Generate" not in plan
    want = []
    for k, text in texts.items():
        ids = words.coder().encode_ordinary(text or "")
        starts = [0] if len(ids) <= 50 else range(0, -(-(len(ids) - 50) // 40) * 40 + 1, 40)
        own = [(k, c, text if len(ids) <= 50 else words.coder().decode_bytes(ids[s : s + 50]).decode("utf-8", "ignore"), len(ids[s : s + 50])) for c, s in enumerate(starts)]
        want += [x for x in own if x[2] and x[2].strip(" \t\n\x0b\f\r")]
    assert sorted(tuple(x) for x in got.select("doc_id", "chunk", "content", "tokens").collect()) == want


def test_products_of_many_queries_are_bounded():
    """A block of rows meets thousands of queries in tiles; the results are those of plain products."""
    r = np.random.default_rng(3)
    q, x = r.normal(size=(4_096, 8)), r.normal(size=(2_048, 8))
    tracemalloc.start()
    try:
        parts = list(lanes._nearest({8: (np.arange(4_096), q)}, {8: (np.arange(2_048), x)}, 3, "dot"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120 << 20
    got = [(a, b) for p in parts for a, b in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)]
    assert got == [(i, j) for i, row in enumerate(np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :3].tolist()) for j in row]


def test_batches_are_unpacked_in_stretches():
    batch = pa.RecordBatch.from_pydict({"x": list(range(6))})
    assert [b.column(0).to_pylist() for b in bounded(batch, np.array([3, 0, 9, 1, 2, 2]), 4)] == [[0, 1], [2], [3, 4], [5]]


def test_stretches_of_tokens_change_no_result(spark, monkeypatch):
    rows = [(i, None if i == 5 else " ".join(f"w{(i * j) % 7}" for j in range(i % 9))) for i in range(40)]
    frames = spark.createDataFrame(rows, "frame_id long, content string").coalesce(2).cache()
    asked = spark.createDataFrame([(1, ["w1", "w2"]), (2, ["w3"])], "query_id long, terms array<string>")
    written = spark.createDataFrame([(1, 'w1 AND "w2 w3" OR w4 w5*'), (2, "w0 NEAR/2 w2")], "query_id long, query string")
    found = lambda: (sorted(map(tuple, lanes.bm25(frames, asked, 9).collect())), sorted(map(tuple, boolean_module.boolean(frames, written, 9).collect())))
    want = found()
    assert want[0] and want[1]
    monkeypatch.setattr(bm25, "TOKENS", 3)
    monkeypatch.setattr(boolean_module, "TOKENS", 3)
    assert found() == want


def test_tiers_unpack_one_document_at_a_time(spark):
    """The scan of a batch holds no list of all its documents."""
    import inspect

    assert "to_pylist()" not in inspect.getsource(context.surrogate_tiers)
    got = context.surrogate_tiers(spark.createDataFrame([(1, "A first sentence here. Another sentence there."), (2, None), (3, "")], "doc_id long, content string"))
    assert sorted(r.doc_id for r in got.collect()) == [1, 2, 3]


def test_wide_radii_are_dealt_into_many_tasks(spark):
    """Radii of a quarter of the globe have two cells; their places are dealt over all tasks, and none is lost or found twice."""
    places = spark.range(2_000).select(F.col("id").alias("place"), (F.col("id") * 37 % 1801 / 10 - 90).alias("lat"), (F.col("id") * 7919 % 3600 / 10 - 180).alias("lon"))
    asked = spark.createDataFrame([(1, 0.0, 0.0, 1.08e7), (2, 45.0, 170.0, 1.08e7), (3, -90.0, 0.0, 4e5)], "query_id long, lat double, lon double, radius_m double")
    got = geo.radius_join(places, asked).withColumn("part", F.spark_partition_id()).collect()
    at = {r.place: (r.lat, r.lon) for r in places.collect()}
    apart = lambda a, b: np.degrees(2 * np.arcsin(np.sqrt(min(1.0, np.sin(np.radians(b[0] - a[0]) / 2) ** 2 + np.cos(np.radians(a[0])) * np.cos(np.radians(b[0])) * np.sin(np.radians(b[1] - a[1]) / 2) ** 2))))
    want = [(q.query_id, p) for q in asked.collect() for p, x in at.items() if apart((q.lat, q.lon), x) <= q.radius_m / 111_000.0]
    assert sorted((r.query_id, r.place) for r in got) == sorted(want)
    assert len({r.part for r in got}) >= 16


def test_media_are_sorted_before_their_parts_are_made(spark, monkeypatch):
    """Only items are sorted by range, which reads them twice; parts are made, and texts joined, once."""
    from recollect.operators import library

    plans, placed = [], library.placed
    monkeypatch.setattr(library, "placed", lambda df, base: plans.append(plan_of(df)) or placed(df, base))
    videos = spark.createDataFrame([(7, 5, 15_000, True, None), (3, 6, 15_000, False, {"a": "b"}), (9, 8, 0, True, None)], "asset_id long, captured_ms long, duration_ms long, is_local boolean, metadata map<string,string>")
    pieces = spark.createDataFrame([(7, 0, 9_000, "one"), (7, 8_500, 14_000, "two"), (3, 0, 900, "no")], "asset_id long, from_ms long, to_ms long, text string")
    got = {(r.frame_id, r.asset_id, r.parent_id, r.content, r.search_text, r.metadata.get("segment_index"), r.metadata.get("segment_count")) for r in library.video_frames(videos, pieces, 4, length_ms=10_000).collect()}
    assert got == {(4, 3, None, None, None, None, None), (5, 7, None, None, None, None, None), (6, 7, 5, "one\ntwo", "one\ntwo", "0", "2"), (7, 7, 5, "two", "two", "1", "2"), (8, 9, None, None, None, None, None)}
    photos = spark.createDataFrame([(2, 5, True, "c", None, [(0.5, "x"), (0.9, "y")], None)], "asset_id long, captured_ms long, is_local boolean, caption string, tags string, blocks array<struct<confidence:double,text:string>>, metadata map<string,string>")
    assert [(r.frame_id, r.kind, r.content) for r in library.photo_frames(photos).orderBy("frame_id").collect()] == [(0, "photo.root", None), (1, "photo.caption.short", "c"), (2, "photo.ocr.summary", "y\nx"), (3, "photo.ocr.block", "x"), (4, "photo.ocr.block", "y")]
    for plan in plans:
        assert plan.count("rangepartitioning") == 1 and "Join" not in plan
        assert plan.rindex("Generate") < plan.index("rangepartitioning")


def test_roots_of_a_cascade_are_dealt_out(spark):
    """No task holds all roots, and none sorts the frames."""
    from recollect.operators import media

    frames = spark.createDataFrame([(1, None), (2, 1), (3, None), (4, 3), (5, 1)], "frame_id long, parent_id long")
    got = media.with_children(frames, spark.createDataFrame([(1,), (1,), (9,)], "frame_id long"))
    plan = plan_of(got)
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan and "Sort " not in plan
    assert sorted(r.frame_id for r in got.collect()) == [1, 2, 5]
