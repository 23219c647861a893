"""Library recall: newest rows of ranges against brute force, and what each kind of question gets."""

import random

import pytest

from recollect.plans.library_recall import library_recall, newest_in_range

FRAMES = "frame_id long, parent_id long, kind string, status string, superseded_by long, ts_ms long, content string, score string"
ASKED = "query_id long, query string, embedding array<float>, after_ms long, before_ms long, lat double, lon double, radius_m double"


@pytest.mark.parametrize("limit", [1, 3, 50])
def test_newest_in_range(spark, limit):
    r = random.Random(limit)
    rows = [(i, r.choice([None, *range(12)])) for i in range(60)]
    asked = [(i, r.choice([None, 2, 5, 11]), r.choice([None, 0, 3, 6, 40])) for i in range(30)]
    want = []
    for q, after, before in asked:
        inside = sorted((-t, i) for i, t in rows if t is not None and (after is None or t >= after) and (before is None or t < before))
        want += [(q, i, rank) for rank, (_, i) in enumerate(inside[:limit], 1)]
    got = newest_in_range(spark.createDataFrame(rows, "frame_id long, ts_ms long").repartition(4), spark.createDataFrame(asked, "query_id long, after_ms long, before_ms long"), limit)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def library(spark):
    frames = [
        (1, None, "photo.root", "active", None, 100, None, "clash"),
        (2, 1, "photo.caption.short", "active", None, 100, "a red boat on the lake", "clash"),
        (3, 1, "photo.tags", "active", None, 100, "boat water", "clash"),
        (4, None, "photo.root", "active", None, 200, None, "clash"),
        (5, 4, "photo.caption.short", "active", None, 200, "a green tree", "clash"),
        (6, None, "photo.root", "deleted", None, 300, None, "clash"),
        (7, 6, "photo.caption.short", "active", None, 300, "a boat of a deleted photo", "clash"),
        (8, None, "photo.root", "active", 4, 150, None, "clash"),
        (9, 8, "photo.caption.short", "active", None, 150, "boat superseded", "clash"),
        (10, None, "note", "active", None, 400, "boat in a note", "clash"),
        (11, None, "photo.root", "active", None, None, "  ", "clash"),
    ]
    vectors = spark.createDataFrame([(2, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [1.0, 0.1])], "frame_id long, embedding array<float>")
    places = spark.createDataFrame([(1, 10.0, 179.9), (4, 50.0, 8.0), (6, 10.0, 179.9), (11, None, 3.0)], "frame_id long, lat double, lon double")
    return spark.createDataFrame(frames, FRAMES), vectors, places


def ask(spark, rows, **settings):
    frames, vectors, places = library(spark)
    found = library_recall(frames, vectors, spark.createDataFrame(rows, ASKED), root_kind="photo.root", places=places, **settings)
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["position"])):
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_each_kind_of_question(spark):
    none = (None, None, None, None, None)
    got = ask(spark, [
        (1, "boat", None, *none),
        (2, None, [0.0, 1.0], *none),
        (3, "boat", [1.0, 0.0], *none),
        (4, None, None, 100, 200, None, None, None),  # half open
        (5, None, None, None, None, 10.0, -179.9, 50_000.0),  # across the date line
        (6, " ", None, *none),  # nothing asked
        (7, "boat", None, 150, None, None, None, None),  # its time has none
        (8, "boat", None, None, None, 50.0, 8.0, 10.0),  # another place
        (9, None, None, None, 1000, 50.0, 8.0, 10.0),
    ])
    ids = {q: [(r["root_id"], r["evidence"]) for r in rows] for q, rows in got.items()}
    assert ids == {1: [(1, ["text"])], 2: [(4, ["vector"]), (1, ["vector"])], 3: [(1, ["text", "vector"]), (4, ["vector"])], 4: [(1, ["timeline"])], 5: [(1, ["timeline"])], 9: [(4, ["timeline"])]}
    assert sorted(got[1][0]["parts"]) == [2, 3] and set(got[1][0]["summary"].split()) == set("a red boat on the lake water".split())
    assert got[4][0]["parts"] == [] and got[4][0]["summary"] == "" and got[4][0]["tokens"] == 0


def test_budget_and_limits(spark):
    none = (None, None, None, None, None)
    got = ask(spark, [(2, None, [0.0, 1.0], *none)], tokens=4, parts=1)
    assert [(r["tokens"], r["used"]) for r in got[2]] == [(2, 2), (2, 4)]
    assert len(ask(spark, [(2, None, [0.0, 1.0], *none)], limit=1)[2]) == 1
    assert ask(spark, [(2, None, [0.0, 1.0], *none)], tokens=1)[2][0]["tokens"] == 1  # the second root overflows


def test_empty_tables(spark):
    frames, vectors, _ = library(spark)
    one = spark.createDataFrame([(1, "boat", [1.0, 0.0], 0, 9, None, None, None), (2, None, None, 0, 900, None, None, None)], ASKED)
    assert library_recall(frames.limit(0), vectors.limit(0), one, root_kind="photo.root").count() == 0
    assert library_recall(frames, vectors, one.limit(0), root_kind="photo.root").count() == 0
    assert [r["root_id"] for r in library_recall(frames, vectors, one, root_kind="photo.root").orderBy("position").collect()] == [4, 1]  # without places
