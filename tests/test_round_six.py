"""Open blocks pass on few rows, whichever way they are scored; shards are built apart and walked by unit vectors; texts are lower-cased once."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from recollect.functions import text
from recollect.operators import bm25, lanes
from recollect.sources import graph as graph_module
from recollect.sources import index as index_module
from recollect.sources.graph import VectorGraph
from recollect.sources.index import TextIndex
from tests.test_search import hits_of, same_hits


@pytest.mark.parametrize("path", ["groups", "small cells", "joined"])
def test_open_blocks_pass_on_few_rows(spark, tmp_path, monkeypatch, path):
    monkeypatch.setattr(index_module, "BLOCK_FRAMES", 64)
    if path != "groups":
        monkeypatch.setattr(bm25, *{"small cells": ("CELLS", 100), "joined": ("BATCH_TERMS", 1)}[path])
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcde") for _ in range(r.randrange(0, 30)))) for i in range(900)]
    index = TextIndex(spark, str(tmp_path / "i"))
    index.add(spark.createDataFrame(rows[:600], "frame_id long, content string"))
    index.add(spark.createDataFrame([(i, "a stale text") for i, _ in rows[500:550]], "frame_id long, content string"))
    index.add(spark.createDataFrame(rows[500:], "frame_id long, content string"))
    queries = [(1, ["a", "b"]), (2, ["e"]), (3, ["c", "absent"]), (4, ["absent"])]
    q = spark.createDataFrame(queries, "query_id long, terms array<string>")
    same_hits(hits_of(lanes.bm25(index, q, 3)), rows, queries, 3, False)
    if path == "groups":
        same_hits(hits_of(lanes.bm25(index, q, 3, need_all=True)), rows, queries, 3, True)
        found, opened = bm25.by_blocks(index, q, 3)
        most = {x.query_id: 3 * x.opened for x in opened.collect()}
        sizes = {x.query_id: x["count"] for x in found.groupBy("query_id").count().collect()}
        assert sizes.keys() == {1, 2, 3} and all(n <= most[i] for i, n in sizes.items())
        assert index.compact()
        same_hits(hits_of(lanes.bm25(index, q, 3)), rows, queries, 3, False)


def test_graphs_are_walked_by_unit_vectors(spark, monkeypatch):
    """Lengths are taken once and walks read half the bytes; what they find has the exact scores, also of zero and of huge vectors."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[5], x[7] = 0.0, x[9] * 1e120
    seen = []
    plain = graph_module.scores
    monkeypatch.setattr(graph_module, "scores", lambda q, v, metric: seen.append((v.dtype, metric, v.nbytes)) or plain(q, v, metric))
    ids, s, _ = graph_module.walk(x[:20], x, graph_module.graph_of(x, "cosine"), 64, "cosine")
    assert {(d, m) for d, m, _ in seen[:-1]} == {(np.dtype(np.float32), "dot")} and seen[-1][:2] == (np.dtype(np.float64), "cosine")
    assert np.array_equal(s, plain(x[:20], x[ids], "cosine"))
    assert {7, 9} <= set(ids[7].tolist()) and not s[5].any()


def test_shards_are_built_in_tasks_of_their_own(spark):
    """Small shards, which adaptive execution would put into one task."""
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 4)))], "frame_id long, embedding array<double>")
    graph = VectorGraph(v, k=3, shard_vectors=50)
    q = v.filter("frame_id % 50 = 0").withColumnRenamed("frame_id", "query_id")
    assert graph.shards == 6 and len(graph.nodes.inputFiles()) > 2
    want = {(r.query_id, r.frame_id) for r in lanes.knn(v, q, 3).collect()}
    got = {(r.query_id, r.frame_id) for r in graph.search(q).collect()}
    assert len(got) == 18 and len(got & want) >= 16


def test_texts_are_lower_cased_once(spark):
    """Without diacritics or not, a text is lower-cased a single time before its words are taken."""
    made = spark.createDataFrame([("CAFÉ été, Tea",), ("",), (None,)], "c string").select(text.index_words(F.col("c")).alias("w"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [r.w for r in made.collect()] == [["cafe", "ete", "tea"], [], None]
