"""Findings of round 3, third part: what a plan computes once, and where."""

from __future__ import annotations

import re

from recollect.operators import answers as answering


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_answers_are_one_pass_over_dealt_items(spark):
    rows = [
        (1, "Who likes tea?", 7, 1, 0.0, "Nothing here.  Ada likes [tea] a lot."),
        (1, "Who likes tea?", 8, 0, 0.0, "Rain. Snow."),
        (2, "zzz", 9, 4, 0.0, "!!! "),
        (2, "zzz", 10, 3, 0.0, "???"),
        (3, "Which city did Ada move to?", 11, 0, 0.0, "Ada moved to Oslo."),
        (3, "Which city did Ada move to?", 12, 1, 5.0, "Bob moved to Rome."),
        (4, "Which city?", 13, 0, 0.0, "  "),
        (5, "What is Ada allergic to?", 14, 0, 0.0, "Ada is allergic to nuts."),
        (6, "Who owns readiness and when is the launch?", 15, 0, 0.0, "Ada owns deployment readiness. The public launch is March 5, 2026."),
    ]
    items = spark.createDataFrame(rows, "query_id long, query string, frame_id long, position int, score double, content string")
    found = answering.answers(items)
    plan = _plan(found)  # before it runs: a finished plan is told twice
    assert {r.query_id: r.answer for r in found.collect()} == {1: "Ada likes tea a lot", 2: "???", 3: "Rome", 5: "allergic to nuts", 6: "Ada and March 5, 2026"}
    assert len(re.findall(r"Scan", plan)) == 1 and "REPARTITION_BY_NUM" in plan


def test_alias_keys_are_made_of_distinct_words(spark, tmp_path):
    from recollect.plans.text_queries import alias_keys

    texts = ["Été été plain ÉTÉ", "été Ｎ１ ﬁn", None, "", "ascii only 42", "naïve été"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = alias_keys(spark, str(tmp_path))
    plan = _plan(found)
    assert sorted((r.word, r.alias_norm) for r in found.collect()) == [("naïve", "naive"), ("été", "ete"), ("ﬁn", "fin"), ("ｎ１", "n1")]
    # The key is made above the aggregate, so once for each word.
    assert plan.index("translate(") < plan.index("HashAggregate") and "translate(" not in plan[plan.rindex("Exchange") :]


def test_a_log_of_small_facts_is_read_once(spark):
    from recollect.operators.history import history

    none = None
    rows = [(1, "assert", "a", 0, none, 10, none, none), (2, "assert", "b", 0, 5, 20, none, none), (3, "retract", "a", none, none, none, none, 15), (4, "retract", "b", none, none, none, none, 20), (5, "assert", "a", 0, none, 10, none, none)]
    log = spark.createDataFrame(rows, "seq long, op string, fact_hash string, valid_from_ms long, valid_to_ms long, system_from_ms long, system_to_ms long, at_ms long")
    found = history(log)
    plan = _plan(found)
    assert sorted((r.fact_hash, r.seq, r.system_to_ms, r.assertions) for r in found.collect()) == [("a", 1, 15, 2), ("b", 2, None, 1)]
    assert "Join" not in plan and len(re.findall(r"Scan", plan)) == 1


def test_sweep_computes_each_lane_once(spark, monkeypatch):
    from recollect.operators import lanes
    from recollect.plans import search_queries

    calls = []
    for name in ("bm25", "knn"):
        monkeypatch.setattr(lanes, name, lambda *a, name=name, real=getattr(lanes, name), **k: (calls.append(name), real(*a, **k))[1])
    found = search_queries.hybrid_alpha_sweep(spark, "/root/testdata/sf0.001")
    assert sorted(calls) == ["bm25", "knn"]
    assert {r.alpha for r in found.select("alpha").distinct().collect()} == {0.0, 0.25, 1.0}
