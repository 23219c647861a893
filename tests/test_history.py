"""Fact histories against a plain store that takes one event after another."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import history

SCHEMA = "seq long, op string, fact_hash string, valid_from_ms long, valid_to_ms long, system_from_ms long, system_to_ms long, at_ms long"


def plain(rows):
    """Spans and outcomes of a store that is updated row by row."""
    spans, outcomes = {}, []
    for seq, op, fact, vf, vt, sf, st, at in sorted(rows, key=lambda r: (r[0], r[1] == "retract", r[7] or 0, r[6] if r[6] is not None else 1 << 62)):
        if op == "assert":
            span = spans.setdefault((fact, vf, vt, sf), [seq, st, 0])
            span[2] += 1
            continue
        live = [(k, s) for k, s in spans.items() if k[0] == fact and s[1] is None]
        if not live:
            outcomes.append((fact, seq, at, "nothing"))
        elif any(k[3] >= at for k, _ in live):
            outcomes.append((fact, seq, at, "rejected"))
        else:
            outcomes.append((fact, seq, at, "closed"))
            for _, s in live:
                s[1] = at
    return sorted((k[0], s[0], k[1], k[2], k[3], s[1], s[2]) for k, s in spans.items()), sorted(outcomes)


def made(seed, n, facts, latest):
    r = random.Random(seed)
    rows = []
    for seq in range(n):
        fact = f"f{r.randrange(facts)}"
        now = 1 + seq * latest // n
        if r.random() < 0.6:
            rows.append((seq, "assert", fact, r.randrange(4), r.choice([None, 9]), now + r.randrange(latest // 3), r.choice([None, None, None, latest * 2]), None))
        else:
            rows.append((seq, "retract", fact, None, None, None, None, now + r.randrange(latest // 2)))
    return rows


def check(spark, rows, monkeypatch=None):
    want_spans, want_outcomes = plain(rows)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    events = spark.createDataFrame(shuffled, SCHEMA).repartition(5)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(x) for x in history.history(events).select("fact_hash", "seq", "valid_from_ms", "valid_to_ms", "system_from_ms", "system_to_ms", "assertions").collect()), key=key) == sorted(want_spans, key=key)
    assert sorted(tuple(x) for x in history.retractions(events).collect()) == want_outcomes


@pytest.mark.parametrize("seed", range(2))
def test_small_facts(spark, seed):
    check(spark, made(seed, 400, 25, 60))


@pytest.mark.parametrize("seed", range(2))
def test_a_large_fact_is_cut_into_cells(spark, monkeypatch, seed):
    monkeypatch.setattr(history, "CELL_BITS", 3)
    check(spark, made(10 + seed, 900, 2, 200))


def test_functions_of_cells_compose(spark):
    """Both functions one after another equal their composition, for all small cases that a log can give."""
    small = [history.NOTHING, 1, 2, 3]
    fs = [(t, c, b) for t in small for c in small for b in small if c <= b]
    rows = [(f, g, m) for f in fs for g in fs for m in small]
    df = spark.createDataFrame(rows, "f struct<t:long,c:long,b:long>, g struct<t:long,c:long,b:long>, m long")
    one = history._after(F.col("g"), history._after(F.col("f"), F.col("m")))
    assert df.filter(one != history._after(history._both(F.col("f"), F.col("g")), F.col("m"))).count() == 0


def test_ties_repeats_and_ill_formed_rows(spark):
    rows = [
        (5, "retract", "a", None, None, None, None, 7),  # same number: after the assertion
        (5, "assert", "a", 0, None, 1, None, None),
        (6, "assert", "a", 0, None, 1, None, None),  # known and closed: counts only
        (7, "retract", "a", None, None, None, None, 9),
        (8, "assert", "b", 0, 4, 5, 6, None),  # comes closed
        (9, "retract", "b", None, None, None, None, 9),
        (10, "assert", "c", 0, 4, 5, None, None),
        (11, "retract", "c", None, None, None, None, 5),  # not after its start
        (12, "retract", "c", None, None, None, None, 6),
        (12, "retract", "c", None, None, None, None, 8),
    ]
    check(spark, rows)
    bad = [(None, "assert", "a", 0, None, 1, None, None), (1, "assert", None, 0, None, 1, None, None), (1, "assert", "a", None, None, 1, None, None), (1, "retract", "a", 0, 0, 0, 0, None), (1, None, "a", 0, 0, 0, 0, 3), (1, "other", "a", 0, 0, 0, 0, 3)]
    events = spark.createDataFrame(rows + bad, SCHEMA).withColumn("state", F.lit("extra"))
    assert history.ill_formed(events).count() == len(bad)
    assert history.played(events).count() == len(plain(rows)[0]) + len(plain(rows)[1])


def test_empty(spark):
    assert history.played(spark.createDataFrame([], SCHEMA)).count() == 0
