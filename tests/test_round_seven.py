"""Findings of round 4: scores that are rounded once, as their SQL does."""

from itertools import islice, product

import duckdb
import pytest

from recollect.operators import context
from recollect.plans import text_queries


def _long(n: int, distinct: int, begin: str = "") -> str:
    """A sentence of n words, so many of them distinct."""
    names = ["".join(x) for x in islice(product("abcdefghijklm", repeat=3), distinct)]
    return begin + " ".join((names * (n // distinct + 1))[:n]) + "."


#: n words and k distinct ones: 28 + 3k/n lies just below a half of the sixth digit (or on it, where its product with a million is just below).
NEAR = [(1001, 834), (1283, 940), (1409, 958), (2003, 1632), (640, 429), (640, 439), (1003, 130)]


def _against_sql(spark, folder, texts):
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(text_queries.ORACLES["sentence_salience"]).fetchall()
    found = [tuple(r) for r in text_queries.sentence_salience(spark, folder).select("doc_id", "score").collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(found, key=key) == sorted(want, key=key)
    return dict(found)


def test_scores_are_rounded_once(spark, tmp_path):
    texts = [(i, f"Short one. {_long(n, k, b)} Another.") for i, (n, k, b) in enumerate((n, k, b) for n, k in NEAR for b in ("", "- "))]
    got = _against_sql(spark, str(tmp_path), texts)
    assert got[0] == 30.4995 and got[9] == 32.010937


@pytest.mark.parametrize("text", ["", "  \n", None, ".", "...", " ", "One two three ", "Alpha. - beta gamma delta epsilon zeta", "Alpha. 　* beta: gamma!  "])
def test_odd_texts_score_as_in_sql(spark, tmp_path, text):
    _against_sql(spark, str(tmp_path), [(1, text), (2, "A plain sentence of some words."), (2, "Another, of the same document, with 2 digits."), (None, "No number here.")])


def test_first_of_equal_sentences_is_taken(spark):
    df = spark.createDataFrame([(1, "Alpha beta gamma delta. Delta gamma beta alpha. Short."), (2, "  "), (3, None)], "doc_id long, content string")
    assert [(r.doc_id, r.micro, r.score) for r in context.micro_surrogate(df).collect()] == [(1, "Alpha beta gamma delta.", 7.0), (2, None, None)]
