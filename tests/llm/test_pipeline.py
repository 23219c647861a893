"""The pipeline's stages against plainer versions of their decisions."""

import corpus_pipeline
from recollect.llm import common, language_id

from .test_models import LANGUAGES
from .test_word_operators import components


def test_pipeline(spark, tmp_path):
    import random

    r = random.Random(3)
    rows = []
    for i in range(40):
        lang = list(LANGUAGES)[i % 3]
        rows.append((i, " ".join(r.choice(LANGUAGES[lang]) + r.choice(["", "s", "er"]) for _ in range(60)), lang, f"s{i % 4}"))
    rows += [(100, rows[0][1], "en", "s1"), (101, rows[1][1] + " x@y.example.com", "de", "s1"), (102, "そのようなことはない" * 9, None, "s2"), (103, None, "en", "s0"), (104, "the with thing and that mail bob@site.example.org now", "en", None)]
    folder = str(tmp_path)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) AS bigint) AS n_chars")
    df.write.parquet(f"{folder}/documents.parquet")

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == df.columns
        docs.write.parquet(f"{folder}/{len(kept)}")
        docs = spark.read.parquet(f"{folder}/{len(kept)}")
        kept.append({x.doc_id: x.text for x in docs.collect()})
    told = {x.id for x in language_id.identify(df).collect() if x.kept}
    assert set(kept[0]) == told
    assert 102 not in told
    newest = {}
    for d in kept[0]:
        newest[kept[0][d] or ""] = max(d, newest.get(kept[0][d] or "", -1))
    assert set(kept[1]) == set(newest.values())
    want = {d for d, (_, c) in components(list(kept[1].items()), 5, 80).items() if c == d}
    assert set(kept[2]) == want
    assert kept[3][104] == "the with thing and that mail <EMAIL> now"
    common.mark()
    other = common.staged(spark.range(3))  # of another run
    packed = corpus_pipeline.run(spark, folder).collect()
    assert len(common._RUN.get()) <= 4  # what earlier stages staged is gone
    assert other.count() == 3
    assert {p.doc_id for p in packed} == set(kept[3])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "pii", "packing"]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids, rows that repeat, two texts under one id, an empty table."""
    german = " ".join(LANGUAGES["de"] * 8)
    other = " ".join(reversed(LANGUAGES["de"] * 9)) + " auf dem Tisch"
    rows = [(None, german, "de", "s"), (None, german, "de", "s"), (7, other, "de", "s"), (7, other, "de", "s"), (7, german + " und mehr mit der", "de", "s"), (8, None, "de", "s"), (9, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) AS bigint) AS n_chars", "1 AS _row", "2 AS row")
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
        docs = common.staged(docs)
    texts = [x.text for x in docs.collect() if x.text]
    assert len(texts) == len(set(texts))
    assert other in texts
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
