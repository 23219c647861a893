"""Divergence of sources by run-length columns: how the word frequencies of each (language, source) differ from the others and from the language.

1. Terms are counted in each piece of the input (map side), then summed: one row for each (language, source, term).
2. A language keeps the terms of at least ``MIN_DOCUMENTS`` of its documents.  The share of a kept term in a group is
   ``p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``, in decimals without rounding; it depends on the count alone.
3. The vocabulary is reordered to cluster equal counts: a term's signature is the list of its (source, p), and terms of one
   signature become one *class* with their number.  Classes are dealt into blocks by a hash of their signature and sorted by it in a block.
4. In a block, each source's column is run-length encoded: stretches of terms with the same p; terms that it lacks have
   the p of a count of 0.  For each pair of sources the boundaries of both are intersected, and f = |p - q| is multiplied by the
   length of each common stretch.  Blocks give partial sums, added up at the end.

A block holds a bounded number of classes (``BLOCK_CLASSES``, about) with at most one entry for each source; the number of pairs is the
size of the result.  No task holds a language's vocabulary.

Defined cases: null text, language and source are ''; a group without terms has its pairs, and p of 0 counts; without kept
terms (V = 0) the values are 0; rows that repeat are documents like others; ties go to the smaller item in the order of UTF-8; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.session import spread

from .common import SPREAD_BYTES, lean, staged, table

MIN_DOCUMENTS = 30
SCALE, PRIOR = 1_000_000_000, 5
MOST_TERMS = 50
#: Classes of a block, about.
BLOCK_CLASSES = 2_000
#: Counts that a task holds before it passes them on.
HELD_COUNTS = 400_000
#: Terms: everything but ASCII characters that aren't letters ends one.
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256))
#: More than the words of the documents between two flushes.
_DOCUMENT = 1 << 36
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: bytes) -> list[str]:
    """Terms of a text in UTF-8.  Its bytes are lower-cased, by a table: only ASCII letters change, and a string with other letters takes many times as long."""
    return TERM.findall(text.translate(_LOWER).decode())


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it) of documents (lang, source, text); one row without a term for each group, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[str, int]] = {}
        new = 0
        for batch in batches:
            lang, source, text = batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                # Both counts of a term in one number: documents above, occurrences below.
                of = held.setdefault((lang[i].as_py(), source[i].as_py()), {})
                before, known = len(of), of.get
                for term, n in Counter(terms_of(text[i].as_py())).items():
                    of[term] = known(term, 0) + n + _DOCUMENT
                new += len(of) - before
                if new >= HELD_COUNTS:
                    yield from flushed(held)
                    held, new = {}, 0
        yield from flushed(held)

    def flushed(held) -> Iterator[pa.RecordBatch]:
        for (lang, source), of in held.items():
            both = np.fromiter((0, *of.values()), dtype=np.int64, count=len(of) + 1)
            names = [pa.repeat(pa.scalar(x, pa.string()), len(both)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, pa.array([None, *of], pa.string()), pa.array(both % _DOCUMENT), pa.array(both // _DOCUMENT)], schema=_COUNTS)

    parts = docs.select("lang", "source", "text").mapInArrow(lean(run), "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count, total, kept):
    """p of a count, exact: decimals of 38 digits, since a billion times a count may exceed 64 bits."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(19,0)")
    return F.call_function("div", top, (total + PRIOR * kept).cast("decimal(19,0)")).cast("long") + 1


def divergence(df: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", most_terms: int = MOST_TERMS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    docs = spread(df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]), SPREAD_BYTES)
    counts = staged(term_counts(docs))
    groups = counts.filter("term IS NULL").select("lang", "source")
    # A term has at most one entry for each source of its language.
    each = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang"), F.collect_list(F.struct("source", "n")).alias("by_source"))
    kept = staged(each.filter(F.col("docs") >= min_documents).drop("docs"))
    languages = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("of_lang").alias("of_lang_total"))
    entries = kept.select("lang", "term", "of_lang", F.inline("by_source"))
    totals = staged(_with_totals(groups, entries.groupBy("lang", "source").agg(F.sum("n").alias("total")), languages))
    shares = staged(entries.join(totals, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("of_lang"), F.col("of_lang_total"), F.col("kept")).alias("q")))
    pairs = _ranked(pair_values(totals, shares), "pair")
    terms = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(_ranked(terms, "term").filter(F.col("rank") <= most_terms))


def _with_totals(groups: DataFrame, sums: DataFrame, languages: DataFrame) -> DataFrame:
    """lang, source, total, kept, of_lang_total, none (p of a count of 0) of each group; none is null without kept terms."""
    out = groups.join(sums, ["lang", "source"], "left").join(languages, "lang", "left").fillna(0, ["total", "kept", "of_lang_total"])
    return out.withColumn("none", F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))))


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    rank = F.expr("row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)").cast("int")
    return rows.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def pair_values(totals: DataFrame, shares: DataFrame) -> DataFrame:
    """lang, source, item (each other source), value: sums of |p - q| over all kept terms."""
    signature = F.sort_array(F.collect_list(F.struct("source", "p")))
    classes = staged(shares.groupBy("lang", "term").agg(signature.alias("signature")).groupBy("lang", "signature").agg(F.count(F.lit(1)).alias("terms")))
    # As many blocks as a language's classes need, one at least; a block gets the sources of its language.
    blocks = classes.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES).cast("int").alias("blocks"))
    dealt = classes.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("signature"), F.col("blocks")).cast("int").alias("block"), "signature", "terms")
    last = F.coalesce("blocks", F.lit(1)) - 1
    sources = totals.join(blocks, "lang", "left").select("lang", "source", "none", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    partial = sources.groupBy("lang", "block").cogroup(dealt.groupBy("lang", "block")).applyInArrow(_block, "lang string, source string, item string, value long")
    whole = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return whole.select("lang", F.inline(F.array(F.struct(F.col("source"), F.col("item"), F.col("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("value")))))


def _block(sources: pa.Table, classes: pa.Table) -> pa.Table:
    """Partial sums of all pairs of a language's sources over the classes of a block."""
    # In the order of names, so that all blocks give a pair the same way round.
    names, none = (list(c) for c in zip(*sorted(zip(sources.column("source").to_pylist(), sources.column("none").to_pylist(), strict=True)), strict=True)) if len(sources) else ([], [])
    columns = encoded(names, none, classes)
    ends = columns.pop()
    a, b, value = [], [], []
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            a.append(names[i])
            b.append(names[j])
            value.append(crossed(columns[i], columns[j]) if ends else 0)
    lang = sources.column("lang")[0].as_py() if len(names) else None
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": pa.array(a, pa.string()), "item": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


def encoded(names: list[str], none: list[int | None], classes: pa.Table) -> list:
    """For each source the ends of its runs and their p, over the terms in order of their signatures; the number of terms comes last."""
    lists, many = classes.column("signature").combine_chunks(), classes.column("terms").to_numpy()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], classes.schema.field("signature").type)
    flat = lists.flatten()
    code = {n: i for i, n in enumerate(names)}
    which = np.fromiter((code[s] for s in flat.field("source").to_pylist()), dtype=np.int64, count=len(flat))
    p = flat.field("p").to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    # The order of signatures: by the first source, then its p, and so on; equal counts of common sources come to lie together.
    at = np.flatnonzero(np.diff(row, prepend=-1))
    keys = [tuple(zip(w, v, strict=True)) for w, v in zip(np.split(which, at[1:]), np.split(-p, at[1:]), strict=True)] if len(row) else []
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.arange(len(keys))
    end = np.cumsum(many[order]) if len(keys) else np.zeros(0, np.int64)
    start = np.concatenate((np.zeros(1, np.int64), end))
    total = int(start[-1])
    out: list = []
    by = np.lexsort((place[row], which)) if len(row) else np.zeros(0, np.int64)
    cut = np.searchsorted(which[by], np.arange(len(names) + 1))
    for i, zero in enumerate(none):
        mine = by[cut[i] : cut[i + 1]]
        out.append(_runs(place[row[mine]], p[mine], start, total, zero if zero is not None else 0))
    return [*out, total]


def _runs(place: np.ndarray, p: np.ndarray, start: np.ndarray, total: int, zero: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends and values of the runs of a column that has ``p`` at some classes and ``zero`` at all others."""
    bounds = np.empty(2 * len(place) + 1, dtype=np.int64)
    bounds[0:-1:2], bounds[1::2], bounds[-1] = start[place], start[place + 1], total
    values = np.full(2 * len(place) + 1, zero, dtype=np.int64)
    values[1::2] = p
    there = np.diff(bounds, prepend=0) > 0  # no stretch between neighbours
    bounds, values = bounds[there], values[there]
    last = np.flatnonzero(np.concatenate((values[1:] != values[:-1], np.ones(min(1, len(values)), dtype=bool))))
    return bounds[last], values[last]


def crossed(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of |p - q| times the length of each stretch between boundaries of either column."""
    ends = np.union1d(a[0], b[0])
    f = np.abs(a[1][np.searchsorted(a[0], ends)] - b[1][np.searchsorted(b[0], ends)])
    return int((f * np.diff(ends, prepend=0)).sum())


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(n.n, 0) + 5 * v.v) AS p,
  1 + (1000000000::HUGEINT * (k.c + 5)) // (v.n + 5 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM x JOIN x y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM x WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM pair
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM term) WHERE rank <= 50
"""
