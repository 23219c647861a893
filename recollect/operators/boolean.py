"""Queries with AND, OR, NOT, quoted phrases, NEAR and prefixes, over positional postings: one plan for a whole batch.

A query is an OR of groups, a group an AND of clauses: ``budget "annual report" -draft OR plan* NEAR`` and so on.  :func:`clauses` takes
them apart by column functions:

* ``word``; ``-word`` or ``NOT word``: frames without it; ``AND`` may stand between clauses,
* ``"some words"``: adjacent words; so is a clause that splits into several words (``e-mail``),
* ``start*``: words that begin so,
* ``a NEAR/3 b``: both, with at most 3 words between them, in either order (``NEAR`` alone: 10).

Equal clauses of the batch are evaluated once.  Words are compared as the full-text index has them (lower case, no diacritics).

A batch of up to ``BATCH_TERMS`` words goes to every piece of the frames: its words' places, runs and nearness are looked up there, groups are
put together there, and only what was found leaves the task, with the counts that its score needs.  For more words, positional postings are
joined with the clauses.  Both give the same rows.

Defined cases: a group without a clause that must hold finds nothing; a clause without words is left out; null queries and null
contents find nothing; a NEAR of a word with itself means that word; rows that repeat a frame id are one frame.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.text import index_words
from recollect.operators.bm25 import BATCH_TERMS, TOKENS, UNIT, gain_column, gain_of, idf_column, idf_of, ranked
from recollect.session import bounded, spread, staged

#: Words between both sides of a NEAR without a number.
NEAR_DISTANCE = 10
_CLAUSE = r'-?(?:"[^"]*"|[^\s"]+\s+NEAR(?:/[0-9]+)?\s+[^\s"]+|[^\s"]+)'


def clauses(queries: DataFrame) -> DataFrame:
    """query_id, group, negated, kind (term, phrase, near, prefix), words, distance of queries (query_id, query)."""
    plain = F.regexp_replace(F.regexp_replace("query", r"(^|\s)NOT\s+", "$1-"), r"(^|\s)AND(?=\s|$)", " ")
    groups = queries.select("query_id", F.posexplode(F.split(plain, r"\s+OR\s+|^OR\s+|\s+OR$")).alias("group", "part"))
    each = groups.select("query_id", "group", F.explode(F.regexp_extract_all("part", F.lit(_CLAUSE), F.lit(0))).alias("clause"))
    near = F.col("clause").rlike(r"\sNEAR(/[0-9]+)?\s") & ~F.col("clause").contains('"')
    said = F.regexp_extract("clause", r"\sNEAR/([0-9]+)\s", 1)
    words = index_words(F.when(near, F.regexp_replace("clause", r"\sNEAR(/[0-9]+)?\s", " ")).otherwise(F.col("clause")))
    out = each.select("query_id", "group", F.col("clause").startswith("-").alias("negated"), near.alias("near"), F.rtrim("clause").endswith("*").alias("starred"), F.when(said != "", said.cast("int")).otherwise(NEAR_DISTANCE).alias("said"), words.alias("words")).filter(F.size("words") > 0)
    kind = F.when(F.col("near") & (F.size(F.array_distinct("words")) > 1), "near").when(F.size("words") > 1, F.when(F.col("near"), "term").otherwise("phrase")).when(F.col("starred"), "prefix").otherwise("term")
    out = out.withColumn("kind", kind)
    return out.select("query_id", "group", "negated", "kind", F.when(F.col("kind").isin("near", "term"), F.array_distinct("words")).otherwise(F.col("words")).alias("words"), F.when(F.col("kind") == "near", F.col("said")).otherwise(0).alias("distance"))


def positions(frames: DataFrame, terms: DataFrame) -> DataFrame:
    """term, frame_id, length, at (sorted word numbers) of some terms (term)."""
    tokens = _tokens(frames)
    each = tokens.select("frame_id", F.size("tokens").alias("length"), F.posexplode("tokens").alias("at", "term"))
    small = terms.limit(BATCH_TERMS + 1).count() <= BATCH_TERMS
    return each.join(F.broadcast(terms) if small else terms, "term", "left_semi").groupBy("term", "frame_id").agg(F.max("length").alias("length"), F.sort_array(F.collect_set("at")).alias("at"))


def _tokens(frames: DataFrame) -> DataFrame:
    return spread(frames.filter(F.col("content").isNotNull()).select("frame_id", "content")).select("frame_id", index_words(F.col("content")).alias("tokens"))


def starting(frames: DataFrame, prefixes: DataFrame) -> DataFrame:
    """atom, term: the words of the frames that begin with a prefix (atom, prefix), by an equality join on beginnings."""
    lengths = sorted(r.n for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect())
    if not lengths:
        return prefixes.select("atom", F.col("prefix").alias("term"))
    vocabulary = _tokens(frames).select(F.explode(F.array_distinct("tokens")).alias("term")).distinct()
    begins = vocabulary.select("term", F.explode(F.array(*[F.substring("term", 1, n) for n in lengths])).alias("prefix")).distinct()
    return begins.join(prefixes, "prefix").select("atom", "term").distinct()


def adjacent(lists: Column) -> Column:
    """Whether words (i, at), in order of i, stand next to each other somewhere."""
    shifted = F.transform(lists, lambda x: F.transform(x["at"], lambda p: p - x["i"]))
    return F.size(F.aggregate(F.slice(shifted, 2, F.greatest(F.size(lists), F.lit(1))), F.get(shifted, F.lit(0)), lambda a, b: F.array_intersect(a, b))) > 0


def within(lists: Column, distance: Column) -> Column:
    """Whether one occurrence each of all words (i, at) has at most ``distance`` other words between the first and the last: one pass over all places in order."""
    n = F.size(lists)
    places = F.array_sort(F.flatten(F.transform(lists, lambda x: F.transform(x["at"], lambda p: F.struct(p.alias("p"), x["i"].alias("i"))))))
    start = F.struct(F.array_repeat(F.lit(-1), n).alias("last"), F.lit(False).alias("found"))

    def step(state, place):
        last = F.transform(state["last"], lambda v, j: F.when(j == place["i"], place["p"]).otherwise(v))
        close = (F.array_min(last) >= 0) & (place["p"] - F.array_min(last) - n + 1 <= distance)
        return F.struct(last.alias("last"), (state["found"] | close).alias("found"))

    return F.aggregate(places, start, step, lambda state: state["found"])


def boolean(frames: DataFrame, queries: DataFrame, k: int | None = None) -> DataFrame:
    """query_id, frame_id, score, rank of the frames (frame_id, content) that queries (query_id, query) find, ranked by BM25.

    Words of clauses that must hold count, each once; prefixes and negated clauses add nothing.
    """
    k = k if k is not None else (1 << 31) - 1
    asked = clauses(queries)
    size = asked.agg(F.sum(F.size("words")).alias("n")).first().n or 0
    return _in_batch(frames, asked.toArrow().to_pylist(), asked.schema["query_id"].dataType.simpleString(), k) if size <= BATCH_TERMS else _joined(frames, asked, k)


class Batch:
    """Clauses of all queries: atoms (kind, words, distance), groups of atoms by query, words that count for its score."""

    def __init__(self, rows: list[dict]):
        self.atoms: list[tuple[str, tuple[str, ...], int]] = []
        known: dict = {}
        groups: dict = {}
        words: dict = {}
        for r in rows:
            atom = (r["kind"], tuple(r["words"]), r["distance"])
            if atom not in known:
                known[atom] = len(self.atoms)
                self.atoms.append(atom)
            groups.setdefault(r["query_id"], {}).setdefault(r["group"], (set(), set()))[r["negated"]].add(known[atom])
            if not r["negated"] and r["kind"] != "prefix":
                words.setdefault(r["query_id"], {}).update(dict.fromkeys(r["words"]))
        self.queries = list(groups)
        self.groups = [[(sorted(must), sorted(never)) for must, never in groups[q].values() if must] for q in self.queries]
        self.terms = sorted({w for q in words.values() for w in q})
        at = {w: i for i, w in enumerate(self.terms)}
        self.scored = [[at[w] for w in words.get(q, ())] for q in self.queries]


class Places:
    """Where the words of a batch of frames stand: ``codes`` of all tokens one after the other, ``row`` of each."""

    def __init__(self, tokens: pa.ListArray):
        flat = tokens.flatten().dictionary_encode()
        words = np.array(flat.dictionary.to_pylist(), dtype=object)
        order = np.argsort(words) if len(words) else np.zeros(0, np.int64)
        self.words = words[order]
        rank = np.empty(len(words), dtype=np.int64)
        rank[order] = np.arange(len(words))
        self.codes = rank[flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(flat) else np.zeros(0, np.int64)
        self.sizes = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.row = np.repeat(np.arange(len(tokens)), self.sizes)
        self.order = np.argsort(self.codes, kind="stable")
        self.first = np.searchsorted(self.codes[self.order], np.arange(len(words) + 1))

    def code(self, word: str) -> int:
        at = int(np.searchsorted(self.words, word))
        return at if at < len(self.words) and self.words[at] == word else -1

    def of(self, lo: int, hi: int) -> np.ndarray:
        """Places of the words lo .. hi - 1, in order."""
        return self.order[self.first[lo] : self.first[hi]]

    def rows(self, kind: str, words: tuple[str, ...], distance: int) -> np.ndarray:
        """Frames (rows) that hold an atom, in order."""
        if kind == "prefix":
            # The words that begin so are a range of the sorted ones.
            lo, hi = np.searchsorted(self.words, words[0]), np.searchsorted(self.words, words[0] + "\U0010ffff")
            return np.unique(self.row[self.of(lo, hi)])
        codes = [self.code(w) for w in words]
        if -1 in codes:
            return np.zeros(0, np.int64)
        lists = [self.of(c, c + 1) for c in codes]
        if kind == "term":
            return np.unique(self.row[lists[0]])
        if kind == "phrase":
            rarest = min(range(len(lists)), key=lambda i: len(lists[i]))
            start = lists[rarest] - rarest
            start = start[(start >= 0) & (start + len(codes) <= len(self.codes))]
            start = start[self.row[start] == self.row[start + len(codes) - 1]]
            for i, c in enumerate(codes):
                start = start[self.codes[start + i] == c]
            return np.unique(self.row[start])
        found = []
        for i, last in enumerate(lists):  # the word that comes last, and the nearest of all others before it
            earliest = last
            for j, other in enumerate(lists):
                if j != i:
                    at = np.searchsorted(other, last, side="right") - 1
                    earliest = np.minimum(earliest, np.where(at >= 0, other[np.maximum(at, 0)], -1))
            close = (earliest >= 0) & (self.row[np.maximum(earliest, 0)] == self.row[last]) & (last - earliest - len(codes) + 1 <= distance)
            found.append(self.row[last[close]])
        return np.unique(np.concatenate(found))


def _in_batch(frames: DataFrame, rows: list[dict], kind: str, k: int) -> DataFrame:
    batch = Batch(rows)
    shared = frames.sparkSession.sparkContext.broadcast(batch)
    schema = pa.schema([("query", pa.int32()), ("frame_id", pa.int64()), ("length", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        n, words, df = 0, 0, np.zeros(len(asked.terms), dtype=np.int64)
        for part in (x for whole in batches for x in bounded(whole, pc.fill_null(pc.list_value_length(whole.column(1)), 0).to_numpy(zero_copy_only=False), TOKENS)):
            frame, places = part.column(0).to_numpy(), Places(part.column(1))
            n, words = n + part.num_rows, words + len(places.codes)
            counts = []  # rows and numbers of occurrences of each word that counts
            for i, term in enumerate(asked.terms):
                c = places.code(term)
                counts.append(np.unique(places.row[places.of(c, c + 1)], return_counts=True) if c >= 0 else (np.zeros(0, np.int64),) * 2)
                df[i] += len(counts[-1][0])
            held: dict[int, np.ndarray] = {}
            at = lambda a: held[a] if a in held else held.setdefault(a, places.rows(*asked.atoms[a]))
            for q, groups in enumerate(asked.groups):
                hits = []
                for must, never in groups:
                    found = at(must[0])
                    for a in must[1:]:
                        found = np.intersect1d(found, at(a), assume_unique=True)
                    for a in never if len(found) else ():
                        found = np.setdiff1d(found, at(a), assume_unique=True)
                    hits.append(found)
                hit = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
                if not len(hit):
                    continue
                term, tf = [], []
                for t in asked.scored[q]:
                    row, many = counts[t]
                    place = np.minimum(np.searchsorted(row, hit), max(len(row) - 1, 0))
                    term.append(np.full(len(hit), t))
                    tf.append(np.where(row[place] == hit, many[place], 0) if len(row) else np.zeros(len(hit), np.int64))
                width = len(term)
                ends = pa.array(np.arange(len(hit) + 1, dtype=np.int32) * width)
                lists = [pa.ListArray.from_arrays(ends, pa.array((np.stack(x, 1).ravel() if width else np.zeros(0, np.int64)).astype(t))) for x, t in ((term, np.int32), (tf, np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), q, dtype=np.int32)), pa.array(frame[hit].astype(np.int64)), pa.array(places.sizes[hit]), *lists], schema=schema)
        # One row of the counts of this piece: frames, words, frames of each word.
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n]), pa.array([words]), pa.array([list(range(len(df)))], schema.field("terms").type), pa.array([df.tolist()], schema.field("tfs").type)], schema=schema)

    found = staged(_tokens(frames).select(F.col("frame_id").cast("long").alias("frame_id"), "tokens").mapInArrow(find, "query int, frame_id long, length long, terms array<int>, tfs array<long>"))
    pieces = found.filter("query < 0")
    n, words = pieces.agg(F.sum("frame_id"), F.sum("length")).first()
    df = {r.term: r.df for r in pieces.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.tfs").alias("df")).collect()}
    mean = words / n if n and words else 1.0
    idf = F.from_json(F.lit(json.dumps([idf_of(n or 0, df.get(i, 0)) for i in range(len(batch.terms))])), "array<double>")
    gain = F.transform(F.filter(F.arrays_zip("terms", "tfs"), lambda x: x["tfs"] > 0), lambda x: F.rint(gain_of(F.get(idf, x["terms"]), x["tfs"], F.col("length"), F.lit(float(mean))) * UNIT).cast("long"))
    raw = F.aggregate(gain, F.lit(0).cast("long"), lambda a, b: a + b)
    ids = F.from_json(F.lit(json.dumps(batch.queries)), f"array<{kind}>")
    scored = found.filter("query >= 0").select(F.get(ids, F.col("query")).alias("query_id"), "frame_id", raw.alias("raw"))
    return ranked(scored.groupBy("query_id", "frame_id").agg(F.max("raw").alias("raw")), k)


def _joined(frames: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    atom = F.concat_ws("\u0001", F.col("kind"), F.col("distance").cast("string"), F.array_join("words", " "))
    asked = staged(asked.withColumn("atom", atom))
    atoms = asked.select("atom", "kind", "words", "distance").distinct()
    expanded = staged(starting(frames, atoms.filter("kind = 'prefix'").select("atom", F.get("words", F.lit(0)).alias("prefix"))))
    plain = atoms.filter("kind <> 'prefix'").select("atom", "kind", "distance", F.size("words").alias("n"), F.posexplode("words").alias("i", "term"))
    found = staged(positions(frames, plain.select("term").unionByName(expanded.select("term")).distinct()))
    # Prefixes and single words: any posting; others: frames with all words, in their order or near each other.
    one = plain.filter("n = 1").select("atom", "term").unionByName(expanded).join(found, "term").select("atom", "frame_id").distinct()
    several = plain.filter("n > 1").join(found, "term").groupBy("atom", "frame_id").agg(F.array_sort(F.collect_list(F.struct("i", "at"))).alias("lists"), F.first("n").alias("n"), F.first("kind").alias("kind"), F.first("distance").alias("distance"))
    several = several.filter(F.size("lists") == F.col("n")).filter(F.when(F.col("kind") == "phrase", adjacent(F.col("lists"))).otherwise(within(F.col("lists"), F.col("distance")))).select("atom", "frame_id")
    # A group holds where all its clauses but the negated ones do, and none of these.
    parts = asked.select("query_id", "group", "atom", "negated").distinct()
    needed = parts.filter("NOT negated").groupBy("query_id", "group").agg(F.count(F.lit(1)).alias("needed"))
    held = parts.join(one.unionByName(several), "atom").groupBy("query_id", "group", "frame_id").agg(F.sum(F.when(F.col("negated"), 0).otherwise(1)).alias("held"), F.max("negated").alias("excluded"))
    hits = staged(held.join(needed, ["query_id", "group"]).filter("held = needed AND NOT excluded").select("query_id", "frame_id").distinct())
    # Scores of the words of what was found.
    n, mean = _lengths(frames)
    terms = asked.filter("NOT negated AND kind <> 'prefix'").select("query_id", F.explode("words").alias("term")).distinct()
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf_column(n))
    gains = hits.join(terms, "query_id").join(df, "term").join(found.select("term", "frame_id", "length", F.size("at").alias("tf")), ["term", "frame_id"]).groupBy("query_id", "frame_id").agg(F.sum(gain_column(mean)).alias("raw"))
    scored = hits.join(gains, ["query_id", "frame_id"], "left").select("query_id", "frame_id", F.coalesce("raw", F.lit(0)).alias("raw"))
    return ranked(scored, k)


def _lengths(frames: DataFrame) -> tuple[int, float]:
    row = _tokens(frames).select(F.size("tokens").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    return row.n, row["mean"] or 1.0
