"""Language identification by Bayesian evidence fusion.

The posterior of a language is proportional to

* the text's likelihood under a byte-trigram model of the language, tempered to ``TEMPER`` trigrams
  (neighbouring trigrams are not independent),
* P(declared markup language | language),
* P(address suffix | language),
* the host's prior: its own counts smoothed by those of its domain, which are smoothed by the corpus.

The trigram model tells every declared language apart.  It is fitted on a bounded sample of each: all its
rows up to ``TRAIN_DOCS``, about as many of a more frequent one, whatever the size of the table.  It is held
as the trigrams seen in each language; time and the row of scores grow with the number of languages.  The
other tables are grouped aggregates over all rows, by the language that the text alone suggests.  One more
class, ``und``, has all trigrams of ``UNKNOWN_ALPHABET`` letters alike; a row is rejected when it wins or when
no language reaches ``LEAST_POSTERIOR``.

The texts are read for the sample and once more for the scores; :func:`keep_known` carries the rows along with
their scores, so that no text is moved between tasks.  The tables of hosts, declared languages and
suffixes are broadcast only when they have at most ``BROADCAST_HOSTS`` rows and ``BROADCAST_VALUES`` numbers;
otherwise they are joined by shuffle, where adaptive execution splits a hot key.

Defined cases: missing evidence (null or empty text, declaration, address or host) leaves the
posterior to what there is; declared languages are compared by their primary subtag in lower case;
repeated rows count as often as they occur; an empty table, or one that declares no language,
rejects all its rows; a null id is an id like others, and rows that share one are judged by their own texts;
further columns are ignored by :func:`identify` and kept by :func:`keep_known`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, lean, mix, staged, table, text_buffer

BITS = 16
#: Rows of each declared language that the trigram model is fitted on.
TRAIN_DOCS = 5_000
TEMPER = 100.0
UNKNOWN_ALPHABET = 40
HOST_WEIGHT, DOMAIN_WEIGHT = 5.0, 5.0
LEAST_POSTERIOR = 0.5
BROADCAST_HOSTS, BROADCAST_VALUES = 100_000, 3_300_000
UND = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that aren't letters count as one separator.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams that hold a letter, and the text of each; runs of separators are one."""
    data, offsets = text_buffer(column)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.where(_LETTER[_LOWER[data]], _LOWER[data], 32).astype(np.uint8)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32) | (owner[1:] != owner[:-1])
    low, owner = low[keep].astype(U64), owner[keep]
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = low[:-2] << U64(16) | low[1:-1] << U64(8) | low[2:]
    good = (owner[:-2] == owner[2:]) & (low[1:-1] != 32)
    return (mix(code[good]) >> U64(64 - BITS)).astype(np.int64), owner[:-2][good]


class Trigrams:
    """Log-probabilities by language, the last row for the unknown.

    Counts come as ``at`` (language and trigram, ascending) and ``n``; what a language doesn't have is smoothed.
    """

    def __init__(self, languages: list[str], at: np.ndarray, n: np.ndarray):
        self.languages = [*languages, UND]
        cuts = np.searchsorted(at, np.arange(len(languages) + 1, dtype=np.int64) << BITS)
        self.seen = []
        for i in range(len(languages)):
            own = slice(cuts[i], cuts[i + 1])
            smooth = n[own] + 0.05
            total = smooth.sum() + 0.05 * ((1 << BITS) - len(smooth))
            self.seen.append(((at[own] & ((1 << BITS) - 1)).astype(np.uint16), np.log(smooth / total), math.log(0.05 / total)))

    def rows(self) -> Iterator[np.ndarray]:
        """Log-probabilities of all trigrams, a language at a time."""
        for code, log, other in self.seen:
            row = np.full(1 << BITS, other)
            row[code] = log
            yield row
        yield np.full(1 << BITS, -3 * math.log(UNKNOWN_ALPHABET))

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of trigrams and log-likelihoods of each text."""
        code, owner = trigrams(column)
        n = np.bincount(owner, minlength=len(column))
        return n, np.stack([np.bincount(owner, weights=row[code], minlength=len(column)) for row in self.rows()], axis=1)


def train(rows: DataFrame, *, train_docs: int = TRAIN_DOCS) -> Trigrams:
    """Fit on rows (id, text, declared) that declare a language."""
    known = rows.filter(F.col("declared") != "")
    often = {r.declared: r["count"] for r in known.groupBy("declared").count().collect()}
    languages = sorted(often)
    if not languages:
        return Trigrams([], np.zeros(0, np.int64), np.zeros(0))
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = np.array([number[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for at in range(0, batch.num_rows, 512):
                code, owner = trigrams(batch.column(0).slice(at, 512))
                keys, n = np.unique(which[at : at + 512][owner] << BITS | code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["at", "n"])

    shares = known.sparkSession.createDataFrame([(x, int(min(1.0, train_docs / often[x]) * (1 << 30))) for x in languages], "declared string, share long")
    sample = known.select("id", "text", "declared").join(F.broadcast(shares), "declared").filter(F.pmod(F.xxhash64("id", F.lit(61)), F.lit(1 << 30)) < F.col("share")).select("text", "declared")
    counts = sample.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().sort_by("at")  # the trigrams seen in each language
    return Trigrams(languages, counts.column("at").to_numpy(), counts.column("n").to_numpy())


def evidence(df: DataFrame, *, key: str, text: str, declared: str | None = None, url: str | None = None, host: str | None = None, whole: bool = False) -> DataFrame:
    """row, id, text, declared, host, suffix, domain of each row; missing values are empty.

    ``row`` is a struct of all columns but the text if the row is wanted ``whole``; else it is null.
    """

    def or_empty(name: str | None) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name else F.lit("")

    place = F.lower(F.regexp_extract(or_empty(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)) if url else F.lower(or_empty(host))
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    row = F.struct(*others) if whole and others else F.lit(None).cast("struct<none:int>")
    out = df.select(row.alias("row"), F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.lower(F.regexp_extract(or_empty(declared), "^[A-Za-z]{2,8}", 0)).alias("declared"), place.alias("host"))
    return out.select("*", F.regexp_extract("host", r"\.([a-z]{2,12})$", 1).alias("suffix"), F.coalesce(F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")), F.col("host")).alias("domain"))


def identify(df: DataFrame, *, key: str = "doc_id", text: str = "text", declared: str | None = "lang", url: str | None = None, host: str | None = "source", least: float = LEAST_POSTERIOR) -> DataFrame:
    """id, language, posterior, n_trigrams and kept for each row."""
    return judged(evidence(df, key=key, text=text, declared=declared, url=url, host=host), least, whole=False).drop("row", "text")


def judged(rows: DataFrame, least: float, *, whole: bool) -> DataFrame:
    """row, text, id, language, posterior, n_trigrams and kept for each row of :func:`evidence`; the text only with its row."""
    spark = rows.sparkSession
    model = train(rows)
    shared = spark.sparkContext.broadcast(model)
    names = model.languages
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, log = shared.value.scores(part.column(2))
                log = log * np.minimum(1.0, TEMPER / np.maximum(n, 1))[:, None]
                text = part.column(2) if whole else pa.nulls(part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text, *[part.column(i) for i in range(3, 7)], pa.array(n), pa.array(list(log), pa.list_(pa.float64())), pa.array(np.where(n > 0, log.argmax(1), -1), pa.int32())], names=[*part.schema.names, "n", "log", "guess"])

    kinds = T.StructType([*rows.schema.fields, T.StructField("n", T.LongType()), T.StructField("log", T.ArrayType(T.DoubleType())), T.StructField("guess", T.IntegerType())])
    seen = staged(rows.mapInArrow(lean(run), kinds))

    def numbers(values: list[float]) -> Column:
        return F.array(*[F.lit(float(x)) for x in values])

    def by_language(each: DataFrame, *columns: str) -> DataFrame:
        """columns, of: counts by guess as an array over the languages."""
        of = each.groupBy(*columns).agg(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("of"))
        return of.withColumn("of", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0.0))))

    def guesses(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.groupBy(*columns, "guess").agg(F.count(F.lit(1)).cast("double").alias("n"))

    def totals(each: DataFrame) -> list[float]:
        of = {r.guess: r.n for r in each.groupBy("guess").agg(F.sum("n").alias("n")).collect()}
        return [of.get(i, 0.0) for i in range(k)]

    def added(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    def held(df: DataFrame) -> DataFrame:
        df = staged(df)
        n = df.count()
        return F.broadcast(df) if n <= BROADCAST_HOSTS and n * k <= BROADCAST_VALUES else df

    total = totals(guesses(seen))
    overall = [(x + 1.0) / (sum(total) + k) for x in total]

    def likelihoods(column: str) -> DataFrame:
        """column, log P(column | language) by language: counts smoothed by one half."""
        each = staged(guesses(seen.filter(F.col(column) != ""), column))
        by = by_language(each, column)
        values = each.select(column).distinct().count()
        log = F.zip_with("of", numbers([x + 0.5 * (values + 1) for x in totals(each)]), lambda c, s: F.log((c + 0.5) / s))
        return held(by.select(column, log.alias(f"log_{column}")))

    each = staged(guesses(seen.filter(F.col("host") != ""), "host", "domain"))
    domains = by_language(each.groupBy("domain", "guess").agg(F.sum("n").alias("n")), "domain").withColumnRenamed("of", "of_domain")

    def size(of: str) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda a, x: a + x)

    hosts = by_language(each, "host", "domain").join(domains, "domain").select("host", "of", "of_domain", size("of").alias("n_host"), size("of_domain").alias("n_domain"))
    of_domain = F.zip_with("of_domain", numbers(overall), lambda d, p: (d + DOMAIN_WEIGHT * p) / (F.col("n_domain") + DOMAIN_WEIGHT))
    by_host = held(hosts.select("host", F.zip_with("of", of_domain, lambda c, p: F.log((c + HOST_WEIGHT * p) / (F.col("n_host") + HOST_WEIGHT))).alias("log_host")))

    fused = seen.join(by_host, "host", "left").join(likelihoods("declared"), "declared", "left").join(likelihoods("suffix"), "suffix", "left")
    total_log = added(F.col("log"), F.coalesce(F.col("log_host"), numbers([math.log(x) for x in overall])))
    for column in ("log_declared", "log_suffix"):
        total_log = F.when(F.col(column).isNull(), total_log).otherwise(added(total_log, F.col(column)))
    fused = fused.select("row", "text", "id", "n", total_log.alias("whole")).withColumn("top", F.array_max("whole"))
    fused = fused.select("row", "text", "id", "n", (F.array_position("whole", F.col("top")) - 1).cast("int").alias("best"), (1 / F.aggregate("whole", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("posterior"))
    language = F.array(*map(F.lit, names))[F.col("best")]
    return fused.select("row", "text", "id", language.alias("language"), "posterior", F.col("n").alias("n_trigrams"), ((F.col("posterior") >= least) & (language != UND)).alias("kept"))


def keep_known(df: DataFrame, *, key: str = "doc_id", text: str = "text", declared: str | None = "lang", url: str | None = None, host: str | None = "source", least: float = LEAST_POSTERIOR) -> DataFrame:
    """The rows of ``df`` whose language is told."""
    stay = judged(evidence(df, key=key, text=text, declared=declared, url=url, host=host, whole=True), least, whole=True).filter("kept")
    return stay.select(*[F.col("text").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in df.columns])


def visible_text(html: Column) -> Column:
    """Text of a page for language models: without scripts, styles and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On documents: the declared language is ``lang``, the host is ``source``."""
    return identify(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On pages, which have all four kinds of evidence."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", visible_text(F.col("html")).alias("text"), F.regexp_extract("html", r"(?i)<html[^>]*\slang=[\"']?([A-Za-z-]+)", 1).alias("lang"))
    return identify(pages, key="page_id", url="url", host=None).withColumnRenamed("id", "page_id")

