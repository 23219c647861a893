"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so (after ``CUT`` once ``MIN_CHUNK`` characters have passed,
after ``MAX_CHUNK`` at the latest).  Every chunk gets a 64-bit identifier; an identifier is
*verified* by grouping all chunks by identifier and bytes: where one identifier stands for two
different chunks, it is lengthened with the chunk's SHA-256.  Documents are then grouped by their
ordered identifier lists, which are hundreds of times shorter than the texts.  Only distinct chunks
are moved, once, after map-side combining.  :func:`keep_one` numbers the rows and drops the numbers of those
that go, so the texts that stay aren't moved.

Defined cases: null text counts as empty, and all empty texts are equal (their recipe is the empty
list).  A null ``doc_id`` never stays where a document with an id has the same text.  Rows that
repeat the id of the row that stays are all marked kept by :func:`exact_duplicates`, while
:func:`keep_one` leaves one row of each text.  An empty table gives an empty result; further columns of
the input are ignored, and kept by :func:`keep_one` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_of, numbered_rows, staged, table, without_rows

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Where content cuts: after one of these letters and a space.
CUT = "[ensrt] "
#: Bound on identifiers that stand for two chunks: expected are N^2 / 2^65, some hundreds at 10^11 chunks.
MAX_COLLISIONS = 100_000


def chunks_of(text, min_chunk: int = MIN_CHUNK, max_chunk: int = MAX_CHUNK):
    """The chunks of a text, in order; joined they are the text."""
    pattern = f"(?s).{{{min_chunk},{max_chunk - 2}}}?{CUT}|.{{{max_chunk}}}|.+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def collided(docs: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk."""
    distinct = docs.select(F.explode(chunks_of(F.col("text"))).alias("chunk")).select(F.xxhash64("chunk").alias("id"), "chunk").groupBy("id", "chunk").agg(F.lit(1).alias("one"))
    return distinct.groupBy("id").agg(F.sum("one").alias("n")).filter("n > 1").select("id")


def recipes(docs: DataFrame, ambiguous: list[int], with_digest: bool = True) -> DataFrame:
    """doc_id, recipe (ordered identifiers) and the text's digest."""
    return docs.select("doc_id", recipe_of(F.col("text"), ambiguous).alias("recipe"), *([F.sha2("text", 256).alias("text_sha256")] if with_digest else []))


def recipe_of(text, ambiguous: list[int]):
    if not ambiguous:
        return F.transform(chunks_of(text), lambda c: F.xxhash64(c))
    known = F.array(*map(F.lit, ambiguous))
    return F.transform(chunks_of(text), lambda c: F.concat_ws(":", F.xxhash64(c), F.when(F.array_contains(known, F.xxhash64(c)), F.sha2(c, 256))))


def ambiguous_ids(docs: DataFrame) -> list[int]:
    """All identifiers that stand for more than one chunk."""
    found = [r.id for r in collided(docs).limit(MAX_COLLISIONS + 1).collect()]
    if len(found) > MAX_COLLISIONS:
        raise ValueError("more chunk identifiers collide than a 64-bit hash allows")
    return found


def exact_duplicates(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row for each row of ``df``."""
    docs = documents_of(df, key=key, text=text)
    ambiguous = ambiguous_ids(docs)
    # The groups are written first, so that both sides of the join are shuffled for it and adaptive
    # execution can split a group of copies that is hot.
    groups = staged(recipes(docs, ambiguous, with_digest=False).groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    found = recipes(docs, ambiguous).join(groups, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def keep_one(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each text: that with the largest id."""
    recipe = recipe_of(F.coalesce(F.col(text), F.lit("")), ambiguous_ids(documents_of(df, key=key, text=text)))
    rows = numbered_rows(df, F.col(key).cast("long").alias("doc_id"), recipe.alias("recipe"))
    # Of ids and numbers, those of groups of copies; a null id is the smallest.
    order = F.struct("doc_id", "_row")
    groups = staged(rows.groupBy("recipe").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    lost = staged(rows.select("recipe", "_row").join(groups, "recipe").filter(F.col("_row") != F.col("best")["_row"]).select("_row"))
    return without_rows(rows.select("row", "_row"), lost)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
