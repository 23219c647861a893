"""Files, commit logs and photo data as frames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIFF_BYTES = 8192
PDF_PAGES = 500


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """uri, content, metadata of UTF-8 files; empty and ill-formed ones are left out."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content", "length", "modificationTime")
    text = raw.withColumn("text", F.try_validate_utf8(F.col("content").cast("string"))).filter(F.col("text").isNotNull() & (F.regexp_replace("text", r"\s+", "") != ""))
    name = F.element_at(F.split("path", "/"), -1)
    return text.select(F.col("path").alias("uri"), F.col("text").alias("content"), file_metadata(name, F.col("path"), F.col("length")).alias("metadata"))


def file_metadata(name: Column, uri: Column, size: Column) -> Column:
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.create_map(F.lit("source_kind"), F.lit("file"), F.lit("source_uri"), uri, F.lit("source_filename"), name, F.lit("source_extension"), ending, F.lit("source_bytes"), size.cast("string"))


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """uri, content of PDF files; needs the optional package ``pypdf``."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the package pypdf") from e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from pypdf import PdfReader

        for batch in batches:
            out = []
            for content in batch.column(1).to_pylist():
                pages = PdfReader(io.BytesIO(content)).pages[:PDF_PAGES]
                out.append("\n\n".join(t for p in pages if (t := (p.extract_text() or "").strip())) or None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["uri", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "uri string, content string").filter("content IS NOT NULL")


# ------------------------------------------------------------- commit logs
HEADER = "COMMIT:"


def commits(lines: DataFrame) -> DataFrame:
    """hash, short, author, date, subject, diff from log text (log_id, text), whose commits start with ``COMMIT:h|s|a|d|subject``."""
    each = lines.select("log_id", F.posexplode(F.split("text", f"(?m)^{HEADER}")).alias("at", "part")).filter("at > 0")
    head = F.split(F.regexp_extract("part", r"^([^\n]*)", 1), r"\|", 5)
    body = F.regexp_replace("part", r"^[^\n]*\n?", "")
    diff = F.regexp_extract(body, r"(?s)(?m:^)(diff --git .*)", 1)
    message = F.regexp_replace(body, r"(?s)(?m:^)diff --git .*", "")
    return each.select("log_id", "at", head[0].alias("hash"), head[1].alias("short"), head[2].alias("author"), head[3].alias("date"), head[4].alias("subject"), F.trim(message).alias("body"), F.substring(diff, 1, DIFF_BYTES).alias("diff"), F.size(F.regexp_extract_all(body, F.lit(r"(?m)^diff --git "), F.lit(0))).alias("files_changed"))


def commit_content(c: DataFrame) -> Column:
    """The text of a commit's frame."""
    return F.concat(F.lit(HEADER), F.concat_ws("|", "hash", "short", "author", "date", "subject"), F.lit("\n"), F.col("body"), F.lit("\n"), F.col("diff"))


def commit_metadata() -> Column:
    return F.create_map(F.lit("hash"), F.col("hash"), F.lit("short_hash"), F.col("short"), F.lit("author"), F.col("author"), F.lit("date"), F.col("date"), F.lit("files_changed"), F.col("files_changed").cast("string"))


def new_commits(log: DataFrame, known: str | None) -> DataFrame:
    """Commits above the last known one in a log that goes from new to old."""
    if known is None:
        return log
    at = log.filter(F.col("hash") == known).groupBy("log_id").agg(F.min("at").alias("stop"))
    return log.join(F.broadcast(at), "log_id", "left").filter("stop IS NULL OR at < stop").drop("stop")


# ------------------------------------------------------------------ photos
def keywords(value: Column) -> Column:
    """Split on commas and semicolons, trimmed, without repeats (case apart); the first spelling stays."""
    parts = F.filter(F.transform(F.split(value, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(parts, F.lower)
    return F.filter(parts, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def signed_degrees(value: Column, reference: Column) -> Column:
    return F.when(F.upper(reference).isin("S", "W"), -F.abs(value)).otherwise(value)


def exif_millis(value: Column) -> Column:
    """Milliseconds of ``yyyy:MM:dd HH:mm:ss`` read as UTC."""
    return F.unix_millis(F.try_to_timestamp(value, F.lit("yyyy:MM:dd HH:mm:ss")))
