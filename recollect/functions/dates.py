"""Date literals in text and times in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

# Month names and their short forms.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SHORT = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec"]
_NAME = f"(?:{'|'.join(MONTHS + sorted(SHORT, key=len, reverse=True))})"
LITERAL = rf"(?i)\b{_NAME}\.?\s+\d{{1,2}}(?:,\s*|\s+)\d{{4}}\b|\b\d{{1,2}}\s+{_NAME}\.?(?:,\s*|\s+)\d{{4}}\b|\b\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}\b"


def date_key(literal: Column) -> Column:
    """``YYYY-MM-DD`` of a date literal; null where no such day exists or the year is outside 1900-2999."""
    name = F.substring(F.regexp_extract(F.lower(literal), r"[a-z]+", 0), 1, 3)
    month = F.try_element_at(F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m[:3], str(i))]), name)
    named = F.concat_ws("-", F.regexp_extract(literal, r"\d{4}", 0), month, F.regexp_extract(literal, r"(?<!\d)\d{1,2}(?!\d)", 0))
    numbers = F.regexp_extract_all(literal, F.lit(r"\d+"), F.lit(0))
    day = F.try_to_date(F.when(literal.rlike("[A-Za-z]"), named).otherwise(F.array_join(numbers, "-")), "y-M-d")
    return once(day, lambda d: F.when(F.year(d).between(1900, 2999), F.date_format(d, "yyyy-MM-dd")))


def date_literals(text: Column) -> Column:
    """Literals of real days in order, without repeats."""
    return F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0))), lambda x: date_key(x).isNotNull())


def date_keys(text: Column) -> Column:
    """Sorted distinct days that a text names."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0)))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, date_key))))


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp, towards the past."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return ((micros - F.pmod(micros, F.lit(1000))) / 1000).cast("long")


def half_open(first_ms: Column, last_ms: Column) -> tuple[Column, Column]:
    """A closed range in milliseconds as a half-open one; the largest end stays."""
    return first_ms, F.when(last_ms == 9223372036854775807, last_ms).otherwise(last_ms + 1)


def age_hours(now_ms: Column, at_ms: Column) -> Column:
    return F.greatest(now_ms - at_ms, F.lit(0)) / 3_600_000.0
