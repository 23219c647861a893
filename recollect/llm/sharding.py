"""Shards of near equal size by sampled splitters, in DataFrame functions only.

1. Sizes and digests of all records are written once (no text is moved or read again).
2. Records larger than ``1 / (shards * GIANT)`` of all bytes, fewer than ``shards * GIANT`` by that very rule, are dealt out
   one by one, largest first, each to the lightest shard.  What they leave free of each shard is its capacity.
3. All others lie in order of (key, row number).  A sample of them, drawn with a chance in proportion to
   their size, gives quantile boundaries: the splitters of ranges of about ``RANGE_ROWS`` rows.  Ranges are measured exactly; an
   overfull one is subdivided by a denser sample of its own, and measured again.  A key that
   repeats can't overfill a range, since row numbers split it.
4. Exact running sums (of ranges, then within each) give every record its place in bytes; the shard whose capacity holds
   the record's middle takes it.  So shards are ranges of the key, equal up to a record smaller than ``1 / GIANT`` of a shard,
   and no task ever holds a shard.

The law is ``bytes``.  Equal texts may lie in several shards: a group of copies may be larger than one.

Defined cases: a null text has no bytes and the size of ``OVERHEAD``; a null key comes first; rows that repeat are records like
others; an empty table gives an empty result; fewer records than shards leave shards empty; further columns of the
input are ignored by :func:`assign`, and written by :func:`write_shards` whatever their names.
"""

from __future__ import annotations

import heapq
import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.session import spread

from .common import SPREAD_BYTES, numbered_rows, staged, table

SHARDS = 40
#: Bytes that a record has besides its text.
OVERHEAD = 16
#: Records from this part of a shard on are dealt out one by one.
GIANT = 32
#: Rows of a range, about; a range is sorted in one task.
RANGE_ROWS = 250_000
#: Ranges at least for each shard, and at most in all: bounds the splitters, which the driver holds.
LEAST_RANGES, MOST_RANGES = 4, 8192
#: Sampled keys for each range.
SAMPLES = 48
#: A range is overfull from this many times the mean rows or bytes on.
OVERFULL = 2
#: Steps of the uniform number that a record's hash gives.
_STEPS = 1 << 30


def assign(df: DataFrame, shards: int = SHARDS, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, shard, slot: a row for each row of ``df``."""
    known = F.coalesce(F.col(text), F.lit(""))
    digest = spread(df.select(F.col(key).alias("key"), known.alias("text")), SPREAD_BYTES)
    rows = staged(digest.select("key", _size(F.col("text")).alias("size"), F.crc32("text").alias("text_crc32"), F.monotonically_increasing_id().alias("row")))
    return place(rows, shards)


def _size(text: Column) -> Column:
    return F.octet_length(text).cast("long") + OVERHEAD


def place(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` (a written table with key, size and row, a number that no other row has) with shard and slot."""
    if shards < 1:
        raise ValueError("there must be a shard at least")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    n, total = sums.n, sums.bytes or 0
    if not n:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    giant = F.col("size") * (shards * GIANT) > total
    # Fewer than shards * GIANT rows: together they have no more than all bytes.
    giants = rows.filter(giant).orderBy(F.desc("size"), F.asc_nulls_first("key"), "row").select("row", "size").collect()
    dealt, loads = _lightest_first([(r.row, r.size) for r in giants], shards)
    at = F.element_at(_literal(dealt, "map<string,struct<shard:int,slot:bigint>>"), F.col("row").cast("string"))
    large = rows.filter(giant).withColumn("_at", at).withColumns({"shard": F.col("_at.shard"), "slot": F.col("_at.slot")}).drop("_at")
    if len(giants) == n:
        return large
    rest = rows.filter(~giant)
    ends, scale = _capacities(loads, total - sum(loads))
    # Giants come first in their shard.
    taken = [0] * shards
    for a in dealt.values():
        taken[a["shard"]] += 1
    return large.unionByName(_by_ranges(rest, n - len(giants), total - sum(loads), ends, scale, taken))


def _lightest_first(items: list[tuple[int, int]], shards: int) -> tuple[dict[str, dict], list[int]]:
    """Where each (row, size) goes, and the bytes of each shard then."""
    heap, loads, counts = [(0, s) for s in range(shards)], [0] * shards, [0] * shards
    out = {}
    for row, size in items:
        load, s = heapq.heappop(heap)
        out[str(row)] = {"shard": s, "slot": counts[s]}
        loads[s], counts[s] = load + size, counts[s] + 1
        heapq.heappush(heap, (load + size, s))
    return out, loads


def _capacities(loads: list[int], rest: int) -> tuple[list[int], int]:
    """Where each shard's part of the rest ends, as whole numbers of 1 / scale bytes: all shards are filled to one level."""
    below = sorted(loads)
    level, scale = 0, 1
    for k in range(1, len(below) + 1):
        if k == len(below) or rest + sum(below[:k]) <= k * below[k]:
            level, scale = rest + sum(below[:k]), k
            break
    return list(accumulate(max(0, level - scale * x) for x in loads)), scale


def _by_ranges(rest: DataFrame, n: int, total: int, ends: list[int], scale: int, taken: list[int]) -> DataFrame:
    """Rows with the shard that holds their middle, and their slot in it."""
    wanted = min(max(LEAST_RANGES * len(ends), -(-n // RANGE_ROWS)), MOST_RANGES)
    kind = rest.select("key", "row").schema.simpleString()
    place_of = F.struct("key", "row")

    def sample(of: DataFrame, chance: Column) -> list[dict]:
        drawn = of.filter(F.pmod(F.xxhash64("row", "key", "size"), F.lit(_STEPS)) < chance * _STEPS)
        return [json.loads(r.at) for r in drawn.select(F.to_json(place_of, {"ignoreNullFields": "false"}).alias("at"), place_of.alias("p")).orderBy("p").select("at").collect()]

    keys = sample(rest, F.col("size") * (wanted * SAMPLES / total))
    splitters = [keys[i * len(keys) // wanted] for i in range(1, wanted)] if len(keys) >= wanted else keys
    while True:
        ranged = rest.withColumn("range", _range_of(place_of, splitters, kind))
        measured = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).orderBy("range").collect()
        full = [r.range for r in measured if max(r.n / n, r.bytes / total) > OVERFULL / wanted and r.n > 1]
        if not full or len(splitters) > 4 * MOST_RANGES:
            break
        # Rows and bytes both count here: a range may be overfull by either.
        chance = (F.col("size") / F.lit(float(total)) + F.lit(1.0 / n)) * wanted * 2
        more = sample(ranged.filter(F.array_contains(F.lit(full), F.col("range"))), chance)
        grown = _in_order(splitters, more)
        if len(grown) == len(splitters):
            break
        splitters = grown
    before = dict(zip([r.range for r in measured], accumulate((r.bytes for r in measured), initial=0)))
    base = F.element_at(_literal([before.get(i, 0) for i in range(len(splitters) + 1)], "array<bigint>"), F.col("range") + 1)
    sums = "sum(size) OVER (PARTITION BY range ORDER BY key NULLS FIRST, row ROWS UNBOUNDED PRECEDING)"
    counts = "row_number() OVER (PARTITION BY range ORDER BY key NULLS FIRST, row)"
    middle = (F.col("_sum") + base) * 2 - F.col("size")
    shard = F.size(F.filter(F.lit(ends), lambda e: e * 2 <= middle * scale))
    placed = staged(ranged.withColumns({"_sum": F.expr(sums), "_n": F.expr(counts).cast("long")}).withColumn("shard", shard.cast("int")).drop("_sum"))
    # A piece is what a range gives to a shard: as many as ranges and shards together, at most.
    pieces = placed.groupBy("range", "shard").agg(F.min("_n").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.expr("sum(n) OVER (PARTITION BY shard ORDER BY range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    start = pieces.select("range", "shard", (earlier + F.element_at(F.lit(taken), F.col("shard") + 1) - F.col("first")).alias("_start"))
    return placed.join(F.broadcast(start), ["range", "shard"]).withColumn("slot", F.col("_n") + F.col("_start")).drop("_n", "_start", "range")


def _in_order(splitters: list[dict], more: list[dict]) -> list[dict]:
    """Both lists in one order, nulls first, without repeats."""
    seen = {(p["key"] is not None, p["key"] if p["key"] is not None else 0, p["row"]): p for p in splitters + more}
    return [seen[k] for k in sorted(seen)]


def _range_of(at: Column, splitters: list[dict], kind: str) -> Column:
    """How many splitters are not above a place: a binary search of the sorted literal."""
    known = _literal(splitters, f"array<{kind}>")
    steps = [1 << b for b in reversed(range(len(splitters).bit_length()))]
    if not steps:
        return F.lit(0)
    fits = lambda lo, s: (lo + s <= len(splitters)) & (F.get(known, lo + s - 1) <= at)
    return F.aggregate(F.lit(steps), F.lit(0), lambda lo, s: F.when(fits(lo, s), lo + s).otherwise(lo))


def _literal(value, kind: str) -> Column:
    """A value of a nested type as one constant."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, *, key: str = "doc_id", text: str = "text") -> None:
    """Write all records with all their columns under ``path``, a folder ``shard=i`` for each shard, in order of slots within each file.

    Records are dealt out by shard and stretch of slots, so no task writes a whole shard.
    """
    rows = numbered_rows(df, F.col(key).alias("key"), _size(F.coalesce(F.col(text), F.lit(""))).alias("size"), name="row_number")
    digest = staged(rows.select("key", "size", F.col("row_number").alias("row")))
    places = place(digest, shards).select(F.col("row").alias("row_number"), "shard", "slot")
    whole = rows.select("row_number", "row").join(places, "row_number").withColumn("stretch", F.floor(F.col("slot") / RANGE_ROWS))
    dealt = whole.repartition("shard", "stretch").sortWithinPartitions("shard", "slot")
    dealt.select("row", "slot", "shard").write.partitionBy("shard").parquet(path)


def op11_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return placed.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# The checksum by its definition, a byte at a time over a table of 256 remainders; large records by recursion.
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS r),
b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT doc_id, length(h) // 2 + {OVERHEAD} AS size,
  xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, x: xor(r[xor(c, x) % 256 + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS crc FROM b CROSS JOIN crc),
s AS (SELECT sum(size)::BIGINT AS total FROM d),
g AS (SELECT doc_id, size, row_number() OVER (ORDER BY size DESC, doc_id NULLS FIRST) AS i FROM d, s WHERE size * {SHARDS * GIANT} > total),
deal(i, loads, shard) AS (SELECT 0::BIGINT, list_transform(range({SHARDS}), lambda x: 0::BIGINT), NULL::INTEGER
  UNION ALL SELECT e.i, list_transform(range({SHARDS}), lambda x: loads[x + 1] + CASE WHEN x = e.at THEN e.size ELSE 0 END), e.at::INTEGER
  FROM (SELECT g.i, g.size, loads, list_position(loads, list_min(loads)) - 1 AS at FROM deal JOIN g ON g.i = deal.i + 1) e),
l AS (SELECT loads, list_sort(loads) AS below, total - list_sum(loads) AS rest FROM deal, s ORDER BY i DESC LIMIT 1),
k AS (SELECT loads, k, rest + list_sum(below[:k]) AS level FROM l, range(1, {SHARDS + 1}) t(k) WHERE k = {SHARDS} OR rest + list_sum(below[:k]) <= k * below[k + 1] ORDER BY k LIMIT 1),
e AS (SELECT k, list_transform(range({SHARDS}), lambda s: list_sum(list_transform(loads[:s + 1], lambda x: greatest(0, level - k * x)))) AS ends FROM k),
o AS (SELECT doc_id, size, 2 * sum(size) OVER (ORDER BY doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS middle FROM d, s WHERE size * {SHARDS * GIANT} <= total),
p AS (SELECT doc_id, 0 AS kind, i, shard FROM g JOIN deal USING (i) UNION ALL SELECT doc_id, 1, 0, len(list_filter(ends, lambda x: 2 * x <= middle * k))::INTEGER FROM o, e)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY kind, i, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard FROM p JOIN d USING (doc_id)
"""
