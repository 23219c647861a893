"""Queries of fact histories: a log of assertions and retractions played as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import dates
from recollect.operators import facts
from recollect.operators import history as log
from recollect.plans.tables import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """A log of statuses of customers: each order asserts one for its year, known from its month on; returned lines retract it when they are shipped."""
    o = table(spark, sf, "orders")
    about = facts.fact_hash(F.col("o_custkey").cast("string"), F.lit("order_status"), F.lit(1), F.col("o_orderstatus"))

    def start(unit: str):
        return dates.millis(F.date_trunc(unit, F.col("o_orderdate")))

    none = F.lit(None).cast("long")
    known_to = F.when(F.col("o_orderpriority") == "5-LOW", dates.millis(F.col("o_orderdate")) + 8_640_000_000)
    asserted = o.select((F.col("o_orderkey") * 16).alias("seq"), F.lit("assert").alias("op"), about.alias("fact_hash"), start("year").alias("valid_from_ms"), F.when(F.col("o_orderstatus") == "F", start("year") + 31_536_000_000).alias("valid_to_ms"), start("month").alias("system_from_ms"), known_to.alias("system_to_ms"), none.alias("at_ms"))
    back = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    gone = back.select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("seq"), F.lit("retract").alias("op"), about.alias("fact_hash"), *[none.alias(c) for c in ("valid_from_ms", "valid_to_ms", "system_from_ms", "system_to_ms")], dates.millis(F.col("l_shipdate")).alias("at_ms"))
    return asserted.unionByName(gone)


def fact_history(spark: SparkSession, sf: str) -> DataFrame:
    """Every span that the log leaves, closed by the first retraction that wasn't rejected."""
    return log.history(_events(spark, sf))


def fact_retractions(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every retraction."""
    return log.retractions(_events(spark, sf))


# One event after another: the recursion carries the latest start of an open span of each fact.
_PLAYED = """WITH RECURSIVE a AS (SELECT o_orderkey * 16 AS seq, sha256(concat_ws(chr(31), o_custkey::varchar, 'order_status', '1', o_orderstatus)) AS fact_hash, epoch_us(date_trunc('year', o_orderdate)) // 1000 AS vf,
  CASE WHEN o_orderstatus = 'F' THEN epoch_us(date_trunc('year', o_orderdate)) // 1000 + 31536000000 END AS vt, epoch_us(date_trunc('month', o_orderdate)) // 1000 AS st, CASE WHEN o_orderpriority = '5-LOW' THEN epoch_us(o_orderdate) // 1000 + 8640000000 END AS se FROM orders),
 s AS (SELECT fact_hash, vf, vt, st, min(seq) AS seq, arg_min(coalesce(se, 9223372036854775807), seq) AS se, count(*) AS assertions FROM a GROUP BY ALL),
 r AS (SELECT l_orderkey * 16 + l_linenumber AS seq, a.fact_hash, epoch_us(l_shipdate) // 1000 AS at_ms FROM lineitem JOIN a ON a.seq = l_orderkey * 16 WHERE l_returnflag = 'R'),
 e AS (SELECT fact_hash, seq, CASE WHEN se = 9223372036854775807 THEN st END AS opens, NULL::bigint AS at_ms, 0 AS kind FROM s UNION ALL SELECT fact_hash, seq, NULL::bigint, at_ms, 1 FROM r),
 n AS (SELECT *, row_number() OVER (PARTITION BY fact_hash ORDER BY seq, kind, at_ms) AS i FROM e),
 p AS (SELECT fact_hash, seq, i, kind, at_ms, CASE WHEN kind = 1 THEN 'nothing' END AS outcome, opens AS latest FROM n WHERE i = 1
  UNION ALL SELECT n.fact_hash, n.seq, n.i, n.kind, n.at_ms, CASE WHEN n.kind = 1 THEN CASE WHEN latest IS NULL THEN 'nothing' WHEN latest < n.at_ms THEN 'closed' ELSE 'rejected' END END,
   CASE WHEN n.kind = 0 THEN greatest(latest, n.opens) WHEN latest < n.at_ms THEN NULL ELSE latest END FROM p JOIN n ON n.fact_hash = p.fact_hash AND n.i = p.i + 1)"""

QUERIES = {f.__name__: f for f in (fact_history, fact_retractions)}
ORACLES = {
    "fact_history": f"""{_PLAYED}, c AS (SELECT s.fact_hash, s.seq, arg_min(p.at_ms, p.i) AS at_ms FROM s JOIN p ON p.fact_hash = s.fact_hash AND p.seq > s.seq AND p.outcome = 'closed' GROUP BY ALL)
 SELECT s.fact_hash, s.seq, vf AS valid_from_ms, vt AS valid_to_ms, st AS system_from_ms, CASE WHEN se < 9223372036854775807 THEN se ELSE at_ms END AS system_to_ms, assertions FROM s LEFT JOIN c USING (fact_hash, seq)""",
    "fact_retractions": f"{_PLAYED} SELECT fact_hash, seq, at_ms, outcome FROM p WHERE kind = 1",
}
