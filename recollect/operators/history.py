"""The history of facts from a log of assertions and retractions, whatever the order of its rows.

A retraction closes all spans of its fact that are open when it comes, unless one of them starts at or after its time:
then it is rejected and closes nothing.  So what an event does depends on the events before it.  What they leave is one
number, the latest start of an open span, and each event is a function of that number::

    m -> c where m < t, else max(m, b)            with c <= b

Such functions, done one after another, are again of this form.  So a fact's log is cut into cells of consecutive numbers;
each cell becomes one function, the functions of the cells are composed in the same way, and every cell then starts
from its own state.  No task holds more than a cell of a fact, however many events it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.session import staged

#: A cell has 2**CELL_BITS numbers; a fact with more events than that is cut, LEVELS times over.
CELL_BITS, LEVELS = 10, 3
NOTHING = -9223372036854775808  # no span is open


def _long(value: int | None) -> Column:
    return F.lit(value).cast("long")


def _step(below: Column, then: Column, least: Column) -> Column:
    return F.struct(below.alias("t"), then.alias("c"), least.alias("b"))


def _after(f: Column, m: Column) -> Column:
    return F.when(m < f["t"], f["c"]).otherwise(F.greatest(m, f["b"]))


def _both(f: Column, g: Column) -> Column:
    """First f, then g."""
    kept = f["b"] >= g["t"]
    return _step(F.when(kept, f["t"]).otherwise(F.greatest(f["t"], g["t"])), F.when(kept, _after(g, f["c"])).otherwise(g["c"]), F.greatest(f["b"], g["b"]))


def _before(units: DataFrame, same: Column, both: Callable, after: Callable, start: Column, levels: int = LEVELS) -> DataFrame:
    """Each unit (fact_hash, large, at, f, row) with ``state``, what the units of its fact before it leave of ``start``."""
    cell = F.when(F.col("large"), F.shiftright("at", CELL_BITS)) if levels else _long(None)
    packed = units.groupBy("fact_hash", "large", F.coalesce(cell, _long(0)).alias("cell")).agg(F.array_sort(F.collect_list(F.struct("at", "f", "row"))).alias("run"))
    if levels:
        cells = packed.filter("large").select("fact_hash", "large", F.col("cell").alias("at"), F.aggregate("run", same, lambda acc, x: both(acc, x["f"])).alias("f"), _long(None).alias("row"))
        entered = _before(cells, same, both, after, start, levels - 1).select("fact_hash", F.col("at").alias("cell"), "state")
        packed = packed.join(entered, ["fact_hash", "cell"], "left").withColumn("state", F.coalesce("state", start))
    else:
        packed = packed.withColumn("state", start)
    first = F.struct(F.col("state").alias("m"), F.slice(F.transform("run", lambda x: F.col("state")), 1, 0).alias("out"))
    states = F.aggregate("run", first, lambda acc, x: F.struct(after(x["f"], acc["m"]).alias("m"), F.concat(acc["out"], F.array(acc["m"])).alias("out")), lambda acc: acc["out"])
    each = packed.select("fact_hash", "large", F.explode(F.arrays_zip("run", states.alias("states"))).alias("z"))
    return each.select("fact_hash", "large", "z.run.at", "z.run.f", "z.run.row", F.col("z.states").alias("state"))


def _valid() -> Column:
    given = F.col("seq").isNotNull() & F.col("fact_hash").isNotNull()
    return F.coalesce(given & F.when(F.col("op") == "assert", F.col("valid_from_ms").isNotNull() & F.col("system_from_ms").isNotNull()).when(F.col("op") == "retract", F.col("at_ms").isNotNull()), F.lit(False))


def played(events: DataFrame) -> DataFrame:
    """fact_hash, seq, valid_from_ms, valid_to_ms, system_from_ms, system_to_ms, assertions; at_ms, outcome: spans and retractions of a log.

    ``events`` has seq, op (``assert`` or ``retract``), fact_hash; valid_from_ms, valid_to_ms, system_from_ms,
    system_to_ms of assertions; at_ms of retractions.  They count by ``seq``, which numbers the log; of rows with one
    number assertions come first, then retractions by time.

    * A span is asserted once: its first row (ties: the earliest end, an open one last) counts, later ones only add to ``assertions``, even if it is closed by then.
    * ``outcome`` of a retraction: ``closed``, ``nothing`` (no open span) or ``rejected``.
    The log is read once and staged while the plan is built, which also tells whether any fact is large enough to be cut.

    * Rows without what their kind needs, or of another kind, are left out (see :func:`ill_formed`).
    """
    good = events.filter(_valid())
    end = F.coalesce("system_to_ms", F.lit(9223372036854775807))
    spans = good.filter("op = 'assert'").groupBy("fact_hash", "valid_from_ms", "valid_to_ms", "system_from_ms").agg(F.min(F.struct("seq", end.alias("end"))).alias("first"), F.count(F.lit(1)).alias("assertions"))
    spans = spans.withColumn("system_to_ms", F.nullif("first.end", F.lit(9223372036854775807)))
    span_row = F.struct(F.col("first.seq").alias("seq"), "valid_from_ms", "valid_to_ms", "system_from_ms", "system_to_ms", "assertions", _long(None).alias("at_ms"))
    opens = F.when(F.col("system_to_ms").isNull(), F.col("system_from_ms")).otherwise(_long(NOTHING))
    gone = good.filter("op = 'retract'")
    gone_row = F.struct("seq", *[_long(None).alias(c) for c in ("valid_from_ms", "valid_to_ms", "system_from_ms", "system_to_ms", "assertions")], "at_ms")
    units = spans.select("fact_hash", (F.col("first.seq") * 2).alias("at"), _step(_long(NOTHING), _long(NOTHING), opens).alias("f"), span_row.alias("row"))
    units = units.unionByName(gone.select("fact_hash", (F.col("seq") * 2 + 1).alias("at"), _step(F.col("at_ms"), _long(NOTHING), _long(NOTHING)).alias("f"), gone_row.alias("row")))
    units = staged(units)
    sizes = units.groupBy("fact_hash").agg((F.count(F.lit(1)) > (1 << CELL_BITS)).alias("large")).filter("large")
    levels = LEVELS if sizes.take(1) else 0
    if levels:
        units = staged(units.join(sizes, "fact_hash", "left").withColumn("large", F.coalesce("large", F.lit(False))))
    else:  # no fact is cut: each is one cell
        units = units.withColumn("large", F.lit(False))
    none = _long(NOTHING)
    seen = _before(units, _step(none, none, none), _both, _after, none, levels)
    if levels:
        seen = staged(seen)  # read once for each level
    at_ms = F.col("row.at_ms")
    outcome = F.when(at_ms.isNotNull(), F.when(F.col("state") == NOTHING, "nothing").when(F.col("state") < at_ms, "closed").otherwise("rejected"))
    # Backwards: the next retraction that closes.
    back = seen.select("fact_hash", "large", (-F.col("at")).alias("at"), F.when(outcome == "closed", at_ms).alias("f"), F.struct("row.*", outcome.alias("outcome")).alias("row"))
    last = _before(back, _long(None), lambda f, g: F.coalesce(g, f), lambda f, m: F.coalesce(f, m), _long(None), levels)
    return last.select("fact_hash", "row.seq", "row.valid_from_ms", "row.valid_to_ms", "row.system_from_ms", F.when(F.col("row.at_ms").isNull(), F.coalesce("row.system_to_ms", "state")).alias("system_to_ms"), "row.assertions", "row.at_ms", "row.outcome")


def history(events: DataFrame) -> DataFrame:
    """fact_hash, seq, valid_from_ms, valid_to_ms, system_from_ms, system_to_ms, assertions: all spans that a log leaves, see :func:`played`."""
    return played(events).filter("at_ms IS NULL").drop("at_ms", "outcome")


def retractions(events: DataFrame) -> DataFrame:
    """fact_hash, seq, at_ms, outcome of every retraction, see :func:`played`."""
    return played(events).filter("at_ms IS NOT NULL").select("fact_hash", "seq", "at_ms", "outcome")


def ill_formed(events: DataFrame) -> DataFrame:
    """Rows of a log that take no part in it."""
    return events.filter(~_valid())
