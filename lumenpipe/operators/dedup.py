"""Messages delivered more than once: exactly one row per identifier.

An identifier is a producer and a sequence number. What was delivered of a producer is kept as disjoint ranges of numbers with the
number of copies of each. A delivered number opens a range and closes it again behind itself; openings and closings at one
place add up map-side, so that neighbours delivered equally often melt into one range and a number delivered a million times
is two rows. One sweep along the numbers then gives the ranges: those covered twice are repeats, those covered by ranges seen
before are no news. The number line of a producer is cut into blocks of 2**20 numbers, so that neither a hot producer nor its
ranges meet in one task. Identifiers that are not a number go by exact keyed lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import hex_id

BLOCK_BITS = 20


def hex_number(digits: Column) -> Column:
    """16 hexadecimal digits as a signed 64-bit number in the order of the unsigned ones; null if malformed."""
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint")
    number = (high - F.lit(1 << 31)) * F.lit(1 << 32) + low
    return F.when(digits.rlike("^[0-9a-f]{16}$"), number)


def _hashable(rows: DataFrame, name: str) -> Column:
    return F.map_entries(name) if rows.schema[name].dataType.typeName() == "map" else F.col(name)


def coverage(numbers: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Disjoint ranges (producer, block, first, last, copies, seen) of delivered numbers and of ranges seen before.

    ``numbers`` has (producer, number), a row per delivery, and ``seen`` (producer, first, last), inclusive and disjoint. ``copies`` is how
    often each number of the range was delivered, ``seen`` 1 if it had been before. Ranges end at block borders.
    """
    size = 1 << BLOCK_BITS
    at = F.col("number").bitwiseAND(F.lit(size - 1)).cast("int")
    marks = F.explode(F.array(F.struct(at.alias("at"), F.lit(1).alias("c")), F.struct((at + 1).alias("at"), F.lit(-1).alias("c"))))
    events = numbers.select("producer", F.shiftright("number", BLOCK_BITS).alias("block"), marks.alias("e"))
    events = events.select("producer", "block", "e.at", "e.c", F.lit(0).alias("s"))
    if seen is not None:
        lo, hi = F.shiftright("first", BLOCK_BITS), F.shiftright("last", BLOCK_BITS)
        cut = seen.select("producer", F.explode(F.sequence(lo, hi)).alias("block"), "first", "last")
        base = F.shiftleft("block", BLOCK_BITS)
        begin = F.greatest(F.col("first") - base, F.lit(0)).cast("int")
        end = F.least(F.col("last") - base, F.lit(size - 1)).cast("int") + 1
        ends = F.explode(F.array(F.struct(begin.alias("at"), F.lit(1).alias("s")), F.struct(end.alias("at"), F.lit(-1).alias("s"))))
        cut = cut.select("producer", "block", ends.alias("e")).select("producer", "block", "e.at", F.lit(0).alias("c"), "e.s")
        events = events.unionByName(cut)
    borders = events.groupBy("producer", "block", "at").agg(F.sum("c").alias("c"), F.sum("s").alias("s")).where("c <> 0 OR s <> 0")
    line = Window.partitionBy("producer", "block").orderBy("at")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    swept = borders.select(
        "producer", "block", "at", F.lead("at").over(line).alias("next"), F.sum("c").over(upto).alias("copies"), F.sum("s").over(upto).alias("seen")
    ).where("copies > 0 OR seen > 0")
    base = F.shiftleft("block", BLOCK_BITS)
    return swept.select("producer", "block", (base + F.col("at")).alias("first"), (base + (F.col("next") - 1)).alias("last"), "copies", "seen")


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """The disjoint ranges (producer, first, last) of all numbers, delivered now or before; they end at block borders."""
    line = Window.partitionBy("producer", "block").orderBy("first")
    gap = F.coalesce(F.lag("last").over(line) + 1 < F.col("first"), F.lit(True))
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    islands = ranges.withColumn("gap", gap.cast("int")).withColumn("island", F.sum("gap").over(upto))
    return islands.groupBy("producer", "block", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).select(
        "producer", "first", "last"
    )


def span_keys(spans: DataFrame) -> DataFrame:
    """``__t`` and ``__s``, the normalised ids, and ``__number``, the span id as a number where both ids are proper."""
    rows = spans.select("*", hex_id("trace_id").alias("__t"), hex_id("span_id").alias("__s"))
    proper = F.col("__t").rlike("^[0-9a-f]{32}$") & F.col("__s").rlike("^[0-9a-f]{16}$")
    return rows.withColumn("__number", F.when(F.coalesce(proper, F.lit(False)), hex_number(F.col("__s"))))


def span_ranges(spans: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """``coverage`` of the spans with proper ids: the trace is the producer (16 bytes), the span id its number."""
    numbers = span_keys(spans.select("trace_id", "span_id")).where("__number IS NOT NULL")
    if seen is not None:
        seen = seen.withColumn("producer", F.unhex("producer"))
    return coverage(numbers.select(F.unhex("__t").alias("producer"), F.col("__number").alias("number")), seen)


#: Stands for a missing id in keyed lookups.
_NONE = "\u0000"


def _known(spans: DataFrame, ranges: DataFrame, seen_keys: DataFrame | None) -> DataFrame:
    """(k_t, k_s, n_copies, old) of the spans that were delivered more than once or before: from ranges, and from malformed ids by key."""
    several = ranges.where("copies > 1 OR (copies > 0 AND seen > 0)")
    numbers = several.select("producer", "copies", "seen", F.explode(F.sequence("first", "last")).alias("number"))
    high = F.shiftright("number", 32) + F.lit(1 << 31)
    low = F.col("number").bitwiseAND(F.lit((1 << 32) - 1))
    digits = F.lower(F.concat(F.lpad(F.hex(high), 8, "0"), F.lpad(F.hex(low), 8, "0")))
    proper = numbers.select(F.lower(F.hex("producer")).alias("k_t"), digits.alias("k_s"), F.col("copies").alias("n_copies"), (F.col("seen") > 0).alias("old"))
    keys = [F.coalesce("__t", F.lit(_NONE)).alias("k_t"), F.coalesce("__s", F.lit(_NONE)).alias("k_s")]
    odd = span_keys(spans.select("trace_id", "span_id")).where("__number IS NULL").select(*keys).groupBy("k_t", "k_s").agg(
        F.count(F.lit(1)).alias("n_copies")
    )
    if seen_keys is None:
        odd = odd.withColumn("old", F.lit(False))
    else:
        before = span_keys(seen_keys.select("trace_id", "span_id")).select(*keys).distinct().withColumn("old", F.lit(True))
        odd = odd.join(before, ["k_t", "k_s"], "left").withColumn("old", F.coalesce("old", F.lit(False)))
    return proper.unionByName(odd.where("n_copies > 1 OR old"))


def deduplicate_spans(
    spans: DataFrame,
    seen: DataFrame | None = None,
    seen_keys: DataFrame | None = None,
    payload: list[str] | None = None,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """Exactly one row per span (trace_id, span_id) that was not seen before: the first delivery by wal_seq.

    The ranges say how often each span was delivered (``n_copies``) and which were seen; ids of other lengths or with other
    characters are looked up by (trace_id, span_id) in ``seen_keys``. Rows without one of the ids are kept as one
    span per pair of what is there (null equals null). Copies within one delivery go by a row hash. Payload goes through one shuffle, after
    copies are folded map-side. ``ranges`` may be given if ``span_ranges(spans, seen)`` is at hand.
    """
    payload = [c for c in (spans.columns if payload is None else payload) if c not in ("trace_id", "span_id")]
    known = _known(spans, span_ranges(spans, seen) if ranges is None else ranges, seen_keys)
    # packed, so that no column of the spans can clash with those of the pass
    pack = F.struct(*payload).alias("__pack") if payload else F.struct(F.lit(0).alias("none")).alias("__pack")
    order = [F.col("wal_seq")] if "wal_seq" in spans.columns else []
    tie = F.xxhash64(*[_hashable(spans, c) for c in payload]) if payload else F.lit(0)
    rows = spans.select(
        F.coalesce(hex_id("trace_id"), F.lit(_NONE)).alias("k_t"), F.coalesce(hex_id("span_id"), F.lit(_NONE)).alias("k_s"),
        F.struct(*order, tie.alias("tie")).alias("__order"), pack,
    )
    first = rows.groupBy("k_t", "k_s").agg(F.min_by("__pack", "__order").alias("__pack"))
    out = first.join(known, ["k_t", "k_s"], "left").where("old IS NULL OR NOT old")
    none = lambda c: F.when(F.col(c) != _NONE, F.col(c))
    fields = [F.col(f"__pack.{c}").alias(c) for c in payload]
    return out.select(none("k_t").alias("trace_id"), none("k_s").alias("span_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"), *fields)


def repeated_spans(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id) of spans with more than one row: the ranges covered more than once, and malformed ids counted by key."""
    none = lambda c: F.when(F.col(c) != _NONE, F.col(c))
    return _known(spans, span_ranges(spans), None).select(none("k_t").alias("trace_id"), none("k_s").alias("span_id"))
