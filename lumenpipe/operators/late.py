"""Late and out-of-order events: per-period aggregates that late records correct until a cut-off.

The state of a period is a multiset: how often each value occurs. A late record only adds to a count
(a withdrawn one subtracts), so medians, distinct counts and extremes, which cannot be patched from
their old values, are derived again by cumulating counts in value order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import joined, median_index, values_at_ranks
from .shared import NS, floor_div, hex_id, materialize

ON_TIME_S, CUT_OFF_S = 60, 900


def first_deliveries(spans: DataFrame) -> DataFrame:
    """Each span once, by its first delivery; spans without a start or a receipt time are left out."""
    rows = spans.where(F.col("start_time_unix_nano").isNotNull() & F.col("received_unix_nano").isNotNull())
    rank = F.struct("wal_seq", "received_unix_nano", "start_time_unix_nano", "resource_id", "duration_ns")
    once = rows.groupBy(hex_id("trace_id").alias("t"), hex_id("span_id").alias("s")).agg(F.min(rank).alias("r"))
    return once.select("r.*").where(F.col("start_time_unix_nano") != 0)


def multiset(
    events: DataFrame, period_s: int = 60, on_time_s: int = ON_TIME_S, cut_off_s: int = CUT_OFF_S
) -> DataFrame:
    """State rows (resource_id, minute_unix_s, value, n_on_time, n_late, n_dropped).

    Lateness is the receipt minus the end of the period: up to ``on_time_s`` a record is on time, up to
    ``cut_off_s`` it corrects the period, beyond it is only counted as dropped. Counts add up, so states
    of separate batches are merged with ``merge_states``.
    """
    width = F.lit(period_s * NS)
    period = floor_div(F.col("start_time_unix_nano"), width)
    late = F.col("received_unix_nano") - (period + 1) * width
    rows = events.select(
        "resource_id", (period * period_s).alias("minute_unix_s"), F.col("duration_ns").alias("value"), late.alias("late")
    )
    on_time, in_time = F.col("late") <= on_time_s * NS, F.col("late") <= cut_off_s * NS
    one = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("resource_id", "minute_unix_s", "value").agg(
        one(on_time).alias("n_on_time"), one(~on_time & in_time).alias("n_late"), one(~in_time).alias("n_dropped")
    )


def merge_states(*states: DataFrame) -> DataFrame:
    """Sum of multisets; values whose counts fall to zero everywhere leave the state."""
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    counts = ["n_on_time", "n_late", "n_dropped"]
    out = both.groupBy("resource_id", "minute_unix_s", "value").agg(*[F.sum(c).alias(c) for c in counts])
    return out.where(" OR ".join(f"{c} <> 0" for c in counts))


def periods(state: DataFrame) -> DataFrame:
    """Per period: rows on time, late and dropped, and distinct, least and greatest value after correction."""
    kept = F.col("n_on_time") + F.col("n_late")
    live = F.when(kept > 0, F.col("value"))
    return state.groupBy("resource_id", "minute_unix_s").agg(
        F.sum("n_on_time").alias("n_on_time"),
        F.sum("n_late").alias("n_late"),
        F.sum("n_dropped").alias("n_dropped"),
        F.count(live).alias("n_distinct"),
        F.min(live).alias("min_value"),
        F.max(live).alias("max_value"),
    )


def with_medians(state: DataFrame) -> DataFrame:
    """The periods of a state with the lower medians of their values before (median_on_time) and after (median_value) correction."""
    keys = ["resource_id", "minute_unix_s"]
    counts = state.where(F.col("value").isNotNull()).withColumn("n_kept", F.col("n_on_time") + F.col("n_late"))
    early = values_at_ranks(counts, keys, "value", "n_on_time", {"median_on_time": median_index})
    both = values_at_ranks(counts, keys, "value", "n_kept", {"median_value": median_index})
    out = joined(joined(periods(state), early, keys, "left"), both, keys, "left")
    return out.select(
        *keys, "n_on_time", "n_late", "n_dropped", "n_distinct", "min_value", "max_value", "median_on_time", "median_value"
    )


def corrected_periods(spans: DataFrame) -> DataFrame:
    """Per (resource_id, minute_unix_s) the aggregates on time and after late corrections.

    Columns: n_on_time, n_late, n_dropped, n_distinct, min_value, max_value, median_on_time and median_value
    (lower medians of duration_ns, exact). Null durations count as rows but have no value.
    """
    return with_medians(materialize(multiset(first_deliveries(spans))))


def corrected_minutes(spans: DataFrame) -> DataFrame:
    """(resource_id, minute_unix_s) of the periods that late records within the cut-off corrected."""
    state = multiset(first_deliveries(spans))
    return periods(state).where("n_late > 0").select("resource_id", "minute_unix_s")
