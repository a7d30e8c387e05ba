"""Explicit-bucket histograms: averages, percentiles, merging, heatmap columns, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NS, int_div, previous_row

#: Width of the time shards in which deltas are taken.
SHARD_NS = 86400 * NS


def average(total: Column, count: Column) -> Column:
    """sum / count, 0 for an empty histogram."""
    return F.when(count > 0, total / count).otherwise(0.0)


def percentile(counts: Column, bounds: Column, p: float) -> Column:
    """Upper bound of the first bucket whose cumulative count reaches max(1, ceil(total * p / 100)).

    The overflow bucket gives the last bound; null if the histogram is empty, has no bounds or p is out of [0, 100].
    """
    if not 0 <= p <= 100:
        return F.lit(None).cast("double")
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    goal = F.greatest(F.lit(1), F.ceil(total * (p / 100.0)))
    cumulative = F.transform(
        counts, lambda _, i: F.aggregate(F.slice(counts, 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
    )
    first = F.size(F.filter(cumulative, lambda c: c < goal)) + 1
    return F.when((total > 0) & (F.size(bounds) > 0), F.element_at(bounds, F.least(first, F.size(bounds))))


def add_counts(a: Column, b: Column) -> Column:
    """Element-wise sum; the shorter array counts as zeros."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def merge_bins(histograms: DataFrame, width_ns: int, keys: list[str]) -> DataFrame:
    """Histograms of one time bin merged: bucket counts add up by position, the longest bounds are kept.

    Counts are summed by (bin, position) map-side; no task gathers the histograms of a bin.
    """
    bin_ = int_div(F.col("time_unix_nano"), F.lit(width_ns)) * F.lit(width_ns)
    rows = histograms.withColumn("bin", bin_)
    cells = rows.select(*keys, "bin", F.posexplode("bucket_counts").alias("i", "c"))
    sums = cells.groupBy(*keys, "bin", "i").agg(F.sum("c").alias("c"))
    merged = sums.groupBy(*keys, "bin").agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("s"))
    bounds = rows.groupBy(*keys, "bin").agg(
        F.max_by("explicit_bounds", F.struct(F.size("explicit_bounds"), "explicit_bounds")).alias("explicit_bounds"),
        F.sum("count").alias("count"),
        F.sum("sum").alias("sum"),
    )
    return merged.select(*keys, "bin", F.transform("s", lambda x: x["c"]).alias("bucket_counts")).join(bounds, [*keys, "bin"])


def deltas(histograms: DataFrame, keys: list[str], time: str = "bin") -> DataFrame:
    """Cumulative counts to deltas along time; a count below the one before is a reset and stands as it is."""
    before = previous_row(histograms, keys, time, ["bucket_counts"], SHARD_NS).withColumn("__before", F.col("previous.bucket_counts"))
    delta = F.zip_with(
        "bucket_counts", "__before",
        lambda c, p: F.when(p.isNotNull() & (c >= p), c - p).otherwise(F.coalesce(c, F.lit(0))),
    )
    step = F.when(F.col("__before").isNull(), F.col("bucket_counts")).otherwise(delta)
    return before.withColumn("delta_counts", step).drop("__before", "previous")


def heatmap_columns(histograms: DataFrame, keys: list[str], span_ns: int, max_columns: int) -> DataFrame:
    """Columns of a heatmap: bins of max(5 s, ceil(span / columns)), merged, as deltas and as shares of the largest count."""
    width = max(5 * NS, -(-span_ns // max(max_columns, 1)))
    columns = deltas(merge_bins(histograms, width, keys), keys)
    top = F.array_max("delta_counts")
    share = F.transform("delta_counts", lambda c: F.when(F.col("__top") > 0, c / F.col("__top")).otherwise(0.0))
    return columns.withColumn("__top", top).withColumn("shares", share).drop("__top")


def activity(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """Highest bucket with a delta above zero, per histogram; null where nothing happened."""
    d = deltas(histograms, keys, "time_unix_nano")
    last = F.array_max(F.transform("delta_counts", lambda c, i: F.when(c > 0, i)))
    return d.withColumn("highest_bucket", last)
