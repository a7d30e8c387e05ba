"""Time-bucketed rollups of spans, metrics and profile samples, and exemplars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import exemplar_index, joined, ranked_values, rollup_index, values_at_ranks
from .shared import NS, floor_div, int_div

MINUTE = 60 * NS


def with_service(spans: DataFrame, resources: DataFrame) -> DataFrame:
    """Adds ``service``, the service name of the resource, ``unknown`` if there is none."""
    names = resources.groupBy(F.col("resource_id").alias("__id")).agg(F.min("service_name").alias("service"))
    joined = spans.drop("service").join(names, F.col("resource_id") == F.col("__id"), "left").drop("__id")
    return joined.withColumn("service", F.coalesce("service", F.lit("unknown")))


def span_rollup(spans: DataFrame) -> DataFrame:
    """Per (service, name, minute since the epoch): counts, duration extremes, sum and percentiles.

    Every status but OK (1) counts as an error; percentiles are the values at index (n - 1) * p / 100.
    """
    keys = ["service", "name", "minute_bucket"]
    rows = spans.withColumn("minute_bucket", floor_div(F.col("start_time_unix_nano"), F.lit(MINUTE)))
    n = F.col("count")
    folded = rows.groupBy(*keys, "duration_ns").agg(
        F.count(F.lit(1)).alias("count"), F.count(F.when(~F.col("status").eqNullSafe(F.lit(1)), 1)).alias("error_count")
    )
    base = folded.groupBy(*keys).agg(
        F.sum("count").alias("count"), F.sum("error_count").alias("error_count"), F.min("duration_ns").alias("min_duration"),
        F.max("duration_ns").alias("max_duration"), F.sum(F.col("duration_ns") * n).alias("sum_duration"),
    )
    picks = {f"p{p}_duration": (lambda n, p=p: rollup_index(n, p)) for p in (50, 90, 95, 99)}
    ranks = values_at_ranks(folded.where("duration_ns IS NOT NULL"), keys, "duration_ns", "count", picks)
    return joined(base, ranks, keys, "left")


def metric_rollup(points: DataFrame, width_s: int) -> DataFrame:
    """Per (series_id, start of the bucket in seconds): min, max, sum and count. NaN and null values are left out."""
    good = points.where(F.col("value").isNotNull() & ~F.isnan("value"))
    bucket = floor_div(F.col("time_unix_nano"), F.lit(width_s * NS)) * F.lit(width_s)
    return good.groupBy("series_id", bucket.alias("bucket")).agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count")
    )


def metric_rollups(points: DataFrame) -> dict[str, DataFrame]:
    return {"1m": metric_rollup(points, 60), "1h": metric_rollup(points, 3600), "1d": metric_rollup(points, 86400)}


def profile_rollup(samples: DataFrame) -> DataFrame:
    """Per (service, stack_id, minute, value_type) the sum of the sample values."""
    minute = floor_div(F.col("time_unix_nano"), F.lit(MINUTE))
    return samples.groupBy("service", "stack_id", minute.alias("minute_bucket"), "value_type").agg(
        F.sum("value").alias("total_value")
    )


def exemplars(points: DataFrame) -> DataFrame:
    """Points at or above their series' value at index n * 9 / 10, each with a synthetic trace id."""
    good = points.where(F.col("value").isNotNull() & ~F.isnan("value"))
    cut = ranked_values(good, ["series_id"], "value", {"threshold": exemplar_index})
    trace = F.format_string("%016x%016x", F.col("series_id"), F.col("time_unix_nano"))
    return good.join(cut, "series_id").where("value >= threshold").select(
        "series_id", "time_unix_nano", "value", trace.alias("trace_id")
    )


def coarser(rollup: DataFrame, width_s: int) -> DataFrame:
    """A metric rollup of wider buckets from one of narrower ones that divide them."""
    bucket = floor_div(F.col("bucket"), F.lit(width_s)) * F.lit(width_s)
    return rollup.groupBy("series_id", bucket.alias("bucket")).agg(
        F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("count").alias("count")
    )


def nice_bin_s(range_s: int, points: int = 100) -> int:
    """Smallest of a list of round widths that gives at most ``points`` bins."""
    widths = [1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 14400, 21600, 43200, 86400]
    return next((w for w in widths if w * points >= range_s), widths[-1])


def two_hour_bucket(time_ns):
    """Start hour of the two-hour storage bucket of a time."""
    hour = F.pmod(floor_div(time_ns, F.lit(3600 * NS)), F.lit(24))
    return int_div(hour, F.lit(2)) * 2
