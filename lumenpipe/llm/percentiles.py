"""Exact percentiles per group by bisection.

A first pass counts, per day and group, the values of every bucket of a fixed logarithmic scale. These
partial counts add up over partitions and days, and alone give every percentile within a relative error
of 2**(2**-SCALE) - 1 of 1 + |value|. Each further pass keeps one value interval per group and percentile,
counts the rows below its midpoints, and narrows it, until every target rank is resolved exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.shared import int_div, materialize

#: Buckets per octave of the partial counts: 2**SCALE.
SCALE = 5
#: Sub-intervals that one bisection pass tells apart (midpoints + 1).
WAYS = 64


def bucket(value: Column) -> Column:
    """Order-preserving logarithmic bucket of a number; equal numbers share it, negative ones mirror it."""
    x = value.cast("double")
    far = F.lit(2048 << SCALE)  # beyond every finite double: infinities are apart
    octave = F.when(F.abs(x) == float("inf"), far).otherwise(F.floor(F.log2(F.abs(x) + 1.0) * float(1 << SCALE)) + 1)
    return (F.signum(x) * octave).cast("bigint")


def error_bound() -> float:
    """Largest relative error (of 1 + |value|) of a percentile read from the partial counts alone."""
    return 2.0 ** (2.0**-SCALE) - 1.0


def partial_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable partial result: (keys, bucket, n, low, high). Null and NaN values are left out.

    At most a few thousand rows per key whatever the number of values; the keys usually include the day.
    """
    v = F.col(value)
    kept = rows.where(v.isNotNull() & ~F.isnan(v.cast("double")))
    return kept.groupBy(*keys, bucket(v).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")
    )


def combine(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Partial counts over fewer keys (for example without the day): counts add, bounds widen."""
    return partials.groupBy(*keys, "bucket").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def _narrow(counts: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The sub-interval that holds the target rank: cumulative counts below the interval borders."""
    upto = Window.partitionBy(*keys, "per_mille").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("cum", F.sum("n").over(upto))
    hit = cum.where((F.col("cum") >= F.col("rank")) & (F.col("cum") - F.col("n") < F.col("rank")))
    return hit.select(
        *keys, "per_mille", "total", (F.col("rank") - F.col("cum") + F.col("n")).alias("rank"), "low", "high", by, "n"
    )


def _targets(partials: DataFrame, keys: list[str], per_mille: list[int]) -> DataFrame:
    totals = partials.groupBy(*keys).agg(F.sum("n").alias("total"))
    wanted = totals.withColumn("per_mille", F.explode(F.array(*[F.lit(p) for p in per_mille])))
    return wanted.withColumn(
        "rank", F.greatest(F.lit(1), int_div(F.col("total") * F.col("per_mille") + 999, F.lit(1000)))
    )


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Join on keys where null equals null; the right side's keys are dropped."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = extra
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    return left.join(named, on, how).drop(*[f"__{k}" for k in keys])


def percentiles_by_bisection(rows: DataFrame, partials: DataFrame, keys: list[str], value: str, per_mille: list[int]) -> DataFrame:
    """(keys, per_mille, value, n): the value of rank max(1, ceil(n * per_mille / 1000)) of every group, exactly.

    ``partials`` are the combined partial counts of the same rows over ``keys``. After the first narrowing only
    the rows inside some group's interval are kept, in a table in the shared folder; every pass then
    aggregates them map-side to at most ``WAYS`` counts per group and percentile.
    """
    first = _narrow(_join(_targets(partials, keys, per_mille), partials, keys), keys, "bucket")
    intervals = materialize(first)
    v = F.col(value)
    open_ = intervals.where("low < high")
    cells = open_.select(*keys, F.col("bucket").alias("__bucket")).distinct()
    inside = rows.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*keys, v.alias("v"))
    inside = inside.withColumn("bucket", bucket(F.col("v")))
    inside = materialize(
        _join(inside, cells, keys, "left_semi", F.col("bucket") == F.col("__bucket")).groupBy(*keys, "bucket", "v").agg(
            F.count(F.lit(1)).alias("c")
        )
    )
    done = [intervals.where("low >= high").select(*keys, "per_mille", F.col("low").alias("value"), F.col("total").alias("n"))]
    current = open_.select(*keys, "per_mille", "total", "rank", "low", "high", "bucket")
    while True:
        left = current.count()
        if not left:
            break
        active = _join(
            inside, current.withColumnRenamed("bucket", "__bucket"), keys, "inner",
            (F.col("bucket") == F.col("__bucket")) & (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")),
        )
        share = (F.col("v") - F.col("low")).cast("double") / (F.col("high") - F.col("low")).cast("double")
        part = F.least(F.lit(WAYS - 1), F.floor(share * WAYS))
        counts = active.withColumn("part", part.cast("int")).groupBy(
            *keys, "per_mille", "total", "rank", "bucket", "part"
        ).agg(F.sum("c").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = Window.partitionBy(*keys, "per_mille").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        cum = counts.withColumn("cum", F.sum("n").over(upto))
        hit = cum.where((F.col("cum") >= F.col("rank")) & (F.col("cum") - F.col("n") < F.col("rank")))
        step = materialize(
            hit.select(
                *keys, "per_mille", "total", (F.col("rank") - F.col("cum") + F.col("n")).alias("rank"), "low", "high", "bucket"
            )
        )
        done.append(step.where("low >= high").select(*keys, "per_mille", F.col("low").alias("value"), F.col("total").alias("n")))
        current = step.where("low < high")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def approximate_percentiles(partials: DataFrame, keys: list[str], per_mille: list[int]) -> DataFrame:
    """(keys, per_mille, low, high, n): the interval of values that holds the rank, from partial counts alone."""
    hit = _narrow(_join(_targets(partials, keys, per_mille), partials, keys), keys, "bucket")
    return hit.select(*keys, "per_mille", "low", "high", F.col("total").alias("n"))
