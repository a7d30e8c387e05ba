"""Irregular readings onto a regular grid.

Every series is cut into time shards of a fixed number of periods, those without a reading included. A shard is summarised by its
first and last counted reading; a forward scan over the summaries hands every shard the reading in force when it begins, a backward
scan the first one after it ends. Then all shards are filled on their own: no cell is made outside its shard's task, so a gap of any length
is spread like readings are. No step holds a whole series: the largest group is one shard, or one block of shard summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import NS, floor_div, materialize

#: Periods of a shard, and shards of a block of the prefix scan.
SHARD = 4096


def counted_periods(points: DataFrame, series: DataFrame) -> DataFrame:
    """One row per (series_id, period) with a counted reading.

    A reading counts if series, time and value are there and the value is not NaN. Series whose
    interval is null or not positive have no grid and are left out; a series listed twice uses its
    smallest interval. ``value`` is the latest reading of the period, ties going to the larger value.
    """
    steps = (
        series.where((F.col("interval_s") > 0) & F.col("series_id").isNotNull())
        .groupBy("series_id")
        .agg(F.min("interval_s").alias("interval_s"))
    )
    good = points.where(
        F.col("value").isNotNull()
        & ~F.isnan("value")
        & F.col("time_unix_nano").isNotNull()
        & F.col("series_id").isNotNull()
    ).select("series_id", "time_unix_nano", F.col("value").cast("double").alias("value"))
    at = good.join(steps, "series_id").withColumn(
        "period", floor_div(F.col("time_unix_nano"), F.col("interval_s") * F.lit(NS))
    )
    return at.groupBy("series_id", "period").agg(
        F.first("interval_s").alias("interval_s"),
        F.max_by("value", F.struct("time_unix_nano", "value")).alias("value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.count(F.lit(1)).alias("n_readings"),
    )


def _shards(periods: DataFrame) -> DataFrame:
    """One row per (series_id, shard) from the first to the last shard of the series, with the readings around it.

    ``before`` is the last reading of the shards before, ``last`` that of the shard itself (null if it has none), ``after`` the first one of the
    shards that follow. The scans go in two levels: over the shards of a block of ``SHARD`` shards, and over blocks; blocks
    without any reading stand in the second level only and are opened after it.
    """
    point = lambda p, v: F.struct(F.col(p).alias("period"), F.col(v).alias("value"))
    summary = periods.groupBy("series_id", "shard").agg(
        F.first("interval_s").alias("interval_s"), F.min("period").alias("p0"), F.min_by("value", "period").alias("v0"),
        F.max("period").alias("p1"), F.max_by("value", "period").alias("v1"),
    )
    summary = summary.select("series_id", "shard", "interval_s", point("p0", "v0").alias("first"), point("p1", "v1").alias("last"))
    block = floor_div(F.col("shard"), F.lit(SHARD))
    blocks = summary.groupBy("series_id", block.alias("block")).agg(
        F.first("interval_s").alias("interval_s"), F.min("shard").alias("s0"), F.max("shard").alias("s1"),
        F.min_by("first", "shard").alias("first"), F.max_by("last", "shard").alias("last"),
    )
    line = Window.partitionBy("series_id").orderBy("block")
    blocks = blocks.select(
        "*", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("after"), F.lag("block").over(line).alias("block_before"),
        F.lead("block").over(line).alias("block_after"),
    )
    base = F.col("block") * SHARD
    held = blocks.select(  # the shards of a block that has readings, to its ends unless the series begins or ends in it
        "series_id", "interval_s", "block", "before", "after",
        F.explode(
            F.sequence(
                F.when(F.col("block_before").isNull(), F.col("s0")).otherwise(base),
                F.when(F.col("block_after").isNull(), F.col("s1")).otherwise(base + (SHARD - 1)),
            )
        ).alias("shard"),
    )
    held = held.join(summary.drop("interval_s"), ["series_id", "shard"], "left")
    inside = Window.partitionBy("series_id", "block").orderBy("shard")
    held = held.select(
        "series_id", "interval_s", "shard", "first", "last",
        F.coalesce(F.last("last", True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), "before").alias("before"),
        F.coalesce(F.first("first", True).over(inside.rowsBetween(1, Window.unboundedFollowing)), "after").alias("after"),
    )
    void = blocks.where(F.col("block_after") > F.col("block") + 1).select(
        "series_id", "interval_s", F.explode(F.sequence(F.col("block") + 1, F.col("block_after") - 1)).alias("block"),
        F.col("last").alias("before"), "after",
    )
    empty = F.lit(None).cast(summary.schema["last"].dataType)
    tasks = int(periods.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    void = void.repartition(tasks, "series_id", "block").select(
        "series_id", "interval_s", F.explode(F.sequence(base, base + (SHARD - 1))).alias("shard"), empty.alias("first"), empty.alias("last"), "before", "after"
    )
    return held.unionByName(void)


def regular_grid(points: DataFrame, series: DataFrame) -> DataFrame:
    """Regular series from the first to the last counted reading of every series.

    Returns (series_id, period_unix_s, value, is_missing, locf_value, linear_value, n_readings): for a
    missing period ``value`` is null, ``locf_value`` repeats the reading in force and ``linear_value``
    lies on the line between the readings around the gap. Readings after a period is known (repeated or
    contradicting ones) collapse into that period. Empty input gives an empty grid.
    """
    periods = counted_periods(points, series).withColumn("shard", floor_div(F.col("period"), F.lit(SHARD)))
    periods = materialize(periods)  # both the shards and their summaries read it
    own = periods.select(
        "series_id", "shard", "interval_s", "period", F.struct("period", "value").alias("here"), F.col("n_readings").alias("n")
    )
    # a reading closes the gap before it within its shard; the end of the shard closes the gap after its last reading
    shards = _shards(periods)
    start, end = F.col("shard") * SHARD, F.col("shard") * SHARD + (SHARD - 1)
    tail = shards.where(F.col("after").isNotNull()).select(
        "series_id", "shard", "interval_s", end.alias("to"), F.coalesce(F.col("last.period") + 1, start).alias("from"), F.coalesce("last", "before").alias("prev"),
        F.col("after").alias("next"), F.lit(0).cast("bigint").alias("n"),
    )
    line = Window.partitionBy("series_id", "shard").orderBy("period")
    carry = shards.where("last IS NOT NULL").select(F.col("series_id").alias("__s"), F.col("shard").alias("__k"), "before")
    own = own.withColumn("lag", F.lag("here").over(line))
    own = own.join(carry, (F.col("series_id") == F.col("__s")) & (F.col("shard") == F.col("__k")))
    prev = F.coalesce("lag", "before")
    first = F.when(F.col("lag").isNotNull(), F.col("lag.period") + 1).when(F.col("before").isNotNull(), start).otherwise(F.col("period"))
    readings = own.select(
        "series_id", "shard", "interval_s", F.col("period").alias("to"), first.alias("from"), prev.alias("prev"), F.col("here").alias("next"), "n"
    )
    gaps = readings.unionByName(tail).where(F.col("from") <= F.col("to"))
    tasks = int(periods.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gaps = gaps.repartition(tasks, "series_id", "shard")  # by number: small rows that become many cells are not to be put together
    cells = gaps.withColumn("p", F.explode(F.sequence("from", "to")))
    missing = (F.col("p") < F.col("next.period")) | (F.col("n") == 0)
    share = (F.col("p") - F.col("prev.period")) / (F.col("next.period") - F.col("prev.period"))
    return cells.select(
        "series_id",
        (F.col("p") * F.col("interval_s")).alias("period_unix_s"),
        F.when(~missing, F.col("next.value")).alias("value"),
        missing.alias("is_missing"),
        F.when(missing, F.col("prev.value")).otherwise(F.col("next.value")).alias("locf_value"),
        F.when(missing, F.col("prev.value") + (F.col("next.value") - F.col("prev.value")) * share)
        .otherwise(F.col("next.value"))
        .alias("linear_value"),
        F.when(missing, F.lit(0)).otherwise(F.col("n")).cast("bigint").alias("n_readings"),
    )


def missing_periods(points: DataFrame, series: DataFrame) -> DataFrame:
    """(series_id, period_unix_s) of the grid's cells without a counted reading."""
    return regular_grid(points, series).where("is_missing").select("series_id", "period_unix_s")
