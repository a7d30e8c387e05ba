"""Driver tables as signals: telemetry tables as they are, the rest derived from the star schema and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper ends of the buckets that values of events are counted in.
BOUNDS = [10.0, 50.0, 100.0, 200.0]
STORED = ("spans", "logs", "metrics", "datapoints", "series", "resources", "scopes")


def nanos(col: str):
    return F.unix_micros(F.col(col).cast("timestamp")) * 1000


def event_histograms(events: DataFrame) -> DataFrame:
    """One histogram per event type and day: counts of values up to 10, 50, 100, 200 and above."""
    day = F.call_function("div", nanos("ts"), F.lit(86400 * 10**9)) * F.lit(86400 * 10**9)
    edges = [None, *BOUNDS, None]
    v = F.col("value")
    inside = []
    for lo, hi in zip(edges, edges[1:]):
        cond = (v > lo if lo is not None else F.lit(True)) & (v <= hi if hi is not None else F.lit(True))
        inside.append(F.count(F.when(cond, v)))
    return events.groupBy(F.col("event_type").alias("metric_id"), day.alias("time_unix_nano")).agg(
        F.count("value").alias("count"), F.round(F.sum("value"), 4).alias("sum"), F.array(*inside).alias("bucket_counts")
    ).select(
        F.xxhash64("metric_id").alias("series_id"), "metric_id", "time_unix_nano", "count", "sum", "bucket_counts",
        F.array(*[F.lit(b) for b in BOUNDS]).alias("explicit_bounds"),
    )


def line_samples(lineitem: DataFrame) -> DataFrame:
    """A profile sample per line item: the stack is the supplier, the value the quantity."""
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("profile_id"), F.col("l_suppkey").cast("bigint").alias("stack_id"),
        F.col("l_returnflag").alias("service"), nanos("l_shipdate").alias("time_unix_nano"),
        F.col("l_suppkey").cast("bigint").alias("resource_id"), F.lit(0).cast("bigint").alias("scope_id"),
        F.lit("cpu").alias("value_type"), F.round("l_quantity").cast("bigint").alias("value"),
    )


def supplier_stacks(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Stack of a supplier: itself (leaf), its nation, its region. Frame ids: supplier key, 1e6 + nation, 2e6 + region."""
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    frames = F.array(
        F.col("s_suppkey").cast("bigint"), F.col("n_nationkey").cast("bigint") + 1_000_000, F.col("n_regionkey").cast("bigint") + 2_000_000
    )
    return joined.select(F.col("s_suppkey").cast("bigint").alias("stack_id"), F.posexplode(frames).alias("position", "frame_id")).select(
        "stack_id", "frame_id", F.col("position").cast("bigint").alias("position")
    )


def geography_frames(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    def part(df: DataFrame, key: str, base: int, name: str) -> DataFrame:
        return df.select(
            (F.col(key).cast("bigint") + base).alias("frame_id"), F.col(name).alias("function_name"),
            F.lit(None).cast("string").alias("system_name"), F.lit(None).cast("string").alias("filename"),
            F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("bigint").alias("column"),
            F.lit(None).cast("bigint").alias("mapping_id"), F.lit(False).alias("inline"),
        )

    return part(supplier, "s_suppkey", 0, "s_name").unionByName(part(nation, "n_nationkey", 1_000_000, "n_name")).unionByName(
        part(region, "r_regionkey", 2_000_000, "r_name")
    )


#: What metric_variants appends to names: statistical last parts, parts of a histogram family, and deeper name spaces.
VARIANTS = [".min", ".max", ".p99", "_bucket", "_count", "_sum", ".queue.wait.avg", ".queue.wait.ms", ".queue.depth.now"]


def metric_variants(metrics: DataFrame) -> DataFrame:
    """The metrics under each of the names that exporters derive from theirs."""
    return metrics.withColumn("name", F.explode(F.array(*[F.concat("name", F.lit(v)) for v in VARIANTS])))


def signals(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], DataFrame]]:
    """Signal tables of a driver folder, read when a query needs them."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    out: dict[str, Callable[[], DataFrame]] = {n: (lambda n=n: read(n)) for n in STORED}
    out["histograms"] = lambda: event_histograms(read("events"))
    out["samples"] = lambda: line_samples(read("lineitem"))
    out["stacks"] = lambda: supplier_stacks(read("supplier"), read("nation"))
    out["frames"] = lambda: geography_frames(read("supplier"), read("nation"), read("region"))
    return out
