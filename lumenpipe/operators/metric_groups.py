"""Grouping of metrics by their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Suffixes of statistical variants and of histogram families.
STATISTICAL = (
    "min max mean median avg average stddev std_dev variance p50 p75 p90 p95 p99 p999 count sum total"
).split()
HISTOGRAM = ["_bucket", "_count", "_sum"]


def statistical_groups(metrics: DataFrame) -> DataFrame:
    """Metrics of one resource, type and unit whose names differ in a statistical last part: 2 to 20 members."""
    prefix, suffix = F.regexp_extract("name", r"^(.*)\.([^.]*)$", 1), F.regexp_extract("name", r"^(.*)\.([^.]*)$", 2)
    rows = metrics.select("resource_id", "metric_type", "unit", "name", prefix.alias("prefix"), suffix.alias("suffix"))
    rows = rows.where((F.col("prefix") != "") & F.col("suffix").isin(STATISTICAL))
    groups = rows.groupBy("resource_id", "metric_type", "unit", "prefix").agg(F.sort_array(F.collect_set("name")).alias("members"))
    return groups.where(F.size("members").between(2, 20))


def histogram_families(metrics: DataFrame) -> DataFrame:
    """Names with _bucket, _count or _sum; a family needs the last two."""
    pattern = "^(.*)(" + "|".join(HISTOGRAM) + ")$"
    rows = metrics.select(
        "resource_id", "name", F.regexp_extract("name", pattern, 1).alias("base"), F.regexp_extract("name", pattern, 2).alias("part")
    ).where("base <> ''")
    groups = rows.groupBy("resource_id", "base").agg(
        F.sort_array(F.collect_set("name")).alias("members"), F.collect_set("part").alias("parts")
    )
    need = F.array_contains("parts", "_count") & F.array_contains("parts", "_sum")
    return groups.where(need).drop("parts")


def namespace_groups(metrics: DataFrame) -> DataFrame:
    """Metrics of a resource that share their first three or four dotted parts: 2 to 10 members."""
    parts = F.split("name", r"\.")
    rows = metrics.select("resource_id", "name", parts.alias("parts"), F.explode(F.array(F.lit(3), F.lit(4))).alias("depth"))
    rows = rows.where(F.size("parts") > F.col("depth"))
    namespace = F.array_join(F.slice("parts", F.lit(1), F.col("depth")), ".")
    groups = rows.groupBy("resource_id", namespace.alias("namespace")).agg(F.sort_array(F.collect_set("name")).alias("members"))
    return groups.where(F.size("members").between(2, 10))


def hierarchy(metrics: DataFrame) -> DataFrame:
    """(prefix, name): every proper dotted prefix of every metric name."""
    parts = F.split("name", r"\.")
    rows = metrics.select("name", parts.alias("parts")).where(F.size("parts") > 1).distinct()
    rows = rows.select("name", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    return rows.select(F.array_join(F.slice("parts", F.lit(1), F.col("k")), ".").alias("prefix"), "name")
