"""Series index: which series a metric name and label matchers select, and their points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv64


def content_id(name: Column, labels: Column) -> Column:
    """Hash of the name and the sorted labels (a map of strings); equal on every node."""
    nul = F.lit("\u0000")
    entries = F.array_sort(F.map_entries(F.coalesce(labels, F.create_map().cast("map<string,string>"))))
    tail = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], nul, e["value"], nul)), "")
    return fnv64(F.concat(name, nul, tail))


def register(index: DataFrame | None, observed: DataFrame) -> DataFrame:
    """The index (series_id, metric_name, labels) with the observed (metric_name, labels); registering twice changes nothing."""
    new = observed.select("metric_name", "labels").withColumn("series_id", content_id(F.col("metric_name"), F.col("labels")))
    new = new.select("series_id", "metric_name", "labels")
    both = new if index is None else index.unionByName(new)
    return both.dropDuplicates(["series_id"])


def merge(*indexes: DataFrame) -> DataFrame:
    out = indexes[0]
    for i in indexes[1:]:
        out = out.unionByName(i)
    return out.dropDuplicates(["series_id"])


def lookup(index: DataFrame, name: str, matchers: dict[str, str] | None = None) -> DataFrame:
    """(series_id) of the series of a metric that have all the labels."""
    cond = F.col("metric_name") == name
    for k, v in (matchers or {}).items():
        cond = cond & F.coalesce(F.try_element_at("labels", F.lit(k)) == v, F.lit(False))
    return index.where(cond).select("series_id")


def points_of(points: DataFrame, index: DataFrame, name: str, start: int, end: int, matchers: dict[str, str] | None = None) -> DataFrame:
    """Points (or histograms) of the selected series in [start, end]."""
    inside = points.where(F.col("time_unix_nano").between(start, end))
    return inside.join(lookup(index, name, matchers), "series_id", "left_semi")
