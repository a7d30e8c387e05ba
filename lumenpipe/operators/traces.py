"""Traces: summaries, filters over their spans, and the order of the span tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import catalog as C
from . import hierarchy
from .shared import hex_id, parent_id


def trace_summary(spans: DataFrame) -> DataFrame:
    """Per trace: the root's name (no parent first, then the earliest start), span count, error flag, start and duration."""
    parent = parent_id("parent_span_id")
    rows = spans.select(
        hex_id("trace_id").alias("trace_id"), hex_id("span_id").alias("span_id"), parent.alias("parent"), "name", "status",
        "start_time_unix_nano", "end_time_unix_nano",
    )
    first = F.struct(F.col("parent").isNotNull(), "start_time_unix_nano", "span_id")
    return rows.groupBy("trace_id").agg(
        F.min_by("name", first).alias("root_name"), F.count(F.lit(1)).alias("span_count"),
        F.max(F.coalesce(F.col("status") == 2, F.lit(False))).alias("has_error"),
        F.min("start_time_unix_nano").alias("start_time_unix_nano"),
        (F.max("end_time_unix_nano") - F.min("start_time_unix_nano")).alias("duration_ns"),
    )


def matching_traces(spans: DataFrame, condition: Column) -> DataFrame:
    """Summaries of the traces in which any span matches."""
    hits = spans.groupBy(hex_id("trace_id").alias("__trace")).agg(F.max(F.coalesce(condition, F.lit(False))).alias("__hit"))
    return trace_summary(spans).join(hits.where("__hit"), F.col("trace_id") == F.col("__trace"), "left_semi")


def span_matches(
    spans: DataFrame, text: str | None = None, errors_only: bool = False, http_class: int | None = None, service: str = "service"
) -> Column:
    """Filter of the spans: error status, a text, and the class of the HTTP status.

    The text is looked for, ignoring case, in the name, the service (column ``service`` where it is there, and the span's own attribute), and in the
    key or value of every attribute, promoted (by its dotted key) or not. Columns that the spans lack match nothing.
    """
    cond = F.lit(True)
    if errors_only:
        cond = cond & (F.col("status") == 2)
    if text:
        low = text.lower()
        has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(low)), F.lit(False))
        found = F.lit(False)
        for c in ("name", service):
            if c in spans.columns:
                found = found | has(F.col(c))
        for column, key in C.PROMOTED_COLUMNS.items():
            if column in spans.columns:
                found = found | (F.col(column).isNotNull() if low in key else has(F.col(column).cast("string")))
        if "_overflow_attrs" in spans.columns:
            for side in (F.map_keys, F.map_values):
                found = found | F.coalesce(F.exists(side("_overflow_attrs"), has), F.lit(False))
        cond = cond & found
    if http_class is not None:
        code = F.col("http_response_status_code")
        cond = cond & (code >= http_class * 100) & (code < (http_class + 1) * 100)
    return cond


SORTS = {"start": ("start_time_unix_nano", True), "duration": ("duration_ns", True), "service": ("service", False)}


def sorted_traces(summaries: DataFrame, by: str = "start") -> DataFrame:
    """Summaries with the latest start or the longest duration first, or by service; ties by trace id."""
    column, down = SORTS[by]
    return summaries.orderBy(F.desc(column) if down else F.asc(column), "trace_id")


def span_tree(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth, sort_path): ordering by sort_path is the pre-order walk, children by start time.

    Spans with an unknown parent are roots; those on or below a circle have depth 0 and come last.
    """
    nodes = hierarchy.span_nodes(spans)
    solved = hierarchy.resolve(nodes)
    rank = nodes.select("tree", F.col("node").alias("link"), F.concat(F.lpad(F.hex("ord"), 16, "0"), F.lit(":"), "node").alias("rank"))
    links = solved.where("chain IS NOT NULL").select("tree", "node", "depth", F.posexplode("chain").alias("k", "link"))
    paths = (
        links.join(rank, ["tree", "link"])
        .groupBy("tree", "node")
        .agg(F.first("depth").alias("depth"), F.array_sort(F.collect_list(F.struct("k", "rank"))).alias("p"))
        .select("tree", "node", "depth", F.array_join(F.transform("p", lambda x: x["rank"]), "/").alias("sort_path"))
    )
    loose = solved.where("chain IS NULL").select("tree", "node", F.lit(0).cast("bigint").alias("depth"), F.concat(F.lit("~"), "node").alias("sort_path"))
    return paths.unionByName(loose).select(
        F.col("tree").alias("trace_id"), F.col("node").alias("span_id"), "depth", "sort_path"
    )
