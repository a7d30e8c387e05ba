"""OTLP files into a store: format and signal are found out where they are not given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import materialize
from ..plans.errors import InvalidQuery
from . import otlp_json, otlp_proto
from .storage import Store

#: Tables that documents of a family give, and the function that reads them.
TABLES = {
    "traces": {"spans": otlp_json.spans, "span_events": otlp_json.span_events, "span_links": otlp_json.span_links},
    "logs": {"logs": otlp_json.logs},
    "metrics": {
        "metrics": otlp_json.metrics, "datapoints": otlp_json.datapoints, "histograms": otlp_json.histograms, "exp_histograms": otlp_json.exp_histograms,
    },
}


def documents(spark: SparkSession, path: str, form: str = "auto", signal: str | None = None) -> DataFrame:
    """(text, kind, error): JSON documents of the files. ``auto`` takes files that begin with a brace as JSON lines, all others as protobuf."""
    if form not in ("auto", "json", "protobuf"):
        raise InvalidQuery("the format must be auto, json or protobuf")
    files = spark.read.format("binaryFile").load(path).select("path", F.decode(F.substring("content", 1, 64), "ISO-8859-1").rlike(r"^\s*\{").alias("json"))
    listed = files.collect() if form == "auto" else []  # one row per file given to the command
    as_json = [path] if form == "json" else [r["path"] for r in listed if r["json"]]
    as_proto = [path] if form == "protobuf" else [r["path"] for r in listed if not r["json"]]
    out = spark.createDataFrame([], "text string, error string")
    if as_json:
        out = out.unionByName(spark.read.text(as_json).where("trim(value) <> ''").select(F.col("value").alias("text"), F.lit(None).cast("string").alias("error")))
    for p in as_proto:
        out = out.unionByName(otlp_proto.read_documents(spark, p, signal).select("text", "error"))
    return otlp_json.detect(out)


def ingest(spark: SparkSession, store: Store, path: str, form: str = "auto", signal: str | None = None) -> dict[str, int]:
    """Append what the files hold to the store's tables; rows written per table, and ``unreadable`` documents."""
    docs = materialize(documents(spark, path, form, signal))
    counts = {"unreadable": docs.where("kind IS NULL").count()}
    for (family,) in docs.where("kind IS NOT NULL").select("kind").distinct().collect():
        if family not in TABLES:
            continue
        mine = docs.where(F.col("kind") == family).select("text")
        for name, read in TABLES[family].items():
            rows = materialize(read(mine))
            counts[name] = rows.count()
            if counts[name]:
                store.write(name, rows)
        for name, read in (("resources", otlp_json.resources), ("scopes", otlp_json.scopes)):
            store.write(name, read(mine, family))
    return counts
