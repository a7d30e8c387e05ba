"""Signals, their schemas, key columns, correlation paths and promoted attributes."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, LONG, SHORT, DOUBLE, INT = T.StringType(), T.LongType(), T.ShortType(), T.DoubleType(), T.IntegerType()
ATTRS = T.MapType(STRING, STRING)

# Promoted attributes; the column is the key with underscores, but for service.name.
_LONG_KEYS = "http.response.status_code http.status_code server.port rpc.grpc.status_code net.peer.port".split()
_TEXT_KEYS = (
    "http.request.method http.method http.route url.path url.full http.url server.address db.system db.name "
    "db.operation.name db.operation db.statement db.collection.name rpc.system rpc.method rpc.service messaging.system "
    "messaging.destination.name messaging.operation.name error.type exception.type exception.message "
    "network.peer.address net.peer.name service.name service.version deployment.environment.name k8s.namespace.name "
    "k8s.pod.name k8s.deployment.name log.iostream log.file.name"
).split()


def attribute_column(key: str) -> str:
    return "service_name_attr" if key == "service.name" else key.replace(".", "_")


PROMOTED: dict[str, T.DataType] = {k: LONG for k in _LONG_KEYS} | {k: STRING for k in _TEXT_KEYS}
PROMOTED_COLUMNS = {attribute_column(k): k for k in PROMOTED}


def promoted_column(name: str) -> str | None:
    """Column of a promoted attribute, given by key or by column name."""
    if name in PROMOTED:
        return attribute_column(name)
    return name if name in PROMOTED_COLUMNS else None


_PROMOTED_DDL = ", ".join(f"{attribute_column(k)} {t.simpleString()}" for k, t in PROMOTED.items())
_OVERFLOW = "_overflow_attrs map<string,string>"

#: Schemas as DDL; times are nanoseconds since the epoch, 64-bit ids are signed.
DDL: dict[str, str] = {
    "spans": "trace_id string, span_id string, parent_span_id string, name string, kind smallint, status smallint, "
    "start_time_unix_nano bigint, end_time_unix_nano bigint, duration_ns bigint, resource_id bigint, scope_id bigint, "
    f"{_PROMOTED_DDL}, {_OVERFLOW}",
    "logs": "log_id string, time_unix_nano bigint, observed_time_unix_nano bigint, service_name string, severity_text string, "
    "severity_number smallint, body string, trace_id string, span_id string, resource_id bigint, scope_id bigint, "
    f"{_PROMOTED_DDL}, {_OVERFLOW}",
    "metrics": "metric_id string, name string, description string, unit string, metric_type string, service_name string, "
    "resource_id bigint, scope_id bigint",
    "datapoints": "series_id bigint, metric_id string, time_unix_nano bigint, value double",
    "histograms": "series_id bigint, metric_id string, time_unix_nano bigint, count bigint, sum double, "
    "bucket_counts array<bigint>, explicit_bounds array<double>",
    "exp_histograms": "series_id bigint, metric_id string, time_unix_nano bigint, count bigint, sum double, scale int, "
    "zero_count bigint, positive_offset int, positive_counts array<bigint>, negative_offset int, negative_counts array<bigint>",
    "profiles": "profile_id string, time_unix_nano bigint, service_name string, resource_id bigint, scope_id bigint, "
    "profile_type string, sample_type string, sample_unit string, trace_id string, data binary",
    "samples": "profile_id string, stack_id bigint, service string, time_unix_nano bigint, resource_id bigint, scope_id bigint, "
    "value_type string, value bigint",
    "frames": "frame_id bigint, function_name string, system_name string, filename string, line bigint, column bigint, "
    "mapping_id bigint, inline boolean",
    "stacks": "stack_id bigint, frame_id bigint, position bigint",
    "mappings": "mapping_id bigint, filename string, build_id string",
    "resources": "resource_id bigint, service_name string, attributes string",
    "scopes": "scope_id bigint, name string, version string, attributes string",
    "span_events": f"trace_id string, span_id string, time_unix_nano bigint, name string, {_OVERFLOW}",
    "span_links": "source_trace_id string, source_span_id string, target_trace_id string, target_span_id string, "
    f"trace_state string, {_OVERFLOW}",
}


def schema(signal: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table_of(signal)])


#: Signals of the language; traces read the table of spans.
SIGNALS = (
    "spans", "span_links", "span_events", "logs", "datapoints", "histograms", "exp_histograms", "metrics", "samples", "traces",
    "profiles", "stacks", "frames", "mappings", "resources", "scopes",
)


def table_of(signal: str) -> str:
    return "spans" if signal == "traces" else signal


TIME_COLUMN = {"spans": "start_time_unix_nano", "traces": "start_time_unix_nano"} | {
    s: "time_unix_nano" for s in ("logs", "datapoints", "histograms", "exp_histograms", "samples", "profiles", "span_events")
}

ID_COLUMN = {
    "spans": "span_id", "span_links": "source_span_id", "span_events": "span_id", "logs": "log_id", "datapoints": "metric_id",
    "histograms": "metric_id", "exp_histograms": "metric_id", "metrics": "metric_id", "samples": "profile_id",
    "profiles": "profile_id", "traces": "trace_id", "stacks": "stack_id", "frames": "frame_id", "mappings": "mapping_id",
    "resources": "resource_id", "scopes": "scope_id",
}

#: Lookup keywords: the singular of every signal.
SINGULAR = {s[:-1]: s for s in SIGNALS}

_OWNED = ("spans", "logs", "metrics", "datapoints", "histograms", "profiles", "samples")
_PAIRS = [
    ("spans", "logs", "trace_id"), ("spans", "traces", "trace_id"), ("traces", "logs", "trace_id"),
    ("metrics", "datapoints", "metric_id"), ("metrics", "histograms", "metric_id"), ("metrics", "exp_histograms", "metric_id"),
    ("profiles", "samples", "profile_id"), ("samples", "stacks", "stack_id"), ("stacks", "frames", "frame_id"),
    ("frames", "mappings", "mapping_id"),
    *[("resources", s, "resource_id") for s in _OWNED], *[("scopes", s, "scope_id") for s in _OWNED],
]

MERGE_KEY = {(a, b): k for a, b, k in _PAIRS} | {(b, a): k for a, b, k in _PAIRS}
NAVIGATE_KEY = {
    ("logs", "spans"): "trace_id", ("logs", "traces"): "trace_id", ("spans", "traces"): "trace_id",
    ("traces", "spans"): "trace_id", ("datapoints", "metrics"): "metric_id",
}

STATUS = {"UNSET": 0, "OK": 1, "ERROR": 2}
KIND = {"UNSPECIFIED": 0, "INTERNAL": 1, "SERVER": 2, "CLIENT": 3, "PRODUCER": 4, "CONSUMER": 5}
SEVERITY = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17, "FATAL": 21}
