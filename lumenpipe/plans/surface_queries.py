"""Queries of sources, stored tables, live results and small functions over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import attributes
from ..operators import flamegraph, rollups, series
from ..operators.shared import NS, _folder, floor_div
from ..sources import adapters, otlp_json
from ..sources.storage import Retention, Store
from ..streaming.live import LiveQuery
from .core_queries import table as _t
from .language_queries import ALL_A, ALL_B, A, engine, series_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_ALL = f"between({ALL_A}, {ALL_B})"
DAY = 86400 * NS


def _op(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


# tiers and scopes
def two_tiers(s: SparkSession, d: str) -> DataFrame:
    """Logs of the last days are hot, earlier ones cold; each scope counts what it sees."""
    logs = _t(s, d, "logs")
    e = Engine(s, {"logs": logs.where(F.col("time_unix_nano") < A)}, {"logs": logs.where(F.col("time_unix_nano") >= A)}, now_ns=ALL_B)
    parts = [e.query(f"logs {_ALL} | group by {{ severity_text }} {{ count() as n }}", scope).primary.withColumn("scope", F.lit(scope)) for scope in ("all", "hot", "cold")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_op("s9_s10_two_tiers", two_tiers, " UNION ALL ".join(
    f"SELECT severity_text, count(*) AS n, '{scope}' AS scope FROM logs WHERE {cond} GROUP BY 1"
    for scope, cond in (("all", "true"), ("hot", f"time_unix_nano >= {A}"), ("cold", f"time_unix_nano < {A}"))))


# OTLP documents rendered from the tables and read again
def _attribute(key: str, value, kind: str = "stringValue"):
    empty = {k: F.lit(None).cast(t) for k, t in (("stringValue", "string"), ("intValue", "string"))}
    empty[kind] = value.cast("string")
    return F.struct(F.lit(key).alias("key"), F.struct(*[v.alias(k) for k, v in empty.items()]).alias("value"))


def _document(root: str, scopes: str, records: str, record, service) -> F.Column:
    inner = F.struct(F.struct(F.lit("lib").alias("name")).alias("scope"), F.array(record).alias(records))
    resource = F.struct(F.array(_attribute("service.name", service)).alias("attributes")).alias("resource")
    return F.to_json(F.struct(F.array(F.struct(resource, F.array(inner).alias(scopes))).alias(root)))


def otlp_spans(s: SparkSession, d: str) -> DataFrame:
    t = lambda c: F.col(c).cast("string")
    record = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), "name", t("kind").alias("kind"), t("start_time_unix_nano").alias("startTimeUnixNano"),
        t("end_time_unix_nano").alias("endTimeUnixNano"), F.struct(t("status").alias("code")).alias("status"),
        F.array(_attribute("http.route", F.col("http_route")), _attribute("http.response.status_code", F.col("http_response_status_code"), "intValue")).alias("attributes"),
    )
    docs = _t(s, d, "spans").select(_document("resourceSpans", "scopeSpans", "spans", record, F.lit("shop")).alias("text"))
    wanted = ["trace_id", "span_id", "name", "kind", "status", "start_time_unix_nano", "end_time_unix_nano", "duration_ns", "http_route", "http_response_status_code"]
    return otlp_json.spans(docs).select(*wanted)


_op("s13_otlp_traces", otlp_spans,
    "SELECT lower(trace_id) AS trace_id, lower(span_id) AS span_id, name, kind, status, start_time_unix_nano, end_time_unix_nano, "
    "end_time_unix_nano - start_time_unix_nano AS duration_ns, http_route, http_response_status_code FROM spans")


def otlp_logs(s: SparkSession, d: str) -> DataFrame:
    record = F.struct(
        F.col("time_unix_nano").cast("string").alias("timeUnixNano"), F.col("observed_time_unix_nano").cast("string").alias("observedTimeUnixNano"),
        F.col("severity_number").cast("string").alias("severityNumber"), F.col("severity_text").alias("severityText"), F.struct(F.col("body").alias("stringValue")).alias("body"),
    )
    docs = _t(s, d, "logs").select(_document("resourceLogs", "scopeLogs", "logRecords", record, F.col("service_name")).alias("text"))
    return otlp_json.logs(docs).select("service_name", "time_unix_nano", "observed_time_unix_nano", "severity_text", "severity_number", "body")


_op("s14_otlp_logs", otlp_logs,
    "SELECT service_name, time_unix_nano, observed_time_unix_nano, coalesce(severity_text, '') AS severity_text, CAST(CASE WHEN severity_number BETWEEN 1 AND 24 "
    "THEN (severity_number - 1) // 4 * 4 + 1 ELSE 9 END AS SMALLINT) AS severity_number, coalesce(body, '') AS body FROM logs")


def otlp_points(s: SparkSession, d: str) -> DataFrame:
    points = _t(s, d, "datapoints").where("value IS NOT NULL AND NOT isnan(value)")
    point = F.struct(F.col("time_unix_nano").cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble"))
    record = F.struct(F.col("metric_id").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("gauge"))
    docs = points.select(_document("resourceMetrics", "scopeMetrics", "metrics", record, F.lit("shop")).alias("text"))
    both = otlp_json.datapoints(docs).join(otlp_json.metrics(docs).select("metric_id", "name", "metric_type"), "metric_id")
    return both.select("name", "metric_type", "time_unix_nano", "value")


_op("s15_otlp_metrics", otlp_points,
    "SELECT metric_id AS name, 'gauge' AS metric_type, time_unix_nano, value FROM datapoints WHERE value IS NOT NULL AND NOT isnan(value)")


# stored tables
def _store(s: SparkSession) -> Store:
    return Store(s, f"{_folder(s)}/store-{uuid.uuid4().hex}")


def stored_logs(s: SparkSession, d: str) -> DataFrame:
    """Logs written in two parts, compacted and cleaned up two days before the last one; what is left per day."""
    store, logs = _store(s), _t(s, d, "logs")
    for part in ("time_unix_nano % 2 = 0", "time_unix_nano % 2 <> 0"):
        store.write("logs", logs.where(part))
    store.compact("logs")
    last = logs.agg(F.max("time_unix_nano")).first()[0] or 0
    store.cleanup(last, Retention(logs_days=2))
    return store.read("logs").groupBy(floor_div(F.col("time_unix_nano"), F.lit(DAY)).alias("day_number")).agg(F.count("*").alias("n"), F.count_distinct("log_id").alias("ids"))


_op("s20_m1_m3_stored_logs", stored_logs,
    f"""SELECT time_unix_nano // {DAY} AS day_number, count(*) AS n, count(DISTINCT log_id) AS ids FROM logs
    WHERE time_unix_nano // {DAY} >= ((SELECT max(time_unix_nano) FROM logs) - 2 * {DAY}) // {DAY} GROUP BY 1""")


def stored_points(s: SparkSession, d: str) -> DataFrame:
    """Points written to two-hour folders and read back by metric name and label through the stored series index."""
    store = _store(s)
    store.write("datapoints", _t(s, d, "datapoints"))
    store.register_series(series_index(s, d))
    store.register_series(series_index(s, d))
    found = store.points_of("request.total", 0, ALL_B, {"zone": "z1"})
    return found.groupBy("year", "month", "day", "hour").agg(F.count("*").alias("n"), F.count_distinct("series_id").alias("n_series"))


_op("s21_s22_stored_points", stored_points,
    """WITH p AS (SELECT *, make_timestamp(time_unix_nano // 1000) AS t FROM datapoints WHERE series_id IN (
      SELECT series_id FROM series WHERE metric_name = 'request.total' AND json_extract_string(attributes, '$.zone') = 'z1'))
    SELECT CAST(year(t) AS INTEGER) AS year, CAST(month(t) AS INTEGER) AS month, CAST(day(t) AS INTEGER) AS day, CAST(hour(t) // 2 * 2 AS INTEGER) AS hour, count(*) AS n,
      count(DISTINCT series_id) AS n_series FROM p GROUP BY 1, 2, 3, 4""")
_op("s21_two_hour_buckets", lambda s, d: _t(s, d, "datapoints").groupBy(rollups.two_hour_bucket(F.col("time_unix_nano")).alias("hour")).agg(F.count("*").alias("n")),
    "SELECT (time_unix_nano // 3600000000000) % 24 // 2 * 2 AS hour, count(*) AS n FROM datapoints GROUP BY 1")


def histogram_points(s: SparkSession, d: str) -> DataFrame:
    """Histograms of the series of a metric, by an index over them."""
    h = adapters.event_histograms(_t(s, d, "events"))
    index = h.select("series_id", F.col("metric_id").alias("metric_name"), F.create_map(F.lit("source"), F.lit("events")).alias("labels")).dropDuplicates(["series_id"])
    first = h.agg(F.min("metric_id")).first()[0]
    return series.points_of(h, index, first, 0, ALL_B, {"source": "events"}).select("metric_id", "time_unix_nano", "count", F.array_join("bucket_counts", ",").alias("buckets"))


_op("s23_histogram_points", histogram_points,
    """SELECT event_type AS metric_id, epoch_ns(ts) // 86400000000000 * 86400000000000 AS time_unix_nano, count(value) AS count, array_to_string([count(*) FILTER (WHERE value <= 10),
      count(*) FILTER (WHERE value > 10 AND value <= 50), count(*) FILTER (WHERE value > 50 AND value <= 100), count(*) FILTER (WHERE value > 100 AND value <= 200),
      count(*) FILTER (WHERE value > 200)], ',') AS buckets FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1, 2""")

# flamegraphs
_AFTER = 820454400 * NS  # the start of 1996
_STACKS = """f AS (SELECT l_suppkey AS s, n_nationkey + 1000000 AS n, n_regionkey + 2000000 AS r, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS v
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE {} GROUP BY 1, 2, 3),
    g AS (SELECT CAST(r AS VARCHAR) AS path, NULL AS parent_path, 0 AS depth, CAST(sum(v) AS BIGINT) AS total_value FROM f GROUP BY r UNION ALL
      SELECT r || '/' || n, CAST(r AS VARCHAR), 1, CAST(sum(v) AS BIGINT) FROM f GROUP BY r, n UNION ALL SELECT r || '/' || n || '/' || s, r || '/' || n, 2, v FROM f)"""
_op("d13_flamegraph_expiry",
    lambda s, d: flamegraph.flamegraph((e := engine(s, d)).table("samples"), e.table("stacks"), _AFTER).select("path", "parent_path", "depth", "total_value"),
    "WITH " + _STACKS.format("l_shipdate >= DATE '1996-01-01'") + " SELECT * FROM g WHERE total_value > 0")
_op("d14_icicle", lambda s, d: flamegraph.icicle(flamegraph.flamegraph((e := engine(s, d)).table("samples"), e.table("stacks"))).select("path", "rank", "share"),
    "WITH " + _STACKS.format("true") + """ SELECT path, CAST(row_number() OVER (PARTITION BY parent_path ORDER BY total_value DESC, path) AS INTEGER) AS rank,
      total_value / (SELECT sum(total_value) FROM g WHERE depth = 0) AS share FROM g""")




def flamegraph_deltas(s: SparkSession, d: str) -> DataFrame:
    """A flamegraph of all samples up to 1996 against that of all since 1995: late samples come, early ones expire."""
    e = engine(s, d)
    samples, stacks = e.table("samples"), e.table("stacks")
    before = flamegraph.flamegraph(samples.where(F.col("time_unix_nano") < _AFTER), stacks)
    after = flamegraph.flamegraph(samples, stacks, _AFTER - 365 * DAY)
    return flamegraph.node_deltas(before, after).select("op", "path", "depth", "total_value")


_op("l12_flamegraph_deltas", flamegraph_deltas,
    "WITH a AS (WITH " + _STACKS.format("l_shipdate < DATE '1996-01-01'") + " SELECT path, depth, total_value FROM g WHERE total_value > 0), "
    "b AS (WITH " + _STACKS.format("l_shipdate >= DATE '1995-01-01'") + " SELECT path, depth, total_value FROM g WHERE total_value > 0) "
    "SELECT CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'removed' ELSE 'updated' END AS op, path, coalesce(b.depth, a.depth) AS depth, "
    "coalesce(b.total_value, a.total_value) AS total_value FROM a FULL JOIN b USING (path) WHERE a.total_value IS DISTINCT FROM b.total_value")

# health rules, bins, record tree, shapes
def edited_rules(s: SparkSession, d: str) -> DataFrame:
    store = _store(s)
    store.set_health_rule("latency_p95_ns", 0.5, 1e8, 3e8)
    store.set_health_rule("http_5xx_rate", 0.1, 0.01, 0.02)
    store.remove_health_rule("error_logs_per_minute")
    return s.createDataFrame(store.health_rules(), "metric string, weight double, warn double, error double")


_op("d18_health_rules", edited_rules,
    "SELECT * FROM (VALUES ('span_error_rate', 0.4::DOUBLE, 0.01::DOUBLE, 0.05::DOUBLE), ('http_error_rate', 0.25, 0.05, 0.15), ('latency_p95_ns', 0.5, 1e8, 3e8), "
    "('http_5xx_rate', 0.1, 0.01, 0.02)) t(metric, weight, warn, error)")
_RANGES = [1, 99, 100, 101, 3600, 86400, 7 * 86400, 400 * 86400]
_op("d23_bin_choice", lambda s, d: s.createDataFrame([(r, rollups.nice_bin_s(r)) for r in _RANGES], "range_s bigint, bin_s bigint"),
    f"""SELECT r AS range_s, coalesce(list_min(list_filter(w, lambda x: x * 100 >= r)), 86400) AS bin_s FROM (SELECT unnest({_RANGES})::BIGINT AS r,
      [1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 14400, 21600, 43200, 86400]::BIGINT[] AS w)""")
_SHAPED = {
    "spans last 1h": "table", "logs last 1h | where severity_number >= 17 -> spans": "trace_timeline", "spans last 1h | group by {} { count() as n }": "scalar",
    "spans last 1h | group by { ts() bin 5m as b } { count() as n }": "time_series", "spans last 1h | group by { name } { count() as n }": "table",
    "spans last 1h | group by { ts() bin 5m as b } { heatmap(duration_ns) as h }": "heatmap", "logs last 1h | patterns body": "pattern_groups", "traces last 1h": "table",
}
_op("r1_shapes", lambda s, d: s.createDataFrame([(q, engine(s, d).query(q).shape) for q in _SHAPED], "query string, shape string"),
    "SELECT * FROM (VALUES " + ", ".join(f"('{q}', '{k}')" for q, k in _SHAPED.items()) + ") t(query, shape)")


# live queries: the deltas of a stream's two micro-batches
def _deltas(s: SparkSession, d: str, text: str, kind: str, at: int = A) -> DataFrame:
    logs, out = _t(s, d, "logs"), []
    clock = [at]
    batches = [logs.where(F.col("time_unix_nano") < at), logs.where(F.col("time_unix_nano") >= at)]
    live = LiveQuery(Engine(s, {"logs": logs}, now_ns=at), text, lambda x: out.append(x), lambda: clock[0])
    live.snapshot()
    for k, batch in enumerate(batches):
        clock[0] = at + k * DAY
        live.process(batch, k)
    rows = [x.rows.withColumn("batch", F.lit(x.batch)) for x in out if x.kind == kind]
    both = rows[0]
    for r in rows[1:]:
        both = both.unionByName(r)
    return both


_op("l2_append", lambda s, d: _deltas(s, d, "logs last 2d | where severity_number >= 17 | select log_id, service_name", "append"),
    f"""SELECT log_id, service_name, 0 AS batch FROM logs WHERE severity_number >= 17 AND time_unix_nano < {A} AND time_unix_nano >= {A - 2 * DAY}
      UNION ALL SELECT log_id, service_name, 1 FROM logs WHERE severity_number >= 17 AND time_unix_nano >= {A}""")
_op("l4_expiry", lambda s, d: _deltas(s, d, "logs last 2d | where severity_number >= 13 | select log_id", "expire", A + 3 * DAY),
    f"SELECT log_id, 1 AS batch FROM logs WHERE severity_number >= 13 AND time_unix_nano >= {A + DAY} AND time_unix_nano < {A + 2 * DAY}")
_op("l5_replace", lambda s, d: _deltas(s, d, "logs last 2d | group by { severity_text } { count() as n }", "replace"),
    " UNION ALL ".join(f"SELECT severity_text, count(*) AS n, {k} AS batch FROM logs WHERE time_unix_nano BETWEEN {A + (k - 2) * DAY} AND {A + k * DAY} GROUP BY 1" for k in (0, 1)))


# typed overflow attributes, arithmetic
def typed_attributes(s: SparkSession, d: str) -> DataFrame:
    m = F.col("_overflow_attrs")
    return _t(s, d, "spans").where(F.size("_overflow_attrs") > 0).select(
        "trace_id", "span_id", "wal_seq", attributes.overflow_get_str(m, "debug.note").alias("note"), attributes.overflow_get_i64(m, "retry.count").alias("retries"),
        attributes.overflow_get_f64(m, "sampled.ratio").alias("ratio"), attributes.overflow_get_bool(m, "cache.hit").alias("hit"),
    )


def _raw(key: str) -> str:
    return f"_overflow_attrs['{key}']"


_NUMBER = "{0} NOT LIKE '\"%' AND regexp_matches({0}, '^[-+]?[0-9.]')"
_op("u1_u4_typed_attributes", typed_attributes,
    f"""SELECT trace_id, span_id, wal_seq, CASE WHEN {_raw('debug.note')} LIKE '"%"' THEN {_raw('debug.note')}[2:-2] ELSE {_raw('debug.note')} END AS note,
      CASE WHEN {_NUMBER.format(_raw('retry.count'))} THEN coalesce(CASE WHEN regexp_full_match({_raw('retry.count')}, '[-+]?[0-9]+') THEN try_cast({_raw('retry.count')} AS BIGINT) END,
        try_cast(trunc(try_cast({_raw('retry.count')} AS DOUBLE)) AS BIGINT)) END AS retries,
      CASE WHEN {_NUMBER.format(_raw('sampled.ratio'))} THEN try_cast({_raw('sampled.ratio')} AS DOUBLE) END AS ratio,
      CASE {_raw('cache.hit')} WHEN 'true' THEN true WHEN 'false' THEN false END AS hit FROM spans WHERE cardinality(_overflow_attrs) > 0""")
_op("e2_minus", lambda s, d: engine(s, d).query(f"spans {_ALL} | compute end_time_unix_nano - start_time_unix_nano as took, duration_ns - 1.5 as less | select span_id, took, less").primary,
    "SELECT span_id, end_time_unix_nano - start_time_unix_nano AS took, duration_ns - 1.5::DOUBLE AS less FROM spans")
_op("j1_spans_traces", lambda s, d: engine(s, d).query(f"spans {_ALL} | where status == ERROR -> traces | group by {{ kind }} {{ count() as n }}").primary,
    "SELECT kind, count(*) AS n FROM spans WHERE trace_id IN (SELECT trace_id FROM spans WHERE status = 2) GROUP BY 1")
_op("j1_traces_spans", lambda s, d: engine(s, d).query(f"traces {_ALL} | where duration_ns > 100000000 -> spans | group by {{ kind }} {{ count() as n }}").primary,
    "SELECT kind, count(*) AS n FROM spans WHERE trace_id IN (SELECT trace_id FROM spans WHERE duration_ns > 100000000) GROUP BY 1")
