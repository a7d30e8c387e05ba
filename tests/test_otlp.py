import json

from lumenpipe.engine import Engine
from lumenpipe.functions.hashing import fnv1a_32, fnv1a_64
from lumenpipe.plans import catalog
from lumenpipe.sources import otlp_json as otlp

RES = {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}]}
SCOPE = {"name": "lib", "version": "1"}


def docs(spark, *requests):
    return spark.createDataFrame([(json.dumps(r),) for r in requests] + [("not json",), (None,)], "text string")


def test_spans_events_links(spark):
    span = {
        "traceId": "AB" * 16, "spanId": "CD" * 8, "name": "GET /", "kind": 2, "startTimeUnixNano": "1000", "endTimeUnixNano": "1500",
        "status": {"code": "STATUS_CODE_ERROR"},
        "attributes": [
            {"key": "http.method", "value": {"stringValue": "GET"}}, {"key": "http.status_code", "value": {"intValue": "200"}},
            {"key": "http.route", "value": {"intValue": "7"}}, {"key": "x", "value": {"stringValue": 'a"b'}}, {"key": "x", "value": {"boolValue": True}},
        ],
        "events": [{"timeUnixNano": "1200", "name": "e", "attributes": []}], "links": [{"traceId": "00" * 16, "spanId": "11" * 8}],
    }
    d = docs(spark, {"resourceSpans": [{"resource": RES, "scopeSpans": [{"scope": SCOPE, "spans": [span, {"traceId": "a", "spanId": "b"}]}]}]})
    rows = sorted(otlp.spans(d).collect(), key=lambda r: r["span_id"], reverse=True)
    r = rows[0]
    assert (r["trace_id"], r["kind"], r["status"], r["duration_ns"], r["parent_span_id"]) == ("ab" * 16, 2, 2, 500, None)
    assert (r["http_method"], r["http_status_code"], r["http_route"]) == ("GET", 200, None)
    assert r["_overflow_attrs"] == {"http.route": "7", "x": "true"}
    assert r["resource_id"] == fnv1a_32(b"service.name\0api\n") and r["scope_id"] == fnv1a_32(b"lib\0001\0")
    assert set(otlp.spans(d).columns) == set(catalog.schema("spans").names)
    assert otlp.span_events(d).first()["time_unix_nano"] == 1200
    assert otlp.span_links(d).first()["target_span_id"] == "11" * 8
    assert [tuple(x) for x in otlp.resources(d, "traces").collect()] == [(r["resource_id"], "api", '{"service.name":"api"}')]
    assert [x["kind"] for x in otlp.detect(d).collect()] == ["traces", None, None]


def test_logs(spark):
    records = [
        {"timeUnixNano": "5", "severityNumber": 18, "severityText": "oops", "body": {"stringValue": "hi"}, "traceId": "AA"},
        {"severityNumber": "SEVERITY_NUMBER_WARN", "body": {"intValue": "3"}}, {"timeUnixNano": "6", "severityNumber": 99},
    ]
    d = docs(spark, {"resourceLogs": [{"resource": {}, "scopeLogs": [{"logRecords": records}]}]})
    rows = sorted(otlp.logs(d, received_ns=77).collect(), key=lambda r: r["time_unix_nano"])
    assert [(r["time_unix_nano"], r["severity_number"], r["body"], r["service_name"]) for r in rows] == [
        (5, 17, "hi", "unknown"), (6, 9, "", "unknown"), (77, 13, "", "unknown"),
    ]
    assert len({r["log_id"] for r in rows}) == 3 and rows[0]["trace_id"] == "aa"


def test_metrics(spark):
    ms = [
        {"name": "g", "unit": "ms", "gauge": {"dataPoints": [{"timeUnixNano": "1", "asInt": "4", "attributes": [{"key": "k", "value": {"stringValue": "v"}}]}]}},
        {"name": "c", "sum": {"isMonotonic": True, "dataPoints": [{"timeUnixNano": "2", "asDouble": 1.5}]}},
        {"name": "h", "histogram": {"dataPoints": [{"timeUnixNano": "3", "count": "3", "sum": 6.0, "bucketCounts": ["1", "2"], "explicitBounds": [2.0]}]}},
        {"name": "x", "exponentialHistogram": {"dataPoints": [{"timeUnixNano": "4", "count": "1", "scale": 2, "positive": {"offset": 1, "bucketCounts": ["1"]}}]}},
    ]
    d = docs(spark, {"resourceMetrics": [{"resource": RES, "scopeMetrics": [{"scope": SCOPE, "metrics": ms}]}]})
    assert {r["name"]: r["metric_type"] for r in otlp.metrics(d.union(d)).collect()} == {"g": "gauge", "c": "counter", "h": "histogram", "x": "histogram"}
    points = {r["time_unix_nano"]: r for r in otlp.datapoints(d).collect()}
    assert {t: p["value"] for t, p in points.items()} == {1: 4.0, 2: 1.5}
    ident = points[1]["metric_id"]
    assert points[1]["series_id"] == fnv1a_64(f"metric_{ident.replace('-', '')}".encode() + b"\0k\0v\0")
    assert otlp.histograms(d).first()["bucket_counts"] == [1, 2]
    assert otlp.exp_histograms(d).first()["positive_counts"] == [1]


def test_profiles_to_flamegraph(spark):
    dictionary = {
        "stringTable": ["", "main", "main.rs", "work", "cpu", "ns"],
        "functionTable": [{"nameStrindex": 1, "filenameStrindex": 2, "startLine": "1"}, {"nameStrindex": 3}],
        "locationTable": [{"line": [{"functionIndex": 1}]}, {"line": [{"functionIndex": 0}]}],
        "mappingTable": [{"filenameStrindex": 2}], "stackTable": [{"locationIndices": [0, 1]}, {"locationIndices": []}],
    }
    profile = {"profileId": "AB" * 16, "timeUnixNano": "9", "sampleType": {"typeStrindex": 4, "unitStrindex": 5}, "sample": [{"stackIndex": 0, "values": ["1000", "1"]}, {"stackIndex": 1, "values": []}]}
    d = docs(spark, {"resourceProfiles": [{"resource": RES, "scopeProfiles": [{"scope": SCOPE, "profiles": [profile]}]}], "dictionary": dictionary})
    fs = {r["function_name"]: r for r in otlp.frames(d).collect()}
    assert fs["main"]["frame_id"] == fnv1a_64(b"main\0main.rs\0001") and fs["main"]["line"] == 1 and fs["work"]["filename"] is None
    st = sorted(tuple(r) for r in otlp.stacks(d).select("position", "frame_id").collect())
    assert st == [(0, fs["work"]["frame_id"]), (1, fs["main"]["frame_id"])]
    assert sorted(r["value"] for r in otlp.samples(d).collect()) == [0, 1000]
    assert otlp.profiles(d).first()["profile_type"] == "cpu" and otlp.mappings(d).count() == 1
    e = Engine(spark, {"profiles": otlp.profiles(d), "samples": otlp.samples(d), "stacks": otlp.stacks(d), "frames": otlp.frames(d)}, now_ns=10)
    aux = e.query("profiles last 1h <- samples <- stacks <- frames").aux
    assert {k: v.count() for k, v in aux.items()} == {"samples": 2, "stacks": 2, "frames": 2}
