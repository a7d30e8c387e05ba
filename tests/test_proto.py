"""OTLP protobuf: decoding of hand-made requests, and ingest of mixed files."""

import json
import struct

import pytest

from lumenpipe.sources import otlp_proto
from lumenpipe.sources.ingest_files import ingest
from lumenpipe.sources.storage import Store


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def part(number, data):
    """A field: bytes and texts by length, floats and 8-byte tuples fixed, numbers as varints."""
    if isinstance(data, str):
        data = data.encode()
    if isinstance(data, bytes):
        return varint(number << 3 | 2) + varint(len(data)) + data
    if isinstance(data, float):
        return varint(number << 3 | 1) + struct.pack("<d", data)
    if isinstance(data, tuple):
        return varint(number << 3 | 1) + struct.pack("<q", data[0])
    return varint(number << 3) + varint(data)


def attribute(key, number, value):
    return part(1, key) + part(2, part(number, value))


RESOURCE = part(1, part(1, attribute("service.name", 1, "shop")))
SPAN = (
    part(1, bytes.fromhex("ab" * 16)) + part(2, bytes.fromhex("cd" * 8)) + part(5, "GET /") + part(6, 2) + part(7, (1_000,)) + part(8, (5_000,))
    + part(9, attribute("http.response.status_code", 3, 503)) + part(9, attribute("debug.note", 1, 'say "x"')) + part(99, "unknown") + part(15, part(3, 2))
)
TRACES = part(1, RESOURCE + part(2, part(1, part(1, "lib")) + part(2, SPAN)))
LOGS = part(1, RESOURCE + part(2, part(2, part(1, (7_000,)) + part(2, 17) + part(3, "ERROR") + part(5, part(1, "it broke")))))
POINT = part(3, (9_000,)) + part(6, (-3,)) + part(7, attribute("zone", 1, "z1"))
HIST = part(3, (9_000,)) + part(4, (3,)) + part(5, 4.5) + part(6, struct.pack("<QQ", 1, 2)) + part(7, struct.pack("<d", 10.0))
EXP = part(3, (9_000,)) + part(4, (1,)) + part(6, 3) + part(8, part(1, 4) + part(2, varint(300) + varint(1)))
METRICS = part(1, RESOURCE + part(2, part(2, part(1, "load") + part(7, part(1, POINT) + part(3, 1))) + part(2, part(1, "lat") + part(9, part(1, HIST)))
               + part(2, part(1, "exp") + part(10, part(1, EXP)))))


def test_decoding():
    span = json.loads(otlp_proto.to_json(TRACES))["resourceSpans"][0]["scopeSpans"][0]["spans"][0]
    assert span["traceId"] == "ab" * 16 and span["startTimeUnixNano"] == "1000" and span["status"]["code"] == "2"
    metrics = json.loads(otlp_proto.to_json(METRICS))["resourceMetrics"][0]["scopeMetrics"][0]["metrics"]
    assert metrics[0]["sum"]["dataPoints"][0]["asInt"] == "-3" and metrics[0]["sum"]["isMonotonic"] is True
    assert metrics[1]["histogram"]["dataPoints"][0] == {"timeUnixNano": "9000", "count": "3", "sum": 4.5, "bucketCounts": ["1", "2"], "explicitBounds": [10.0]}
    assert metrics[2]["exponentialHistogram"]["dataPoints"][0]["positive"] == {"offset": 2, "bucketCounts": ["300", "1"]}
    assert "resourceLogs" in otlp_proto.to_json(LOGS)
    for bad in (b"", b"\x0a\xff", b"no protobuf at all", TRACES[:-3]):
        with pytest.raises(ValueError):
            otlp_proto.to_json(bad)


def test_ingest_of_mixed_files(spark, tmp_path):
    files = {"t.pb": TRACES, "l.bin": LOGS, "m.pb": METRICS, "bad.pb": b"no protobuf at all", "j.json": b'\n {"resourceLogs":[{"scopeLogs":[{"logRecords":[{"timeUnixNano":"5","body":{"stringValue":"x"}}]}]}]}\n'}
    (tmp_path / "in").mkdir()
    for name, data in files.items():
        (tmp_path / "in" / name).write_bytes(data)
    store = Store(spark, str(tmp_path / "store"))
    counts = ingest(spark, store, str(tmp_path / "in"))
    assert {k: counts[k] for k in ("unreadable", "spans", "logs", "metrics", "datapoints", "histograms", "exp_histograms")} == {
        "unreadable": 1, "spans": 1, "logs": 2, "metrics": 3, "datapoints": 1, "histograms": 1, "exp_histograms": 1}
    s = store.read("spans").first()
    assert (s["trace_id"], s["status"], s["duration_ns"], s["http_response_status_code"]) == ("ab" * 16, 2, 4000, 503)
    assert s["_overflow_attrs"] == {"debug.note": '"say \\"x\\""'}
    assert store.read("datapoints").first()["value"] == -3.0
    assert {r["service_name"] for r in store.read("resources").collect()} >= {"shop"}
