"""OTLP protobuf files to OTLP/JSON documents, which ``otlp_json`` reads.

A file is one export request as collectors write it. It is decoded by its public schema, kept below as plain text, one file per row in
Arrow batches. Unknown fields are skipped; a field of another wire type than the schema's means that the file is of another signal, which
is how the signal is told where it is not given.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# The messages of the OTLP schema as NAME: number field kind, ... A kind in capitals is a message, * marks repeated fields.
_SCHEMA = """
ANY: 1 stringValue text, 2 boolValue bool, 3 intValue int, 4 doubleValue double, 5 arrayValue LIST, 6 kvlistValue MAP, 7 bytesValue bytes
LIST: 1 values *ANY
MAP: 1 values *KEYVALUE
KEYVALUE: 1 key text, 2 value ANY
RESOURCE: 1 attributes *KEYVALUE
SCOPE: 1 name text, 2 version text, 3 attributes *KEYVALUE
TRACES: 1 resourceSpans *RESOURCESPANS
RESOURCESPANS: 1 resource RESOURCE, 2 scopeSpans *SCOPESPANS
SCOPESPANS: 1 scope SCOPE, 2 spans *SPAN
SPAN: 1 traceId hex, 2 spanId hex, 4 parentSpanId hex, 5 name text, 6 kind int, 7 startTimeUnixNano fixed, 8 endTimeUnixNano fixed, 9 attributes *KEYVALUE, 11 events *EVENT, 13 links *LINK, 15 status STATUS
EVENT: 1 timeUnixNano fixed, 2 name text, 3 attributes *KEYVALUE
LINK: 1 traceId hex, 2 spanId hex, 3 traceState text, 4 attributes *KEYVALUE
STATUS: 2 message text, 3 code int
LOGS: 1 resourceLogs *RESOURCELOGS
RESOURCELOGS: 1 resource RESOURCE, 2 scopeLogs *SCOPELOGS
SCOPELOGS: 1 scope SCOPE, 2 logRecords *LOGRECORD
LOGRECORD: 1 timeUnixNano fixed, 2 severityNumber int, 3 severityText text, 5 body ANY, 6 attributes *KEYVALUE, 9 traceId hex, 10 spanId hex, 11 observedTimeUnixNano fixed
METRICS: 1 resourceMetrics *RESOURCEMETRICS
RESOURCEMETRICS: 1 resource RESOURCE, 2 scopeMetrics *SCOPEMETRICS
SCOPEMETRICS: 1 scope SCOPE, 2 metrics *METRIC
METRIC: 1 name text, 2 description text, 3 unit text, 5 gauge GAUGE, 7 sum SUM, 9 histogram HISTOGRAM, 10 exponentialHistogram EXPONENTIAL, 11 summary SUMMARY
GAUGE: 1 dataPoints *NUMBER
SUM: 1 dataPoints *NUMBER, 3 isMonotonic bool
HISTOGRAM: 1 dataPoints *HISTOGRAMPOINT
EXPONENTIAL: 1 dataPoints *EXPONENTIALPOINT
SUMMARY: 1 dataPoints *SUMMARYPOINT
NUMBER: 3 timeUnixNano fixed, 4 asDouble double, 6 asInt sfixed, 7 attributes *KEYVALUE
HISTOGRAMPOINT: 3 timeUnixNano fixed, 4 count fixed, 5 sum double, 6 bucketCounts *fixed, 7 explicitBounds *double, 9 attributes *KEYVALUE
EXPONENTIALPOINT: 1 attributes *KEYVALUE, 3 timeUnixNano fixed, 4 count fixed, 5 sum double, 6 scale zigzag, 7 zeroCount fixed, 8 positive BUCKETS, 9 negative BUCKETS
BUCKETS: 1 offset zigzag, 2 bucketCounts *int
SUMMARYPOINT: 3 timeUnixNano fixed
"""

Field = tuple[str, str, bool]
MESSAGES: dict[str, dict[int, Field]] = {}
for _line in _SCHEMA.strip().splitlines():
    _name, _fields = _line.split(": ", 1)
    MESSAGES[_name] = {
        int(n): (f, kind.lstrip("*"), kind.startswith("*")) for n, f, kind in (x.split() for x in _fields.split(", "))
    }

SIGNALS = ("traces", "logs", "metrics")
_WIRE = {"int": 0, "bool": 0, "zigzag": 0, "fixed": 1, "sfixed": 1, "double": 1}
_PACKED = {"fixed": "<Q", "sfixed": "<q", "double": "<d"}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number is cut off")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def _scalar(kind: str, raw: int | bytes) -> object:
    """64-bit numbers are texts in JSON."""
    if kind == "bool":
        return bool(raw)
    if kind == "int":
        return str(raw - (1 << 64) if raw >> 63 else raw)
    if kind == "zigzag":
        return (raw >> 1) ^ -(raw & 1)
    if kind == "text":
        return raw.decode("utf-8")
    if kind in ("hex", "bytes"):
        return raw.hex()
    value = struct.unpack(_PACKED[kind], raw)[0]
    return value if kind == "double" else str(value)


def decode(data: bytes, message: str) -> dict:
    """A message as the dictionary of its JSON form; ValueError if it is not one."""
    out: dict = {}
    fields, at = MESSAGES[message], 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            raw, at = _varint(data, at)
        elif wire in (1, 2, 5):
            size, at = (8, at) if wire == 1 else (4, at) if wire == 5 else _varint(data, at)
            raw = data[at : at + size]
            if len(raw) < size:
                raise ValueError("a field is cut off")
            at += size
        else:
            raise ValueError(f"wire type {wire}")
        if number not in fields:
            continue
        name, kind, repeated = fields[number]
        expected = _WIRE.get(kind, 2)
        if repeated and wire == 2 and expected != 2:  # packed
            values, pos = [], 0
            while pos < len(raw):
                if expected == 0:
                    one, pos = _varint(raw, pos)
                else:
                    one, pos = raw[pos : pos + 8], pos + 8
                values.append(_scalar(kind, one))
            out.setdefault(name, []).extend(values)
            continue
        if wire != expected:
            raise ValueError(f"{message}.{name} has wire type {wire}")
        value = decode(raw, kind) if kind.isupper() else _scalar(kind, raw)
        if repeated:
            out.setdefault(name, []).append(value)
        else:
            out[name] = value
    return out


def to_json(data: bytes, signal: str | None = None) -> str:
    """The JSON document of an export request; without a signal the first one whose schema it fits."""
    for kind in [signal] if signal else SIGNALS:
        try:
            found = decode(data, kind.upper())
        except (ValueError, struct.error):
            if signal:
                raise
            continue
        if found:
            return json.dumps(found)
    raise ValueError("no OTLP request")


def read_documents(spark: SparkSession, path: str, signal: str | None = None) -> DataFrame:
    """(path, text, error): the JSON document of every file; text is null, and error says why, where a file is no OTLP request."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"]):
                try:
                    rows.append((file, to_json(bytes(content), signal), None))
                except (ValueError, struct.error) as e:
                    rows.append((file, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string, error string")
