"""Shape and column roles of a result: functions of the query alone (and of the result's schema for types)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import ast as A


@dataclass(frozen=True)
class ColumnDef:
    name: str
    data_type: str
    role: str


def infer_shape(query: A.Query) -> str:
    """One of trace_timeline, table, heatmap, time_series, scalar and pattern_groups; the first deciding stage counts."""
    walked = [s.signal for s in query.stages if isinstance(s, A.Navigate)]
    if walked and walked[-1] == "spans":
        return "trace_timeline"
    if query.scan.signal == "traces" and not walked:
        return "table"
    for s in query.stages:
        if isinstance(s, A.Group):
            if any(a.name == "heatmap" for a in s.aggs):
                return "heatmap"
            if any(k.bin_ns is not None for k in s.keys):
                return "time_series"
            return "table" if s.keys else "scalar"
        if isinstance(s, A.Patterns):
            return "pattern_groups"
    return "table"


def _type_name(name: str, kind: T.DataType) -> str:
    if name.endswith("_unix_nano"):
        return "Timestamp"
    special = {"duration_ns": "Duration", "status": "Status", "kind": "SpanKind", "severity_number": "Severity"}
    if name in special:
        return special[name]
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Int64"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "Float64"
    return "Bool" if isinstance(kind, T.BooleanType) else "String"


def columns_of(query: A.Query, df: DataFrame) -> list[ColumnDef]:
    roles: dict[str, str] = {}
    for s in query.stages:
        if isinstance(s, A.Group):
            roles = {k.alias: "GroupKey" for k in s.keys} | {a.alias: "Aggregation" for a in s.aggs}
        elif isinstance(s, A.Compute):
            roles |= {alias: "Computed" for _, alias in s.items}
        elif isinstance(s, A.Navigate):
            roles = {}
        elif isinstance(s, A.Select):
            roles = {alias: roles.get(f.name, "Field") for f, alias in s.items}
    return [ColumnDef(f.name, _type_name(f.name, f.dataType), roles.get(f.name, "Field")) for f in df.schema]
