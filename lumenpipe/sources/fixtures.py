"""Small fixed data sets for trying the engine out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans import catalog as C

MS = 10**6
#: Service and number of child spans of the three traces.
TRACES = (("web-service", 3), ("api-gateway", 2), ("worker-service", 4))


def demo_traces(spark: SparkSession, base_ns: int) -> dict[str, DataFrame]:
    """Three traces: a server span of 100 + 20 ms per child, with client spans of 15 ms each below it."""
    spans, resources = [], []
    names = C.schema("spans").names
    for t, (service, children) in enumerate(TRACES):
        trace, root = f"{t + 1:032x}", f"{t + 1:08x}00000000"
        start = base_ns + t * 1000 * MS
        length = (100 + 20 * children) * MS
        resources.append((t + 1, service, f'{{"service.name":"{service}"}}'))
        rows = [(root, None, f"{service} request", 2, start, length)]
        rows += [(f"{t + 1:08x}{k + 1:08x}", root, f"{service} call {k}", 3, start + (k + 1) * 20 * MS, 15 * MS) for k in range(children)]
        for span, parent, name, kind, begin, took in rows:
            row = dict.fromkeys(names)
            row |= {
                "trace_id": trace, "span_id": span, "parent_span_id": parent, "name": name, "kind": kind, "status": 1,
                "start_time_unix_nano": begin, "end_time_unix_nano": begin + took, "duration_ns": took, "resource_id": t + 1,
                "scope_id": 1, "service_name_attr": service, "_overflow_attrs": {},
            }
            spans.append(tuple(row[n] for n in names))
    return {
        "spans": spark.createDataFrame(spans, C.schema("spans")),
        "resources": spark.createDataFrame(resources, C.schema("resources")),
        "scopes": spark.createDataFrame([(1, "demo", "1", "{}")], C.schema("scopes")),
    }
