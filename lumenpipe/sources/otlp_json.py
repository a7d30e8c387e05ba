"""OTLP/JSON documents to signal rows.

A document is one export request as JSON text. Decoding is declarative: ``from_json`` with a fixed schema,
``explode`` over resources, scopes and records, and column expressions, content hashes included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import fnv32, fnv64, fnv64_of, long_bytes, metric_id, series_id
from ..plans import catalog as C

_VALUE = "struct<stringValue:string,boolValue:boolean,intValue:string,doubleValue:double,bytesValue:string,arrayValue:string,kvlistValue:string>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
_SCOPE = f"struct<name:string,version:string,attributes:{_ATTRS}>"
_EVENT = f"struct<timeUnixNano:string,name:string,attributes:{_ATTRS}>"
_LINK = f"struct<traceId:string,spanId:string,traceState:string,attributes:{_ATTRS}>"
_SPAN = (
    f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,"
    f"endTimeUnixNano:string,attributes:{_ATTRS},status:struct<code:string>,events:array<{_EVENT}>,links:array<{_LINK}>>"
)
_LOG = (
    f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:string,severityText:string,body:{_VALUE},"
    f"attributes:{_ATTRS},traceId:string,spanId:string>"
)
_NUMBER = f"struct<attributes:{_ATTRS},timeUnixNano:string,asDouble:double,asInt:string>"
_HIST = (
    f"struct<attributes:{_ATTRS},timeUnixNano:string,count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>>"
)
_BUCKETS = "struct<offset:int,bucketCounts:array<string>>"
_EXP = (
    f"struct<attributes:{_ATTRS},timeUnixNano:string,count:string,sum:double,scale:int,zeroCount:string,positive:{_BUCKETS},negative:{_BUCKETS}>"
)
_METRIC = (
    f"struct<name:string,description:string,unit:string,gauge:struct<dataPoints:array<{_NUMBER}>>,"
    f"sum:struct<dataPoints:array<{_NUMBER}>,isMonotonic:boolean>,histogram:struct<dataPoints:array<{_HIST}>>,"
    f"exponentialHistogram:struct<dataPoints:array<{_EXP}>>,summary:string>"
)
_SAMPLE = "struct<stackIndex:int,values:array<string>>"
_PROFILE = (
    "struct<profileId:string,timeUnixNano:string,sampleType:struct<typeStrindex:int,unitStrindex:int>,"
    f"sample:array<{_SAMPLE}>,originalPayload:string>"
)
_DICTIONARY = (
    "struct<stringTable:array<string>,functionTable:array<struct<nameStrindex:int,systemNameStrindex:int,filenameStrindex:int,startLine:string>>,"
    "locationTable:array<struct<line:array<struct<functionIndex:int>>>>,mappingTable:array<struct<filenameStrindex:int>>,"
    "stackTable:array<struct<locationIndices:array<int>>>>"
)


def _request(root: str, scopes: str, records: str, record: str, extra: str = "") -> str:
    return f"struct<{root}:array<struct<resource:struct<attributes:{_ATTRS}>,{scopes}:array<struct<scope:{_SCOPE},{records}:array<{record}>>>>>{extra}>"


_SHAPES = {
    "traces": ("resourceSpans", "scopeSpans", "spans", _SPAN, ""),
    "logs": ("resourceLogs", "scopeLogs", "logRecords", _LOG, ""),
    "metrics": ("resourceMetrics", "scopeMetrics", "metrics", _METRIC, ""),
    "profiles": ("resourceProfiles", "scopeProfiles", "profiles", _PROFILE, f",dictionary:{_DICTIONARY}"),
}


def read_documents(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    """(text): the documents of a file or folder."""
    return spark.read.text(path, wholetext=not one_per_line).select(F.col("value").alias("text"))


def detect(docs: DataFrame) -> DataFrame:
    """Adds ``kind``, the signal family of each document, null if it is none."""
    kind = F.lit(None).cast("string")
    for name, (root, *_) in _SHAPES.items():
        kind = F.when(F.get_json_object("text", f"$.{root}").isNotNull(), name).otherwise(kind)
    return docs.withColumn("kind", kind)


def _value_text(v: Column) -> Column:
    """A value as plain text."""
    return F.coalesce(
        v["stringValue"], v["boolValue"].cast("string"), v["intValue"], v["doubleValue"].cast("string"), v["bytesValue"],
        v["arrayValue"], v["kvlistValue"],
    )


def _value_json(v: Column) -> Column:
    """A value as a JSON scalar (strings and bytes quoted) or the JSON text of a compound one."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return F.coalesce(
        quoted(v["stringValue"]), v["boolValue"].cast("string"), v["intValue"], v["doubleValue"].cast("string"),
        quoted(v["bytesValue"]), v["arrayValue"], v["kvlistValue"],
    )


def _last_of(attrs: Column, key: Column) -> Column:
    return F.try_element_at(F.filter(attrs, lambda a: a["key"] == key), F.lit(-1))["value"]


def _as_map(attrs: Column, text) -> Column:
    """Attributes as a map, the last one of a key; null arrays give an empty map."""
    attrs = F.coalesce(attrs, F.array().cast(_ATTRS))
    keys = F.array_distinct(F.transform(F.filter(attrs, lambda a: a["key"].isNotNull()), lambda a: a["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), text(_last_of(attrs, k)).alias("value"))))


def _routed(df: DataFrame, attrs: str) -> DataFrame:
    """Promoted columns for attributes whose key and type match the catalog; all others go to the overflow map."""
    a = F.coalesce(F.col(attrs), F.array().cast(_ATTRS))
    cols, fits = {}, F.lit(False)
    for key, kind in C.PROMOTED.items():
        v = _last_of(a, F.lit(key))
        long = isinstance(kind, T.LongType)
        cols[C.attribute_column(key)] = v["intValue"].try_cast("bigint") if long else v["stringValue"]
    longs = [k for k, t in C.PROMOTED.items() if isinstance(t, T.LongType)]
    texts = [k for k, t in C.PROMOTED.items() if not isinstance(t, T.LongType)]
    fits = lambda x: (x["key"].isin(longs) & x["value"]["intValue"].isNotNull()) | (
        x["key"].isin(texts) & x["value"]["stringValue"].isNotNull()
    )
    rest = F.filter(a, lambda x: ~F.coalesce(fits(x), F.lit(False)))
    return df.withColumns(cols).withColumn("_overflow_attrs", _as_map(rest, _value_json)).drop(attrs)


def _sorted_content(attributes: Column, end: str) -> Column:
    entries = F.array_sort(F.map_entries(attributes))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("\u0000"), e["value"], F.lit(end))), "")


def _records(docs: DataFrame, family: str) -> DataFrame:
    """One row per record: rec, resource map, scope struct, ids and service name (and the dictionary of profiles)."""
    root, scopes, records, record, extra = _SHAPES[family]
    parsed = docs.select(F.from_json("text", _request(root, scopes, records, record, extra)).alias("d"))
    keep = [F.col("d.dictionary").alias("dictionary")] if extra else []
    rows = parsed.select(F.explode(f"d.{root}").alias("r"), *keep)
    later = [F.col(c) for c in ("dictionary",) if extra]
    rows = rows.select(_as_map(F.col("r.resource.attributes"), _value_text).alias("resource"), F.explode(f"r.{scopes}").alias("s"), *later)
    rows = rows.select("resource", F.col("s.scope").alias("scope"), F.explode(f"s.{records}").alias("rec"), *later)
    scope_attrs = _as_map(F.col("scope.attributes"), _value_json)
    name, version = F.coalesce("scope.name", F.lit("")), F.coalesce("scope.version", F.lit(""))
    content = F.concat(name, F.lit("\u0000"), version, F.lit("\u0000"), _sorted_content(scope_attrs, "\n"))
    return rows.withColumns(
        {
            "resource_id": fnv32(_sorted_content(F.col("resource"), "\n")),
            "scope_id": fnv32(content),
            "service_name": F.coalesce(F.try_element_at("resource", F.lit("service.name")), F.lit("unknown")),
        }
    )


def resources(docs: DataFrame, family: str) -> DataFrame:
    rows = _records(docs, family).select("resource_id", "service_name", F.to_json("resource").alias("attributes"))
    return rows.dropDuplicates(["resource_id"])


def scopes(docs: DataFrame, family: str) -> DataFrame:
    rows = _records(docs, family).select(
        "scope_id", F.coalesce("scope.name", F.lit("")).alias("name"), F.coalesce("scope.version", F.lit("")).alias("version"),
        F.to_json(_as_map(F.col("scope.attributes"), _value_text)).alias("attributes"),
    )
    return rows.dropDuplicates(["scope_id"])


def _code(text: Column, names: dict[str, int], prefix: str) -> Column:
    """An enum given as number or as name."""
    out = text.try_cast("int")
    for name, number in names.items():
        out = F.when(text == prefix + name, number).otherwise(out)
    return F.coalesce(out, F.lit(0)).cast("smallint")


def _nanos(col: str) -> Column:
    return F.coalesce(F.col(col).try_cast("bigint"), F.lit(0).cast("bigint"))


def _ident(col: str) -> Column:
    return F.lower(F.col(col))


def spans(docs: DataFrame) -> DataFrame:
    start, end = _nanos("rec.startTimeUnixNano"), _nanos("rec.endTimeUnixNano")
    parent = F.when(F.col("rec.parentSpanId") != "", _ident("rec.parentSpanId"))
    rows = _records(docs, "traces").select(
        _ident("rec.traceId").alias("trace_id"), _ident("rec.spanId").alias("span_id"), parent.alias("parent_span_id"), F.col("rec.name").alias("name"),
        _code(F.col("rec.kind"), C.KIND, "SPAN_KIND_").alias("kind"), _code(F.col("rec.status.code"), C.STATUS, "STATUS_CODE_").alias("status"),
        start.alias("start_time_unix_nano"), end.alias("end_time_unix_nano"), (end - start).alias("duration_ns"), "resource_id", "scope_id",
        F.col("rec.attributes").alias("attrs"),
    )
    return _routed(rows, "attrs")


def span_events(docs: DataFrame) -> DataFrame:
    rows = _records(docs, "traces").select("rec", F.explode("rec.events").alias("e"))
    return rows.select(
        _ident("rec.traceId").alias("trace_id"), _ident("rec.spanId").alias("span_id"), _nanos("e.timeUnixNano").alias("time_unix_nano"),
        F.col("e.name").alias("name"), _as_map(F.col("e.attributes"), _value_json).alias("_overflow_attrs"),
    )


def span_links(docs: DataFrame) -> DataFrame:
    rows = _records(docs, "traces").select("rec", F.explode("rec.links").alias("l"))
    return rows.select(
        _ident("rec.traceId").alias("source_trace_id"), _ident("rec.spanId").alias("source_span_id"), _ident("l.traceId").alias("target_trace_id"),
        _ident("l.spanId").alias("target_span_id"), F.col("l.traceState").alias("trace_state"),
        _as_map(F.col("l.attributes"), _value_json).alias("_overflow_attrs"),
    )


def severity_floor(number: Column) -> Column:
    """Severity clamped to the floor of its band; unknown numbers are INFO."""
    out = F.lit(9)
    for floor in C.SEVERITY.values():
        out = F.when(number.between(floor, floor + 3), floor).otherwise(out)
    return out.cast("smallint")


def logs(docs: DataFrame, received_ns: int = 0) -> DataFrame:
    """Log rows; records without a time get ``received_ns``. The id is a hash of the record, so that re-reading repeats it."""
    time = F.when(_nanos("rec.timeUnixNano") > 0, _nanos("rec.timeUnixNano")).otherwise(F.lit(received_ns))
    seen = F.when(_nanos("rec.observedTimeUnixNano") > 0, _nanos("rec.observedTimeUnixNano")).otherwise(time)
    ident = F.substring(F.sha2(F.concat_ws("|", F.to_json("rec"), "resource_id", "scope_id"), 256), 1, 32)
    number = F.col("rec.severityNumber").try_cast("int")
    for name, code in C.SEVERITY.items():
        number = F.when(F.col("rec.severityNumber") == f"SEVERITY_NUMBER_{name}", code).otherwise(number)
    rows = _records(docs, "logs").select(
        ident.alias("log_id"), time.alias("time_unix_nano"), seen.alias("observed_time_unix_nano"), "service_name",
        F.coalesce("rec.severityText", F.lit("")).alias("severity_text"), severity_floor(F.coalesce(number, F.lit(0))).alias("severity_number"),
        F.coalesce("rec.body.stringValue", F.lit("")).alias("body"), F.when(F.col("rec.traceId") != "", _ident("rec.traceId")).alias("trace_id"),
        F.when(F.col("rec.spanId") != "", _ident("rec.spanId")).alias("span_id"), "resource_id", "scope_id", F.col("rec.attributes").alias("attrs"),
    )
    return _routed(rows, "attrs")


def _metric_rows(docs: DataFrame) -> DataFrame:
    kind = (
        F.when(F.col("rec.gauge").isNotNull(), "gauge")
        .when(F.col("rec.sum").isNotNull(), F.when(F.col("rec.sum.isMonotonic"), "counter").otherwise("gauge"))
        .when(F.col("rec.histogram").isNotNull() | F.col("rec.exponentialHistogram").isNotNull(), "histogram")
        .when(F.col("rec.summary").isNotNull(), "summary")
        .otherwise("gauge")
    )
    rows = _records(docs, "metrics").withColumn("metric_type", kind)
    ident = metric_id(
        F.col("rec.name"), F.col("rec.description"), F.col("rec.unit"), F.col("metric_type"), F.col("resource_id"), F.col("scope_id")
    )
    return rows.withColumn("metric_id", ident)


def metrics(docs: DataFrame) -> DataFrame:
    """One row per metric id."""
    rows = _metric_rows(docs).select(
        "metric_id", F.col("rec.name").alias("name"), F.col("rec.description").alias("description"), F.col("rec.unit").alias("unit"),
        "metric_type", "service_name", "resource_id", "scope_id",
    )
    return rows.dropDuplicates(["metric_id"])


def _points(docs: DataFrame, points: Column) -> DataFrame:
    rows = _metric_rows(docs).select("metric_id", F.explode(points).alias("p"))
    series = series_id(F.col("metric_id"), _as_map(F.col("p.attributes"), _value_text))
    return rows.withColumn("series_id", series).withColumn("time_unix_nano", _nanos("p.timeUnixNano"))


def datapoints(docs: DataFrame) -> DataFrame:
    """Points of gauges and sums; whole numbers become doubles, and points without a value are none."""
    rows = _points(docs, F.coalesce("rec.gauge.dataPoints", "rec.sum.dataPoints"))
    value = F.coalesce("p.asDouble", F.col("p.asInt").try_cast("double"))
    return rows.select("series_id", "metric_id", "time_unix_nano", value.alias("value")).where("value IS NOT NULL")


def _counts(col: str) -> Column:
    return F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda x: x.try_cast("bigint"))


def histograms(docs: DataFrame) -> DataFrame:
    rows = _points(docs, F.col("rec.histogram.dataPoints"))
    return rows.select(
        "series_id", "metric_id", "time_unix_nano", _nanos("p.count").alias("count"), F.coalesce("p.sum", F.lit(0.0)).alias("sum"),
        _counts("p.bucketCounts").alias("bucket_counts"), F.coalesce("p.explicitBounds", F.array().cast("array<double>")).alias("explicit_bounds"),
    )


def exp_histograms(docs: DataFrame) -> DataFrame:
    rows = _points(docs, F.col("rec.exponentialHistogram.dataPoints"))
    return rows.select(
        "series_id", "metric_id", "time_unix_nano", _nanos("p.count").alias("count"), F.coalesce("p.sum", F.lit(0.0)).alias("sum"),
        F.coalesce("p.scale", F.lit(0)).alias("scale"), _nanos("p.zeroCount").alias("zero_count"),
        F.coalesce("p.positive.offset", F.lit(0)).alias("positive_offset"), _counts("p.positive.bucketCounts").alias("positive_counts"),
        F.coalesce("p.negative.offset", F.lit(0)).alias("negative_offset"), _counts("p.negative.bucketCounts").alias("negative_counts"),
    )


# profiles
def _string(index: Column, table: str = "dictionary.stringTable") -> Column:
    return F.when(index > 0, F.coalesce(F.get(F.col(table), index), F.lit(""))).otherwise("")


def _functions(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.from_json("text", _request(*_SHAPES["profiles"])).alias("d")).select(F.col("d.dictionary").alias("dictionary"))
    rows = rows.withColumn("document", F.xxhash64(F.to_json("dictionary")))
    f = rows.select("dictionary", "document", F.posexplode("dictionary.functionTable").alias("function", "f"))
    name, file = _string(F.col("f.nameStrindex")), _string(F.col("f.filenameStrindex"))
    line = F.coalesce(F.col("f.startLine").try_cast("bigint"), F.lit(0))
    nul = F.lit("\u0000")
    return f.select(
        "document", "function", name.alias("function_name"), _string(F.col("f.systemNameStrindex")).alias("system_name"), file.alias("filename"),
        line.alias("line"), fnv64(F.concat(name, nul, file, nul, line.cast("string"))).alias("frame_id"),
    )


def frames(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.when(F.col(c) != "", F.col(c))
    return _functions(docs).select(
        "frame_id", "function_name", empty("system_name").alias("system_name"), empty("filename").alias("filename"),
        F.when(F.col("line") != 0, F.col("line")).alias("line"), F.lit(None).cast("bigint").alias("column"),
        F.lit(None).cast("bigint").alias("mapping_id"), F.lit(False).alias("inline"),
    ).dropDuplicates(["frame_id"])


def mappings(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.from_json("text", _request(*_SHAPES["profiles"])).alias("d")).select(F.col("d.dictionary").alias("dictionary"))
    m = rows.select("dictionary", F.posexplode("dictionary.mappingTable").alias("i", "m"))
    file = _string(F.col("m.filenameStrindex"))
    return m.select(
        fnv64(F.concat(F.col("i").cast("string"), file)).alias("mapping_id"), file.alias("filename"), F.lit(None).cast("string").alias("build_id")
    ).dropDuplicates(["mapping_id"])


def _stacks(docs: DataFrame) -> DataFrame:
    """(document, stack, frame ids from the leaf up, stack_id) of every stack of every dictionary."""
    rows = docs.select(F.from_json("text", _request(*_SHAPES["profiles"])).alias("d")).select(F.col("d.dictionary").alias("dictionary"))
    rows = rows.withColumn("document", F.xxhash64(F.to_json("dictionary")))
    s = rows.select("document", "dictionary", F.posexplode("dictionary.stackTable").alias("stack", "s"))
    lines = s.select("document", "stack", "dictionary", F.posexplode("s.locationIndices").alias("k", "location"))
    lines = lines.select("document", "stack", "k", F.posexplode(F.get("dictionary.locationTable", F.col("location"))["line"]).alias("j", "line"))
    ids = lines.join(
        _functions(docs).select("document", F.col("function").alias("fn"), "frame_id").distinct(),
        ["document"], "inner",
    ).where(F.col("line.functionIndex") == F.col("fn"))
    found = ids.groupBy("document", "stack").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "j", "frame_id"))), lambda x: x["frame_id"]).alias("frames")
    )
    return found.withColumn("stack_id", fnv64_of(F.flatten(F.transform("frames", long_bytes))))


def stacks(docs: DataFrame) -> DataFrame:
    rows = _stacks(docs).dropDuplicates(["stack_id"])
    return rows.select("stack_id", F.posexplode("frames").alias("position", "frame_id")).select(
        "stack_id", "frame_id", F.col("position").cast("bigint").alias("position")
    )


#: Profile types by name; others are "other".
PROFILE_TYPES = ("cpu", "memory", "goroutine", "block", "mutex")


def _profile_rows(docs: DataFrame, received_ns: int) -> DataFrame:
    rows = _records(docs, "profiles")
    time = F.when(_nanos("rec.timeUnixNano") > 0, _nanos("rec.timeUnixNano")).otherwise(F.lit(received_ns))
    known = F.col("rec.sampleType").isNotNull()
    name = F.when(known, _string(F.col("rec.sampleType.typeStrindex"))).otherwise("unknown")
    unit = F.when(known, _string(F.col("rec.sampleType.unitStrindex"))).otherwise("unknown")
    ident = F.coalesce(F.when(F.col("rec.profileId") != "", _ident("rec.profileId")), F.md5(F.to_json("rec")))
    return rows.withColumns(
        {"profile_id": ident, "time_unix_nano": time, "sample_type": name, "sample_unit": unit, "document": F.xxhash64(F.to_json("dictionary"))}
    )


def profiles(docs: DataFrame, received_ns: int = 0) -> DataFrame:
    low = F.lower("sample_type")
    payload = F.coalesce(F.unbase64("rec.originalPayload"), F.encode(F.to_json("rec"), "UTF-8"))
    return _profile_rows(docs, received_ns).select(
        "profile_id", "time_unix_nano", "service_name", "resource_id", "scope_id", F.when(low.isin(*PROFILE_TYPES), low).otherwise("other").alias("profile_type"),
        "sample_type", "sample_unit", F.lit(None).cast("string").alias("trace_id"), payload.alias("data"),
    )


def samples(docs: DataFrame, received_ns: int = 0) -> DataFrame:
    """A row per sample with its first value; a sample without frames has stack 0."""
    rows = _profile_rows(docs, received_ns).select("*", F.explode("rec.sample").alias("x"))
    known = _stacks(docs).select(F.col("document").alias("__d"), F.col("stack").alias("__s"), "stack_id").dropDuplicates(["__d", "__s"])
    rows = rows.join(known, (F.col("document") == F.col("__d")) & (F.col("x.stackIndex") == F.col("__s")), "left")
    first = F.coalesce(F.get("x.values", F.lit(0)).try_cast("bigint"), F.lit(0))
    return rows.select(
        "profile_id", F.coalesce("stack_id", F.lit(0)).alias("stack_id"), F.col("service_name").alias("service"), "time_unix_nano",
        "resource_id", "scope_id", F.col("sample_type").alias("value_type"), first.alias("value"),
    )
