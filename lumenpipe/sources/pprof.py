"""pprof files (protocol buffers, gzipped or plain) to resolved samples and profile signals."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fnv64, fnv64_of, long_bytes

_FRAME = "struct<function_name:string,system_name:string,filename:string,line:bigint,inline:boolean>"
RESOLVED = f"path string, time_unix_nano bigint, value_type string, unit string, value bigint, frames array<{_FRAME}>"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, number or bytes) of a message, in the order of the wire."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        else:
            raise ValueError(f"wire type {wire}")
        yield number, value


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for number, value in _fields(data):
        out.setdefault(number, []).append(value)
    return out


def _numbers(values: list) -> list[int]:
    """A repeated number field, packed or not."""
    out: list[int] = []
    for v in values:
        if isinstance(v, int):
            out.append(v)
        else:
            at = 0
            while at < len(v):
                n, at = _varint(v, at)
                out.append(n)
    return out


def resolve(data: bytes) -> list[tuple]:
    """(time, value type, unit, first value, frames from the leaf up) per sample of one profile.

    A location with several lines holds inlined calls: all but its last line are inline.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    p = _message(data)
    strings = [s.decode("utf-8", "replace") for s in p.get(6, [])] or [""]
    text = lambda i: strings[i] if 0 <= i < len(strings) else ""
    one = lambda m, k: m.get(k, [0])[-1]
    functions = {}
    for raw in p.get(5, []):
        f = _message(raw)
        functions[one(f, 1)] = (text(one(f, 2)), text(one(f, 3)), text(one(f, 4)))
    locations = {}
    for raw in p.get(4, []):
        m = _message(raw)
        lines = [_message(x) for x in m.get(4, [])]
        frames = []
        for i, x in enumerate(lines):
            name, system, file = functions.get(one(x, 1), ("", "", ""))
            frames.append((name, system or None, file or None, _signed(one(x, 2)), i < len(lines) - 1))
        locations[one(m, 1)] = frames
    kinds = [_message(x) for x in p.get(1, [])]
    kind, unit = (text(one(kinds[0], 1)), text(one(kinds[0], 2))) if kinds else ("unknown", "unknown")
    time = _signed(one(p, 9))
    out = []
    for raw in p.get(2, []):
        s = _message(raw)
        values = _numbers(s.get(2, []))
        frames = [f for loc in _numbers(s.get(1, [])) for f in locations.get(loc, [])]
        out.append((time, kind, unit, _signed(values[0]) if values else 0, frames))
    return out


def read_pprof(spark: SparkSession, path: str) -> DataFrame:
    """Resolved samples of the files of a folder; files that are no profile give nothing here and are listed by ``failed_files``."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "time_unix_nano", "value_type", "unit", "value", "frames"]
        fields = ["function_name", "system_name", "filename", "line", "inline"]
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                try:
                    rows = resolve(bytes(content))
                except (ValueError, IndexError, OSError, EOFError):
                    continue
                table = [(file, *r[:4], [dict(zip(fields, f)) for f in r[4]]) for r in rows]
                yield pd.DataFrame(table, columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, RESOLVED)


def failed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, error): the files of a folder that are no profile, and why."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bad = []
            for file, content in zip(batch["path"], batch["content"]):
                try:
                    resolve(bytes(content))
                except (ValueError, IndexError, OSError, EOFError) as e:
                    bad.append((file, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(bad, columns=["path", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(check, "path string, error string")


def _frame_id(x):
    nul = F.lit("\u0000")
    return fnv64(F.concat(x["function_name"], nul, F.coalesce(x["filename"], F.lit("")), nul, x["line"].cast("string")))


def _with_ids(resolved: DataFrame) -> DataFrame:
    ids = F.transform("frames", _frame_id)
    stack = F.when(F.size("frames") > 0, fnv64_of(F.flatten(F.transform(ids, long_bytes)))).otherwise(F.lit(0).cast("bigint"))
    return resolved.withColumn("frame_ids", ids).withColumn("stack_id", stack)


def frames(resolved: DataFrame) -> DataFrame:
    one = resolved.select(F.explode("frames").alias("f"))
    return one.select(
        _frame_id(F.col("f")).alias("frame_id"), "f.function_name", "f.system_name", "f.filename", F.when(F.col("f.line") != 0, F.col("f.line")).alias("line"),
        F.lit(None).cast("bigint").alias("column"), F.lit(None).cast("bigint").alias("mapping_id"), "f.inline",
    ).dropDuplicates(["frame_id"])


def stacks(resolved: DataFrame) -> DataFrame:
    rows = _with_ids(resolved).dropDuplicates(["stack_id"])
    return rows.select("stack_id", F.posexplode("frame_ids").alias("position", "frame_id")).select(
        "stack_id", "frame_id", F.col("position").cast("bigint").alias("position")
    )


def samples(resolved: DataFrame, service: str = "unknown", resource_id: int = 0, scope_id: int = 0) -> DataFrame:
    return _with_ids(resolved).select(
        F.md5("path").alias("profile_id"), "stack_id", F.lit(service).alias("service"), "time_unix_nano",
        F.lit(resource_id).cast("bigint").alias("resource_id"), F.lit(scope_id).cast("bigint").alias("scope_id"), "value_type", "value",
    )
