"""Streaming forms of the record-keeping operators: deduplicated ingest and late-corrected periods.

Both keep their state in a folder of numbered versions. Batch n reads version n - 1 and replaces version n
and its own output, so a batch that is run again after a failure has the same effect once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import joined
from ..operators import dedup, late
from ..operators.shared import NS, materialize


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions in a folder."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jpath(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(jpath(path))]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and fs.exists(jpath(f"{path}/{n}/_SUCCESS")))


def _read(spark: SparkSession, path: str, version: int, schema: str) -> DataFrame:
    """The latest version up to the given one (numbers may skip where a trigger had no data)."""
    have = [v for v in _versions(spark, path) if v <= version]
    if not have:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/v{have[-1]}")


def _forget(spark: SparkSession, path: str, number: int) -> None:
    """Remove the versions that no batch will read: all but this one and the one before it, which this batch reads if it is run again."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for v in [v for v in _versions(spark, path) if v < number][:-1]:
        fs.delete(jpath(f"{path}/v{v}"), True)


class ExactlyOnce:
    """For ``foreachBatch``: appends each span once to ``out``; seen ranges and malformed keys are the state."""

    def __init__(self, out: str, state: str) -> None:
        self.out, self.state = out.rstrip("/"), state.rstrip("/")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ranges = _read(spark, f"{self.state}/ranges", number - 1, "producer string, first bigint, last bigint")
        keys = _read(spark, f"{self.state}/keys", number - 1, "trace_id string, span_id string")
        found = materialize(dedup.span_ranges(batch, ranges))
        dedup.deduplicate_spans(batch, ranges, keys, ranges=found).write.mode("overwrite").parquet(f"{self.out}/batch={number}")
        merged = dedup.merged_ranges(found).withColumn("producer", F.lower(F.hex("producer")))
        merged.write.mode("overwrite").parquet(f"{self.state}/ranges/v{number}")
        odd = dedup.span_keys(batch.select("trace_id", "span_id")).where("__number IS NULL")
        odd = odd.select(F.col("__t").alias("trace_id"), F.col("__s").alias("span_id"))
        keys.unionByName(odd).distinct().write.mode("overwrite").parquet(f"{self.state}/keys/v{number}")
        _forget(spark, f"{self.state}/ranges", number)
        _forget(spark, f"{self.state}/keys", number)


_STATE = "resource_id bigint, minute_unix_s bigint, value bigint, n_on_time bigint, n_late bigint, n_dropped bigint"
_PERIODS = (
    "resource_id bigint, minute_unix_s bigint, n_on_time bigint, n_late bigint, n_dropped bigint, n_distinct bigint, min_value bigint, "
    "max_value bigint, median_on_time bigint, median_value bigint"
)
_DROPPED = "resource_id bigint, minute_unix_s bigint, n_dropped bigint"


class CorrectedPeriods:
    """For ``foreachBatch`` over rows that are there once, in order of receipt: late rows correct the periods that are still open.

    The state has the multisets of open periods only. A period is closed once something has been received that is past its cut-off; it
    then leaves the state, and its aggregates are written once. A row for a period that is closed is counted as dropped.
    """

    def __init__(self, state: str, period_s: int = 60, on_time_s: int = late.ON_TIME_S, cut_off_s: int = late.CUT_OFF_S) -> None:
        self.state, self.period_s, self.on_time_s, self.cut_off_s = state.rstrip("/"), period_s, on_time_s, cut_off_s

    def _closed(self, received: int | None) -> Column:
        """Whether nothing that is received at or after a time can still correct a period."""
        if received is None:
            return F.lit(False)
        return (F.col("minute_unix_s") + (self.period_s + self.cut_off_s)) * F.lit(NS) < F.lit(received)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where((F.col("start_time_unix_nano") != 0) & F.col("received_unix_nano").isNotNull())
        new = materialize(late.multiset(rows, self.period_s, self.on_time_s, self.cut_off_s))
        before = _read(spark, f"{self.state}/received", number - 1, "received bigint").agg(F.max("received")).first()[0]
        latest = rows.agg(F.max("received_unix_nano")).first()[0]
        now = max((x for x in (before, latest) if x is not None), default=None)
        shut = self._closed(before)
        old = _read(spark, f"{self.state}/open", number - 1, _STATE)
        merged = materialize(late.merge_states(old, new.where(~shut)))
        closed = self._closed(now)
        late.with_medians(merged.where(closed)).write.mode("overwrite").parquet(f"{self.state}/closed/batch={number}")
        dropped = new.where(shut).groupBy("resource_id", "minute_unix_s").agg(
            F.sum(F.col("n_on_time") + F.col("n_late") + F.col("n_dropped")).alias("n_dropped")
        )
        dropped.write.mode("overwrite").parquet(f"{self.state}/dropped/batch={number}")
        spark.createDataFrame([(now,)], "received bigint").write.mode("overwrite").parquet(f"{self.state}/received/v{number}")
        merged.where(~closed).write.mode("overwrite").parquet(f"{self.state}/open/v{number}")
        for folder in ("received", "open"):
            _forget(spark, f"{self.state}/{folder}", number)

    def periods(self, spark: SparkSession) -> DataFrame:
        """All periods so far, closed and open, with medians."""
        parts = []
        for folder, schema in (("closed", _PERIODS), ("dropped", _DROPPED)):
            path = f"{self.state}/{folder}"
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
            parts.append(spark.read.schema(schema).parquet(f"{path}/batch=*") if there else spark.createDataFrame([], schema))
        keys = ["resource_id", "minute_unix_s"]
        found = parts[0].unionByName(late.with_medians(_read(spark, f"{self.state}/open", 1 << 62, _STATE)))
        missed = parts[1].groupBy(*keys).agg(F.sum("n_dropped").alias("__dropped"))
        out = joined(found, missed, keys, "left")
        return out.withColumn("n_dropped", F.col("n_dropped") + F.coalesce("__dropped", F.lit(0))).select(*found.columns)
