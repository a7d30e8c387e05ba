"""Stored signals: date-partitioned Parquet with sorted files, retention, compaction, rollup tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollups, series
from ..plans import catalog as C
from ..plans.errors import ExecutionError

DAY_NS = 86400 * 10**9
#: High-cardinality columns that get a Parquet bloom filter.
BLOOM = {"spans": ("trace_id", "span_id"), "logs": ("trace_id", "span_id")}


@dataclass
class Retention:
    """Days that signals are kept."""

    spans_days: int = 7
    logs_days: int = 7
    metrics_days: int = 7
    profiles_days: int = 7


#: Metric data lie in two-hour folders within the day.
TWO_HOURLY = ("datapoints", "histograms", "exp_histograms")
SERIES_INDEX = "series_id bigint, metric_name string, labels map<string,string>"

FAMILY = {
    "spans": "spans", "span_events": "spans", "span_links": "spans", "logs": "logs", "datapoints": "metrics", "histograms": "metrics",
    "exp_histograms": "metrics", "profiles": "profiles", "samples": "profiles",
}


class Store:
    """A folder (any Hadoop URI) with one table per signal; timed signals lie in year/month/day folders."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, signal: str, df: DataFrame, files_per_day: int | None = None) -> None:
        """Append rows: sorted files in day folders (metric data: two-hour folders below them), with statistics that let scans skip.

        Rows are cut into ranges of time, ties by a hash of the row, so that a hot day or moment does not end in one task; ``files_per_day``
        asks for so many files a day instead. Declared columns are stored in their declared types.
        """
        declared = {f.name: f.dataType for f in C.schema(signal)}
        df = df.select(*[F.col(c).cast(declared[c]).alias(c) if c in declared else F.col(c) for c in df.columns])
        time = C.TIME_COLUMN.get(signal)
        writer_df, folders = df, ["year", "month", "day"]
        if time:
            when = F.timestamp_micros(F.call_function("div", F.col(time), F.lit(1000)))
            writer_df = df.withColumns({"year": F.year(when), "month": F.month(when), "day": F.day(when)})
            if signal in TWO_HOURLY:
                folders.append("hour")
                writer_df = writer_df.withColumn("hour", rollups.two_hour_bucket(F.col(time)).cast("int"))
            spread = F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")])
            if files_per_day:
                writer_df = writer_df.repartition(*folders, F.pmod(spread, F.lit(files_per_day)))
            else:
                writer_df = writer_df.repartitionByRange(time, spread)
            writer_df = writer_df.sortWithinPartitions(*folders, time)
        writer = writer_df.write.mode("append").option("compression", "zstd")
        for col in BLOOM.get(signal, ()):
            if col in df.columns:
                writer = writer.option(f"parquet.bloom.filter.enabled#{col}", "true")
        if time:
            writer = writer.partitionBy(*folders)
        writer.parquet(self.path(signal))

    def read(self, signal: str) -> DataFrame:
        """The table under its declared schema (no footer is opened for it); columns that files lack are null."""
        fs, path = self._fs()
        if not fs.exists(path(self.path(signal))):
            return self.spark.createDataFrame([], C.schema(signal))
        try:
            return self.spark.read.schema(C.schema(signal)).parquet(self.path(signal))
        except Exception as e:
            raise ExecutionError(str(e)) from e

    def points_of(self, metric: str, start: int, end: int, matchers: dict[str, str] | None = None, signal: str = "datapoints") -> DataFrame:
        """Points (or histograms) of the series of a metric in [start, end], by the stored series index; day folders outside are not read."""
        day = F.make_date("year", "month", "day")
        lo, hi = (F.date_add(F.lit("1970-01-01").cast("date"), F.lit(int(x // DAY_NS))) for x in (start, end))
        points = self.read(signal)
        if "year" in points.columns:
            points = points.where((day >= lo) & (day <= hi))
        return series.points_of(points, self.series_index(), metric, start, end, matchers)

    def series_index(self) -> DataFrame:
        fs, path = self._fs()
        if not fs.exists(path(self.path("series_index"))):
            return self.spark.createDataFrame([], SERIES_INDEX)
        return self.spark.read.schema(SERIES_INDEX).parquet(self.path("series_index")).dropDuplicates(["series_id"])

    def register_series(self, index: DataFrame) -> None:
        """Add (series_id, metric_name, labels) to the index; what is there already is not written again."""
        new = index.select("series_id", "metric_name", "labels").dropDuplicates(["series_id"])
        new.join(self.series_index().select("series_id"), "series_id", "left_anti").write.mode("append").parquet(self.path("series_index"))

    def signals(self) -> dict:
        return {s: (lambda s=s: self.read(s)) for s in C.DDL}

    def write_rollups(self, spans: DataFrame | None = None, points: DataFrame | None = None, samples: DataFrame | None = None) -> None:
        """Rollups of new rows beside the raw tables; ``spans`` needs ``service``."""
        if spans is not None:
            rollups.span_rollup(spans).write.mode("append").parquet(self.path("rollup_spans_1m"))
        if points is not None:
            for name, df in rollups.metric_rollups(points).items():
                df.write.mode("append").parquet(self.path(f"rollup_metrics_{name}"))
        if samples is not None:
            rollups.profile_rollup(samples).write.mode("append").parquet(self.path("rollup_profiles_1m"))

    # file system
    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def days(self, signal: str) -> list[tuple[int, str]]:
        """(day number since the epoch, folder) of a signal's date folders."""
        import datetime
        import re

        fs, path = self._fs()
        base = path(self.path(signal))
        found = fs.globStatus(path(f"{self.path(signal)}/year=*/month=*/day=*")) if fs.exists(base) else None
        out = []
        for status in found or []:
            text = status.getPath().toString()
            y, m, d = map(int, re.search(r"year=(\d+)/month=(\d+)/day=(\d+)", text).groups())
            out.append(((datetime.date(y, m, d) - datetime.date(1970, 1, 1)).days, text))
        return sorted(out)

    def cleanup(self, now_ns: int, retention: Retention | None = None) -> int:
        """Drop the date folders that end before the cut-off of their family; returns how many."""
        keep = asdict(retention or self.retention())
        fs, path = self._fs()
        dropped = 0
        for signal, family in FAMILY.items():
            cutoff = (now_ns - keep[f"{family}_days"] * DAY_NS) // DAY_NS
            for day, folder in self.days(signal):
                if day < cutoff:
                    fs.delete(path(folder), True)
                    dropped += 1
        return dropped

    def recover(self, signal: str) -> None:
        """Finish what a compaction that broke off has left: an old folder put aside goes if the new one is in place, else it goes back."""
        fs, path = self._fs()
        for status in fs.globStatus(path(f"{self.root}/_aside/{signal}/*")) or []:
            aside = status.getPath()
            folder = path(f"{self.path(signal)}/{aside.getName().replace('~', '/')}")
            if fs.exists(folder):
                fs.delete(aside, True)
            else:
                fs.rename(aside, folder)
        fs.delete(path(f"{self.root}/_compacting/{signal}"), True)

    def compact(self, signal: str, target_files: int = 1) -> int:
        """Rewrite folders of more files than the target; returns how many.

        The new files are complete, in a folder outside the table, before the old folder is put aside and the new one takes its place by
        a rename: no reader ever meets rows twice. One that comes between the two renames misses the folder; ``recover`` (which every
        compaction begins with) mends what a crash there has left.
        """
        self.recover(signal)
        fs, path = self._fs()
        time, done = C.TIME_COLUMN[signal], 0
        base = path(self.path(signal))
        base_text = fs.makeQualified(base).toString()
        levels = "/year=*/month=*/day=*" + ("/hour=*" if signal in TWO_HOURLY else "")
        for status in (fs.globStatus(path(self.path(signal) + levels)) if fs.exists(base) else None) or []:
            folder = status.getPath()
            old = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".parquet")]
            if len(old) <= target_files:
                continue
            name = folder.toString()[len(base_text) + 1 :].replace("/", "~")
            side, aside = path(f"{self.root}/_compacting/{signal}/{name}"), path(f"{self.root}/_aside/{signal}/{name}")
            rows = self.spark.read.option("mergeSchema", "true").parquet(*[p.toString() for p in old])
            merged = rows.repartitionByRange(target_files, time).sortWithinPartitions(time)
            merged.write.mode("overwrite").option("compression", "zstd").parquet(side.toString())
            if self.spark.read.parquet(side.toString()).count() != rows.count():
                raise ExecutionError(f"compaction of {folder} lost rows")
            fs.mkdirs(aside.getParent())
            if not (fs.rename(folder, aside) and fs.rename(side, folder)):
                raise ExecutionError(f"compaction of {folder} could not be put in place")
            fs.delete(aside, True)
            done += 1
        return done

    def stats(self) -> dict[str, int]:
        return {s: self.read(s).count() for s in C.DDL}

    # small JSON settings
    def save_json(self, name: str, value: object) -> None:
        fs, path = self._fs()
        out = fs.create(path(self.path(f"settings-{name}.json")), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def load_json(self, name: str, default: object) -> object:
        fs, path = self._fs()
        if not fs.exists(path(self.path(f"settings-{name}.json"))):
            return default
        return json.loads(self.spark.read.text(self.path(f"settings-{name}.json"), wholetext=True).first()[0])

    def retention(self) -> Retention:
        return Retention(**self.load_json("retention", {}))

    def set_retention(self, retention: Retention) -> None:
        self.save_json("retention", asdict(retention))

    def health_rules(self) -> list[tuple]:
        from ..operators.health import DEFAULT_RULES

        return [tuple(r) for r in self.load_json("health_rules", DEFAULT_RULES)]

    def set_health_rule(self, metric: str, weight: float, warn: float, error: float) -> None:
        rest = [r for r in self.health_rules() if r[0] != metric]
        self.save_json("health_rules", [*rest, (metric, weight, warn, error)])

    def remove_health_rule(self, metric: str) -> None:
        self.save_json("health_rules", [r for r in self.health_rules() if r[0] != metric])
