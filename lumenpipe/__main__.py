"""Command line.

python -m lumenpipe FOLDER QUERY [--form table|json|jsonl] [--limit N] [--now NS]: run a query over a folder of Parquet tables.
python -m lumenpipe ingest FOLDER PATH [--format auto|json|protobuf] [--signal traces|logs|metrics]: append OTLP files to a store.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .engine import Engine
from .sources import adapters
from .sources.storage import Store


def ingest(args: list[str]) -> None:
    from .sources.ingest_files import ingest as run

    p = argparse.ArgumentParser(prog="lumenpipe ingest")
    p.add_argument("folder")
    p.add_argument("path", help="a file, a folder or a pattern")
    p.add_argument("--format", choices=("auto", "json", "protobuf"), default="auto")
    p.add_argument("--signal", choices=("traces", "logs", "metrics"), default=None)
    a = p.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name, n in run(spark, Store(spark, a.folder), a.path, a.format, a.signal).items():
        print(f"{name}: {n}")


def main() -> None:
    if sys.argv[1:2] == ["ingest"]:
        return ingest(sys.argv[2:])
    p = argparse.ArgumentParser(prog="lumenpipe")
    p.add_argument("folder", help="a store, or with --driver-tables a folder of NAME.parquet files")
    p.add_argument("query")
    p.add_argument("--form", choices=("table", "json", "jsonl"), default="table")
    p.add_argument("--limit", type=int, default=100, help="rows to print")
    p.add_argument("--now", type=int, default=None, help="the clock in nanoseconds")
    p.add_argument("--driver-tables", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    tables = adapters.signals(spark, a.folder) if a.driver_tables else Store(spark, a.folder).signals()
    print(Engine(spark, tables, now_ns=a.now).show(a.query, a.form, a.limit))


if __name__ == "__main__":
    main()
