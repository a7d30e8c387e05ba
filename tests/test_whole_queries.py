"""Registered queries reach every row of the tables, whatever its time."""

import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenpipe.plans import language_queries as lq

D = "/root/testdata/sf0.001"
SCOPED = re.compile(r"time_unix_nano BETWEEN")
#: Queries whose point is the time scope.
SCOPES = {
    "s2_last", "s3_today", "s3_today_last_day", "s3_yesterday", "s4_between", "last_stage", "a13_throughput_window", "d25_health_feed_window",
}


def test_only_queries_of_time_scopes_have_a_window():
    assert len(lq.SQL) > 80
    assert {n for n, sql in lq.SQL.items() if SCOPED.search(sql)} == SCOPES


@pytest.mark.parametrize("name, table", [("select_alias", "spans"), ("e_functions", "datapoints")])
def test_whole_scans_return_every_row(spark, name, table):
    assert lq.QUERIES[name](spark, D).count() == spark.read.parquet(f"{D}/{table}.parquet").count()


def test_whole_aggregates_count_every_row(spark):
    spans = spark.read.parquet(f"{D}/spans.parquet")
    assert spans.where("start_time_unix_nano = 0").count() > 0
    counted = lq.QUERIES["a1_a5_basic"](spark, D).agg(F.sum("n")).first()[0]
    assert counted == spans.count()


def test_whole_health_agrees_with_sql(spark):
    con = duckdb.connect()
    for t in ("spans", "logs", "resources"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    for name in ("d15_health_statistics", "d25_health_feed"):
        rel = con.sql(lq.SQL[name])
        want = {r[rel.columns.index("service")]: dict(zip(rel.columns, r)) for r in rel.fetchall()}
        got = {r["service"]: r.asDict() for r in lq.QUERIES[name](spark, D).collect()}
        assert set(got) == set(want)
        for service, row in want.items():
            for column, value in row.items():
                mine = got[service][column]
                assert mine == value or math.isclose(mine, value, rel_tol=1e-9), (service, column)


def test_today_has_rows(spark):
    (got,) = lq.QUERIES["s3_today_last_day"](spark, D).collect()
    want = duckdb.sql(lq.SQL["s3_today_last_day"].replace("FROM spans", f"FROM '{D}/spans.parquet'")).fetchall()[0][0]
    assert got["n"] == want > 0
