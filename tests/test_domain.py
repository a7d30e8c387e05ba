"""Telemetry operators against literal expectations, and the store."""

import math

from pyspark.sql import functions as F

from lumenpipe.operators import flamegraph, health, histograms, metric_groups, patterns, rollups, traces
from lumenpipe.plans import catalog as C
from lumenpipe.sources.storage import Retention, Store

S = 10**9
DAY = 86400 * S


def test_span_rollup(spark):
    rows = [(60 * S, "GET /users", "api", 100 * 10**6, 1), (int(60.5 * S), "GET /users", "api", 150 * 10**6, 1), (int(60.7 * S), "POST /users", "api", 200 * 10**6, 2)]
    df = spark.createDataFrame(rows, "start_time_unix_nano bigint, name string, service string, duration_ns bigint, status int")
    got = {r["name"]: (r["minute_bucket"], r["count"], r["error_count"]) for r in rollups.span_rollup(df).collect()}
    assert got == {"GET /users": (1, 2, 0), "POST /users": (1, 1, 1)}
    many = spark.createDataFrame([(60 * S, "n", "s", v * 100, None) for v in range(1, 11)], df.schema)
    r = rollups.span_rollup(many).first()
    assert (r["min_duration"], r["max_duration"], r["sum_duration"], r["p50_duration"], r["p90_duration"], r["error_count"]) == (100, 1000, 5500, 500, 900, 10)
    assert rollups.span_rollup(df.limit(0)).count() == 0


def test_metric_rollups(spark):
    df = spark.createDataFrame(
        [(1, 60 * S, 10.0), (1, 90 * S, 20.0), (1, 120 * S, 30.0), (2, 60 * S, 5.0), (2, 61 * S, None), (2, 62 * S, float("nan"))],
        "series_id bigint, time_unix_nano bigint, value double",
    )
    out = {k: v.collect() for k, v in rollups.metric_rollups(df).items()}
    assert [len(out[k]) for k in ("1m", "1h", "1d")] == [3, 2, 2]
    first = next(r for r in out["1m"] if r["series_id"] == 1 and r["bucket"] == 60)
    assert (first["count"], first["min"], first["max"], first["sum"]) == (2, 10.0, 20.0, 30.0)
    one = spark.createDataFrame([(1, 123456 * S, 1.0)], df.schema)
    assert [rollups.metric_rollup(one, w).first()["bucket"] for w in (60, 3600, 86400)] == [123420, 122400, 86400]
    assert sorted(map(str, rollups.coarser(rollups.metric_rollup(df, 60), 3600).collect())) == sorted(map(str, out["1h"]))
    assert rollups.nice_bin_s(3600) == 60 and rollups.nice_bin_s(10**9) == 86400


def test_histograms(spark):
    def pct(counts, bounds, p):
        df = spark.createDataFrame([(counts, bounds)], "c array<bigint>, b array<double>")
        return df.select(histograms.percentile(F.col("c"), F.col("b"), p)).first()[0]

    c, b = [10, 20, 30, 40, 0], [1.0, 5.0, 10.0, 50.0]
    assert [pct(c, b, p) for p in (10, 50, 90, 100, 0)] == [1, 10, 50, 50, 1]
    c = [10, 20, 30, 40, 10]
    assert [pct(c, b, p) for p in (90, 99, 100, -1, 101)] == [50, 50, 50, None, None]
    assert pct([0, 0], [1.0], 50) is None and pct([3], [], 50) is None
    avg = spark.createDataFrame([(500.0, 100), (0.0, 0)], "s double, n bigint").select(histograms.average(F.col("s"), F.col("n"))).collect()
    assert [r[0] for r in avg] == [5.0, 0.0]
    df = spark.createDataFrame(
        [("m", 1 * S, 3, 3.0, [1, 2], [1.0]), ("m", 2 * S, 1, 1.0, [0, 0, 1], [1.0, 2.0]), ("m", 11 * S, 9, 1.0, [2, 1, 6], [1.0, 2.0])],
        "metric_id string, time_unix_nano bigint, count bigint, sum double, bucket_counts array<bigint>, explicit_bounds array<double>",
    )
    cols = sorted(histograms.heatmap_columns(df, ["metric_id"], 30 * S, 3).collect(), key=lambda r: r["bin"])
    assert [r["bucket_counts"] for r in cols] == [[1, 2, 1], [2, 1, 6]] and [r["delta_counts"] for r in cols] == [[1, 2, 1], [1, 1, 5]]
    assert cols[1]["shares"] == [0.2, 0.2, 1.0] and cols[0]["explicit_bounds"] == [1.0, 2.0]
    assert [r["highest_bucket"] for r in sorted(histograms.activity(df, ["metric_id"]).collect(), key=lambda r: r["time_unix_nano"])] == [1, 2, 2]


def test_flamegraph(spark):
    stacks = spark.createDataFrame([(1, 11, 0), (1, 10, 1), (1, 10, 1)], "stack_id bigint, frame_id bigint, position bigint")
    samples = spark.createDataFrame([(1, 1000, 5), (1, 500, 50), (2, 9, 5)], "stack_id bigint, value bigint, time_unix_nano bigint")
    got = {r["path"]: (r["total_value"], r["self_value"], r["depth"], r["parent_path"]) for r in flamegraph.flamegraph(samples, stacks).collect()}
    assert got == {"10": (1500, 0, 0, None), "10/11": (1500, 1500, 1, "10")}
    later = flamegraph.flamegraph(samples, stacks, retention_after=10)
    assert {r["total_value"] for r in later.collect()} == {500}
    assert [r["share"] for r in flamegraph.icicle(later).collect()] == [1.0, 1.0]


def test_metric_groups(spark):
    names = [f"nodejs.eventloop.delay.{x}" for x in ("min", "max", "mean", "p50", "p90", "p99")] + ["unrelated.metric", "h_bucket", "h_count", "h_sum", "i_sum", "a.b.c.d", "a.b.c.e"]
    df = spark.createDataFrame([(1, "gauge", "ms", n) for n in names], "resource_id bigint, metric_type string, unit string, name string")
    groups = metric_groups.statistical_groups(df).collect()
    assert len(groups) == 1 and len(groups[0]["members"]) == 6
    assert [r["members"] for r in metric_groups.histogram_families(df).collect()] == [["h_bucket", "h_count", "h_sum"]]
    assert {r["namespace"] for r in metric_groups.namespace_groups(df).collect()} == {"a.b.c", "nodejs.eventloop.delay"}
    assert metric_groups.hierarchy(df.where("name = 'a.b.c.d'")).count() == 3


def test_health(spark):
    def of(value, warn, error):
        df = spark.createDataFrame([(value, warn, error)], "v double, w double, e double")
        return df.select(health.score(F.col("v"), F.col("w"), F.col("e")), health.grade(F.col("v"), F.col("w"), F.col("e"))).first()

    assert abs(of(0.005, 0.01, 0.05)[0] - 0.85) < 1e-9 and of(0.0, 0.01, 0.05)[1] == 0
    assert abs(of(0.03, 0.01, 0.05)[0] - 0.5) < 1e-9 and of(0.03, 0.01, 0.05)[1] == 1
    assert abs(of(0.1, 0.01, 0.05)[0] - 0.3 * math.exp(-1)) < 1e-9 and of(0.1, 0.01, 0.05)[1] == 2
    assert of(10.0, 9.0, 5.0)[0] == 1.0 and of(4.0, 9.0, 5.0)[1] == 2
    spans = spark.createDataFrame([("api", 2, 200, 10, 0), ("api", 1, 503, 20, 0), ("api", 1, None, 30, 0)], "service string, status int, http_response_status_code bigint, duration_ns bigint, start_time_unix_nano bigint")
    logs = spark.createDataFrame([("api", 17, 0), ("web", 21, 0), ("web", 9, 0)], "service_name string, severity_number int, time_unix_nano bigint")
    st = {r["service"]: r for r in health.health_statistics(spans, logs, 2.0).collect()}
    assert abs(st["api"]["span_error_rate"] - 1 / 3) < 1e-9 and st["api"]["http_error_rate"] == 0.5 and st["api"]["latency_p50_ns"] == 20
    assert st["web"]["error_logs_per_minute"] == 0.5 and st["web"]["latency_p50_ns"] is None
    scores = {r["service"]: r for r in health.health_scores(health.health_statistics(spans, logs, 2.0), health.rules_frame(spark)).collect()}
    assert scores["api"]["status"] == "unhealthy" and scores["web"]["status"] == "healthy"
    assert health.health_metrics(health.health_statistics(spans, logs, 2.0)).count() == 20
    assert health.health_feed(spans, logs, 0, 60 * S, DAY).count() == 2


def test_traces(spark):
    rows = [("T", "b", "a", "child", 2, 5, 9), ("t", "a", None, "root", 1, 6, 30), ("t", "c", "a", "early", 1, 2, 3), ("u", "x", "gone", "late", 0, 9, 9), ("u", "y", "gone", "first", 0, 8, 10)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, name string, status int, start_time_unix_nano bigint, end_time_unix_nano bigint")
    df = df.withColumn("wal_seq", F.lit(1))
    got = {r["trace_id"]: (r["root_name"], r["span_count"], r["has_error"], r["duration_ns"]) for r in traces.trace_summary(df).collect()}
    assert got == {"t": ("root", 3, True, 28), "u": ("first", 2, False, 2)}
    assert [r["trace_id"] for r in traces.matching_traces(df, F.col("status") == 2).collect()] == ["t"]
    tree = traces.span_tree(df).where("trace_id = 't'").orderBy("sort_path").collect()
    assert [(r["span_id"], r["depth"]) for r in tree] == [("a", 0), ("c", 1), ("b", 1)]


def test_patterns(spark):
    df = spark.createDataFrame([('took 12.5 ms for "x"', 2), ('took 7 ms for "y z"', 1), ("id 0xFF deadbeef01", 3), (None, 4), ("", 5)], "body string, time_unix_nano bigint")
    got = {r["pattern"]: (r["count"], r["example"]) for r in patterns.log_patterns(df).collect()}
    assert got["took <num> ms for <text>"] == (2, 'took 7 ms for "y z"') and got["id <hex> <hex>"][0] == 1 and got[None][0] == 1


def test_store_round_trip_compaction_and_retention(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = [(f"l{i}", i * DAY // 4, "svc", "x" * (i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "log_id string, time_unix_nano bigint, service_name string, body string")
    store.write("logs", df.where("log_id < 'l2'"), files_per_day=2)
    store.write("logs", df.where("log_id >= 'l2'").withColumn("trace_id", F.lit("t")))
    store.write("logs", df.limit(0))
    back = store.read("logs")
    assert sorted(map(tuple, back.select(df.columns).collect())) == sorted(rows)
    assert back.where("trace_id is null").count() == df.where("log_id < 'l2'").count() and len(store.days("logs")) == 10
    store.write("logs", df.where("time_unix_nano = 0"))
    assert store.compact("logs") >= 1 and store.compact("logs") == 0
    assert store.read("logs").count() == len(rows) + 1
    from lumenpipe.engine import Engine

    e = Engine(spark, store.signals(), now_ns=10 * DAY)
    result = e.query(f"logs between({2 * DAY}, {3 * DAY})").primary
    assert result.count() == 5
    plan = result._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "make_date" in plan
    store.set_retention(Retention(logs_days=3))
    assert store.cleanup(10 * DAY) == 7 and len(store.days("logs")) == 3
    assert store.read("spans").count() == 0 and store.read("spans").schema == C.schema("spans")
    store.set_health_rule("x", 1.0, 2.0, 3.0)
    assert len(store.health_rules()) == 5
    store.remove_health_rule("x")
    assert [r[0] for r in store.health_rules()] == [r[0] for r in health.DEFAULT_RULES]
    points = spark.createDataFrame([(1, S, 1.0)], "series_id bigint, time_unix_nano bigint, value double")
    store.write_rollups(points=points)
    assert spark.read.parquet(store.path("rollup_metrics_1h")).first()["count"] == 1


def test_compaction_that_broke_off_is_mended(spark, tmp_path):
    import shutil

    store = Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(f"l{i}", i, "svc") for i in range(20)], "log_id string, time_unix_nano bigint, service_name string")
    store.write("logs", df)
    day = tmp_path / "store/logs/year=1970/month=1/day=1"
    aside = tmp_path / "store/_aside/logs/year=1970~month=1~day=1"
    aside.parent.mkdir(parents=True)
    shutil.move(day, aside)  # the old folder is put aside, the new one is not there yet
    store.recover("logs")
    assert store.read("logs").count() == 20 and not aside.exists()
    shutil.copytree(day, aside)  # the new folder is in place, the old one not gone yet
    store.recover("logs")
    assert store.read("logs").count() == 20 and not aside.exists()


def test_points_by_the_stored_index(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.points_of("m", 0, DAY).count() == 0
    store.write("datapoints", spark.createDataFrame([(1, "a", 5, 1.0), (2, "a", 6, 2.0), (1, "a", 3 * DAY, 3.0)], "series_id bigint, metric_id string, time_unix_nano bigint, value double"))
    index = spark.createDataFrame([(1, "m", {"z": "1"}), (2, "m", {"z": "2"})], "series_id bigint, metric_name string, labels map<string,string>")
    store.register_series(index)
    store.register_series(index)
    assert store.series_index().count() == 2
    assert sorted(r["value"] for r in store.points_of("m", 0, DAY).collect()) == [1.0, 2.0]
    assert [r["value"] for r in store.points_of("m", 0, 4 * DAY, {"z": "1"}).orderBy("value").collect()] == [1.0, 3.0]
