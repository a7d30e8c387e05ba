import random

from pyspark.sql import functions as F

from lumenpipe.engine import Engine
from lumenpipe.operators import dedup, late
from lumenpipe.plans.errors import ResourceLimit
from lumenpipe.streaming.ingest import CorrectedPeriods, ExactlyOnce
from lumenpipe.streaming.live import LiveQuery, Reducer, Subscriptions, delta_writer, strategy

from .test_operators import SPAN, span

S = 10**9
LOG = "log_id string, time_unix_nano bigint, service_name string, severity_number smallint, body string"


def logs(n, start):
    return [(f"l{start}-{i}", (start + i) * S, "ab"[i % 2], 9 + 8 * (i % 3 == 0), f"message {i}") for i in range(n)]


def feed(spark, folder, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(folder)


def live(spark, tmp_path, text, key):
    folder = str(tmp_path / "logs")
    feed(spark, folder, logs(10, 100))
    clock = {"now": 110 * S}
    engine = Engine(spark, {"logs": lambda: spark.read.schema(LOG).parquet(folder)}, now_ns=110 * S)
    reducer, kinds = Reducer(key), []

    def on_delta(d):
        kinds.append(d.kind)
        reducer.apply(d)
        delta_writer(str(tmp_path / "deltas"))(d)

    query = LiveQuery(engine, text, on_delta, clock=lambda: clock["now"])
    stream = spark.readStream.schema(LOG).option("latestFirst", "false").parquet(folder)

    def step(now, rows):
        clock["now"] = now
        if rows:
            feed(spark, folder, rows)
        query.start(stream, str(tmp_path / "cp"), available_now=True).awaitTermination()

    return engine, query, reducer, kinds, step


def batch_rows(engine, text, now, key):
    e = Engine(engine.spark, engine.cold, None, now)
    return {r[key]: r.asDict() for r in e.query(text).primary.collect()}


def test_append_and_expire(spark, tmp_path):
    text = "logs last 20s | where severity_number >= ERROR | compute len(body) as n | select log_id, n, time_unix_nano"
    engine, query, reducer, kinds, step = live(spark, tmp_path, text, "log_id")
    assert query.strategy == "append"
    step(110 * S, [])
    step(118 * S, logs(5, 112))
    assert set(reducer.rows) == set(batch_rows(engine, text, 118 * S, "log_id"))
    query.process(spark.createDataFrame(logs(3, 126), LOG), 7)  # without a snapshot in between
    assert {"snapshot", "append", "heartbeat"} <= set(kinds) and reducer.watermark_ns == 118 * S
    query.clock = lambda: 128 * S
    feed(spark, str(tmp_path / "logs"), logs(3, 126))
    query.process(spark.createDataFrame([], LOG), 8)
    assert "expire" in kinds
    assert set(reducer.rows) == set(batch_rows(engine, text, 128 * S, "log_id"))


def test_replace(spark, tmp_path):
    text = "logs last 20s | group by { service_name } { count() as n, max(time_unix_nano) as t }"
    engine, query, reducer, kinds, step = live(spark, tmp_path, text, "service_name")
    assert query.strategy == "replace"
    step(110 * S, [])
    step(118 * S, logs(5, 112))
    assert "replace" in kinds and reducer.rows == batch_rows(engine, text, 118 * S, "service_name")


def test_strategy(spark):
    e = Engine(spark, now_ns=1)
    assert strategy(e.parse("logs last 1h | where exists body <- spans")) == "append"
    for text in ("| take 5", "| sort body", "| uniq body", "| patterns", "-> spans", "| group by {} { count() as n }"):
        assert strategy(e.parse(f"logs last 1h {text}")) == "replace"


def test_subscription_limit():
    subs = Subscriptions(1)
    with subs:
        try:
            with subs:
                raise AssertionError
        except ResourceLimit:
            pass
    assert subs.active == 0


def test_streaming_dedup_and_periods_equal_batch(spark, tmp_path):
    rnd = random.Random(8)
    rows = []
    for w in range(120):
        t, s = f"{rnd.randrange(5):032x}", rnd.choice([f"{rnd.randrange(40):016x}", f"odd{rnd.randrange(3)}"])
        rnd2 = random.Random(t + s)
        start = rnd2.randrange(1, 300) * S
        rows.append(span(t, s, start=start, d=rnd2.randrange(50), w=w, rec=start + rnd2.choice([10, 200, 2000]) * S))
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows.sort(key=lambda r: r[7])  # deliveries come in order of receipt
    df = spark.createDataFrame([(*r[:6], w, *r[7:]) for w, r in enumerate(rows)], SPAN)
    for k in range(3):
        df.where(f"wal_seq div 40 = {k}").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    sink = ExactlyOnce(out, str(tmp_path / "state"))
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    sink(df.where("wal_seq div 40 = 2"), 2)  # the last batch again
    once = spark.read.parquet(out)
    keys = [(r["trace_id"], r["span_id"]) for r in once.collect()]
    assert len(keys) == len(set(keys))
    assert set(keys) == {(r["trace_id"], r["span_id"]) for r in dedup.deduplicate_spans(df).collect()}
    periods = CorrectedPeriods(str(tmp_path / "periods"))
    for k in range(3):
        periods(spark.read.parquet(f"{out}/batch={k}"), k)
    want = late.corrected_periods(df)
    assert sorted(map(str, periods.periods(spark).collect())) == sorted(map(str, want.collect()))


def test_periods_close_at_the_cut_off(spark, tmp_path):
    cols = "resource_id bigint, start_time_unix_nano bigint, duration_ns bigint, received_unix_nano bigint"
    feed_ = [
        [(1, 30 * S, 5, 61 * S), (1, 31 * S, 9, 62 * S)],
        [(1, 32 * S, 7, 500 * S), (1, 32 * S, 7, 130 * S)],
        [(1, 2000 * S, 1, 2001 * S)],  # past the first minute's cut-off
        [(1, 33 * S, 4, 2002 * S)],
    ]
    sink = CorrectedPeriods(str(tmp_path / "p"))
    for k, rows in enumerate(feed_):
        sink(spark.createDataFrame(rows, cols), k)
        if k == 2:
            sink(spark.createDataFrame(rows, cols), k)  # run again
    got = {r["minute_unix_s"]: r.asDict() for r in sink.periods(spark).collect()}
    assert {k: got[0][k] for k in ("n_on_time", "n_late", "n_dropped", "median_on_time", "median_value", "n_distinct")} == {
        "n_on_time": 2, "n_late": 2, "n_dropped": 1, "median_on_time": 5, "median_value": 7, "n_distinct": 3}
    assert set(got) == {0, 1980}
    assert spark.read.parquet(str(tmp_path / "p/open/v3")).count() == 1 and len(list((tmp_path / "p/open").glob("v*"))) == 2


def test_ready_warning_and_error(spark, tmp_path):
    engine, query, reducer, kinds, step = live(spark, tmp_path, "logs last 20s | where severity_number >= 9", "log_id")
    step(110 * S, [])
    assert reducer.ready and not reducer.messages
    query.clock = lambda: 105 * S
    query.process(spark.createDataFrame([], LOG), 3)
    assert [k for k, _ in reducer.messages] == ["warning"]
    try:
        query.process(spark.createDataFrame([], "x int"), 4)
        raise RuntimeError("it must fail")
    except Exception as e:
        assert "it must fail" not in str(e)
    assert [k for k, _ in reducer.messages] == ["warning", "error"]
