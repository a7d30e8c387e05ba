import subprocess
import sys

from pyspark.sql import functions as F

from lumenpipe.engine import Engine
from lumenpipe.functions import attributes
from lumenpipe.functions.hashing import fnv1a_64
from lumenpipe.operators import series
from lumenpipe.sources import fixtures


def test_overflow_access(spark):
    m = {"s": '"a \\"b\\""', "i": "42", "f": "-2.75", "b": "true", "l": "[1]", "big": "1e30"}
    df = spark.createDataFrame([(m,)], "m map<string,string>")
    get = lambda f, k: df.select(f(F.col("m"), k)).first()[0]
    assert [get(attributes.overflow_get_str, k) for k in ("s", "i", "l", "none")] == ['a "b"', "42", "[1]", None]
    assert [get(attributes.overflow_get_i64, k) for k in ("i", "f", "s", "b", "big")] == [42, -2, None, None, None]
    assert [get(attributes.overflow_get_f64, k) for k in ("i", "f", "s", "none")] == [42.0, -2.75, None, None]
    assert [get(attributes.overflow_get_bool, k) for k in ("b", "i")] == [True, None]


def test_series_index(spark):
    seen = spark.createDataFrame([("m", {"b": "2", "a": "1"}), ("m", {"a": "1", "b": "2"}), ("m", {"a": "9"}), ("n", None)], "metric_name string, labels map<string,string>")
    index = series.register(None, seen)
    assert index.count() == 3 and series.register(index, seen).count() == 3 and series.merge(index, index).count() == 3
    ids = [r[0] for r in series.lookup(index, "m", {"a": "1"}).collect()]
    assert ids == [fnv1a_64(b"m\0a\x001\0b\x002\0")]
    points = spark.createDataFrame([(ids[0], t * 1000, float(t)) for t in range(1, 5)] + [(0, 2000, 0.0)], "series_id bigint, time_unix_nano bigint, value double")
    assert series.points_of(points, index, "m", 1500, 3500).count() == 2


def test_demo_traces(spark):
    e = Engine(spark, fixtures.demo_traces(spark, 10**18), now_ns=10**18 + 10**10)
    rows = e.query("spans last 1h | group by { service_name } { count() as n, max(duration_ns) as d } | sort service_name").primary.collect()
    assert [tuple(r) for r in rows] == [("api-gateway", 3, 140 * 10**6), ("web-service", 4, 160 * 10**6), ("worker-service", 5, 180 * 10**6)]


def test_command_line_help():
    out = subprocess.run([sys.executable, "-m", "lumenpipe", "--help"], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and "--form" in out.stdout


def test_materialized_tables_are_released(spark):
    from lumenpipe.operators.shared import materialize, release

    df = materialize(spark.range(5))
    path = df.inputFiles()[0].removeprefix("file:")
    assert df.count() == 5
    import os

    assert os.path.exists(path)
    release(spark)
    assert not os.path.exists(path)
