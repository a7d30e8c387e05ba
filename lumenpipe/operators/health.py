"""Service health: statistics, metrics, and scores against rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranks import health_index, joined, values_at_ranks
from .shared import NS, floor_div

# Default rules (metric, weight, warning, error).
DEFAULT_RULES = [
    ("span_error_rate", 0.40, 0.01, 0.05),
    ("http_error_rate", 0.25, 0.05, 0.15),
    ("latency_p95_ns", 0.20, 2e8, 5e8),
    ("error_logs_per_minute", 0.15, 5.0, 20.0),
]

METRICS = [
    "span_error_rate", "http_error_rate", "http_2xx_rate", "http_3xx_rate", "http_4xx_rate", "http_5xx_rate",
    "throughput_per_minute", "error_logs_per_minute", "latency_p50_ns", "latency_p95_ns",
]


def health_statistics(
    spans: DataFrame, logs: DataFrame, minutes: float, http_column: str = "http_response_status_code", keys: tuple[str, ...] = ("service",)
) -> DataFrame:
    """One row per service: error and HTTP rates, throughput, error logs per minute and latency percentiles.

    ``spans`` needs ``service``; ``keys`` that go beyond it must be in the logs too. Errors are status 2; logs from severity 17 up are
    error logs. Rates over nothing are 0; a service without a duration has null percentiles. Counts and ranks come from one fold of the
    spans by their values.
    """
    keys_ = list(keys)
    code = F.col(http_column)
    klass = lambda k: F.count(F.when((code >= k * 100) & (code < (k + 1) * 100), 1))
    n, http = F.col("n"), F.col("http")
    names = ["n", "errors", "http", "c2", "c3", "c4", "c5"]
    folded = spans.groupBy(*keys_, "duration_ns").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == 2, 1)).alias("errors"),
        F.count(F.when((code >= 200) & (code < 600), 1)).alias("http"), *[klass(k).alias(f"c{k}") for k in (2, 3, 4, 5)],
    )
    base = folded.groupBy(*keys_).agg(*[F.sum(c).alias(c) for c in names])
    picks = {f"latency_p{p}_ns": (lambda c, p=p: health_index(c, p)) for p in (50, 95, 99)}
    latency = values_at_ranks(folded.where("duration_ns IS NOT NULL"), keys_, "duration_ns", "n", picks)
    bad = logs.where(F.col("severity_number") >= 17).withColumnRenamed("service_name", "service").groupBy(*keys_).agg(
        F.count(F.lit(1)).alias("error_logs")
    )
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = joined(base, latency, keys_, "left").join(bad, keys_, "full_outer").fillna(0, [*names, "error_logs"])
    return out.select(
        *keys_, rate(F.col("errors"), n).alias("span_error_rate"), rate(F.col("c4") + F.col("c5"), http).alias("http_error_rate"),
        *[rate(F.col(f"c{k}"), http).alias(f"http_{k}xx_rate") for k in (2, 3, 4, 5)],
        (n / F.lit(float(minutes))).alias("throughput_per_minute"),
        (F.col("error_logs") / F.lit(float(minutes))).alias("error_logs_per_minute"),
        "latency_p50_ns", "latency_p95_ns", "latency_p99_ns",
    )


def health_series(spans: DataFrame, logs: DataFrame, step_s: int = 60, window_s: int = 300) -> DataFrame:
    """The ten metrics per service every ``step_s`` seconds over the ``window_s`` seconds before: (service, window_end, metric, value).

    Windows are [end - window_s, end); those that hold neither a span nor a log are not there. Rows without a time are in none.
    """

    def windows(df: DataFrame, time: str) -> DataFrame:
        step = F.lit(step_s * NS)
        first = floor_div(F.col(time), step) + 1
        ends = F.transform(F.sequence(first, first + (window_s // step_s - 1)), lambda k: k * step)
        return df.withColumn("window_end", F.explode(ends))

    wanted = ["service", "status", "duration_ns", "http_response_status_code", "start_time_unix_nano"]
    keys = ("service", "window_end")
    statistics = health_statistics(
        windows(spans.select(*wanted), "start_time_unix_nano"), windows(logs.select("service_name", "severity_number", "time_unix_nano"), "time_unix_nano"),
        window_s / 60.0, keys=keys,
    )
    return health_metrics(statistics, keys)


def health_metrics(statistics: DataFrame, keys: tuple[str, ...] = ("service",)) -> DataFrame:
    """The ten named metrics per service as (service, metric, value) rows."""
    pairs = ", ".join(f"'health.{m}', cast({m} as double)" for m in METRICS)
    return statistics.selectExpr(*keys, f"stack({len(METRICS)}, {pairs}) as (metric, value)")


def score(value: Column, warn: Column, error: Column) -> Column:
    """1 down to 0.7 up to the warning level, 0.7 to 0.3 up to the error level, then exponentially towards 0.

    Where the warning level lies above the error level, low values are bad: at or above the warning level the
    score is 1, and the other two pieces are mirrored.
    """
    pos = (value - warn) / (error - warn)
    high = F.when(value <= warn, F.when(warn > 0, 1.0 - value / warn * 0.3).otherwise(1.0)).when(
        value <= error, 0.7 - pos * 0.4
    ).otherwise(0.3 * F.exp(-(value - error) / error))
    low = F.when(value >= warn, F.lit(1.0)).when(value >= error, 0.7 - pos * 0.4).otherwise(
        0.3 * F.exp(-(error - value) / error)
    )
    return F.when(warn <= error, high).otherwise(low)


def grade(value: Column, warn: Column, error: Column) -> Column:
    up = F.when(value <= warn, 0).when(value <= error, 1).otherwise(2)
    down = F.when(value >= warn, 0).when(value >= error, 1).otherwise(2)
    return F.when(warn <= error, up).otherwise(down)


def rules_frame(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    """Rules of (metric, weight, warn, error), or with the service that a rule is for as a fifth value."""
    rows = [(*r, None)[:5] for r in rules or DEFAULT_RULES]
    return spark.createDataFrame(rows, "metric string, weight double, warn double, error double, service string")


def health_scores(statistics: DataFrame, rules: DataFrame) -> DataFrame:
    """Per service the weighted mean score over the rules that have data, and the worst status.

    A service's own rule takes the place of the general one for the same metric.
    """
    values = health_metrics(statistics).withColumn("metric", F.expr("substring(metric, 8)")).where("value IS NOT NULL")
    if "service" not in rules.columns:
        rules = rules.withColumn("service", F.lit(None).cast("string"))
    rule = F.struct("weight", "warn", "error")
    general = rules.where("service IS NULL").select(F.col("metric").alias("__m"), rule.alias("__general"))
    own = rules.where("service IS NOT NULL").select(F.col("metric").alias("__om"), F.col("service").alias("__os"), rule.alias("__own"))
    met = values.join(general, F.col("metric") == F.col("__m"), "left").join(
        own, (F.col("metric") == F.col("__om")) & (F.col("service") == F.col("__os")), "left"
    )
    scored = met.select("service", "value", F.coalesce("__own", "__general").alias("r")).where("r IS NOT NULL").select("service", "value", "r.*")
    args = (F.col("value"), F.col("warn"), F.col("error"))
    out = scored.groupBy("service").agg(
        (F.sum(score(*args) * F.col("weight")) / F.sum("weight")).alias("score"), F.max(grade(*args)).alias("worst")
    )
    names = F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), F.col("worst") + 1)
    return out.select("service", "score", names.alias("status"))


def health_feed(spans: DataFrame, logs: DataFrame, start: int, end: int, shift: int) -> DataFrame:
    """Statistics of [start, end] beside those of the period ``shift`` nanoseconds earlier (columns previous_...)."""
    minutes = (end - start) / 60e9

    def over(a: int, b: int) -> DataFrame:
        s = spans.where(F.col("start_time_unix_nano").between(a, b))
        return health_statistics(s, logs.where(F.col("time_unix_nano").between(a, b)), minutes)

    now, before = over(start, end), over(start - shift, end - shift)
    renamed = before.withColumnsRenamed({c: f"previous_{c}" for c in before.columns if c != "service"})
    return now.join(renamed, "service", "full_outer")
