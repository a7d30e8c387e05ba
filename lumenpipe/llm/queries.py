"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import deduplicate_spans
from ..operators.shared import NS, floor_div, hex_id, materialize
from . import abuse, distinct, leakage, mixing, percentiles

PER_MILLE = [500, 900, 950, 990]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _served(spark: SparkSession, d: str, *columns: str, spans: DataFrame | None = None) -> DataFrame:
    """Spans with the service of their resource (null if there is none) and the UTC day of their start."""
    spans = (_table(spark, d, "spans") if spans is None else spans).select("resource_id", "start_time_unix_nano", *columns)
    services = _table(spark, d, "resources").groupBy("resource_id").agg(F.min("service_name").alias("service_name"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), floor_div(F.col("start_time_unix_nano"), F.lit(86400 * NS)).cast("int"))
    return spans.join(services, "resource_id", "left").select("service_name", day.alias("day"), *columns)


def _partials(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.partial_counts(_served(spark, d, "name", "duration_ns"), ["day", "service_name", "name"], "duration_ns")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Over the rows of spans: a span delivered several times counts several times."""
    keys = ["service_name", "name"]
    combined = percentiles.combine(materialize(_partials(spark, d)), keys)
    rows = _served(spark, d, "name", "duration_ns")
    return percentiles.percentiles_by_bisection(rows, combined, keys, "duration_ns", PER_MILLE)


def p3_daily_partials(spark: SparkSession, d: str) -> DataFrame:
    """Over the rows of spans, as p3_percentiles."""
    return _partials(spark, d)


def _once(spark: SparkSession, d: str) -> DataFrame:
    first = deduplicate_spans(_table(spark, d, "spans"), payload=["resource_id", "start_time_unix_nano", "name", "duration_ns"])
    return _served(spark, d, "name", "duration_ns", spans=first)


def p3_span_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The percentiles with each span (trace_id, span_id) counted once, by its first delivery."""
    keys = ["service_name", "name"]
    rows = materialize(_once(spark, d))
    partials = percentiles.partial_counts(rows, ["day", *keys], "duration_ns")
    combined = percentiles.combine(materialize(partials), keys)
    return percentiles.percentiles_by_bisection(rows, combined, keys, "duration_ns", PER_MILLE)


def p3_span_daily_partials(spark: SparkSession, d: str) -> DataFrame:
    """The daily partial counts with each span counted once, by its first delivery."""
    return percentiles.partial_counts(_once(spark, d), ["day", "service_name", "name"], "duration_ns")


def _sketches(spark: SparkSession, d: str) -> DataFrame:
    rows = _served(spark, d, "trace_id").withColumn("trace_id", hex_id("trace_id"))
    return distinct.sketch(rows, ["day", "service_name"], "trace_id")


def p6_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Per day and service, per day, per service and overall, all merged from the finest sketches."""
    base = materialize(_sketches(spark, d))
    sets = [("day_service", ["day", "service_name"]), ("day", ["day"]), ("service", ["service_name"]), ("all", [])]
    out = None
    for level, keys in sets:
        part = distinct.estimates(base if len(keys) == 2 else distinct.merge(base, keys), keys)
        part = part.withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def p6_sketches(spark: SparkSession, d: str) -> DataFrame:
    return _sketches(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p8_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_table(spark, d, "documents"), _table(spark, d, "source_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_table(spark, d, "documents"), _table(spark, d, "source_targets"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    forms = abuse.normal_forms(_table(spark, d, "documents"))
    return abuse.score_documents(forms, abuse.fit(forms, _table(spark, d, "doc_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("flagged").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scored(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p3_percentiles, p3_daily_partials, p6_distinct, p6_sketches, p8_found, p8_clean_documents, p9_mix, p9_shares,
        p10_found, p10_scores, p10_rates, p3_span_percentiles, p3_span_daily_partials,
    )
}

_SERVED = """v AS (SELECT r.service_name, s.name, s.duration_ns AS v,
    DATE '1970-01-01' + CAST(floor(s.start_time_unix_nano // 86400000000000) AS INTEGER) AS day FROM spans s
    LEFT JOIN (SELECT resource_id, min(service_name) AS service_name FROM resources GROUP BY 1) r USING (resource_id)
    WHERE s.duration_ns IS NOT NULL)"""

SQL: dict[str, str] = {
    "p3_percentiles": f"""WITH {_SERVED},
      o AS (SELECT *, row_number() OVER (PARTITION BY service_name, name ORDER BY v) AS k,
                   count(*) OVER (PARTITION BY service_name, name) AS n FROM v)
      SELECT service_name, name, per_mille, v AS value, n FROM o, (VALUES (500), (900), (950), (990)) p(per_mille)
      WHERE k = greatest(1, (n * per_mille + 999) // 1000)""",
    "p3_span_percentiles": """WITH f AS (SELECT arg_min({'r': resource_id, 'name': name, 'v': duration_ns}, wal_seq) AS x FROM spans
      GROUP BY lower(regexp_replace(trace_id, '[\\s\\x{A0}-]', '', 'g')), lower(regexp_replace(span_id, '[\\s\\x{A0}-]', '', 'g'))),
      v AS (SELECT service_name, x.name AS name, x.v AS v FROM f
        LEFT JOIN (SELECT resource_id, min(service_name) AS service_name FROM resources GROUP BY 1) r ON r.resource_id = x.r WHERE x.v IS NOT NULL),
      o AS (SELECT *, row_number() OVER (PARTITION BY service_name, name ORDER BY v) AS k,
                   count(*) OVER (PARTITION BY service_name, name) AS n FROM v)
      SELECT service_name, name, per_mille, v AS value, n FROM o, (VALUES (500), (900), (950), (990)) p(per_mille)
      WHERE k = greatest(1, (n * per_mille + 999) // 1000)""",
}

_CELLS = """CAST(sign(v) * (floor(log2(abs(CAST(v AS DOUBLE)) + 1.0) * 32.0) + 1) AS BIGINT) AS bucket, count(*) AS n, min(v) AS low, max(v) AS high"""
SQL["p3_daily_partials"] = f"WITH {_SERVED} SELECT day, service_name, name, {_CELLS} FROM v GROUP BY ALL"
