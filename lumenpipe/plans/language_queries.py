"""Queries in the pipe language and of the telemetry operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..operators import flamegraph, health, histograms, metric_groups, patterns, rollups, series, traces
from ..sources import adapters

#: The clock of the queries: shortly after the last row of the driver's spans.
NOW = 1741602000000000000
#: A range that covers every row, also those of an unset clock (time 0); its SQL has no filter.
ALL_A, ALL_B = 0, 4 * 10**18
_AT = f"between({ALL_A}, {ALL_B})"
_IN = _INL = "true"
#: Three days, for the queries whose point is the time scope.
A, B = 1741046400000000000, 1741305600000000000
_WINDOW = f"between({A}, {B})"
_INW = f"start_time_unix_nano BETWEEN {A} AND {B}"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def engine(spark: SparkSession, d: str) -> Engine:
    return Engine(spark, adapters.signals(spark, d), now_ns=NOW)


def _text(name: str, text: str, sql: str, aux: str | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        result = engine(spark, d).query(text)
        return result.primary if aux is None else result.aux[aux]

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


def _op(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _marked(name: str, *columns: str) -> None:
    """Make NaN explicit in a registered query's result: ``x`` becomes null, ``x_nan`` true."""
    inner = QUERIES[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        out = inner(spark, d)
        for c in columns:
            out = out.withColumn(f"{c}_nan", F.isnan(c)).withColumn(c, F.nanvl(c, F.lit(None).cast("double")))
        return out

    QUERIES[name] = run


def _nan_sql(sql: str, *columns: str) -> str:
    cells = ", ".join(f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}, coalesce(isnan({c}), false) AS {c}_nan" for c in columns)
    return f"SELECT * EXCLUDE ({', '.join(columns)}), {cells} FROM ({sql})"


# scans and time scopes
_text("s1_scan_metrics", "metrics last 1h", "SELECT * FROM metrics")
_text("s2_last", "logs last 2d | select log_id, time_unix_nano",
      f"SELECT log_id, time_unix_nano FROM logs WHERE time_unix_nano BETWEEN {NOW - 2 * 86400 * 10**9} AND {NOW}")
_MID = NOW // (86400 * 10**9) * 86400 * 10**9
_text("s3_today", "spans today | group by {} { count() as n }",
      f"SELECT count(*) AS n FROM spans WHERE start_time_unix_nano BETWEEN {_MID} AND {_MID + 86400 * 10**9}")
#: A clock within the last day of the driver's spans, where "today" has rows.
LAST_DAY = 1741543200000000000
_MID_LAST = LAST_DAY // (86400 * 10**9) * 86400 * 10**9
_op("s3_today_last_day",
    lambda s, d: Engine(s, adapters.signals(s, d), now_ns=LAST_DAY).query("spans today | group by {} { count() as n }").primary,
    f"SELECT count(*) AS n FROM spans WHERE start_time_unix_nano BETWEEN {_MID_LAST} AND {_MID_LAST + 86400 * 10**9}")
_text("s3_yesterday", "spans yesterday | group by {} { count() as n }",
      f"SELECT count(*) AS n FROM spans WHERE start_time_unix_nano BETWEEN {_MID - 86400 * 10**9} AND {_MID}")
_text("s4_between", f"spans {_WINDOW} | group by {{ kind }} {{ count() as n, sum(duration_ns) as total }}",
      f"SELECT kind, count(*) AS n, CAST(sum(duration_ns) AS BIGINT) AS total FROM spans WHERE {_INW} GROUP BY 1")
_text("s6_lookup_resource", "resource(612398678)", "SELECT * FROM resources WHERE resource_id = 612398678 LIMIT 1")
_text("s12_raw_scan", "scopes last 1h", "SELECT * FROM scopes")

# the minimum slice: filter, bin, aggregate, sort, take
_text(
    "pipe_error_buckets",
    f"spans {_AT} | where status == ERROR | group by {{ ts() bin 1h as bucket, name }} "
    "{ count() as n, sum(duration_ns) as total } | sort bucket asc, n desc, name asc | take 200",
    f"SELECT start_time_unix_nano // 3600000000000 * 3600000000000 AS bucket, name, count(*) AS n, "
    f"CAST(sum(duration_ns) AS BIGINT) AS total FROM spans WHERE {_IN} AND status = 2 GROUP BY 1, 2 "
    "ORDER BY bucket, n DESC, name LIMIT 200",
)

# projection, compute, stages
_text("select_alias", f"spans {_AT} | select span_id as id, name, attr.http.route as route",
      f"SELECT span_id AS id, name, http_route AS route FROM spans WHERE {_IN}")
_text("compute_whole", f"spans {_AT} | compute duration_ns / 1000 as us, us * 2 + 1 as twice, duration_ns % 7 as rest "
      "| select span_id, us, twice, rest",
      f"SELECT span_id, duration_ns // 1000 AS us, duration_ns // 1000 * 2 + 1 AS twice, duration_ns % 7 AS rest FROM spans WHERE {_IN}")
_text("compute_float", f"datapoints {_AT} | compute value / 4 as q, value * 0.5 as h | select series_id, q, h",
      _nan_sql(f"SELECT series_id, value / 4 AS q, value * 0.5 AS h FROM datapoints WHERE {_INL}", "q", "h"))
_marked("compute_float", "q", "h")
_text("last_stage", "logs last 7d | last 3d | group by {} { count() as n }",
      f"SELECT count(*) AS n FROM logs WHERE time_unix_nano BETWEEN {NOW - 3 * 86400 * 10**9} AND {NOW}")
_text("scoped_fields", f"spans {_AT} | where resource.service_name == 'cartwheel' | group by {{ scope.name as lib }} {{ count() as n }}",
      f"SELECT c.name AS lib, count(*) AS n FROM spans s JOIN resources r USING (resource_id) LEFT JOIN scopes c USING (scope_id) "
      f"WHERE {_IN} AND r.service_name = 'cartwheel' GROUP BY 1")
_text("scoped_attribute", f"spans {_AT} | group by {{ resource.k8s.namespace.name as ns }} {{ count() as n }}",
      f"""SELECT json_extract_string(r.attributes, '$."k8s.namespace.name"') AS ns, count(*) AS n
          FROM spans s LEFT JOIN resources r USING (resource_id) WHERE {_IN} GROUP BY 1""")
_text("promoted_attribute", f"spans {_AT} | where attr.http.response.status_code >= 500 | select span_id, http_response_status_code",
      f"SELECT span_id, http_response_status_code FROM spans WHERE {_IN} AND http_response_status_code >= 500")
_text("overflow_attribute", f"spans {_AT} | where exists attr.x-trace-hint | group by {{}} {{ count() as n }}".replace("attr.x-trace-hint", "attr.debug.note"),
      f"SELECT count(*) AS n FROM spans WHERE {_IN} AND _overflow_attrs['debug.note'] IS NOT NULL")
_text("overflow_number", f"spans {_AT} | where attr.retry.count > 500 | select span_id, attr.retry.count as retries",
      f"""SELECT span_id, regexp_replace(_overflow_attrs['retry.count'], '^"(.*)"$', '\\1') AS retries FROM spans WHERE {_IN}
          AND try_cast(regexp_replace(_overflow_attrs['retry.count'], '^"(.*)"$', '\\1') AS DOUBLE) > 500""")

# predicates
_PREDS = {
    "q1_and": ("status == OK and kind == CLIENT", "status = 1 AND kind = 3"),
    "q2_or": ("status == ERROR || kind == PRODUCER", "status = 2 OR kind = 4"),
    "q3_not": ("not status == OK and !(kind == CLIENT)", "NOT status = 1 AND NOT kind = 3"),
    "q4_parens": ("(status == ERROR or status == UNSET) and duration_ns > 1000000", "(status = 2 OR status = 0) AND duration_ns > 1000000"),
    "q5_eq": ("name = 'POST /baskets'", "name = 'POST /baskets'"),
    "q6_ne": ("name != 'POST /baskets'", "name <> 'POST /baskets'"),
    "q7_gt": ("duration_ns > 100000000", "duration_ns > 100000000"),
    "q8_ge": ("duration_ns >= 1.5e8", "duration_ns >= 1.5e8"),
    "q9_lt": ("duration_ns < 0", "duration_ns < 0"),
    "q10_le": ("duration_ns <= 0", "duration_ns <= 0"),
    "q11_exists": ("exists db_system", "db_system IS NOT NULL"),
    "q12_not_exists": ("not_exists attr.db.system", "db_system IS NULL"),
    "q13_contains": ("name contains 'BASK'", "name ILIKE '%bask%'"),
    "q13_contains_wild": ("name contains '_history'", "contains(lower(name), '_history')"),
    "q14_starts_with": ("name starts_with 'get '", "name ILIKE 'get %'"),
    "q15_ends_with": ("name ends_with '{ID}'", "name ILIKE '%{id}'"),
    "q16_matches": ("name matches '^(GET|PUT) /[a-m]'", "regexp_matches(name, '^(GET|PUT) /[a-m]')"),
    "q17_in": ("kind in [CLIENT, SERVER, 5]", "kind IN (3, 2, 5)"),
    "q17_in_text": ("error_type in ['timeout', 'refused']", "error_type IN ('timeout', 'refused')"),
    "q17_in_empty": ("kind in []", "false"),
}
for _name, (_pred, _sql) in _PREDS.items():
    _text(_name, f"spans {_AT} | where {_pred} | select trace_id, span_id, wal_seq", f"SELECT trace_id, span_id, wal_seq FROM spans WHERE {_IN} AND ({_sql})")
_text("g2_severity_text", f"logs {_AT} | where severity_text == ERROR | select log_id", f"SELECT log_id FROM logs WHERE {_INL} AND severity_text = 'ERROR'")
_text("g2_severity_number", f"logs {_AT} | where severity_number >= WARN | select log_id", f"SELECT log_id FROM logs WHERE {_INL} AND severity_number >= 13")
_text("g3_status_name", f"spans {_AT} | where status == 'Error' | group by {{}} {{ count() as n }}", f"SELECT count(*) AS n FROM spans WHERE {_IN} AND status = 2")
_text("g16_service_of_spans", f"spans {_AT} | group by {{ service_name }} {{ count() as n }}",
      f"SELECT r.service_name, count(*) AS n FROM spans s LEFT JOIN resources r USING (resource_id) WHERE {_IN} GROUP BY 1")

# functions
_text(
    "e_functions",
    f"datapoints {_AT} | compute abs(value) as a, round(value) as r, ceil(value) as c, floor(value) as f | select series_id, a, r, c, f",
    _nan_sql(f"SELECT series_id, abs(value) AS a, round(value) AS r, ceil(value) AS c, floor(value) AS f FROM datapoints WHERE {_INL}", "a", "r", "c", "f"),
)
_marked("e_functions", "a", "r", "c", "f")
_text(
    "e_time_and_text",
    f"spans {_AT} | compute to_millis(duration_ns) as ms, to_seconds(ts()) as s, len(name) as l, lower(name) as lo, "
    "upper(name) as up, to_string(kind) as k | select span_id, ms, s, l, lo, up, k",
    f"SELECT span_id, duration_ns // 1000000 AS ms, start_time_unix_nano // 1000000000 AS s, length(name) AS l, lower(name) AS lo, "
    f"upper(name) AS up, CAST(kind AS VARCHAR) AS k FROM spans WHERE {_IN}",
)

# aggregates
_text(
    "a1_a5_basic",
    f"spans {_AT} | group by {{ name }} {{ count() as n, sum(duration_ns) as s, avg(duration_ns) as a, min(duration_ns) as lo, max(duration_ns) as hi }}",
    f"SELECT name, count(*) AS n, CAST(sum(duration_ns) AS BIGINT) AS s, avg(duration_ns) AS a, min(duration_ns) AS lo, max(duration_ns) AS hi "
    f"FROM spans WHERE {_IN} GROUP BY 1",
)
_text(
    "a6_a8_percentiles",
    f"spans {_AT} | group by {{ name }} {{ p50(duration_ns) as p50, p95(duration_ns) as p95, p99(duration_ns) as p99 }} "
    "| compute round(p50 / 1000) as p50, round(p95 / 1000) as p95, round(p99 / 1000) as p99",
    f"SELECT name, round(quantile_cont(duration_ns, 0.5) / 1000) AS p50, round(quantile_cont(duration_ns, 0.95) / 1000) AS p95, "
    f"round(quantile_cont(duration_ns, 0.99) / 1000) AS p99 FROM spans WHERE {_IN} GROUP BY 1",
)
_text("a9_distinct", f"spans {_AT} | group by {{ kind }} {{ distinct(trace_id) as traces, distinct(name) as names }}",
      f"SELECT kind, count(DISTINCT trace_id) AS traces, count(DISTINCT name) AS names FROM spans WHERE {_IN} GROUP BY 1")
_text("a10_a11_first_last", f"logs {_AT} | group by {{ service_name }} {{ first(body) as f, last(body) as l }}",
      f"SELECT service_name, arg_min(body, {{'t': time_unix_nano, 'i': log_id}}) AS f, arg_max(body, {{'t': time_unix_nano, 'i': log_id}}) AS l "
      f"FROM logs WHERE {_INL} GROUP BY 1")
_text("a12_error_rate", f"spans {_AT} | group by {{ kind }} {{ error_rate() as r, error_rate() where duration_ns > 50000000 as slow }}",
      f"SELECT kind, avg(CASE WHEN status = 2 THEN 1.0 ELSE 0.0 END) AS r, avg(CASE WHEN status = 2 THEN 1.0 ELSE 0.0 END) "
      f"FILTER (WHERE duration_ns > 50000000) AS slow FROM spans WHERE {_IN} GROUP BY 1")
_text("a13_throughput", f"spans {_AT} | group by {{ name }} {{ throughput() as per_s }} | compute per_s * 1000000000 as per_s",
      f"SELECT name, count(*) / {(ALL_B - ALL_A) / 1e9} * 1000000000 AS per_s FROM spans GROUP BY 1")
_text("a13_throughput_window", f"spans {_WINDOW} | group by {{ name }} {{ throughput() as per_s }}",
      f"SELECT name, count(*) / {(B - A) / 1e9} AS per_s FROM spans WHERE {_INW} GROUP BY 1")


def a14_heatmap(spark: SparkSession, d: str) -> DataFrame:
    out = engine(spark, d).query(f"spans {_AT} | group by {{ ts() bin 6h as bucket }} {{ heatmap(duration_ns) as h }}").primary
    return out.select("bucket", F.explode("h").alias("c")).select("bucket", "c.le", "c.count")


_op("a14_heatmap", a14_heatmap,
    f"SELECT start_time_unix_nano // 21600000000000 * 21600000000000 AS bucket, "
    f"CASE WHEN duration_ns > 0 THEN pow(2.0, ceil(log2(duration_ns))) ELSE 0.0 END AS le, count(*) AS count FROM spans WHERE {_IN} GROUP BY 1, 2")
def a15_sample(spark: SparkSession, d: str) -> DataFrame:
    out = engine(spark, d).query(f"logs {_AT} | group by {{ service_name }} {{ sample(20) as rows, count() as n }}").primary
    ids = F.array_sort(F.transform("rows", lambda r: F.get_json_object(r, "$.log_id")))
    return out.select("service_name", "n", F.array_join(ids, ",").alias("ids"))


_op("a15_sample", a15_sample,
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY md5(log_id)) AS k, count(*) OVER (PARTITION BY service_name) AS n FROM logs)
      SELECT service_name, any_value(n) AS n, array_to_string(list_sort(list(log_id)), ',') AS ids FROM r WHERE k <= 20 GROUP BY 1""")
_text("a16_filtered", f"spans {_AT} | group by {{}} {{ count() where status == ERROR as errors, count() as total, max(duration_ns) where kind == SERVER as m }}",
      f"SELECT count(*) FILTER (WHERE status = 2) AS errors, count(*) AS total, max(duration_ns) FILTER (WHERE kind = 2) AS m FROM spans WHERE {_IN}")
_text("a17_bin", f"logs {_AT} | group by {{ ts() bin 5m as b, severity_text }} {{ count() as n }}",
      f"SELECT time_unix_nano // 300000000000 * 300000000000 AS b, severity_text, count(*) AS n FROM logs WHERE {_INL} GROUP BY 1, 2")
_text("a19_group_by_expression", f"spans {_AT} | group by {{ duration_ns / 100000000 as slot, len(name) as l }} {{ count() as n }}",
      f"SELECT duration_ns // 100000000 AS slot, length(name) AS l, count(*) AS n FROM spans WHERE {_IN} GROUP BY 1, 2")

# sort, limit, uniq
_text("o1_sort_nulls_first", f"spans {_AT} | select span_id, db_system, wal_seq | sort db_system desc, wal_seq asc, span_id asc | take 50",
      f"SELECT span_id, db_system, wal_seq FROM spans WHERE {_IN} ORDER BY db_system DESC NULLS FIRST, wal_seq ASC NULLS FIRST, span_id ASC LIMIT 50")
_text("o2_take_offset", f"logs {_AT} | sort time_unix_nano desc, log_id | take 20 offset 15 | select log_id",
      f"SELECT log_id FROM logs WHERE {_INL} ORDER BY time_unix_nano DESC, log_id LIMIT 20 OFFSET 15")
_text("o4_uniq", f"logs {_AT} | uniq service_name | select service_name, time_unix_nano",
      f"SELECT service_name, min(time_unix_nano) AS time_unix_nano FROM logs WHERE {_INL} GROUP BY 1")

# correlation
_text("j1_navigate_logs_spans", f"logs {_AT} | where severity_text == 'ERROR' -> spans | select trace_id, span_id, wal_seq",
      f"SELECT trace_id, span_id, wal_seq FROM spans WHERE trace_id IN (SELECT trace_id FROM logs WHERE {_INL} AND severity_text = 'ERROR')")
_text("j1_navigate_points_metrics", f"datapoints {_AT} | where value > 1000 navigate metrics",
      f"SELECT * FROM metrics WHERE metric_id IN (SELECT metric_id FROM datapoints WHERE {_INL} AND value > 1000)")
_text("j1_navigate_then_filter", f"logs {_AT} | where severity_number == FATAL -> traces | where status == ERROR | group by {{ name }} {{ count() as n }}",
      f"SELECT name, count(*) AS n FROM spans WHERE trace_id IN (SELECT trace_id FROM logs WHERE {_INL} AND severity_number = 21) AND status = 2 GROUP BY 1")
_text("j2_merge", f"spans {_AT} | where status == ERROR <- logs | where severity_number >= 17 | select log_id",
      f"SELECT log_id FROM logs WHERE {_INL} AND trace_id IN (SELECT trace_id FROM spans WHERE {_IN} AND status = 2) AND severity_number >= 17", "logs")
_text("j2_merge_parens", f"metrics {_AT} | where metric_type != 'histogram' <- (datapoints | group by {{ ts() bin 30m as bucket, metric_id }} {{ avg(value) as val }}) as series",
      f"SELECT time_unix_nano // 1800000000000 * 1800000000000 AS bucket, metric_id, avg(value) AS val FROM datapoints WHERE {_INL} "
      "AND metric_id IN (SELECT metric_id FROM metrics WHERE metric_type <> 'histogram') GROUP BY 1, 2", "series")
_text("j2_merge_resources", f"spans {_AT} | where status == ERROR <- resources",
      f"SELECT * FROM resources WHERE resource_id IN (SELECT resource_id FROM spans WHERE {_IN} AND status = 2)", "resources")
_text("j2b_nested_merge", "samples between(0, 4000000000000000000) | where value_type = 'cpu' and value > 49 <- stacks <- frames",
      """SELECT frame_id, function_name, NULL::VARCHAR AS system_name, NULL::VARCHAR AS filename, NULL::BIGINT AS line, NULL::BIGINT AS "column",
      NULL::BIGINT AS mapping_id, false AS inline FROM (
        SELECT s_suppkey AS frame_id, s_name AS function_name, s_suppkey AS k FROM supplier
        UNION ALL SELECT n_nationkey + 1000000, n_name, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey
        UNION ALL SELECT r_regionkey + 2000000, r_name, s_suppkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey)
      WHERE k IN (SELECT l_suppkey FROM lineitem WHERE round(l_quantity) > 49) GROUP BY frame_id, function_name""", "frames")

# patterns
_MASKED = "body"
for _mask, _sign in (
    ("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"), ('"[^"]*"', "<text>"), ("\\b0[xX][0-9a-fA-F]+\\b", "<hex>"),
):
    _MASKED = f"regexp_replace({_MASKED}, '{_mask}', '{_sign}', 'g')"
# DuckDB's patterns have no look-ahead: long runs of hexadecimal digits are taken out one alternative at a time
_MASKED = f"regexp_replace({_MASKED}, '\\b([0-9]+[a-fA-F][0-9a-fA-F]*|[a-fA-F]+[0-9][0-9a-fA-F]*)\\b', '\x01\\1\x02', 'g')"
_MASKED = f"regexp_replace(regexp_replace({_MASKED}, '\x01[0-9a-fA-F]{{8,}}\x02', '<hex>', 'g'), '[\x01\x02]', '', 'g')"
_MASKED = f"regexp_replace({_MASKED}, '[0-9]+(\\.[0-9]+)*', '<num>', 'g')"
_text("t1_patterns", f"logs {_AT} | patterns body", f"""SELECT {_MASKED} AS pattern, count(*) AS count,
      arg_min(body, {{'t': time_unix_nano, 'b': body}}) AS example, min(time_unix_nano) AS first_seen, max(time_unix_nano) AS last_seen
      FROM logs WHERE {_INL} GROUP BY 1""")

# queries of dashboards
_text(
    "dash_service_health",
    f"spans {_AT} | where resource_id = 612398678 | group by {{}} {{ count() where status == 2 as errors, count() as total, "
    "p50(duration_ns) as p50, count() where attr.http.response.status_code >= 500 as http_5xx }",
    f"SELECT count(*) FILTER (WHERE status = 2) AS errors, count(*) AS total, quantile_cont(duration_ns, 0.5) AS p50, "
    f"count(*) FILTER (WHERE http_response_status_code >= 500) AS http_5xx FROM spans WHERE {_IN} AND resource_id = 612398678",
)
_text("dash_log_search", f"logs {_AT} | where service_name = 'cartwheel' | where severity_number in [17, 18, 9] | where body contains 'request' | select log_id, body",
      f"SELECT log_id, body FROM logs WHERE {_INL} AND service_name = 'cartwheel' AND severity_number IN (17, 18, 9) AND body ILIKE '%request%'")


# telemetry operators
def _t(s: SparkSession, d: str, n: str) -> DataFrame:
    return s.read.parquet(f"{d}/{n}.parquet")


def _served(s: SparkSession, d: str) -> DataFrame:
    return rollups.with_service(_t(s, d, "spans"), _t(s, d, "resources"))


_SERVED = """v AS (SELECT s.*, coalesce(r.service_name, 'unknown') AS service FROM spans s
    LEFT JOIN (SELECT resource_id, min(service_name) AS service_name FROM resources GROUP BY 1) r USING (resource_id))"""


def _at(p: int) -> str:
    return f"list_sort(list(duration_ns))[((count(*) - 1) * {p}) // 100 + 1] AS p{p}_duration"


_op("d1_span_rollup", lambda s, d: rollups.span_rollup(_served(s, d)),
    f"WITH {_SERVED} SELECT service, name, start_time_unix_nano // 60000000000 AS minute_bucket, count(*) AS count, "
    "count(*) FILTER (WHERE status IS DISTINCT FROM 1) AS error_count, min(duration_ns) AS min_duration, max(duration_ns) AS max_duration, "
    f"CAST(sum(duration_ns) AS BIGINT) AS sum_duration, {_at(50)}, {_at(90)}, {_at(95)}, {_at(99)} FROM v GROUP BY 1, 2, 3")
for _w, _n in ((60, "1m"), (3600, "1h"), (86400, "1d")):
    _op(f"d2_metric_rollup_{_n}", lambda s, d, w=_w: rollups.metric_rollup(_t(s, d, "datapoints"), w).withColumn("sum", F.round("sum", 3)),
        f"SELECT series_id, time_unix_nano // {_w}000000000 * {_w} AS bucket, min(value) AS min, max(value) AS max, round(sum(value), 3) AS sum, "
        "count(*) AS count FROM datapoints WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2")
_op("d3_profile_rollup", lambda s, d: rollups.profile_rollup(adapters.line_samples(_t(s, d, "lineitem"))),
    "SELECT l_returnflag AS service, l_suppkey AS stack_id, epoch_ns(l_shipdate) // 60000000000 AS minute_bucket, 'cpu' AS value_type, "
    "CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS total_value FROM lineitem GROUP BY 1, 2, 3")
_op("d4_exemplars", lambda s, d: rollups.exemplars(_t(s, d, "datapoints")),
    "WITH g AS (SELECT * FROM datapoints WHERE value IS NOT NULL AND NOT isnan(value)), "
    "t AS (SELECT series_id, list_sort(list(value))[least(count(*) * 9 // 10, count(*) - 1) + 1] AS cut FROM g GROUP BY 1) "
    "SELECT series_id, time_unix_nano, value, "
    "printf('%016x', CASE WHEN series_id < 0 THEN CAST(series_id AS HUGEINT) + 18446744073709551616 ELSE series_id END::UBIGINT) "
    "|| printf('%016x', time_unix_nano) AS trace_id FROM g JOIN t USING (series_id) WHERE value >= cut")


def d5_d6_histograms(s: SparkSession, d: str) -> DataFrame:
    h = adapters.event_histograms(_t(s, d, "events"))
    pct = [histograms.percentile(F.col("bucket_counts"), F.col("explicit_bounds"), p).alias(f"p{p}") for p in (50, 90, 99)]
    return h.select("metric_id", "time_unix_nano", F.round(histograms.average(F.col("sum"), F.col("count")), 3).alias("average"), *pct)


_HIST = """h AS (SELECT event_type AS metric_id, epoch_ns(ts) // 86400000000000 * 86400000000000 AS time_unix_nano, count(value) AS n,
    round(sum(value), 4) AS s, count(*) FILTER (WHERE value <= 10) AS c1, count(*) FILTER (WHERE value <= 50) AS c2,
    count(*) FILTER (WHERE value <= 100) AS c3 FROM events GROUP BY 1, 2)"""


def _hp(p: int) -> str:
    goal = f"greatest(1, ceil(n * {p / 100.0}))"
    return f"CASE WHEN n = 0 THEN NULL WHEN c1 >= {goal} THEN 10.0 WHEN c2 >= {goal} THEN 50.0 WHEN c3 >= {goal} THEN 100.0 ELSE 200.0 END AS p{p}"


_op("d5_d6_histograms", d5_d6_histograms,
    f"WITH {_HIST} SELECT metric_id, time_unix_nano, round(CASE WHEN n > 0 THEN s / n ELSE 0 END, 3) AS average, {_hp(50)}, {_hp(90)}, {_hp(99)} FROM h")


def d7_d8_heatmap(s: SparkSession, d: str) -> DataFrame:
    h = adapters.event_histograms(_t(s, d, "events"))
    cols = histograms.heatmap_columns(h, ["metric_id"], 30 * 86400 * 10**9, 10)
    return cols.select("metric_id", "bin", "count", F.array_join("bucket_counts", ",").alias("buckets"), F.array_join("delta_counts", ",").alias("deltas"))


_op("d7_d8_heatmap", d7_d8_heatmap,
    """WITH h AS (SELECT event_type AS metric_id, epoch_ns(ts) // 259200000000000 * 259200000000000 AS bin, count(value) AS count,
      [count(*) FILTER (WHERE value <= 10), count(*) FILTER (WHERE value > 10 AND value <= 50), count(*) FILTER (WHERE value > 50 AND value <= 100),
       count(*) FILTER (WHERE value > 100 AND value <= 200), count(*) FILTER (WHERE value > 200)] AS b FROM events GROUP BY 1, 2),
    w AS (SELECT *, lag(b) OVER (PARTITION BY metric_id ORDER BY bin) AS p FROM h)
    SELECT metric_id, bin, count, array_to_string(b, ',') AS buckets,
      array_to_string([CASE WHEN p IS NOT NULL AND b[i] >= p[i] THEN b[i] - p[i] ELSE b[i] END FOR i IN [1, 2, 3, 4, 5]], ',') AS deltas FROM w""")

_TID = "lower(regexp_replace({}, '[\\s\\x{{A0}}-]', '', 'g'))"
_op("d9_trace_summary", lambda s, d: traces.trace_summary(_t(s, d, "spans")),
    f"""SELECT {_TID.format('trace_id')} AS trace_id, arg_min(name, {{'p': replace({_TID.format("coalesce(parent_span_id, '')")}, '0', '') <> '',
        't': start_time_unix_nano, 's': {_TID.format('span_id')}}}) AS root_name, count(*) AS span_count, bool_or(coalesce(status = 2, false)) AS has_error,
        min(start_time_unix_nano) AS start_time_unix_nano, max(end_time_unix_nano) - min(start_time_unix_nano) AS duration_ns FROM spans GROUP BY 1""")
_PROMOTED_TEXT = "http_request_method http_route db_system messaging_system error_type service_name_attr deployment_environment_name k8s_pod_name".split()
_D10 = " OR ".join(f"coalesce(contains(lower({c}), '{{0}}'), false)" for c in ("name", "service", *_PROMOTED_TEXT)) + (
    " OR coalesce(contains(CAST(http_response_status_code AS VARCHAR), '{0}'), false)"
    + "".join(f" OR (contains('{c.replace('_attr', '').replace('_', '.') if c in ('service_name_attr', 'k8s_pod_name') else c.replace('_', '.')}', '{{0}}') AND {c} IS NOT NULL)" for c in _PROMOTED_TEXT)
    + " OR (contains('http.response.status_code', '{0}') AND http_response_status_code IS NOT NULL)"
    " OR coalesce(len(list_filter(map_keys(_overflow_attrs), lambda k: contains(lower(k), '{0}'))) > 0, false)"
    " OR coalesce(len(list_filter(map_values(_overflow_attrs), lambda k: contains(lower(k), '{0}'))) > 0, false)"
)
for _w, _errors in (("basket", True), ("route", False), ("wheel", True)):
    _op(f"d10_trace_filter_{_w}",
        lambda s, d, w=_w, e=_errors: traces.matching_traces(sp := _served(s, d), traces.span_matches(sp, w, errors_only=e)).select("trace_id", "span_count"),
        f"""WITH {_SERVED} SELECT {_TID.format('trace_id')} AS trace_id, count(*) AS span_count FROM v GROUP BY 1
            HAVING bool_or(coalesce({"status = 2 AND " if _errors else ""}({_D10.format(_w)}), false))""")
_op("d11_span_tree", lambda s, d: traces.span_tree(_t(s, d, "spans")),
    f"""WITH RECURSIVE n AS (SELECT {_TID.format('trace_id')} AS t, {_TID.format('span_id')} AS s, wal_seq, coalesce(start_time_unix_nano, 0) AS st,
        {_TID.format("coalesce(parent_span_id, '')")} AS p0 FROM spans),
      u AS (SELECT t, s, arg_min(CASE WHEN replace(p0, '0', '') = '' THEN '' ELSE p0 END, wal_seq) AS p, printf('%016X', arg_min(st, wal_seq)) || ':' || s AS k
        FROM n GROUP BY t, s),
      r AS (SELECT u.t, u.s, 0 AS depth, u.k AS path FROM u LEFT JOIN u q ON q.t = u.t AND q.s = u.p WHERE u.p = '' OR q.s IS NULL
        UNION ALL SELECT u.t, u.s, r.depth + 1, r.path || '/' || u.k FROM r JOIN u ON u.t = r.t AND u.p = r.s)
      SELECT u.t AS trace_id, u.s AS span_id, CAST(coalesce(r.depth, 0) AS BIGINT) AS depth, coalesce(r.path, '~' || u.s) AS sort_path
      FROM u LEFT JOIN r ON r.t = u.t AND r.s = u.s""")


def d12_flamegraph(s: SparkSession, d: str) -> DataFrame:
    e = engine(s, d)
    return flamegraph.flamegraph(e.table("samples"), e.table("stacks"))


_op("d12_flamegraph", d12_flamegraph,
    """WITH f AS (SELECT l_suppkey AS s, n_nationkey + 1000000 AS n, n_regionkey + 2000000 AS r, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS v
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)
    SELECT CAST(r AS VARCHAR) AS path, r AS frame_id, 0 AS depth, NULL AS parent_path, CAST(sum(v) AS BIGINT) AS total_value, CAST(0 AS BIGINT) AS self_value
      FROM f GROUP BY r UNION ALL
    SELECT r || '/' || n, n, 1, CAST(r AS VARCHAR), CAST(sum(v) AS BIGINT), 0 FROM f GROUP BY r, n UNION ALL
    SELECT r || '/' || n || '/' || s, s, 2, r || '/' || n, v, v FROM f""")


def _health(s: SparkSession, d: str, a: int = ALL_A, b: int = ALL_B) -> DataFrame:
    spans = _served(s, d).where(F.col("start_time_unix_nano").between(a, b))
    logs = _t(s, d, "logs").where(F.col("time_unix_nano").between(a, b))
    return health.health_statistics(spans, logs, (b - a) / 60e9)


def _health_sql(a: int, b: int) -> str:
    span = (lambda t: "true") if b - a == ALL_B - ALL_A else (lambda t: f"{t} BETWEEN {a} AND {b}")  # the whole range has no filter
    return f"""WITH {_SERVED}, w AS (SELECT * FROM v WHERE {span("start_time_unix_nano")}),
    a AS (SELECT service, count(*) AS n, count(*) FILTER (WHERE status = 2) AS e, count(*) FILTER (WHERE http_response_status_code BETWEEN 200 AND 599) AS h,
      count(*) FILTER (WHERE http_response_status_code BETWEEN 200 AND 299) AS c2, count(*) FILTER (WHERE http_response_status_code BETWEEN 300 AND 399) AS c3,
      count(*) FILTER (WHERE http_response_status_code BETWEEN 400 AND 499) AS c4, count(*) FILTER (WHERE http_response_status_code BETWEEN 500 AND 599) AS c5,
      list_sort(list(duration_ns)) AS l FROM w GROUP BY 1),
    b AS (SELECT service_name AS service, count(*) AS bad FROM logs WHERE {span("time_unix_nano")} AND severity_number >= 17 GROUP BY 1),
    j AS (SELECT service, n, e, h, c2, c3, c4, c5, l, coalesce(bad, 0) AS bad FROM a FULL JOIN b USING (service))
    SELECT service, coalesce(e / n, 0.0) AS span_error_rate, CASE WHEN h > 0 THEN (c4 + c5) / h ELSE 0.0 END AS http_error_rate,
      {", ".join(f"CASE WHEN h > 0 THEN c{k} / h ELSE 0.0 END AS http_{k}xx_rate" for k in (2, 3, 4, 5))},
      coalesce(n, 0) / {(b - a) / 60e9} AS throughput_per_minute, bad / {(b - a) / 60e9} AS error_logs_per_minute,
      {", ".join(f"l[CAST(floor((len(l) - 1) * {p / 100.0} + 0.5) AS BIGINT) + 1] AS latency_p{p}_ns" for p in (50, 95, 99))} FROM j"""


_HEALTH = _health_sql(ALL_A, ALL_B)
_op("d15_health_statistics", _health, _HEALTH)
_op("d16_health_metrics", lambda s, d: health.health_metrics(_health(s, d)),
    f"WITH s AS ({_HEALTH}) " + " UNION ALL ".join(f"SELECT service, 'health.{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM s" for m in health.METRICS))
_ENDS = "(CAST(floor({t} // 60000000000) AS BIGINT) + unnest(range(1, 6))) * 60000000000 AS window_end"
_op("d16_health_series", lambda s, d: health.health_series(_served(s, d), _t(s, d, "logs")),
    f"""WITH {_SERVED}, w AS (SELECT *, {_ENDS.format(t="start_time_unix_nano")} FROM v),
    lw AS (SELECT service_name AS service, severity_number, {_ENDS.format(t="time_unix_nano")} FROM logs),
    a AS (SELECT service, window_end, count(*) AS n, count(*) FILTER (WHERE status = 2) AS e, count(*) FILTER (WHERE http_response_status_code BETWEEN 200 AND 599) AS h,
      {", ".join(f"count(*) FILTER (WHERE http_response_status_code BETWEEN {k}00 AND {k}99) AS c{k}" for k in (2, 3, 4, 5))}, list_sort(list(duration_ns)) AS l
      FROM w GROUP BY 1, 2),
    b AS (SELECT service, window_end, count(*) AS bad FROM lw WHERE severity_number >= 17 GROUP BY 1, 2),
    j AS (SELECT service, window_end, coalesce(n, 0) AS n, coalesce(e, 0) AS e, coalesce(h, 0) AS h, c2, c3, c4, c5, l, coalesce(bad, 0) AS bad
      FROM a FULL JOIN b USING (service, window_end)),
    s AS (SELECT service, window_end, CASE WHEN n > 0 THEN e / n ELSE 0.0 END AS span_error_rate, CASE WHEN h > 0 THEN (c4 + c5) / h ELSE 0.0 END AS http_error_rate,
      {", ".join(f"CASE WHEN h > 0 THEN c{k} / h ELSE 0.0 END AS http_{k}xx_rate" for k in (2, 3, 4, 5))}, n / 5.0 AS throughput_per_minute,
      bad / 5.0 AS error_logs_per_minute, {", ".join(f"l[CAST(floor((len(l) - 1) * {p / 100.0} + 0.5) AS BIGINT) + 1] AS latency_p{p}_ns" for p in (50, 95))} FROM j)
    """ + " UNION ALL ".join(f"SELECT service, window_end, 'health.{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM s" for m in health.METRICS))


def _score(col: str, w: float, e: float) -> str:
    return f"CASE WHEN {col} <= {w} THEN 1 - {col} / {w} * 0.3 WHEN {col} <= {e} THEN 0.7 - ({col} - {w}) / ({e} - {w}) * 0.4 ELSE 0.3 * exp(-({col} - {e}) / {e}) END"


def _health_scores_sql() -> str:
    top = " + ".join(f"coalesce(({_score(m, w, e)}) * {g}, 0)" for m, g, w, e in health.DEFAULT_RULES)
    weight = " + ".join(f"CASE WHEN {m} IS NULL THEN 0 ELSE {g} END" for m, g, _, _ in health.DEFAULT_RULES)
    worst = ", ".join(f"coalesce(CASE WHEN {m} <= {w} THEN 0 WHEN {m} <= {e} THEN 1 ELSE 2 END, 0)" for m, _, w, e in health.DEFAULT_RULES)
    return (f"WITH s AS ({_HEALTH}) SELECT service, ({top}) / ({weight}) AS score, "
            f"['healthy', 'degraded', 'unhealthy'][greatest({worst}) + 1] AS status FROM s")


_op("d17_health_scores", lambda s, d: health.health_scores(_health(s, d), health.rules_frame(s)), _health_scores_sql())
_DAY = 86400 * 10**9
_op("d25_health_feed", lambda s, d: health.health_feed(_served(s, d), _t(s, d, "logs"), ALL_A, ALL_B, _DAY),
    f"WITH n AS ({_health_sql(ALL_A, ALL_B)}), p AS ({_health_sql(ALL_A - _DAY, ALL_B - _DAY)}) SELECT service, n.* EXCLUDE (service), "
    "COLUMNS(p.* EXCLUDE (service)) AS 'previous_\\0' FROM n FULL JOIN p USING (service)")
_op("d25_health_feed_window", lambda s, d: health.health_feed(_served(s, d), _t(s, d, "logs"), A, B, B - A),
    f"WITH n AS ({_health_sql(A, B)}), p AS ({_health_sql(2 * A - B, A)}) SELECT service, n.* EXCLUDE (service), "
    "COLUMNS(p.* EXCLUDE (service)) AS 'previous_\\0' FROM n FULL JOIN p USING (service)")
_op("d26_histogram_activity", lambda s, d: histograms.activity(adapters.event_histograms(_t(s, d, "events")), ["metric_id"]).select("metric_id", "time_unix_nano", "highest_bucket"),
    """WITH h AS (SELECT event_type AS metric_id, epoch_ns(ts) // 86400000000000 * 86400000000000 AS t,
      [count(*) FILTER (WHERE value <= 10), count(*) FILTER (WHERE value > 10 AND value <= 50), count(*) FILTER (WHERE value > 50 AND value <= 100),
       count(*) FILTER (WHERE value > 100 AND value <= 200), count(*) FILTER (WHERE value > 200)] AS b FROM events GROUP BY 1, 2),
    w AS (SELECT *, lag(b) OVER (PARTITION BY metric_id ORDER BY t) AS p FROM h)
    SELECT metric_id, t AS time_unix_nano, CAST(list_max([i - 1 FOR i IN [1, 2, 3, 4, 5]
      IF CASE WHEN p IS NOT NULL AND b[i] >= p[i] THEN b[i] - p[i] ELSE b[i] END > 0]) AS INTEGER) AS highest_bucket FROM w""")


def _listed(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: f(adapters.metric_variants(_t(s, d, "metrics"))).withColumn("members", F.array_join("members", ","))


_VARIANTS = f"metrics_ AS (SELECT * EXCLUDE (name), name || unnest({adapters.VARIANTS}) AS name FROM metrics)"
_SUFFIX = ", ".join(f"'{x}'" for x in metric_groups.STATISTICAL)
_op("d19_statistical_groups", _listed(metric_groups.statistical_groups),
    f"""WITH {_VARIANTS} SELECT resource_id, metric_type, unit, regexp_extract(name, '^(.*)\\.([^.]*)$', 1) AS prefix, array_to_string(list_sort(list(DISTINCT name)), ',') AS members
      FROM metrics_ WHERE regexp_extract(name, '^(.*)\\.([^.]*)$', 1) <> '' AND regexp_extract(name, '^(.*)\\.([^.]*)$', 2) IN ({_SUFFIX})
      GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT name) BETWEEN 2 AND 20""")
_op("d20_histogram_families", _listed(metric_groups.histogram_families),
    f"""WITH {_VARIANTS}, r AS (SELECT resource_id, name, regexp_extract(name, '^(.*)(_bucket|_count|_sum)$', 1) AS base, regexp_extract(name, '^(.*)(_bucket|_count|_sum)$', 2) AS part FROM metrics_)
      SELECT resource_id, base, array_to_string(list_sort(list(DISTINCT name)), ',') AS members FROM r WHERE base <> ''
      GROUP BY 1, 2 HAVING bool_or(part = '_count') AND bool_or(part = '_sum')""")
_op("d21_namespace_groups", _listed(metric_groups.namespace_groups),
    f"""WITH {_VARIANTS}, r AS (SELECT resource_id, name, string_split(name, '.') AS p, unnest([3, 4]) AS k FROM metrics_)
      SELECT resource_id, array_to_string(p[1:k], '.') AS namespace, array_to_string(list_sort(list(DISTINCT name)), ',') AS members FROM r WHERE len(p) > k
      GROUP BY 1, 2 HAVING count(DISTINCT name) BETWEEN 2 AND 10""")
_op("d22_metric_hierarchy", lambda s, d: metric_groups.hierarchy(_t(s, d, "metrics")),
    """SELECT DISTINCT array_to_string(p[1:k], '.') AS prefix, name FROM (SELECT name, string_split(name, '.') AS p, unnest(range(1, len(string_split(name, '.')))) AS k FROM metrics)""")
def series_index(s: SparkSession, d: str) -> DataFrame:
    """The driver's series as an index: ids stay the driver's, labels are the attributes."""
    return _t(s, d, "series").select("series_id", "metric_name", F.from_json("attributes", "map<string,string>").alias("labels"))


_op("d24_series_lookup", lambda s, d: series.points_of(_t(s, d, "datapoints"), series_index(s, d), "request.total", ALL_A, ALL_B, {"zone": "z1"}),
    _nan_sql("""SELECT * FROM datapoints WHERE series_id IN (SELECT series_id FROM series
      WHERE metric_name = 'request.total' AND json_extract_string(attributes, '$.zone') = 'z1')""", "value"))
_marked("d24_series_lookup", "value")
_op("t1_log_patterns", lambda s, d: patterns.log_patterns(_t(s, d, "logs")).select("pattern", "count"), f"SELECT {_MASKED} AS pattern, count(*) AS count FROM logs GROUP BY 1")
