"""Queries of the core's data-processing operators, with equivalent SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup, grid, hierarchy, late, wide
from ..operators.shared import parent_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.missing_periods(table(spark, d, "datapoints"), table(spark, d, "series"))


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(table(spark, d, "datapoints"), table(spark, d, "series")).select(
        "series_id", "period_unix_s", "value", "is_missing", "locf_value", "linear_value", "n_readings"
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return dedup.repeated_spans(table(spark, d, "spans"))


def p2_exactly_once(spark: SparkSession, d: str) -> DataFrame:
    once = dedup.deduplicate_spans(table(spark, d, "spans"))
    return once.withColumn("parent_span_id", parent_id("parent_span_id")).drop("_overflow_attrs")


def p2_exactly_once_attrs(spark: SparkSession, d: str) -> DataFrame:
    """The kept rows with their attribute map, as [key, value] pairs by key."""
    once = dedup.deduplicate_spans(table(spark, d, "spans")).withColumn("parent_span_id", parent_id("parent_span_id"))
    pairs = F.transform(F.array_sort(F.map_entries("_overflow_attrs")), lambda e: F.array(e["key"], e["value"]))
    return once.withColumn("_overflow_attrs", pairs)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.spans_on_circles(table(spark, d, "spans"))


def p4_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.span_hierarchy(table(spark, d, "spans"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.span_descendants(table(spark, d, "spans"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return late.corrected_minutes(table(spark, d, "spans"))


def p5_minutes(spark: SparkSession, d: str) -> DataFrame:
    return late.corrected_periods(table(spark, d, "spans"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.ill_typed_values(*[table(spark, d, t) for t in ("spans", "span_attrs", "attr_catalog")])


def p7_wide(spark: SparkSession, d: str) -> DataFrame:
    out = wide.wide_table(*[table(spark, d, t) for t in ("spans", "span_attrs", "attr_catalog")])
    return out.withColumn("ill_typed", F.array_join(F.coalesce("ill_typed", F.array()), ","))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_grid, p2_found, p2_exactly_once, p4_found, p4_hierarchy, p4_descendants, p5_found, p5_minutes,
        p7_found, p7_wide, p2_exactly_once_attrs,
    )
}

_ID = "lower(regexp_replace({}, '[\\s\\x{{A0}}-]', '', 'g'))"
T, S, P = (_ID.format(c) for c in ("trace_id", "span_id", "parent_span_id"))

_PERIODS = """p AS (
  SELECT series_id, interval_s, CAST(floor(time_unix_nano / (interval_s * 1000000000.0)) AS BIGINT) AS approx,
         time_unix_nano - ((time_unix_nano % (interval_s * 1000000000)) + interval_s * 1000000000)
           % (interval_s * 1000000000) AS base, time_unix_nano, value
  FROM datapoints JOIN (SELECT series_id, min(interval_s) AS interval_s FROM series WHERE interval_s > 0 GROUP BY 1)
  USING (series_id) WHERE value IS NOT NULL AND NOT isnan(value) AND time_unix_nano IS NOT NULL),
c AS (SELECT series_id, any_value(interval_s) AS interval_s, base // 1000000000 AS s, count(*) AS n,
             arg_max(value, {'t': time_unix_nano, 'v': value}) AS value FROM p GROUP BY series_id, base),
g AS (SELECT series_id, unnest(range(min(s), max(s) + 1, any_value(interval_s))) AS s FROM c GROUP BY series_id)"""

_FIRST = f"""f AS (SELECT arg_min({{'st': start_time_unix_nano, 'r': resource_id, 'rc': received_unix_nano,
                'd': duration_ns}}, wal_seq) AS x FROM spans
      WHERE start_time_unix_nano IS NOT NULL AND received_unix_nano IS NOT NULL GROUP BY {T}, {S}),
e AS (SELECT x.r AS resource_id, CAST(floor(x.st // 60000000000) AS BIGINT) * 60 AS minute_unix_s, x.d AS v,
             x.rc - (x.st // 60000000000 + 1) * 60000000000 AS late FROM f WHERE x.st <> 0)"""

_LINKS = f"""n AS (SELECT {T} AS t, {S} AS s,
      CASE WHEN replace({P}, '0', '') = '' THEN NULL ELSE {P} END AS p, wal_seq, start_time_unix_nano AS st FROM spans),
u AS (SELECT t, s, arg_min(coalesce(p, ''), wal_seq) AS p FROM n GROUP BY t, s)"""

_TREE = f"""WITH RECURSIVE {_LINKS},
r AS (SELECT u.t, u.s, u.s AS root, 0 AS depth, u.s AS path, CASE WHEN u.p = '' THEN 'root' ELSE 'orphan' END AS e
      FROM u LEFT JOIN u q ON q.t = u.t AND q.s = u.p WHERE u.p = '' OR q.s IS NULL
      UNION ALL
      SELECT u.t, u.s, r.root, r.depth + 1, r.path || '/' || u.s, r.e FROM r JOIN u ON u.t = r.t AND u.p = r.s),
c AS (SELECT t, s, p AS goal FROM u WHERE p <> '' AND NOT EXISTS (SELECT 1 FROM r WHERE r.t = u.t AND r.s = u.s)
      UNION
      SELECT c.t, c.s, u.p FROM c JOIN u ON u.t = c.t AND u.s = c.goal)
"""

_ATTRS = f"""WITH a AS (
  SELECT {T} AS t, {S} AS s, lower(trim(key, E' \\t\\r\\n')) AS k, trim(value, E' \\t\\r\\n') AS v, wal_seq FROM span_attrs
  UNION ALL
  SELECT {T}, {S}, lower(trim(m.key, E' \\t\\r\\n')), trim(m.value, E' \\t\\r\\n'), wal_seq
  FROM (SELECT trace_id, span_id, wal_seq, unnest(map_entries(_overflow_attrs)) AS m FROM spans)),
b AS (SELECT t, s, c.key AS key, c.value_type AS ty, wal_seq,
        CASE WHEN length(v) >= 2 AND v LIKE '"%"' THEN trim(v[2:-2], E' \\t\\r\\n') ELSE v END AS v
      FROM a JOIN attr_catalog c ON a.k = lower(c.key) OR a.k = lower(c.column_name)),
d AS (SELECT *, CASE ty
        WHEN 'int64' THEN regexp_full_match(v, '[+-]?[0-9]+') AND try_cast(ltrim(v, '+') AS BIGINT) IS NOT NULL
        WHEN 'double' THEN regexp_full_match(v, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?')
          AND coalesce(isfinite(try_cast(ltrim(v, '+') AS DOUBLE)), false)
        WHEN 'bool' THEN lower(v) IN ('true', 'false') ELSE true END AS fits
      FROM b WHERE v IS NOT NULL AND v <> '')
"""

#: The attribute catalog's keys by type, whose columns are the keys with underscores.
CATALOG = {
    "string": "http.request.method http.route url.path server.address db.system db.operation.name db.collection.name "
    "rpc.system rpc.method messaging.system messaging.destination.name error.type exception.message service.name "
    "service.version k8s.namespace.name log.iostream",
    "int64": "http.response.status_code server.port rpc.grpc.status_code net.peer.port retry.count payload.bytes",
    "double": "sampled.ratio queue.wait_ms",
    "bool": "cache.hit tenant.trial feature.dark_launch",
}


def _wide_sql() -> str:
    cells = []
    for kind, keys in CATALOG.items():
        for key in keys.split():
            name = "service_name_attr" if key == "service.name" else key.replace(".", "_")
            best = f"max({{'w': wal_seq, 'v': v}}) FILTER (WHERE fits AND key = '{key}')"
            value = f"({best}).v"
            if kind != "string":
                value = f"try_cast(ltrim({value}, '+') AS {dict(int64='BIGINT', double='DOUBLE', bool='BOOLEAN')[kind]})"
            cells.append(f"{value} AS {name}")
    bad = "coalesce(array_to_string(list_sort(list(DISTINCT key) FILTER (WHERE NOT fits)), ','), '')"
    return (
        f"{_ATTRS}, w AS (SELECT t, s, {', '.join(cells)}, {bad} AS ill_typed FROM d GROUP BY t, s), "
        f"ids AS (SELECT DISTINCT {T} AS trace_id, {S} AS span_id FROM spans) "
        "SELECT trace_id, span_id, w.* EXCLUDE (t, s, ill_typed), coalesce(ill_typed, '') AS ill_typed "
        "FROM ids LEFT JOIN w ON w.t = trace_id AND w.s = span_id"
    )


_SPAN_COLUMNS = (
    "name kind status start_time_unix_nano end_time_unix_nano duration_ns resource_id scope_id http_request_method "
    "http_response_status_code http_route db_system messaging_system error_type service_name_attr "
    "deployment_environment_name k8s_pod_name wal_seq received_unix_nano"
).split()

SQL: dict[str, str] = {
    "p1_found": f"WITH {_PERIODS} SELECT series_id, s AS period_unix_s FROM g ANTI JOIN c USING (series_id, s)",
    "p1_grid": f"""WITH {_PERIODS} SELECT g.series_id, g.s AS period_unix_s, c.value, c.s IS NULL AS is_missing,
        last_value(c.value IGNORE NULLS) OVER l AS locf_value, CASE WHEN c.s IS NOT NULL THEN c.value ELSE
          last_value(c.value IGNORE NULLS) OVER l + (first_value(c.value IGNORE NULLS) OVER r - last_value(c.value IGNORE NULLS) OVER l)
          * ((g.s - last_value(c.s IGNORE NULLS) OVER l) / (first_value(c.s IGNORE NULLS) OVER r - last_value(c.s IGNORE NULLS) OVER l)) END AS linear_value,
        coalesce(c.n, 0) AS n_readings FROM g LEFT JOIN c ON c.series_id = g.series_id AND c.s = g.s
        WINDOW l AS (PARTITION BY g.series_id ORDER BY g.s), r AS (PARTITION BY g.series_id ORDER BY g.s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "p2_found": f"SELECT {T} AS trace_id, {S} AS span_id FROM spans GROUP BY 1, 2 HAVING count(*) > 1",
    "p2_exactly_once": f"SELECT trace_id, span_id, n_copies, "
    f"CASE WHEN replace({_ID.format('x.parent_span_id')}, '0', '') = '' THEN NULL ELSE {_ID.format('x.parent_span_id')} END "
    "AS parent_span_id, "
    + ", ".join(f"x.{c} AS {c}" for c in _SPAN_COLUMNS)
    + f" FROM (SELECT {T} AS trace_id, {S} AS span_id, count(*) AS n_copies, arg_min({{"
    + ", ".join(f"'{c}': {c}" for c in [*_SPAN_COLUMNS, "parent_span_id"])
    + "}, wal_seq) AS x FROM spans GROUP BY 1, 2)",
    "p4_found": f"{_TREE} SELECT t AS trace_id, s AS span_id FROM c WHERE goal = s",
    "p4_hierarchy": f"""{_TREE} SELECT u.t AS trace_id, u.s AS span_id,
        CASE WHEN r.s IS NOT NULL THEN r.e WHEN EXISTS (SELECT 1 FROM c WHERE c.t = u.t AND c.s = u.s AND c.goal = u.s)
          THEN 'circle' ELSE 'trapped' END AS end_state, r.root AS root_span_id, CAST(r.depth AS BIGINT) AS depth, r.path
        FROM u LEFT JOIN r ON r.t = u.t AND r.s = u.s""",
    "p4_descendants": f"""{_TREE}, a AS (SELECT t, s, string_split(path, '/') AS ids FROM r WHERE depth > 0)
        SELECT t AS trace_id, ids[k] AS span_id, s AS descendant_id, CAST(len(ids) - k AS BIGINT) AS distance
        FROM (SELECT *, unnest(range(1, len(ids))) AS k FROM a)""",
    "p5_found": f"""WITH {_FIRST} SELECT resource_id, minute_unix_s FROM e
        WHERE late > 60000000000 AND late <= 900000000000 GROUP BY 1, 2""",
    "p5_minutes": f"""WITH {_FIRST} SELECT resource_id, minute_unix_s,
        count(*) FILTER (WHERE late <= 60000000000) AS n_on_time,
        count(*) FILTER (WHERE late > 60000000000 AND late <= 900000000000) AS n_late,
        count(*) FILTER (WHERE late > 900000000000) AS n_dropped,
        count(DISTINCT v) FILTER (WHERE late <= 900000000000) AS n_distinct,
        min(v) FILTER (WHERE late <= 900000000000) AS min_value, max(v) FILTER (WHERE late <= 900000000000) AS max_value,
        quantile_disc(v, 0.5) FILTER (WHERE late <= 60000000000) AS median_on_time,
        quantile_disc(v, 0.5) FILTER (WHERE late <= 900000000000) AS median_value FROM e GROUP BY 1, 2""",
    "p7_found": f"{_ATTRS} SELECT DISTINCT t AS trace_id, s AS span_id, key FROM d WHERE NOT fits",
    "p7_wide": _wide_sql(),
}

SQL["p2_exactly_once_attrs"] = f"""SELECT o.*, list_sort([[e.key, e.value] FOR e IN map_entries(a.x.m)]) AS _overflow_attrs
    FROM ({SQL["p2_exactly_once"]}) o JOIN (
      SELECT {T} AS trace_id, {S} AS span_id, arg_min({{'m': _overflow_attrs}}, wal_seq) AS x FROM spans GROUP BY 1, 2) a
    ON a.trace_id IS NOT DISTINCT FROM o.trace_id AND a.span_id IS NOT DISTINCT FROM o.span_id"""
