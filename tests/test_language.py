"""Parser, shapes and planner."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenpipe.engine import Engine
from lumenpipe.plans import ast as A
from lumenpipe.plans import catalog as C
from lumenpipe.plans.errors import InvalidQuery, ParseError, UnknownField
from lumenpipe.plans.parser import parse
from lumenpipe.plans.shape import infer_shape

H = 3600 * 10**9
NOW = 1_700_000_000 * 10**9


def q(text):
    return parse(text, NOW)


def test_scans():
    assert q("spans last 1h") == A.Query(A.Scan("spans", A.Last(H)))
    assert q("LOGS LAST 30 s").scan.time == A.Last(30 * 10**9)
    assert q("logs between(5 9)").scan.time == q("logs between(5, 9)").scan.time == A.Span(5, 9)
    day = 86400 * 10**9
    midnight = NOW // day * day
    assert q("metrics today").scan.time == A.Span(midnight, midnight + day)
    assert q("metrics yesterday").scan.time == A.Span(midnight - day, midnight)
    assert q("span(7f7ccdd2e5f0d194) | take 1") == A.Query(A.Scan("spans", A.Last(day), "7f7ccdd2e5f0d194"), (A.Take(1),))
    assert q("metric('4b9c3e26-18ee')").scan == A.Scan("metrics", A.Last(day), "4b9c3e26-18ee")
    for signal in C.SIGNALS:
        assert q(f"{signal} last 5m").scan.signal == signal


def test_predicates_bind_as_written():
    w = q("spans last 1h | where a == 1 or b == 2 and not c == 3").stages[0].pred
    assert isinstance(w, A.Or) and isinstance(w.parts[1], A.And) and isinstance(w.parts[1].parts[1], A.Not)
    w = q("spans last 1h | where (a == 1 || b = 2) && !exists c").stages[0].pred
    assert isinstance(w, A.And) and isinstance(w.parts[0], A.Or) and w.parts[1] == A.Not(A.Exists(A.Field("", "c")))
    assert q("logs last 1h | where body contains 'it''s'").stages[0].pred == A.Match("contains", A.Field("", "body"), "it's")
    assert q(r'logs last 1h | where body matches "a\"b"').stages[0].pred.text == 'a"b'
    assert q("spans last 1h | where kind in [CLIENT, 3, -2.5]").stages[0].pred.values == (
        A.Literal("CLIENT", "name"), A.Literal(3, "int"), A.Literal(-2.5, "float"),
    )
    assert q("spans last 1h | where OKAY == 1").stages[0].pred.left == A.Field("", "OKAY")
    assert q("spans last 1h | where infra == 1").stages[0].pred.left == A.Field("", "infra")
    assert q("spans last 1h | where resource.a.b == attr.c").stages[0].pred == A.Compare("==", A.Field("resource", "a.b"), A.Field("attr", "c"))


def test_expressions():
    e = q("spans last 1h | compute a + b * 2 - 3 as x").stages[0].items[0][0]
    assert e == A.Binary("-", A.Binary("+", A.Field("", "a"), A.Binary("*", A.Field("", "b"), A.Literal(2, "int"))), A.Literal(3, "int"))
    assert q("spans last 1h | compute ts() as t, len(name) as l").stages[0].items[1][0] == A.Call("len", (A.Field("", "name"),))


def test_group_by():
    g = q("spans last 1h | group by { ts() bin 5m as b, name } { count() where status == ERROR as n, p95(d) as p }").stages[0]
    assert g.keys == (A.Key(A.Call("ts", ()), 5 * 60 * 10**9, "b"), A.Key(A.Field("", "name"), None, "name"))
    assert g.aggs[0].name == "count" and g.aggs[0].pred is not None and g.aggs[1].arg == A.Field("", "d")
    assert q("spans last 1h | group by {} { count() as n }").stages[0].keys == ()


def test_merge_is_greedy_unless_closed():
    m = q("profiles last 1h <- samples <- stacks <- frames").stages
    assert len(m) == 1 and m[0].stages[0].stages[0] == A.Merge("frames", (), "frames")
    m = q("metrics last 1h <- (datapoints | take 5) as p <- histograms as h").stages
    assert [(x.signal, x.alias) for x in m] == [("datapoints", "p"), ("histograms", "h")]
    m = q("spans last 1h merge logs | where severity_number > 9 -> spans").stages
    assert len(m) == 1 and len(m[0].stages) == 2
    assert q("logs last 1h navigate traces").stages == (A.Navigate("traces"),)
    assert q("logs last 1h | -> traces").stages == (A.Navigate("traces"),)


@pytest.mark.parametrize(
    "text",
    [
        "", "spans", "spans last", "spans last 5", "widgets last 1h", "spans last 1h LIMIT 5", "spans last 1h | where", "spans last 1h | take x",
        "spans last 1h | group by { name } { }", "spans last 1h | group by { name } { count() }", "spans last 1h | compute a", "spans last 1h | where a == 'x",
        "spans last 1h <- (logs", "spans last 1h <- logs as a <- scopes as a", "spans last 1h | let x = 1", "spans last 1h | group by {} { sum() as s }",
        "spans last 1h | group by {} { sample(0) as s }", "spans last 1h | where a ~ 3", "spans last 1h | compute nope(a) as b",
    ],
)
def test_errors_have_offsets(text):
    with pytest.raises(ParseError) as e:
        q(text)
    assert 0 <= e.value.offset <= len(text) and e.value.length >= 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="spanlogwheretkbyi|<->{}()[]=!&'\".,*+ 0123456789", max_size=80))
def test_parser_fails_only_with_parse_errors(text):
    for t in (text, "spans last 1h " + text, "logs last 1h | where " + text):
        try:
            q(t)
        except ParseError:
            pass


def test_shapes():
    assert infer_shape(q("spans last 1h")) == infer_shape(q("traces last 1h | where status == ERROR")) == "table"
    assert infer_shape(q("logs last 1h -> spans")) == "trace_timeline"
    assert infer_shape(q("spans last 1h | group by { ts() bin 1m } { count() as n }")) == "time_series"
    assert infer_shape(q("spans last 1h | group by {} { count() as n }")) == "scalar"
    assert infer_shape(q("spans last 1h | group by { name } { count() as n }")) == "table"
    assert infer_shape(q("spans last 1h | group by { ts() bin 1m } { heatmap(duration_ns) as h }")) == "heatmap"
    assert infer_shape(q("logs last 1h | patterns")) == "pattern_groups"


def test_correlation_paths():
    assert len(C.MERGE_KEY) == 48 and C.MERGE_KEY["samples", "stacks"] == "stack_id" and ("samples", "frames") not in C.MERGE_KEY
    assert len(C.PROMOTED) == 37 and C.promoted_column("service.name") == "service_name_attr"


SPANS = (
    "trace_id string, span_id string, name string, kind smallint, status smallint, start_time_unix_nano bigint, duration_ns bigint, "
    "resource_id bigint, scope_id bigint, http_method string, _overflow_attrs map<string,string>"
)


@pytest.fixture(scope="module")
def engine(spark):
    spans = spark.createDataFrame(
        [
            ("t1", "a", "GET /a_b", 2, 1, NOW - 10, 100, 1, 7, "GET", {"n": "5", "s": '"x"'}), ("t1", "b", "db%", 3, 2, NOW, 0, 1, 7, None, {}),
            ("t2", "c", None, None, None, NOW - 2 * H, None, 9, None, None, None),
        ],
        SPANS,
    )
    resources = spark.createDataFrame([(1, "api", '{"k.v": "deep"}')], C.schema("resources"))
    logs = spark.createDataFrame([("l1", NOW, "t1", "ERROR", 17), ("l2", NOW, None, "INFO", 9)], "log_id string, time_unix_nano bigint, trace_id string, severity_text string, severity_number smallint")
    return Engine(spark, {"spans": spans, "resources": resources}, {"logs": logs}, now_ns=NOW)


def ids(engine, text, col="span_id"):
    return sorted(r[col] for r in engine.query(text).primary.collect())


def test_planner_semantics(engine):
    assert ids(engine, "spans last 1h") == ["a", "b"]
    assert ids(engine, "spans last 900000d") == ["a", "b", "c"]
    assert ids(engine, f"spans between({NOW - 10}, {NOW - 10})") == ["a"]
    assert ids(engine, "spans last 1h | where status == 'error'") == ["b"]
    assert ids(engine, "spans last 1h | where ERROR == status") == ["b"]
    assert ids(engine, "spans last 1h | where name contains '_'") == ["a"]
    assert ids(engine, "spans last 1h | where name ends_with '%'") == ["b"]
    assert ids(engine, "spans last 1h | where attr.n >= 5 and attr.s == 'x' and attr.http.method == 'GET'") == ["a"]
    assert ids(engine, "spans last 1h | where n.x == 1 or exists http.method") == ["a"]
    assert ids(engine, "spans last 3h | where service_name == 'api' and resource.k.v == 'deep'") == ["a", "b"]
    assert ids(engine, "logs last 1h | where severity_text == ERROR -> spans") == ["a", "b"]
    assert ids(engine, "span(b)") == ["b"]
    r = engine.query("spans last 1h | compute duration_ns / 0 as x, duration_ns / 3 as y, name as name | sort span_id").primary.collect()
    assert [(x["x"], x["y"]) for x in r] == [(None, 33), (None, 0)] and engine.query("spans last 1h").primary.columns == [c.split()[0] for c in SPANS.split(", ")]
    r = engine.query("spans last 3h | group by {} { first(name) as f, last(name) as l, throughput() as t, error_rate() as e, heatmap(duration_ns) as h, sample(2) as s, count() as n }").primary.first()
    assert (r["f"], r["l"], r["n"], len(r["s"])) == (None, "db%", 3, 2) and abs(r["e"] - 1 / 3) < 1e-9 and r["t"] == 3 / 10800
    assert [(x["le"], x["count"]) for x in r["h"]] == [(0.0, 1), (128.0, 1)]
    r = engine.query("spans last 3h | sort name desc | select span_id").primary.collect()
    assert r[0]["span_id"] == "c"
    aux = engine.query("spans last 1h <- (resources) <- (logs) as l").aux
    assert {k: v.count() for k, v in aux.items()} == {"resources": 1, "l": 1}
    cols = engine.query("spans last 1h | group by { name } { count() as n } | compute n * 2 as m").columns
    assert [(c.name, c.role) for c in cols] == [("name", "GroupKey"), ("n", "Aggregation"), ("m", "Computed")]
    assert engine.query("exp_histograms last 1h").primary.count() == 0
    assert engine.query("logs last 1h", scope="cold").primary.count() == 0
    assert "span_id" in engine.show("spans last 1h", "jsonl") and engine.stats()["spans"] == 3


def test_planner_errors(engine):
    for text, kind in [
        ("spans last 1h | where nope == 1", UnknownField), ("spans last 1h -> metrics", InvalidQuery), ("metrics last 1h | where ts() > 1", InvalidQuery),
        ("spans last 1h | where status == 'zzz'", InvalidQuery), ("spans last 1h | group by { name } { count() as n } <- logs", InvalidQuery),
        ("samples last 1h <- frames", InvalidQuery),
    ]:
        with pytest.raises(kind, match="."):
            engine.query(text)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "spans")
    spark.createDataFrame([("t", "a", "n", 1, 2, 5, 1, 1, 1, None, {})], SPANS).write.parquet(path)
    e = Engine(spark, {"spans": lambda: spark.read.parquet(path)}, now_ns=10)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    df = e.query("spans last 1h | where status == ERROR | select span_id, duration_ns").primary
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(start_time_unix_nano)" in plan and "EqualTo(status,2)" in plan
    assert "ReadSchema: struct<span_id:string,status:smallint,start_time_unix_nano:bigint,duration_ns:bigint>" in plan


def test_last_with_a_filter_and_no_time_column(spark):
    from lumenpipe.engine import Engine

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "scope_id bigint, name string")
    engine = Engine(spark, {"scopes": df}, now_ns=0)
    row = engine.query("scopes last 1h | group by {} { first(name) where scope_id < 3 as f, last(name) where scope_id < 3 as l }").primary.first()
    assert (row["f"], row["l"]) == ("a", "b")


def test_overflow_text_resolves_escapes(spark):
    from lumenpipe.engine import Engine

    df = spark.createDataFrame([("s", {"a.b": '"say \\"hi\\" \\\\ there"'}), ("t", {"a.b": '"plain"'}), ("u", {"a.b": "7"})], "span_id string, _overflow_attrs map<string,string>")
    rows = Engine(spark, {"span_links": df}, now_ns=0).query("span_links last 1h | select attr.a.b as v").primary.collect()
    assert [r["v"] for r in rows] == ['say "hi" \\ there', "plain", "7"]
